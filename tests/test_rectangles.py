import datetime
import json

import pytest
from fixtures import ARCHIVE, CARDS, CREW, GAUGES, GAUGES_XSD, HARVEST, VOYAGES

import sylva


def nodes(spark, text):
    return sylva.xml_text_to_nodes_memory(spark, text, whitespace="drop_blank")


def test_inspection(spark):
    found = sylva.inspect_xml(nodes(spark, VOYAGES))
    assert [(p.display_path, p.occurrences) for p in found.likely] == [("logbook/voyage", 3)]
    assert [p.display_path for p in found.paths if p.repeated] == ["logbook/voyage", "logbook/voyage/leg"]
    assert "logbook/voyage" in repr(found)


def test_auto_layouts(spark):
    structure = sylva.inspect_xml(nodes(spark, VOYAGES))
    assert sylva.make_rectangle(structure, "voyage").representation == "long"
    wide = sylva.make_rectangle(structure, "voyage", fields={"now": "phase", "sign": "vessel/callsign"}, identify_by="@no")
    assert (wide.representation, wide.identifier.label) == ("wide", "@no")
    table = sylva.xml_rectangle(nodes(spark, VOYAGES), wide).orderBy("record_index").collect()
    assert [(r.record_id, r.now, r.sign) for r in table] == [("V17", "under way", "07QX"), ("V18", "moored", "0044"), ("V19", "moored", "9LM")]
    with pytest.raises(sylva.XmlStructureError, match="flatten"):
        sylva.make_rectangle(structure, "voyage", representation="wide")


def test_missing_values_are_null(spark):
    spec = sylva.make_rectangle(sylva.inspect_xml(nodes(spark, VOYAGES)), "voyage", fields=["tonnage"])
    assert [r["vessel_tonnage"] for r in sylva.xml_rectangle(nodes(spark, VOYAGES), spec).orderBy("record_index").collect()] == ["512", None, "88"]


def test_independent_repeats_stay_apart(spark):
    spec = sylva.make_rectangle(sylva.inspect_xml(nodes(spark, HARVEST)), "plot")
    rows = sylva.xml_rectangle(nodes(spark, HARVEST), spec).orderBy("source_node_id").collect()
    assert [(r.entity_index, r.value) for r in rows if r.entity == "frost"] == [(1, "12"), (2, "13")]
    assert [(r.entity_index, r.value) for r in rows if r.entity == "sown/seed"] == [(1, "40"), (1, "rye"), (2, "25"), (2, "oat"), (3, "8"), (3, "flax")]


def test_namespace_tells_names_apart(spark):
    structure = sylva.inspect_xml(nodes(spark, CARDS))
    with pytest.raises(sylva.XmlStructureError, match="is ambiguous"):
        sylva.make_rectangle(structure, "card")
    assert sylva.make_rectangle(structure, "card", namespace="urn:sylva:black").record_name == "card"
    with pytest.raises(sylva.XmlStructureError, match="matches no"):
        sylva.make_rectangle(structure, "dice")


def test_identifiers(spark):
    twice = CREW.replace('badge="h3"', 'badge="h1"')
    structure = sylva.inspect_xml(nodes(spark, twice))
    assert sylva.make_rectangle(structure, "hand").identifier is None
    with pytest.raises(sylva.XmlStructureError):
        sylva.make_rectangle(structure, "hand", identify_by="@badge")
    good = sylva.make_rectangle(sylva.inspect_xml(nodes(spark, CREW)), "hand", identify_by="@badge")
    with pytest.raises(sylva.XmlStructureError, match="duplicate"):
        sylva.xml_rectangle(nodes(spark, twice), good)
    with pytest.raises(Exception, match="record id"):
        sylva.xml_rectangle(nodes(spark, twice), good, check=False).collect()


def test_new_repetition_is_refused(spark):
    spec = sylva.make_rectangle(sylva.inspect_xml(nodes(spark, CREW)), "hand", fields=["rank"])
    with pytest.raises(sylva.XmlStructureError, match="repeats in the new XML document"):
        sylva.xml_rectangle(nodes(spark, CREW.replace("<rank>cook</rank>", "<rank>cook</rank><rank>baker</rank>")), spec)


def test_types(spark):
    kinds = {"hits": "integer", "level": "double", "open": "logical", "checked": "date"}
    spec = sylva.make_rectangle(sylva.inspect_xml(nodes(spark, GAUGES)), "gauge", types=kinds)
    table = sylva.xml_rectangle(nodes(spark, GAUGES), spec).orderBy("record_index").collect()
    first, july = datetime.date(2024, 2, 29), datetime.date(2023, 7, 1)
    assert [tuple(r[c] for c in (*kinds, "plate")) for r in table] == [(41, 0.75, False, first, "01070"), (-3, 6.0, True, july, "00815"), (0, 10.0, True, july, "10007")]
    broken = GAUGES.replace("<hits>-3<", "<hits>few<")
    with pytest.raises(sylva.XmlTypeError) as found:
        sylva.xml_rectangle(nodes(spark, broken), spec)
    assert (found.value.source, found.value.output_name, found.value.declared_type, found.value.value) == ("hits", "hits", "integer", "few")
    with pytest.raises(Exception, match="not integer"):
        sylva.xml_rectangle(nodes(spark, broken), spec, check=False).collect()


@pytest.mark.parametrize("value", ["2147483648", "-2147483648", "1.0", "", " x"])
def test_integers_that_do_not_fit(spark, value):
    with pytest.raises(sylva.XmlTypeError):
        sylva.make_rectangle(sylva.inspect_xml(nodes(spark, f'<r><a id="1"><v k="{value}"/></a><a id="2"/></r>')), "a", fields={"v": "v/@k"}, types={"v": "integer"})


def test_profiles(spark, tmp_path):
    profile = sylva.xml_profile("voyage", "@no", {"now": "phase"})
    for name in ("p.json", "p.yaml"):
        path = sylva.write_xml_profile(profile, str(tmp_path / name))
        assert sylva.read_xml_profile(path) == profile
        with pytest.raises(sylva.XmlProfileError):
            sylva.write_xml_profile(profile, path)
    assert sylva.xml_rectangle(nodes(spark, VOYAGES), profile).count() == 3
    with pytest.raises(sylva.XmlProfileError, match="rows"):
        sylva.compile_xml_profile(spark, sylva.xml_profile("nothing"), nodes(spark, VOYAGES))


@pytest.mark.parametrize("bad", [{}, {"rows": "a", "more": 1}, {"rows": "a", "version": 2}, {"rows": "a", "layout": "tall"}, {"rows": "a", "types": {"x": "decimal"}}, {"rows": "a", "id": True}, {"rows": "a", "fields": ["x", "x"]}, []])
def test_strict_profiles(bad):
    with pytest.raises(sylva.XmlProfileError):
        sylva.as_xml_profile(bad)


def test_profile_with_repeated_names(tmp_path):
    (tmp_path / "p.json").write_text('{"rows": "a", "rows": "b"}')
    with pytest.raises(sylva.XmlProfileError, match="unique"):
        sylva.read_xml_profile(str(tmp_path / "p.json"))
    assert json.loads((tmp_path / "p.json").read_text())["rows"] == "b"


def test_proposals(spark):
    found = sylva.propose_xml_profile(spark, nodes(spark, GAUGES))
    assert (found.row_selection, found.selected_rows) == ("heuristic_for_review", "gauges/gauge")
    assert [(c.source, c.priority) for c in found.id_candidates] == [("@tag", "plausible"), ("hits", "possible"), ("level", "possible"), ("plate", "possible")]
    kinds = {c.source: (c.sample_type, c.sample_confidence) for c in found.field_candidates}
    assert kinds == {"@tag": ("character", "high"), "hits": ("integer", "high"), "level": ("double", "high"), "open": ("logical", "high"), "checked": ("date", "high"), "plate": ("character", "high")}
    assert found.profile_template.fields is None
    open_ = sylva.propose_xml_profile(spark, nodes(spark, ARCHIVE))
    assert open_.row_selection == "choice_required"
    assert [(c.path, c.occurrences) for c in open_.row_candidates if c.priority == "primary"] == [("archive/shelf/map", 3), ("archive/box/letter", 2)]
    with pytest.raises(TypeError):
        sylva.xml_rectangle(nodes(spark, GAUGES), found)


def test_xsd(spark, tmp_path):
    (tmp_path / "g.xsd").write_text(GAUGES_XSD)
    found = sylva.inspect_xsd(str(tmp_path / "g.xsd"))
    by = {d.selector: d for d in found.declarations}
    assert found.target_namespace == "urn:sylva:gauges"
    assert by["gauges/gauge"].repeated
    assert (by["gauges/gauge/hits"].analytical_type, by["gauges/gauge/open"].required) == ("integer", False)
    assert [(by[f"gauges/gauge/@{a}"].required, by[f"gauges/gauge/@{a}"].min_occurs) for a in ("tag", "note")] == [(True, "0"), (False, "0")]
    assert by["gauges/gauge/plate"].type_source == "inline_restriction"
    assert by["gauges/gauge/maker"].analytical_type is None
    proposal = sylva.propose_xml_profile(spark, nodes(spark, GAUGES), xsd=found)
    assert proposal.row_candidates[0].evidence == "sample+xsd"
    assert {c.source: c.xsd_analytical_type for c in proposal.field_candidates}["checked"] == "date"
    assert sylva.review_xml_proposal(spark, proposal, "xsd").count() == len(found.declarations)
    (tmp_path / "x.xsd").write_text("<a/>")
    with pytest.raises(sylva.XmlProposalError):
        sylva.inspect_xsd(str(tmp_path / "x.xsd"))
    (tmp_path / "y.xsd").write_text("<a>")
    with pytest.raises(sylva.XmlParseError):
        sylva.inspect_xsd(str(tmp_path / "y.xsd"))


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_partitions_change_nothing(spark, partitions):
    base = nodes(spark, VOYAGES)
    spec = sylva.make_rectangle(sylva.inspect_xml(base), "voyage")
    expected = sorted(map(str, sylva.xml_rectangle(base, spec).collect()))
    assert sorted(map(str, sylva.xml_rectangle(base.repartition(partitions), spec, parallel="auto", workers=2).collect())) == expected


def test_sinks_and_streams(spark, tmp_path):
    source = tmp_path / "crew.xml"
    source.write_text(CREW)
    spec = sylva.rectangle_spec(spark, str(source), "hand", types={"since": "date"}, identify_by="@badge")
    long = sylva.rectangle_spec(spark, str(source), "hand", identify_by=False, representation="long")
    stats = sylva.rectangle_xml_csv(spark, str(source), spec, str(tmp_path / "o.csv"))
    lines = (tmp_path / "o.csv").read_text().splitlines()
    assert (stats["result_rows"], stats["record_count"], len(lines)) == (3, 3, 4)
    assert lines[1] == '"crew.xml",1,"h1",3,"h1","mate",2011-05-02'
    with pytest.raises(FileExistsError):
        sylva.rectangle_xml_csv(spark, str(source), spec, str(tmp_path / "o.csv"))
    with pytest.raises(ValueError, match="replace the input"):
        sylva.rectangle_xml_csv(spark, str(source), spec, str(source), overwrite=True)
    before = (tmp_path / "o.csv").read_bytes()
    source.write_text(CREW.replace("2011-05-02", "long ago"))
    with pytest.raises(sylva.XmlTypeError):
        sylva.rectangle_xml_csv(spark, str(source), spec, str(tmp_path / "o.csv"), overwrite=True)
    assert (tmp_path / "o.csv").read_bytes() == before
    source.write_text("<crew/>")
    with pytest.raises(sylva.XmlStructureError, match="crew/hand"):
        sylva.rectangle_xml_parquet(spark, str(source), spec, str(tmp_path / "parts"))
    source.write_text("<crew><hand/></crew>")
    assert sylva.rectangle_xml_csv(spark, str(source), long, str(tmp_path / "none.csv"))["result_rows"] == 0
    assert len((tmp_path / "none.csv").read_text().splitlines()) == 1
    assert sylva.rectangle_xml_parquet(spark, str(source), long, str(tmp_path / "parts"))["output_parts"] == 1
    assert spark.read.parquet(str(tmp_path / "parts")).columns == sylva.schema.LONG_COLUMNS
    source.write_text(CREW)
    stats = sylva.rectangle_xml_parquet(spark, str(source), spec, str(tmp_path / "parts"), overwrite=True, batch_rows=1)
    assert sorted(p.name for p in (tmp_path / "parts").glob("*.parquet")) == [f"part-00000{i}.parquet" for i in (1, 2, 3)]
    seen = []
    stats = sylva.xml_stream_rectangle(spark, str(source), spec, seen.append, batch_rows=1)
    assert (stats["result_chunks"], [len(f) for f in seen]) == (3, [1, 1, 1])
    with pytest.raises(sylva.XmlProfileError):
        sylva.xml_stream_rectangle(spark, str(source), sylva.xml_profile("hand"), seen.append)

import re

import pytest
from fixtures import CARDS, GAUGES, HARVEST, MUSEUM, VOYAGES

import sylva
from sylva.operators import analyst
from sylva.plans import queries
from sylva.sources import plain
from sylva.sources.nodes import parsed_nodes


def made(spark, text, **how):
    how = {"include_misc": False} | how
    return sylva.xml_analyst_table(sylva.xml_text_to_nodes_memory(spark, text, whitespace="drop_blank"), **how)


def entity(table, name):
    return table.table.where(f"xml_entity = '{name}'").orderBy("xml_node_id").collect()


def test_one_atomic_table(spark):
    found = made(spark, MUSEUM, include_misc=True)
    rows = found.table.orderBy("xml_node_id").collect()
    assert [r.xml_entity for r in rows] == ["museum", "xml_misc", "exhibit", "exhibit", "exhibit", "guard", "guard"]
    assert not any(kind.startswith(("array", "map", "struct")) for _, kind in found.table.dtypes)
    exhibits = entity(found, "exhibit")
    assert {(r.museum__wing__attr_floor, r.museum__wing__attr_label) for r in exhibits} == {("2", "")}
    assert (exhibits[0].exhibit__caption__text_content, exhibits[0].exhibit__caption__i, exhibits[0].exhibit__loaned__present) == ("Amber bee in resin", "bee", True)
    assert (exhibits[1].exhibit__caption__text_content, exhibits[1].exhibit__loaned__present) == (None, None)
    assert [(r.guard__attr_shift, r.guard__radio) for r in entity(found, "guard")] == [("late", 5), ("early", 6)]
    assert (rows[1].xml_misc__type, rows[1].xml_misc__value) == ("comment", "closed on Mondays")
    audit = found.audit()
    assert audit["canonical_attributes"] == audit["projected_attributes"] == 8
    assert audit["canonical_text_nodes"] == audit["projected_text_nodes"] == 8
    assert audit["expected_entity_rows"] == audit["emitted_entity_rows"] == 6


def test_independent_branches(spark):
    found = made(spark, HARVEST)
    assert sorted(r.xml_entity for r in found.table.collect()) == ["farm", "frost", "frost", "seed", "seed", "seed"]
    assert [(r.seed__attr_kg, r.seed__value, r.farm__plot__attr_code) for r in entity(found, "seed")] == [(40, "rye", "N4"), (25, "oat", "N4"), (8, "flax", "N4")]
    assert [r.frost__attr_day for r in entity(found, "frost")] == [12, 13]


def test_context_is_one_hop_and_expands(spark):
    text = '<isle name="Unst"><glen name="Dale"><croft no="a"/><croft no="b"/><croft no="c"/></glen><glen name="Wick"><croft no="d"/><croft no="e"/></glen></isle>'
    found = made(spark, text)
    croft = entity(found, "croft")
    assert [r.glen__attr_name for r in croft] == ["Dale"] * 3 + ["Wick"] * 2
    assert all(r.isle__attr_name is None for r in croft)
    wide = sylva.xml_analyst_expand_context(found, "croft").orderBy("xml_node_id").collect()
    assert [(r.isle__attr_name, r.croft__attr_no) for r in wide] == [("Unst", x) for x in "abcde"]
    assert all(r.isle__attr_name is None for r in sylva.xml_analyst_expand_context(found, "croft", levels=1).collect())


def test_subtree_text_stays_with_its_owner(spark):
    found = made(spark, "<tale>once <part><verse n='1'>a king</verse><verse n='2'> and a cat</verse></part> met</tale>")
    assert entity(found, "tale")[0].tale__text_content == "once a king and a cat met"
    assert all(r.tale__text_content is None for r in entity(found, "verse"))


def test_amplification(spark):
    row = made(spark, '<yard><lot mark="QQ"><crate>1</crate><crate>2</crate><crate>3</crate></lot></yard>').amplification().where("column = 'yard__lot__attr_mark'").collect()[0]
    assert (row.field_kind, row.owner_rows, row.emitted_rows, row.context_rows, row.owner_bytes, row.emitted_bytes, row.max_propagation_depth) == ("attribute", 1, 4, 3, 2, 8, 2)


def test_types(spark):
    kinds = dict(made(spark, GAUGES).table.dtypes)
    assert [kinds[f"gauge__{c}"] for c in ("hits", "level", "open", "checked", "plate")] == ["int", "double", "boolean", "date", "string"]
    assert dict(made(spark, GAUGES, infer_types=False).table.dtypes)["gauge__hits"] == "string"


def test_namespaces(spark):
    found = made(spark, CARDS)
    assert found.table.count() == 1
    assert {"deck__card", "deck__r_card", "deck__k_card", "deck__r_card__attr_k_marked"} <= set(found.table.columns)
    assert found.namespaces == "(default)=urn:sylva:plain; k=urn:sylva:black; r=urn:sylva:red"


def test_default_namespace_stays_readable(spark):
    columns = made(spark, '<sky xmlns="urn:sylva:sky" xmlns:q="urn:sylva:q" q:seen="by night"><star q:hue="blue">Vega</star></sky>').table.columns
    assert {"sky__attr_q_seen", "sky__star", "sky__star__attr_q_hue"} <= set(columns)


def two(name, first, second):
    return f"<all><{name}>{first}</{name}><{name}>{second}</{name}></all>"


# What identifies a record: an identifier's name at the record or one step below it, unique among the records, not a flag.
@pytest.mark.parametrize(
    ("text", "name", "column", "values"),
    [
        (VOYAGES, "voyage", None, [None] * 3),
        (VOYAGES.replace(" no=", " id="), "voyage", "voyage__attr_id", ["V17", "V18", "V19"]),
        (two("whale", "<uuid>w-9</uuid>", "<uuid>w-8</uuid>"), "whale", "whale__uuid", ["w-9", "w-8"]),
        (two("whale", "<uuid>w-9</uuid>", "<uuid>w-9</uuid>"), "whale", None, [None, None]),
        (two("whale", '<guid value="1-a"/>', '<guid value="1-b"/>'), "whale", "whale__guid__attr_value", ["1-a", "1-b"]),
        (two("whale", '<pod addr="n4"/>', '<pod addr="n5"/>'), "whale", "whale__pod__attr_addr", ["n4", "n5"]),
        (two("whale", "<whaleId>7a</whaleId><podId>x</podId>", "<whaleId>7b</whaleId><podId>y</podId>"), "whale", "whale__whaleId", ["7a", "7b"]),
        (two("whale", "<whaleId>7a</whaleId><about>Moby</about>", "<whaleId>7b</whaleId><about>Keiko</about>"), "whale", "whale__about", ["Moby", "Keiko"]),
        (two("whale", "<tooth><uuid>t1</uuid></tooth>", "<tooth><uuid>t2</uuid></tooth>"), "whale", None, [None, None]),
        (two("whale", "<rapid>yes</rapid><link>l1</link>", "<rapid>no</rapid><link>l2</link>"), "whale", None, [None, None]),
        (two("whale", "<record_reference>r1</record_reference>", "<record_reference>r2</record_reference>"), "whale", None, [None, None]),
        (two("whale", "<uuid> TRUE</uuid>", "<uuid>false </uuid>"), "whale", None, [None, None]),
        (two("whale", "<guid>only</guid>", "<sound>low</sound>"), "whale", "whale__guid", ["only", None]),
    ],
)
def test_source_keys(spark, text, name, column, values):
    found = entity(made(spark, text), name)
    assert [r.xml_key_value for r in found] == values
    assert {r.xml_key_column for r in found if r.xml_key_value} == ({column} if column else set())


def test_alternating_siblings_are_entities(spark):
    found = made(spark, "<q><day>mon</day><rain>1</rain><day>tue</day><sun>2</sun></q>")
    assert {r.xml_entity for r in found.table.collect()} == {"q", "day", "rain", "sun"}


def test_files(spark, tmp_path):
    (tmp_path / "c.xml").write_text(MUSEUM)
    sylva.rectangle_xml_analyst_csv(spark, str(tmp_path / "c.xml"), str(tmp_path / "new" / "c.csv"), include_misc=False)
    text = (tmp_path / "new" / "c.csv").read_text()
    assert "\\N" in text
    assert '""' in text
    found = sylva.rectangle_xml_analyst_parquet(spark, str(tmp_path / "c.xml"), str(tmp_path / "c.parquet"))
    assert (tmp_path / "c.parquet").is_file()
    assert spark.read.parquet(str(tmp_path / "c.parquet")).dtypes == found.table.dtypes
    (tmp_path / "n.xml").write_text("<jar><lid>\\N</lid></jar>")
    with pytest.raises(ValueError, match="occurs as genuine source data"):
        sylva.rectangle_xml_analyst_csv(spark, str(tmp_path / "n.xml"), str(tmp_path / "n.csv"))
    assert not (tmp_path / "n.csv").exists()


def test_nodes_are_kept_in_the_shared_folder(spark):
    """Nodes and fields are tables there, not caches; release() deletes them."""
    spark.catalog.clearCache()
    made = sylva.xml_analyst_table(sylva.xml_text_to_nodes_memory(spark, VOYAGES))
    assert made.table.count() and spark._jsparkSession.sharedState().cacheManager().isEmpty()
    assert [p.name for p in made._kept.children()] == ["fields", "nodes"]
    made.release()
    assert not made._kept.exists()


def bare(text):
    """Without a declaration and comments, of no namespace."""
    return re.sub(r' xmlns="[^"]*"|<[?]xml[^>]*>|<!--.*?-->', "", text)


PLAIN = [
    bare(VOYAGES),
    bare(GAUGES),
    bare(HARVEST),
    '<isle name="Unst"><glen name="Dale"><croft no="a"/><croft no="b"/><croft no="c"/></glen><glen name="Wick"><croft no="d"/><croft no="e"/></glen></isle>',
    "<q><day>mon</day><rain>1</rain><day>tue</day><sun>2</sun></q>",
    '<log>\n <on id="+1" at="x &amp; &lt;y&gt;">5</on >\n <on id="1"><far><deep a="1" b = "">é &quot; &apos;</deep></far></on>\n <on id="3"/><on  id="4" ><flag/><note> </note></on></log>',
    two("whale", "<uuid>w-9</uuid>", "<uuid>w-9</uuid>"),
    two("whale", "<whaleId>7</whaleId><whaleCode>x</whaleCode>", "<whaleId>8</whaleId><whaleCode>1</whaleCode>"),
    "<a/>",
]
OTHER = [VOYAGES, MUSEUM, CARDS, "<tale>once <part><verse n='1'>a king</verse></part> met</tale>", "<a b='1'/>", "<a><![CDATA[x]]></a>"]


def shown(made):
    names = made.table.columns
    return names, made.table.dtypes, sorted(map(str, made.table.select(*sorted(names)).collect())), made.entity_paths, made.key_columns, [(c.entity_path, c.signature, c.kinds, c.columns) for c in made.column_sources]


@pytest.mark.parametrize("texts", [*([t] for t in PLAIN), PLAIN[:3], PLAIN[3:6], *([t] for t in OTHER), [PLAIN[0], OTHER[0]]])
@pytest.mark.parametrize("whitespace", ["drop_blank", "preserve"])
def test_plain_documents_give_the_table_of_their_nodes(spark, texts, whitespace):
    sources = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "document_id string, content string")
    found = analyst.xml_analyst_sources(sources, whitespace)
    assert shown(found) == shown(sylva.xml_analyst_table(parsed_nodes(sources, whitespace)))
    if whitespace == "drop_blank":
        assert isinstance(found, analyst.PlainAnalystTable) == all(t in PLAIN for t in texts)


def test_plain_documents_in_small_pieces(monkeypatch):
    text = PLAIN[5].encode()
    whole = plain.PlainDocument(text, True)
    monkeypatch.setattr(plain, "BYTES", 20)
    parts = plain.PlainDocument(text, True)

    def fields(d):
        return [(p, n, x, e.tolist(), i.tolist(), v if v is None else v.to_pylist()) for p, n, x, e, i, v in d.fields()]

    key = lambda f: (f[:3], sorted(zip(*(f[3:5] if f[5] is None else f[3:]), strict=True)))
    assert list(map(key, fields(parts))) == list(map(key, fields(whole)))


def test_plain_documents_need_no_nodes(spark):
    """Of orders, only their texts and what is in them are kept: no row for each node."""
    made = queries.analyst(spark, queries.order_documents(spark, "/root/testdata/sf0.001"), include_misc=False)
    assert [p.name for p in made._kept.children()] == ["facts", "sources"]
    assert made.table.where("xml_entity = 'order'").count() == made.entity_paths["orders", "order"]
    assert made.audit()["emitted_entity_rows"] == made.table.count()


@pytest.mark.parametrize("text", ["<a><b></a>", "<a>&none;</a>", "<a", "", "<a/><b/>", '<a b="1" b="2"/>'])
def test_what_is_not_well_formed_is_an_error_still(spark, text):
    with pytest.raises(Exception, match="Could not parse XML source"):
        analyst.xml_analyst_sources(spark.createDataFrame([("d", text)], "document_id string, content string")).table.collect()

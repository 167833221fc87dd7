from collections import Counter

import pandas as pd
import pytest
from fixtures import ARCHIVE, CARDS, CREW, GAUGES, HARVEST, MISC, MIXED, MUSEUM, VOYAGES
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import sylva
from sylva.schema import NODES
from sylva.sources.nodes import ordered_parts, parsed_nodes, with_paths
from sylva.sources.parse import parse_document


def rows(spark, text, whitespace="drop_blank"):
    return sylva.xml_text_to_nodes_memory(spark, text, whitespace=whitespace).orderBy("node_id").collect()


def test_schema_and_keys(spark):
    nodes = sylva.xml_text_to_nodes_memory(spark, VOYAGES)
    assert nodes.schema == NODES
    found = nodes.orderBy("node_id").collect()
    assert [r.node_id for r in found] == [r.node_order for r in found] == list(range(1, len(found) + 1))
    assert [r.parent_id for r in found if r.node_type == "document"] == [None]
    assert sylva.xml_nodes_schema(spark).count() == 0


def test_mixed_content_and_order(spark):
    kinds = [(r.node_type, r.value) for r in rows(spark, MIXED)]
    assert kinds == [
        ("document", None), ("element", None), ("element", None), ("text", "Mind "), ("element", None), ("attribute", "2"), ("text", "the"),
        ("text", " gap & the step."), ("cdata", "x > y"), ("comment", "draft"), ("pi", "twice"),
    ]


def test_document_level_nodes(spark):
    top = [r for r in rows(spark, MISC) if r.parent_id == 1]
    assert [(r.sibling_order, r.node_type, r.value) for r in top] == [(1, "pi", "plain"), (2, "pi", "bold"), (3, "comment", "top"), (4, "element", None), (5, "comment", "foot")]


def test_whitespace_policies(spark):
    text = "<a>\n <b> x </b>\n <![CDATA[ ]]></a>"
    assert Counter(r.node_type for r in rows(spark, text)) == {"document": 1, "element": 2, "text": 1, "cdata": 1}
    assert Counter(r.node_type for r in rows(spark, text, "preserve"))["text"] == 3
    with pytest.raises(ValueError):
        sylva.xml_text_to_nodes_memory(spark, text, whitespace="trim")


def test_namespaces_by_uri(spark):
    found = [(r.qualified_name, r.namespace_uri, r.prefix) for r in rows(spark, CARDS) if r.local_name in ("card", "worn")]
    assert found == [("k:card", "urn:sylva:black", "k"), ("r:worn", "urn:sylva:red", "r"), ("card", "urn:sylva:plain", ""), ("r:card", "urn:sylva:red", "r"), ("r:worn", "urn:sylva:red", "r")]


def test_doctype_defaults_and_references(spark):
    text = '<!DOCTYPE r [<!ATTLIST r k CDATA "v"><!ENTITY e "in">]><r a="&#38;&#x1F642;">&e;side</r>'
    found = rows(spark, text)
    assert [(r.node_type, r.value) for r in found] == [("document", None), ("element", None), ("attribute", "&🙂"), ("text", "inside")]


@pytest.mark.parametrize("text", ["<a><b></a>", "<a>&nothing;</a>", '<!DOCTYPE r SYSTEM "x.dtd"><r>&lost;</r>', '<!DOCTYPE r [<!ENTITY e SYSTEM "file:///etc/passwd">]><r>&e;</r>'])
def test_malformed_is_an_error(text):
    with pytest.raises(sylva.XmlParseError) as found:
        list(parse_document("doc", text))
    assert found.value.source == "doc"


def test_malformed_documents_can_be_dropped(spark):
    sources = spark.createDataFrame([("good", "<a/>"), ("bad", "<a>"), ("none", None)], "document_id string, content string")
    assert {r.document_id for r in parsed_nodes(sources, malformed="drop").collect()} == {"good"}


@pytest.mark.parametrize("batch_rows", [1, 3, 10_000])
def test_batches_change_nothing(spark, batch_rows):
    sources = spark.createDataFrame([(str(i), x) for i, x in enumerate([VOYAGES, MIXED, CARDS, MISC])], "document_id string, content string")
    expected = sorted(map(str, parsed_nodes(sources).collect()))
    assert sorted(map(str, parsed_nodes(sources.repartition(3), batch_rows=batch_rows).collect())) == expected


@pytest.mark.parametrize("text", [VOYAGES, CREW, HARVEST, MIXED, CARDS, MISC, GAUGES, ARCHIVE, MUSEUM])
def test_window_paths_equal_kernel_paths(spark, text):
    sources = spark.createDataFrame([("d", text)], "document_id string, content string")
    parsed = parsed_nodes(sources, "drop_blank")
    assert with_paths(parsed.select(*NODES.names)).orderBy("node_id").collect() == parsed.orderBy("node_id").collect()
    sylva.validate_xml_nodes(parsed.select(*NODES.names))


def test_files_and_streams(spark, tmp_path):
    (tmp_path / "one+two.xml").write_text(VOYAGES)
    nodes = sylva.xml_to_nodes_memory(spark, str(tmp_path / "one+two.xml"))
    assert nodes.select("document_id").distinct().collect()[0][0] == "one+two.xml"
    seen = []
    stats = sylva.xml_stream_nodes(spark, str(tmp_path), seen.append, chunk_rows=5)
    assert pd.concat(seen).node_id.tolist() == list(range(1, nodes.count() + 1))
    assert stats == {"document_id": "one+two.xml", "node_count": nodes.count(), "chunk_count": len(seen)}

    def fail(_):
        raise KeyError("mine")

    with pytest.raises(sylva.XmlCallbackError) as found:
        sylva.xml_stream_nodes(spark, str(tmp_path), fail)
    assert isinstance(found.value.__cause__, KeyError)


def test_streams_reach_the_driver_in_parts(spark, tmp_path):
    """One document of 302 nodes, and two in a partition: never more than 50 rows at once, in order."""
    text = "<r>" + "<a>x</a>" * 150 + "</r>"
    for name in ("a", "b"):
        (tmp_path / f"{name}.xml").write_text(text)
    one = sylva.xml_to_nodes_memory(spark, str(tmp_path / "a.xml"))
    parts = list(ordered_parts(spark, one, several=False, most=50))
    assert max(map(len, parts)) <= 50
    assert [row[1] for p in parts for row in p] == list(range(1, one.count() + 1))
    both = sylva.xml_to_nodes_memory(spark, str(tmp_path)).coalesce(1)
    parts = list(ordered_parts(spark, both, most=50))
    assert max(map(len, parts)) <= 50
    assert [row[:2] for p in parts for row in p] == [(d, n) for d in ("a.xml", "b.xml") for n in range(1, one.count() + 1)]


@pytest.mark.parametrize(
    ("change", "message"),
    [
        (lambda n: n.withColumn("parent_id", F.when(F.col("node_id") == 5, 99).otherwise(F.col("parent_id"))), "missing parent"),
        (lambda n: n.where("node_id != 4"), "without gaps"),
        (lambda n: n.withColumn("depth", F.when(F.col("node_id") == 3, 9).otherwise(F.col("depth"))), "depth"),
        (lambda n: n.withColumn("value", F.when(F.col("node_type") == "element", "x").otherwise(F.col("value"))), "no value"),
        (lambda n: n.unionByName(n.limit(1)), "twice"),
        (lambda n: n.drop("value"), "lacks columns"),
    ],
)
def test_validator_finds(spark, change, message):
    with pytest.raises(sylva.XmlNodesError, match=message):
        sylva.validate_xml_nodes(change(sylva.xml_text_to_nodes_memory(spark, CREW)))


def test_children(spark):
    nodes = sylva.xml_text_to_nodes_memory(spark, CREW)
    assert [r.local_name for r in sylva.xml_node_children(nodes, 3, include_attributes=True).collect()] == ["badge", "rank", "since"]
    assert sylva.xml_node_children(nodes, 3).count() == 2
    with pytest.raises(sylva.XmlNodesError):
        sylva.xml_node_children(nodes, 999)
    with pytest.raises(sylva.XmlNodesError):
        sylva.xml_node_children(nodes.unionByName(sylva.xml_text_to_nodes_memory(spark, CREW, "other")), 3)


TREES = st.recursive(st.sampled_from(["", "text", "<!--c-->", "<![CDATA[d]]>"]), lambda x: st.builds(lambda n, k, inner: f'<{n} a="{k}">{"".join(inner)}</{n}>', st.sampled_from("abc"), st.integers(0, 3), st.lists(x, max_size=4)), max_leaves=12)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TREES, max_size=4))
def test_random_trees(spark, inner):
    text = f"<r>{''.join(inner)}</r>"
    sources = spark.createDataFrame([("d", text)], "document_id string, content string")
    parsed = parsed_nodes(sources, "preserve")
    assert with_paths(parsed.select(*NODES.names)).orderBy("node_id").collect() == parsed.orderBy("node_id").collect()
    sylva.validate_xml_nodes(parsed.select(*NODES.names))

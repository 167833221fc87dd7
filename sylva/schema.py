"""The fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


# Names, order, types and nulls of the canonical table's columns.
#: The canonical node table.
NODES = T.StructType(
    [
        T.StructField("document_id", T.StringType(), False),
        T.StructField("node_id", T.IntegerType(), False),
        T.StructField("parent_id", T.IntegerType()),
        T.StructField("node_order", T.IntegerType(), False),
        T.StructField("sibling_order", T.IntegerType()),
        T.StructField("depth", T.IntegerType(), False),
        T.StructField("node_type", T.StringType(), False),
        T.StructField("qualified_name", T.StringType()),
        T.StructField("local_name", T.StringType()),
        T.StructField("prefix", T.StringType()),
        T.StructField("namespace_uri", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

#: What the parse kernel adds, so that no later step has to walk the tree: the expanded names of the elements from the
#: root to the owning element (of an element: itself), their ids, and an element's number among its equals.
PATH_COLUMNS = T.StructType(
    [
        T.StructField("path", T.ArrayType(T.StringType())),
        T.StructField("anc_ids", T.ArrayType(T.IntegerType())),
        T.StructField("sibling_occurrence", T.IntegerType()),
    ]
)

PARSED = T.StructType(NODES.fields + PATH_COLUMNS.fields)

# The columns of rectangles and analyst tables.
LONG_COLUMNS = [
    "document_id", "record_index", "record_id", "entity", "entity_index", "field", "value_index", "value", "value_kind",
    "source", "record_node_id", "entity_node_id", "parent_entity_node_id", "source_node_id", "source_path",
]

WIDE_COLUMNS = ["document_id", "record_index", "record_id", "record_node_id"]

ANALYST_COLUMNS = [
    "xml_document_id", "xml_entity", "xml_entity_id", "xml_parent_entity", "xml_parent_entity_id", "xml_occurrence", "xml_node_id",
    "xml_parent_node_id", "xml_depth", "xml_source_path", "xml_namespace_uri", "xml_key_column", "xml_key_value", "xml_namespaces",
]

#: Kinds of nodes that have names.
NAMED = ("element", "attribute", "pi")
#: Kinds of nodes whose values are data.
VALUES = ("attribute", "text", "cdata")


def xml_nodes_schema(spark: SparkSession) -> DataFrame:
    """An empty canonical table."""
    return spark.createDataFrame([], NODES)

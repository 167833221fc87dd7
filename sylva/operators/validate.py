"""The canonical contract as queries, and navigation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import XmlNodesError
from ..schema import NAMED, NODES


def violations(nodes: DataFrame) -> DataFrame:
    """number, message, document_id, node_id of every broken rule. One pass by document and one join with the parents."""
    by_document = Window.partitionBy("document_id").orderBy("node_id")
    parent = nodes.select("document_id", F.col("node_id").alias("parent_id"), F.col("depth").alias("p_depth"), F.col("node_type").alias("p_type"), F.lit(True).alias("found")).dropDuplicates(["document_id", "parent_id"]).hint("merge")  # Spark takes what a kernel returns for as small as its documents
    siblings = Window.partitionBy("document_id", "parent_id", F.col("node_type") == "attribute")
    rows = nodes.withColumn("seat", F.row_number().over(by_document)).withColumn("copies", F.count("*").over(Window.partitionBy("document_id", "node_id")))
    rows = rows.withColumn("roots", F.sum(F.when(F.col("node_type") == "document", 1).otherwise(0)).over(Window.partitionBy("document_id")))
    rows = rows.withColumn("rank", F.row_number().over(siblings.orderBy("node_order")))
    rows = rows.join(parent, ["document_id", "parent_id"], "left")
    kind, attribute = F.col("node_type"), F.col("node_type") == "attribute"
    root = kind == "document"
    rules = [
        (F.coalesce(F.col("document_id"), F.lit("")) == "", "document_id must not be empty"),
        (F.col("node_id").isNull() | (F.col("node_id") < 1), "node_id must be positive"),
        (F.col("copies") > 1, "node_id occurs twice in a document"),
        (F.col("node_id") != F.col("seat"), "node_id must run from 1 without gaps"),
        (~F.col("node_order").eqNullSafe(F.col("node_id")), "node_order must equal the row's place in the document"),
        (F.col("roots") != 1, "a document needs exactly one document node"),
        (root & (F.col("parent_id").isNotNull() | (F.col("depth") != 0)), "the document node has no parent and depth 0"),
        (~root & F.col("parent_id").isNull(), "a node other than the document has no parent"),
        (F.col("parent_id").isNotNull() & F.col("found").isNull(), "a node references a missing parent"),
        (F.col("parent_id") >= F.col("node_id"), "a parent must come before its children"),
        (F.col("depth") != F.col("p_depth") + 1, "depth must be the parent's plus 1"),
        (attribute & (F.col("p_type") != "element"), "an attribute's owner must be an element"),
        (attribute & F.col("sibling_order").isNotNull(), "an attribute has no sibling_order"),
        (~attribute & ~root & (F.col("sibling_order").isNull() | (F.col("sibling_order") < 1)), "content needs a positive sibling_order"),
        (~attribute & ~root & (F.col("sibling_order") != F.col("rank")), "sibling_order must run from 1 without gaps"),
        (kind.isin(*NAMED) & (F.coalesce(F.col("qualified_name"), F.lit("")) == ""), "elements, attributes and processing instructions need names"),
        (kind.isin("document", "element") & F.col("value").isNotNull(), "document and element nodes have no value"),
    ]
    broken = F.array(*(F.when(rule, F.struct(F.lit(i).alias("number"), F.lit(message).alias("message"))) for i, (rule, message) in enumerate(rules, 1)))
    out = rows.select("document_id", "node_id", F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("x"))
    return out.select("x.number", "x.message", "document_id", "node_id")


def validate_xml_nodes(nodes: DataFrame) -> DataFrame:
    """nodes, or XmlNodesError for the first rule that is broken. An empty table is valid."""
    if not isinstance(nodes, DataFrame):
        raise XmlNodesError("nodes must be a DataFrame")
    missing = [c for c in NODES.names if c not in nodes.columns]
    if missing:
        raise XmlNodesError(f"nodes lacks columns: {', '.join(missing)}")
    wrong = [f.name for f in NODES if nodes.schema[f.name].dataType != f.dataType]
    if wrong:
        raise XmlNodesError(f"columns of a wrong type: {', '.join(wrong)}")
    first = violations(nodes).orderBy("number", "document_id", "node_id").limit(1).collect()
    if first:
        raise XmlNodesError(f"{first[0].message} (document '{first[0].document_id}', node {first[0].node_id})")
    return nodes


def xml_node_children(nodes: DataFrame, node_id: int, document_id: str | None = None, include_attributes: bool = False) -> DataFrame:
    """The children of a node in order; its attributes before them if wanted."""
    if document_id is None:
        found = nodes.select("document_id").distinct().limit(2).collect()
        if len(found) > 1:
            raise XmlNodesError("document_id is needed: the table holds several documents")
        document_id = found[0].document_id if found else ""
    own = nodes.where(F.col("document_id") == document_id)
    if not own.where(F.col("node_id") == node_id).limit(1).collect():
        raise XmlNodesError(f"node {node_id} is not in document '{document_id}'")
    out = own.where(F.col("parent_id") == node_id)
    if not include_attributes:
        out = out.where("node_type != 'attribute'")
    return out.orderBy(F.col("node_type") != "attribute", F.col("sibling_order").asc_nulls_last(), "node_order")

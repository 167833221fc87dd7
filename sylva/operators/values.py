"""Values of records: from the node table to long rows, in one pass over each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import KEY_SEPARATOR, locals_column, path_key_column
from ..schema import VALUES
from ..sources.nodes import with_paths


def _literal(path: tuple[str, ...] | list[str]) -> Column:
    return F.array(*map(F.lit, path))


def _last_entity(upto: Column, record: int) -> Column:
    """The depth of the deepest entity path that a path of that depth has; the record's own if none."""
    depths = F.sequence(F.lit(record), F.greatest(upto, F.lit(record)))
    inside = F.filter(depths, lambda d: (d == record) | F.array_contains(F.col("entities"), F.slice("path", F.lit(1), d)))
    return F.element_at(inside, -1)


def _joined(parts: Column) -> Column:
    text = F.array_join(parts, "/")
    return F.when(text == "", "value").otherwise(text)


def owned_nodes(nodes: DataFrame, record: tuple[str, ...], entities: list[tuple[str, ...]]) -> DataFrame:
    """The nodes inside records, with record_index, record_node_id, entity_depth, entity_node_id, entity_index, parent_entity_node_id.

    Entities are the declared paths and, in each document, those that repeat there inside the record path. All windows
    are within a document, so its nodes are shuffled once.
    """
    n = len(record)
    rows = with_paths(nodes).withColumn("inside", F.coalesce(F.slice("path", 1, n) == _literal(record), F.lit(False)))
    element = F.col("node_type") == "element"
    document = Window.partitionBy("document_id")
    found = F.collect_set(F.when(F.col("inside") & element & (F.size("path") > n) & (F.col("sibling_occurrence") > 1), F.col("path"))).over(document)
    declared = F.array(*map(_literal, entities)) if entities else F.lit(None).cast("array<array<string>>")
    rows = rows.withColumn("entities", F.array_union(F.coalesce(declared, F.array().cast("array<array<string>>")), found) if entities else found)
    order = document.orderBy("node_order").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.when(F.col("inside") & element & (F.size("path") == n), 1).otherwise(0)
    rows = rows.withColumn("record_index", F.sum(starts).over(order).cast("int")).where("inside")
    rows = rows.withColumn("record_node_id", F.element_at("anc_ids", n)).withColumn("entity_depth", _last_entity(F.size("path"), n))
    rows = rows.withColumn("entity_node_id", F.element_at("anc_ids", F.col("entity_depth")))
    above = F.when(F.col("entity_depth") > n, F.element_at("anc_ids", _last_entity(F.col("entity_depth") - 1, n)))
    rows = rows.withColumn("parent_entity_node_id", above)
    entity = Window.partitionBy("document_id", "entity_node_id")
    number = F.max(F.when(F.col("node_id") == F.col("entity_node_id"), F.col("sibling_occurrence"))).over(entity)
    return rows.withColumn("entity_index", F.when(F.col("entity_depth") == n, 1).otherwise(number).cast("int"))


def labelled(owned: DataFrame, record: tuple[str, ...]) -> DataFrame:
    """owned with entity, field, source_label, source_path and source_key of the nodes that have values; null for others."""
    n = len(record)
    names = locals_column(F.col("path"))
    attribute = F.col("node_type") == "attribute"
    depth = F.col("entity_depth")
    rest = F.size("path") - depth
    name = F.when(attribute, F.array("local_name")).otherwise(F.array().cast("array<string>"))
    at = F.when(attribute, F.array(F.concat(F.lit("@"), "local_name"))).otherwise(F.array().cast("array<string>"))
    uri = F.coalesce("namespace_uri", F.lit(""))
    terminal = F.when(attribute, F.when(uri == "", F.col("local_name")).otherwise(F.concat(F.lit("{"), uri, F.lit("}"), "local_name"))).otherwise(F.concat(F.lit("#"), "node_type"))
    relative = F.slice("path", F.lit(n + 1), F.size("path") - n)
    has = F.col("node_type").isin(*VALUES)
    columns = {
        "entity": F.when(depth == n, F.element_at(names, n)).otherwise(F.array_join(F.slice(names, F.lit(n + 1), depth - n), "/")),
        "field": _joined(F.concat(F.slice(names, depth + 1, rest), name)),
        "source_label": _joined(F.concat(F.slice(names, F.lit(n + 1), F.size("path") - n), at)),
        "source_path": F.array_join(F.concat(names, at), "/"),
        "source_key": F.concat_ws(KEY_SEPARATOR, "node_type", path_key_column(relative), terminal),
    }
    return owned.select("*", *(F.when(has, c).alias(k) for k, c in columns.items()))


def long_values(nodes: DataFrame, record: tuple[str, ...], entities: list[tuple[str, ...]]) -> DataFrame:
    """Every attribute, text and CDATA value inside a record: the internal long table, with node_order."""
    rows = labelled(owned_nodes(nodes, record, entities), record).where(F.col("node_type").isin(*VALUES))
    index = Window.partitionBy("document_id", "entity_node_id", "source_key").orderBy("node_order")
    return rows.select(
        "document_id", "record_index", "record_node_id", "entity", "entity_index", "entity_node_id", "parent_entity_node_id", "field", "source_label",
        F.row_number().over(index).alias("value_index"), "value", F.col("node_type").alias("value_kind"), F.col("node_id").alias("source_node_id"), "source_path", "source_key",
        "node_order", (F.col("entity_depth") > len(record)).alias("under_repetition"),
    )


def value_catalog(values: DataFrame) -> DataFrame:
    """A row for each source: its labels where it is first seen, the records that have it, the most values in a record."""
    first = F.min(F.struct("document_id", "node_order", "source_label", "field", "entity", "value_kind"))
    by_record = values.groupBy("source_key", "document_id", "record_node_id").agg(F.count("*").alias("n"), F.max("under_repetition").alias("under"), first.alias("first"))
    out = by_record.groupBy("source_key").agg(F.count("*").alias("records_observed"), F.max("n").alias("max_per_record"), F.max("under").alias("under_repetition"), F.min("first").alias("first"))
    return out.select("source_key", "first.source_label", "first.field", "first.entity", "first.value_kind", "records_observed", "max_per_record", "under_repetition", F.col("first.document_id").alias("first_document"), F.col("first.node_order").alias("first_order"))

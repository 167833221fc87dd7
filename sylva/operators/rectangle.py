"""Rectangles: a specification applied to nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import XmlStructureError
from ..functions.types import strict
from ..plans.profile import XmlProfile, compile_xml_profile
from ..plans.spec import XmlRectSpec, check_types
from ..schema import LONG_COLUMNS, VALUES, WIDE_COLUMNS
from ..sources.nodes import check_count, parse_files, with_paths
from .values import labelled, long_values, owned_nodes

STRATEGIES = ("auto", "shared_chunk", "parallel_chunks")


def check_execution(parallel=False, workers=None, strategy: str = "auto", chunk_records=None, task_records=None, progress: bool = False) -> None:
    """Execution settings are checked and change nothing: Spark schedules the same plan in any case."""
    if parallel not in (True, False, "auto"):
        raise ValueError("parallel must be True, False or 'auto'")
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    if not isinstance(progress, bool):
        raise ValueError("progress must be True or False")
    for name, value in (("workers", workers), ("chunk_records", chunk_records), ("task_records", task_records)):
        if value is not None:
            check_count(value, name)


def _record_id(spec: XmlRectSpec) -> Column:
    """record_id over a window of the record's values; a source must give exactly one non-empty value."""
    if spec.identifier is None:
        return F.col("record_index").cast("string")
    record = Window.partitionBy("document_id", "record_node_id")
    own = F.when(F.col("source_key") == spec.identifier.key, F.col("value"))
    return _checked_id(F.count(own).over(record), F.max(own).over(record), spec)


def _checked_id(n: Column, value: Column, spec: XmlRectSpec) -> Column:
    message = F.lit(f"identifier '{spec.identifier.label}' needs exactly one non-empty value in every record")
    return F.when((n != 1) | (F.length(value) == 0), F.raise_error(message).cast("string")).otherwise(value)


def with_unique_ids(rows: DataFrame, spec: XmlRectSpec) -> DataFrame:
    """rows, but the query fails at a record_id that two records of a document have. Generated ones are unique."""
    if spec.identifier is None:
        return rows
    same = Window.partitionBy("document_id", "record_id")
    message = F.concat(F.lit("duplicate record id: "), F.col("record_id"))
    twice = F.min("record_node_id").over(same) != F.max("record_node_id").over(same)
    return rows.withColumn("record_id", F.when(twice, F.raise_error(message).cast("string")).otherwise(F.col("record_id")))


def check_record_ids(rows: DataFrame) -> None:
    """Raises if two records of a document have the same record_id."""
    twice = rows.select("document_id", "record_node_id", "record_id").distinct().groupBy("document_id", "record_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise XmlStructureError(f"duplicate record identifier '{twice[0].record_id}' in document '{twice[0].document_id}'")


def long_rectangle(nodes: DataFrame, spec: XmlRectSpec) -> DataFrame:
    values = long_values(nodes, spec.record_path, list(spec.repeated_paths))
    names = F.create_map(*(F.lit(x) for f in spec.fields for x in (f.source.key, f.name)))
    rows = values.withColumn("record_id", _record_id(spec)).where(F.col("source_key").isin([f.source.key for f in spec.fields]))
    rows = rows.withColumn("field", F.element_at(names, F.col("source_key"))).withColumn("source", F.col("source_label"))
    return rows.select(*LONG_COLUMNS)


def wide_rectangle(nodes: DataFrame, spec: XmlRectSpec) -> DataFrame:
    """A row for every record, also without values. The records' elements are grouped with their values, so nothing is joined."""
    rows = labelled(owned_nodes(nodes, spec.record_path, list(spec.repeated_paths)), spec.record_path)
    rows = rows.where(F.col("node_type").isin(*VALUES) | (F.col("node_id") == F.col("record_node_id")))
    aggregates = []
    for i, f in enumerate(spec.fields):
        own = F.when(F.col("source_key") == f.source.key, F.col("value"))
        aggregates += [F.max(own).alias(f"v{i}"), F.count(own).alias(f"n{i}")]
    if spec.identifier is not None:
        own = F.when(F.col("source_key") == spec.identifier.key, F.col("value"))
        aggregates += [F.max(own).alias("id_value"), F.count(own).alias("id_count")]
    out = rows.groupBy("document_id", "record_node_id").agg(F.first("record_index").alias("record_index"), *aggregates)
    record_id = F.col("record_index").cast("string") if spec.identifier is None else _checked_id(F.col("id_count"), F.col("id_value"), spec)
    columns = []
    for i, f in enumerate(spec.fields):
        message = f"Source '{f.source.label}' repeats in the new XML document. Rebuild the specification as long"
        single = F.when(F.col(f"n{i}") > 1, F.raise_error(F.lit(message)).cast("string")).otherwise(F.col(f"v{i}"))
        columns.append(strict(single, f.type, f.source.label, f.name).alias(f.name))
    return out.select("document_id", "record_index", record_id.alias("record_id"), "record_node_id", *columns).select(*WIDE_COLUMNS, *(f.name for f in spec.fields))


def rectangle(nodes: DataFrame, spec: XmlRectSpec, checked: bool = False) -> DataFrame:
    """The lazy plan. What doesn't fit fails when it runs. checked: the record ids have been found unique."""
    rows = (wide_rectangle if spec.representation == "wide" else long_rectangle)(nodes, spec)
    return rows if checked else with_unique_ids(rows, spec)


def check_rectangle(nodes: DataFrame, spec: XmlRectSpec) -> None:
    """Runs the checks whose errors carry their particulars: types, repetition, identifiers."""
    n = len(spec.fields)
    values = long_values(nodes, spec.record_path, list(spec.repeated_paths))
    if spec.representation == "wide":
        keys = [f.source.key for f in spec.fields]
        again = values.where(F.col("source_key").isin(keys)).groupBy("document_id", "record_node_id", "source_key").count().where("count > 1").limit(1).collect() if n else []
        if again:
            label = next(f.source.label for f in spec.fields if f.source.key == again[0].source_key)
            raise XmlStructureError(f"Source '{label}' repeats in the new XML document. Rebuild the specification as long")
        check_types(values, list(spec.fields))
    if spec.identifier is not None:
        owned = labelled(owned_nodes(nodes, spec.record_path, list(spec.repeated_paths)), spec.record_path)
        own = F.when(F.col("source_key") == spec.identifier.key, F.col("value"))
        ids = owned.groupBy("document_id", "record_node_id").agg(F.count(own).alias("n"), F.max(own).alias("record_id"))
        if ids.where((F.col("n") != 1) | (F.length("record_id") == 0)).limit(1).collect():
            raise XmlStructureError(f"identifier '{spec.identifier.label}' needs exactly one non-empty value in every record")
        check_record_ids(ids)


def as_spec(spark: SparkSession, spec: XmlRectSpec | XmlProfile, sample) -> XmlRectSpec:
    if isinstance(spec, XmlRectSpec):
        return spec
    if isinstance(spec, XmlProfile):
        return compile_xml_profile(spark, spec, sample)
    raise TypeError("spec must be an XmlRectSpec or an XmlProfile")


def xml_rectangle(nodes: DataFrame, spec: XmlRectSpec | XmlProfile, parallel=False, workers=None, strategy: str = "auto", chunk_records=None, task_records=None, progress: bool = False, check: bool = True) -> DataFrame:
    """Applies a specification or profile to a canonical table. check=False leaves errors to the query itself."""
    check_execution(parallel, workers, strategy, chunk_records, task_records, progress)
    nodes = with_paths(nodes)
    spec = as_spec(nodes.sparkSession, spec, nodes)
    if check:
        check_rectangle(nodes, spec)
    return rectangle(nodes, spec, checked=check)


def rectangle_xml(spark: SparkSession, file: str | list[str], spec: XmlRectSpec | XmlProfile, whitespace: str | None = None, parallel=False, workers=None, strategy: str = "auto", chunk_records=None, task_records=None, progress: bool = False, document_id: str | None = None, check: bool = True) -> DataFrame:
    """Scans files and applies a specification; a profile is compiled against the same files."""
    check_execution(parallel, workers, strategy, chunk_records, task_records, progress)
    whitespace = whitespace or (spec.whitespace if isinstance(spec, XmlRectSpec) else "drop_blank")
    nodes = parse_files(spark, file, document_id, whitespace)
    if check or isinstance(spec, XmlProfile):
        nodes = nodes.persist()
    return xml_rectangle(nodes, spec, check=check)


def xml_rectangle_parallel(nodes: DataFrame, spec, workers=None, strategy: str = "shared_chunk", chunk_records=None, task_records=None, progress: bool = False) -> DataFrame:
    return xml_rectangle(nodes, spec, True, workers, strategy, chunk_records, task_records, progress)


def rectangle_xml_parallel(spark: SparkSession, file, spec, whitespace=None, workers=None, strategy: str = "shared_chunk", chunk_records=None, task_records=None, progress: bool = False) -> DataFrame:
    return rectangle_xml(spark, file, spec, whitespace, True, workers, strategy, chunk_records, task_records, progress)

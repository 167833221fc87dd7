"""Rectangles in batches: callbacks, staged CSV and Parquet, and Structured Streaming."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import XmlCallbackError, XmlProfileError, XmlStructureError
from ..functions.kernels import map_arrow
from ..operators.analyst import AnalystTable, rectangle_xml_analyst
from ..operators.rectangle import check_execution, check_record_ids, check_rectangle, rectangle
from ..functions.naming import local_of
from ..plans.spec import XmlRectSpec
from ..sources.nodes import check_count, parse_files, parsed_nodes
from ..sources.publish import Place, check_output, published

ID_CHECKS = ("memory", "none")
ORDER = {"wide": ("document_id", "record_index"), "long": ("document_id", "record_index", "source_node_id")}


def check_stream_spec(spec: object) -> XmlRectSpec:
    """Streams need a compiled specification: a profile would have to see a whole document first."""
    if not isinstance(spec, XmlRectSpec):
        raise XmlProfileError("streaming needs a compiled specification, not a profile")
    return spec


def _rows(spark: SparkSession, file, spec: XmlRectSpec, document_id, whitespace, chunk_rows: int, id_check: str) -> tuple[DataFrame, DataFrame]:
    if id_check not in ID_CHECKS:
        raise ValueError(f"id_check must be one of {', '.join(ID_CHECKS)}")
    nodes = parse_files(spark, file, document_id, whitespace or spec.whitespace, check_count(chunk_rows, "chunk_rows")).persist()
    try:
        if not nodes.where((F.col("node_type") == "element") & (F.col("path") == F.array(*map(F.lit, spec.record_path)))).limit(1).count():
            raise XmlStructureError(f"no element of the input is a record: '{'/'.join(map(local_of, spec.record_path))}' isn't there")
        check_rectangle(nodes, spec if id_check == "memory" else _without_id_check(spec))
    except Exception:
        nodes.unpersist()
        raise
    return nodes, rectangle(nodes, spec, checked=True).orderBy(*ORDER[spec.representation])


def _without_id_check(spec: XmlRectSpec) -> XmlRectSpec:
    return replace(spec, identifier=None)


def _files(file: str | list[str]) -> tuple[str, ...]:
    return (file,) if isinstance(file, str) else tuple(file)


def _stats(nodes: DataFrame, spec: XmlRectSpec, result_rows: int, result_chunks: int, id_check: str, chunk_rows: int) -> dict:
    n = len(spec.record_path)
    inside = F.size("path") >= n
    record = F.slice("path", 1, n) == F.array(*map(F.lit, spec.record_path))
    sizes = nodes.where(inside & record).groupBy("document_id", F.element_at("anc_ids", n)).count().agg(F.count("*").alias("records"), F.max("count").alias("most")).first()
    documents = [r.document_id for r in nodes.select("document_id").distinct().limit(2).collect()]
    nodes_read = nodes.count()
    return {
        "document_id": documents[0] if len(documents) == 1 else None, "node_count": nodes_read, "parser_chunks": -(-nodes_read // chunk_rows), "record_count": sizes.records,
        "result_rows": result_rows, "result_chunks": result_chunks, "max_record_nodes": sizes.most or 0, "id_check": id_check if spec.identifier is not None else "not needed (generated IDs)",
    }


def xml_stream_rectangle(spark: SparkSession, file, spec: XmlRectSpec, callback: Callable, document_id: str | None = None, whitespace: str | None = None, chunk_rows: int = 100_000, batch_rows: int = 100_000, id_check: str = "memory", parallel=False, workers=None, strategy: str = "auto", chunk_records=None, task_records=None, progress: bool = False) -> dict:
    """Calls back with pandas frames of at most batch_rows result rows, in document order; returns counts.

    The driver holds a partition of the result at a time. An exception of the callback becomes XmlCallbackError.
    """
    check_execution(parallel, workers, strategy, chunk_records, task_records, progress)
    check_stream_spec(spec)
    check_count(batch_rows, "batch_rows")
    import pandas as pd

    nodes, rows = _rows(spark, file, spec, document_id, whitespace, chunk_rows, id_check)
    done = {"rows": 0, "chunks": 0}
    waiting: list = []

    def emit() -> None:
        frame = pd.DataFrame.from_records([tuple(r) for r in waiting], columns=rows.columns)
        try:
            callback(frame)
        except Exception as error:
            raise XmlCallbackError(f"The callback failed: {error}") from error
        done["rows"] += len(waiting)
        done["chunks"] += 1
        waiting.clear()

    try:
        for row in rows.toLocalIterator():
            waiting.append(row)
            if len(waiting) == batch_rows:
                emit()
        if waiting:
            emit()
        out = _stats(nodes, spec, done["rows"], done["chunks"], id_check, chunk_rows)
    finally:
        nodes.unpersist()
    if parallel:
        out |= {"parallel_strategy": strategy, "workers": workers, "chunk_records": chunk_records, "task_records": task_records}
    return out


def xml_stream_rectangle_parallel(spark: SparkSession, file, spec, callback, workers=None, strategy: str = "shared_chunk", **how) -> dict:
    return xml_stream_rectangle(spark, file, spec, callback, parallel=True, workers=workers, strategy=strategy, **how)


def _text(value: object, na: str) -> str:
    if value is None:
        return na
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        return f"{value:.15g}"
    if isinstance(value, datetime.date):
        return value.isoformat()
    return str(value)


def write_csv(df: DataFrame, staged: Place, na: str = "") -> int:
    """One file in the frame's order, which must be a global sort: strings quoted, missing values bare; returns the rows.

    The lines are made and written by the executors, a file for each partition; their bytes are joined behind the header.
    """
    quoted = [isinstance(f.dataType, T.StringType) for f in df.schema]

    def lines(batches):
        for batch in batches:
            columns = []
            for column, q in zip(batch.columns, quoted, strict=True):
                columns.append([('"' + x.replace('"', '""') + '"' if q and x is not None else _text(x, na)) for x in column.to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(map(",".join, zip(*columns, strict=True)), pa.string())], ["value"])

    counted = Observation()
    folder = staged.sibling(f"{staged.name}.parts")
    try:
        map_arrow(df.observe(counted, F.count(F.lit(1)).alias("n")), lines, "value string").write.text(str(folder.at))
        header = ",".join('"' + c.replace('"', '""') + '"' for c in df.columns) + "\n"
        staged.write(header.encode(), [x for x in folder.children() if x.name.startswith("part-")])
    finally:
        folder.remove()
    return counted.get["n"]


def rectangle_xml_csv(spark: SparkSession, file, spec: XmlRectSpec, output: str, overwrite: bool = False, document_id: str | None = None, whitespace: str | None = None, chunk_rows: int = 100_000, batch_rows: int = 100_000, id_check: str = "memory", **execution) -> dict:
    """A rectangle as one CSV file, header first even without rows."""
    check_execution(**execution)
    check_stream_spec(spec)
    path = check_output(spark, output, overwrite, _files(file))
    nodes, rows = _rows(spark, file, spec, document_id, whitespace, chunk_rows, id_check)
    try:
        n = published(path, lambda staged: write_csv(rows, staged))
        return _stats(nodes, spec, n, -(-n // batch_rows), id_check, chunk_rows) | {"output_file": str(path), "output_format": "csv"}
    finally:
        nodes.unpersist()


def rectangle_xml_parquet(spark: SparkSession, file, spec: XmlRectSpec, output_dir: str, overwrite: bool = False, compression: str = "snappy", document_id: str | None = None, whitespace: str | None = None, chunk_rows: int = 100_000, batch_rows: int = 100_000, id_check: str = "memory", **execution) -> dict:
    """A rectangle as a folder of part-NNNNNN.parquet, in order, of at most batch_rows rows; one empty part if there are none."""
    check_execution(**execution)
    check_stream_spec(spec)
    path = check_output(spark, output_dir, overwrite, _files(file), folder=True)
    nodes, rows = _rows(spark, file, spec, document_id, whitespace, chunk_rows, id_check)

    def make(staged: Place) -> tuple[int, int]:
        counted = Observation()
        rows.observe(counted, F.count(F.lit(1)).alias("n")).write.option("compression", compression).option("maxRecordsPerFile", batch_rows).parquet(str(staged.at))
        parts = 0
        for x in staged.children():
            if x.name.startswith("part-"):
                parts += 1
                x.rename(staged.child(f"part-{parts:06d}.parquet"))
            else:
                x.remove()
        return counted.get["n"], parts

    try:
        n, parts = published(path, make)
        return _stats(nodes, spec, n, parts, id_check, chunk_rows) | {"output_dir": str(path), "output_format": "parquet", "output_parts": parts, "compression": compression}
    finally:
        nodes.unpersist()


def rectangle_xml_analyst_csv(spark: SparkSession, file, output: str, whitespace: str = "drop_blank", infer_types: bool = True, include_misc: bool = True, na: str = "\\N", overwrite: bool = False) -> AnalystTable:
    """An analyst table as one CSV file. Refused where the mark of missing values is among the data."""
    path = check_output(spark, output, overwrite, _files(file), make_parent=True)
    made = rectangle_xml_analyst(spark, file, whitespace, infer_types, include_misc)
    table = made.table.orderBy("xml_document_id", "xml_node_id")
    strings = [f.name for f in table.schema if isinstance(f.dataType, T.StringType)]
    found = table.agg(*(F.max(F.coalesce(F.col(c) == na, F.lit(False))).alias(c) for c in strings)).first()
    clash = [c for c in strings if found[c]]
    if clash:
        raise ValueError(f"the missing-value sentinel {na!r} occurs as genuine source data in '{clash[0]}'")
    published(path, lambda staged: write_csv(table, staged, na))
    return made


def rectangle_xml_analyst_parquet(spark: SparkSession, file, output: str, whitespace: str = "drop_blank", infer_types: bool = True, include_misc: bool = True, overwrite: bool = False, compression: str = "snappy") -> AnalystTable:
    """An analyst table as one Parquet file."""
    path = check_output(spark, output, overwrite, _files(file))
    made = rectangle_xml_analyst(spark, file, whitespace, infer_types, include_misc)

    def make(staged: Place) -> None:
        folder = staged.sibling(f"{staged.name}.parts")
        try:
            made.table.orderBy("xml_document_id", "xml_node_id").coalesce(1).write.option("compression", compression).parquet(str(folder.at))
            next(x for x in folder.children() if x.name.startswith("part-")).rename(staged)
        finally:
            folder.remove()

    published(path, make)
    return made


def stream_rectangles(spark: SparkSession, folder: str, spec: XmlRectSpec, sink: Callable[[DataFrame, int], None], checkpoint: str, pattern: str = "*.xml", max_files: int = 100, id_check: str = "memory"):
    """A streaming query over files that arrive in a folder: each micro-batch is parsed, rectangled and given to sink.

    A document arrives whole, so its records' ids are checked in its batch.
    """
    check_stream_spec(spec)
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).load(folder)

    def each(batch: DataFrame, number: int) -> None:
        sources = batch.select(F.element_at(F.split("path", "/"), -1).alias("document_id"), "content")
        rows = rectangle(parsed_nodes(sources, spec.whitespace), spec, checked=True)
        if id_check == "memory":
            rows = rows.persist()
            check_record_ids(rows)
        sink(rows, number)
        rows.unpersist()

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

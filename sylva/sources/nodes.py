"""Reading XML into canonical node tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import XmlCallbackError, XmlParseError, XmlStructureError
from ..functions.kernels import map_arrow
from ..schema import NODES, PARSED, PATH_COLUMNS
from .parse import BATCH_ROWS, WHITESPACE, parse_document
from .workspace import workspace

CANONICAL = NODES.names
#: Rows that the driver reads at once.
PART_ROWS = 100_000


def check_whitespace(whitespace: str) -> str:
    if whitespace not in WHITESPACE:
        raise ValueError(f"whitespace must be one of {', '.join(WHITESPACE)}")
    return whitespace


def check_string(value: object, name: str) -> str:
    if not isinstance(value, str) or not value:
        raise ValueError(f"{name} must be one non-empty string")
    return value


def check_count(value: object, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ValueError(f"{name} must be one positive whole number")
    return value


def parsed_nodes(sources: DataFrame, whitespace: str = "preserve", batch_rows: int = BATCH_ROWS, malformed: str = "raise", columns: list[str] | None = None) -> DataFrame:
    """The nodes of many documents, with the path columns. sources: document_id, and content as string or binary.

    Every document is parsed by one task, as a stream; a row of null content gives no rows. malformed: "raise", or
    "drop" to leave documents out that aren't well-formed. columns: those that are wanted; the kernel makes no others.
    """
    check_whitespace(whitespace)
    schema = PARSED if columns is None else T.StructType([PARSED[c] for c in columns])
    if malformed not in ("raise", "drop"):
        raise ValueError("malformed must be 'raise' or 'drop'")

    # Spark takes equal plans for the same cached data, also when a file has changed since: a token keeps each call's apart.
    def kernel(batches, token=uuid.uuid4().hex):  # noqa: B008
        for batch in batches:
            waiting, rows = [], 0
            for document_id, content in zip(batch.column(0), batch.column(1), strict=True):
                if not content.is_valid:
                    continue
                parts = parse_document(document_id.as_py(), content.as_py(), whitespace, batch_rows, schema.names)
                if malformed == "drop":  # nothing of a document is emitted before it is known to be well-formed
                    try:
                        parts = list(parts)
                    except XmlParseError:
                        continue
                for part in parts:
                    waiting.append(part)
                    rows += part.num_rows
                    if rows >= batch_rows:
                        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                        waiting, rows = [], 0
            if waiting:
                yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()

    return map_arrow(sources.select("document_id", "content"), kernel, schema)


def file_sources(spark: SparkSession, path: str | list[str], document_id: str | None = None) -> DataFrame:
    """document_id (the file's name unless given) and content of the files that a path or pattern names."""
    check_string(path if isinstance(path, str) else "".join(path), "file")
    files = spark.read.format("binaryFile").load(path)
    name = F.lit(check_string(document_id, "document_id")) if document_id is not None else F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\+", "%2B"))
    return files.select(name.alias("document_id"), "content")


def text_sources(spark: SparkSession, text: str, document_id: str = "inline-xml") -> DataFrame:
    return spark.createDataFrame([(check_string(document_id, "document_id"), check_string(text, "text"))], "document_id string, content string")


def parse_files(spark: SparkSession, file: str | list[str], document_id: str | None = None, whitespace: str = "preserve", chunk_rows: int = BATCH_ROWS) -> DataFrame:
    return parsed_nodes(file_sources(spark, file, document_id), whitespace, chunk_rows)


def xml_to_nodes_memory(spark: SparkSession, file: str | list[str], document_id: str | None = None, whitespace: str = "preserve") -> DataFrame:
    """The canonical node table of files."""
    return parse_files(spark, file, document_id, whitespace).select(*CANONICAL)


def xml_text_to_nodes_memory(spark: SparkSession, text: str, document_id: str = "inline-xml", whitespace: str = "preserve") -> DataFrame:
    """The canonical node table of literal text, which is never taken for a path."""
    return parsed_nodes(text_sources(spark, text, document_id), whitespace).select(*CANONICAL)


def xml_to_nodes_stream(spark: SparkSession, file: str | list[str], document_id: str | None = None, whitespace: str = "preserve", chunk_rows: int = 100_000) -> DataFrame:
    """The same table; the kernel hands on chunk_rows rows at a time."""
    return parse_files(spark, file, document_id, whitespace, check_count(chunk_rows, "chunk_rows")).select(*CANONICAL)


def xml_stream_nodes(spark: SparkSession, file: str, callback: Callable, document_id: str | None = None, whitespace: str = "preserve", chunk_rows: int = 100_000) -> dict:
    """Calls back with pandas frames of at most chunk_rows canonical rows, in order; returns document_id, node_count, chunk_count.

    The executors write the nodes in order to parts of at most chunk_rows rows; the driver holds one part and one chunk at a
    time. An exception of the callback is raised as XmlCallbackError.
    """
    check_count(chunk_rows, "chunk_rows")
    nodes = xml_to_nodes_stream(spark, file, document_id, whitespace, chunk_rows)
    import pandas as pd

    stats = {"document_id": document_id, "node_count": 0, "chunk_count": 0}
    rows: list = []

    def emit() -> None:
        frame = pd.DataFrame.from_records(rows, columns=CANONICAL)
        try:
            callback(frame)
        except Exception as error:
            raise XmlCallbackError(f"The callback failed: {error}") from error
        stats["node_count"] += len(rows)
        stats["chunk_count"] += 1
        rows.clear()

    for part in ordered_parts(spark, nodes, several=len(file_sources(spark, file).select("document_id").limit(2).collect()) > 1):
        if part and not stats["document_id"]:
            stats["document_id"] = part[0][0]
        while part:
            room = chunk_rows - len(rows)
            rows += part[:room]
            part = part[room:]
            if len(rows) == chunk_rows:
                emit()
    if rows:
        emit()
    return stats


def ordered_parts(spark: SparkSession, nodes: DataFrame, several: bool = True, most: int = PART_ROWS) -> Iterator[list[tuple]]:
    """The rows of a canonical table in lists of at most `most`: partition by partition, each by document and node_order.

    several: whether a partition may hold several documents; of one, the kernel's rows are in order as they come.
    """
    folder = workspace(spark, "nodes")
    try:
        ordered = nodes.sortWithinPartitions("document_id", "node_order") if several else nodes
        ordered.write.option("maxRecordsPerFile", most).mode("overwrite").parquet(str(folder.at))
        # part-<partition>-<job>-c<number of the file in the partition>...
        parts = sorted((int(m[1]), int(m[2]), str(x.at)) for x in folder.children() if (m := re.match(r"part-(\d+)-.*-c(\d+)\.", x.name)))
        for *_, path in parts:
            part = spark.read.schema(nodes.schema).parquet(path).coalesce(1).sortWithinPartitions("document_id", "node_order").toArrow()
            yield list(zip(*(c.to_pylist() for c in part.columns), strict=True))
    finally:
        folder.remove()


def with_paths(nodes: DataFrame) -> DataFrame:
    """Adds the path columns to a canonical table that didn't come from the kernel.

    In preorder, the ancestor of a node at depth k is the last element at depth k up to it, so windows over a document
    find all ancestors without recursion. The depth of the deepest element is asked for first.
    """
    if set(PATH_COLUMNS.names) <= set(nodes.columns):
        return nodes
    deepest = nodes.where("node_type = 'element'").agg(F.max("depth")).first()[0] or 0
    order = Window.partitionBy("document_id").orderBy("node_order").rowsBetween(Window.unboundedPreceding, 0)
    name = expanded_name(F.col("local_name"), F.col("namespace_uri"))
    element = F.col("node_type") == "element"
    levels = [F.last(F.when(element & (F.col("depth") == k), F.struct(F.col("node_id").alias("id"), name.alias("name"))), ignorenulls=True).over(order) for k in range(1, deepest + 1)]
    own_depth = F.greatest(F.when(element, F.col("depth")).otherwise(F.col("depth") - 1), F.lit(0))
    out = nodes.withColumn("own_depth", own_depth).withColumn("levels", F.array(*levels) if levels else F.lit(None).cast("array<struct<id:int,name:string>>"))
    steps = F.when(F.col("own_depth") > 0, F.slice("levels", 1, F.col("own_depth")))
    same = Window.partitionBy("document_id", "parent_id", "node_type", "local_name", "namespace_uri").orderBy("node_order")
    return out.select(
        *nodes.columns,
        F.transform(steps, lambda s: s["name"]).alias("path"),
        F.transform(steps, lambda s: s["id"]).alias("anc_ids"),
        F.when(element, F.row_number().over(same)).alias("sibling_occurrence"),
    )


def expanded_name(local: Column, uri: Column) -> Column:
    return F.when(F.coalesce(uri, F.lit("")) == "", local).otherwise(F.concat(F.lit("{"), uri, F.lit("}"), local))


def single_document(nodes: DataFrame, what: str) -> None:
    """Raises if nodes are of no document or of several."""
    found = nodes.select("document_id").distinct().limit(2).collect()
    if len(found) != 1:
        raise XmlStructureError(f"{what} needs the nodes of one document")

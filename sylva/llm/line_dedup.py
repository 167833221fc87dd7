"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines says where a chunk ends, so a shift of lines moves no boundary
but the nearest. Short runs hold no whole chunk, so each two neighbouring lines with words (and the blank ones between)
are a chunk as well: all lines of a repeated run are in such pairs. Of chunks of several lines that occur more than once
in the corpus, the first occurrence (least doc_id) stays and the others are removed, if their bytes are the same and not
just their hashes.

Nulls: a null text has no lines and stays null; a null doc_id counts last. Repeated rows (doc_id and text the same)
are one document: its chunks stay or go in all of them. A chunk of one line, or with fewer than two lines that have
words, is never removed. Very long texts are read whole; their chunks travel as hashes until they are known to be repeated.
Ties can't be: two chunks of one place don't begin alike. An empty table gives an empty result. Extra columns are carried
along; those that are called like the counts that dedup_lines adds give way to them.
"""

from __future__ import annotations

import bisect
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_arrow, maybe_broadcast, mixed, text_hash, written

#: A chunk ends after a line whose rolling hash is 0 modulo this.
SPREAD = 4
#: Lines that the rolling hash covers.
WINDOW = 2


def chunks(text: str, spread: int = SPREAD) -> list[tuple[int, int, int]]:
    """(hash, first line, lines) of every chunk with at least two lines that have words, and of every pair of such lines."""
    lines = text.split("\n")
    if len(lines) < 2:
        return []
    encoded = [line.encode() for line in lines]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, encoded), np.uint64, len(lines))
    rolling = h.copy()
    for i in range(1, WINDOW):
        rolling[i:] += h[:-i] * np.uint64(2 * i + 0x9E3779B97F4A7C15)
    last = np.flatnonzero(mixed(rolling) % np.uint64(spread) == 0)
    filled = [i for i, b in enumerate(encoded) if b.split()]
    found, start = {(a, b + 1) for a, b in itertools.pairwise(filled)}, 0
    for end in [*(last + 1).tolist(), len(lines)]:
        if bisect.bisect_left(filled, end) - bisect.bisect_left(filled, start) > 1:
            found.add((start, end))
        start = end
    return [(xxhash.xxh3_64_intdigest(b"\n".join(encoded[a:b])) - (1 << 63), a, b - a) for a, b in sorted(found)]


def chunk_table(docs: DataFrame, spread: int = SPREAD) -> DataFrame:
    """doc_id, text_hash, chunk, start, lines of every chunk of several lines, as a table without texts."""

    def kernel(batches):
        for batch in batches:
            found, ends = [], [0]
            for text in batch.column(2):
                found += chunks(text.as_py() or "", spread)
                ends.append(len(found))
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 3, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["chunk", "start", "lines"]))], ["doc_id", "text_hash", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), "text")
    out = map_arrow(rows, kernel, "doc_id long, text_hash long, x array<struct<chunk:long,start:int,lines:int>>")
    return written(out.select("doc_id", "text_hash", F.explode("x").alias("x")).select("doc_id", "text_hash", "x.*"), "chunks")


def _of_row(docs: DataFrame, right: DataFrame):
    return (text_hash(docs["text"]) == right["_sylva_hash"]) & docs["doc_id"].eqNullSafe(right["_sylva_id"])


def removed_lines(docs: DataFrame, spread: int = SPREAD) -> DataFrame:
    """_sylva_id, _sylva_hash (doc_id and text hash of a row), _sylva_lines (the numbers of the lines to remove), _sylva_chunks."""
    table = chunk_table(docs, spread)
    often = table.groupBy("chunk").count().where("count > 1").select("chunk")
    often = written(often, "often")
    repeated = table.join(maybe_broadcast(often), "chunk")
    by_row = repeated.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("chunk", "start", "lines")).alias("x"))
    by_row = written(by_row.select(F.col("doc_id").alias("_sylva_id"), F.col("text_hash").alias("_sylva_hash"), "x"), "repeated")
    # The lines are made below the join: above it, each chunk would split the text anew.
    texts = docs.select("doc_id", "text", F.split("text", "\n").alias("all"))
    rows = texts.join(maybe_broadcast(by_row), _of_row(texts, by_row)).select("doc_id", "_sylva_hash", "all", "x")
    sliced = F.transform("x", lambda c: F.struct(c["chunk"].alias("chunk"), c["start"].alias("start"), c["lines"].alias("lines"), F.array_join(F.slice("all", c["start"] + 1, c["lines"]), "\n").alias("bytes")))
    rows = rows.select("doc_id", "_sylva_hash", F.explode(sliced).alias("x"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc_id"), F.col("_sylva_hash").alias("text_hash"), F.col("x.start").alias("start"))
    found = rows.select("x.chunk", "x.bytes", place.alias("place"), "x.lines")
    found = written(found, "candidates")
    first = written(found.groupBy("chunk", "bytes").agg(F.min("place").alias("first")), "first")  # apart, so that AQE can split a hot chunk's rows
    gone = found.join(first, ["chunk", "bytes"]).where("place != first")
    numbers = F.sequence(F.col("place.start"), F.col("place.start") + F.col("lines") - 1)
    gone = gone.groupBy(F.col("place.doc_id").alias("_sylva_id"), F.col("place.text_hash").alias("_sylva_hash")).agg(
        F.array_distinct(F.flatten(F.collect_list(numbers))).alias("_sylva_lines"), F.countDistinct("place.start").alias("_sylva_chunks")
    )
    return written(gone, "gone")


COUNTS = ("n_lines", "n_removed_lines", "n_removed_chunks")


def deduped(docs: DataFrame, counts: str = "_sylva_counts", spread: int = SPREAD) -> DataFrame:
    """docs with text as it is left, and a column `counts`: a struct of n_lines, n_removed_lines and n_removed_chunks."""
    gone = removed_lines(docs, spread)
    rows = docs.withColumn("_sylva_all", F.split("text", "\n"))  # below the join, like the lines of removed_lines
    out = rows.join(maybe_broadcast(gone), _of_row(rows, gone), "left")
    docs, lines = rows.drop("_sylva_all"), F.col("_sylva_all")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_sylva_lines"))
    left = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col("_sylva_lines").isNull(), docs["text"]).otherwise(left)
    values = (
        F.when(docs["text"].isNull(), 0).otherwise(F.size(lines)),
        F.when(F.col("_sylva_lines").isNull(), 0).otherwise(F.size("_sylva_lines")),
        F.coalesce("_sylva_chunks", F.lit(0)),
    )
    kept = [docs[c] if c != "text" else text.alias("text") for c in docs.columns]
    return out.select(*kept, F.struct(*(v.cast("long").alias(c) for c, v in zip(COUNTS, values, strict=True))).alias(counts))


def dedup_lines(docs: DataFrame, spread: int = SPREAD) -> DataFrame:
    """docs with text as it is left, and n_lines, n_removed_lines, n_removed_chunks."""
    docs = docs.drop(*COUNTS)
    return deduped(docs, spread=spread).select(*docs.columns, "_sylva_counts.*")


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))

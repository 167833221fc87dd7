"""Token counts without token ids.

The pieces of every distinct pre-token are counted once, by the tokenizer's own library; these counts are
joined to the pre-token frequencies of each document and summed. The most frequent pre-tokens (a fixed number)
are joined from a broadcast table inside the kernel that splits the texts, the long tail by a shuffled join.

Nulls: a null text counts as an empty one (0 bytes, 0 tokens); doc_id may be null or repeated, rows stay apart.
Very long texts are split whole; memory follows the distinct pre-tokens of one text. Special strings inside
texts are one token, as the library has it. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import kept as kept_in_worker
from ..functions.kernels import map_arrow
from .common import documents, small_batches, utf8_bytes, written
from .pretokens import Numbered, PreTokenizer

LIMIT = 1024
#: At most so many of the most frequent pre-tokens are broadcast (some 3 MB); the number doesn't follow the input.
HEAD = 1 << 18
#: Rows that are split together; a kernel hands on the distinct pre-tokens it has gathered when there are so many, or parts.
ROWS, GATHERED, PARTS = 512, 400_000, 500_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@kept_in_worker
@lru_cache(maxsize=1)
def _splitter(path: str) -> Numbered:
    """Splits texts as does a byte-level tokenizer file, which has no normalizer and doesn't add a space."""
    import json

    import public_tokenizers

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = spec["pre_tokenizer"]
    if spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
        raise ValueError(f"{path}: not a plain byte-level tokenizer")
    return Numbered(PreTokenizer(public_tokenizers.PATTERN, tuple(x["content"] for x in spec["added_tokens"])), PARTS)


def _slices(batches):
    """The same rows in batches of at most ROWS: what splitting keeps for a batch is many times its texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def distinct_pretokens(docs: DataFrame, path: str) -> DataFrame:
    """piece, n: every distinct pre-token of all texts and how often it occurs. Each task sums its own before the shuffle."""

    def gather(batches):
        splitter, seen = _splitter(path), np.zeros(0, np.int64)

        def table():
            some = np.flatnonzero(seen)
            pieces = pa.array(splitter.pieces.keys(), pa.string()).take(pa.array(some))
            return pa.RecordBatch.from_arrays([pieces, pa.array(seen[some])], ["piece", "n"])

        for batch in _slices(batches):
            if splitter.full or len(splitter.pieces) > GATHERED:
                if len(seen):
                    yield table()
                splitter.forget()
                seen = np.zeros(0, np.int64)
            found, _ = splitter.cut(batch.column(0))
            counts = np.bincount(found, minlength=len(splitter.pieces))
            counts[: len(seen)] += seen
            seen = counts
        if len(seen):
            yield table()

    return map_arrow(docs.select("text"), gather, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def piece_counts(pretokens: DataFrame, path: str) -> DataFrame:
    """pretokens with pieces: the tokens that the library makes of each, counted once."""

    def count(batches):
        tokenizer = _tokenizer(path)
        for batch in batches:
            pieces = batch.column(0)
            encoded = tokenizer.encode_batch_fast(pieces.to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([pieces, batch.column(1), pa.array([len(e) for e in encoded], pa.int32())], ["piece", "n", "pieces"])

    return map_arrow(pretokens, count, "piece string, n long, pieces int")


def frequent_pieces(dictionary: DataFrame, head: int) -> DataFrame:
    """piece, pieces of the most frequent pre-tokens, at most `head`: those above a frequency that a histogram gives, so none are sorted."""
    grade = F.floor(8 * F.log2("n"))
    left, least = head, None
    for x in sorted(dictionary.groupBy(grade.alias("grade")).count().collect(), reverse=True):
        left -= x["count"]
        if left < 0:
            break
        least = x.grade
    return dictionary.where(F.lit(False) if least is None else grade >= least).select("piece", "pieces")


def token_counts(docs: DataFrame, path: str, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of docs."""
    small_batches(docs.sparkSession)
    dictionary = written(piece_counts(distinct_pretokens(docs, path), path), "pieces")
    frequent = docs.sparkSession.sparkContext.broadcast({x.piece: x.pieces for x in frequent_pieces(dictionary, head).toLocalIterator()})

    def sums(batches):
        splitter, known = _splitter(path), frequent.value
        names, tokens = [], np.zeros(0, np.int64)  # of each pre-token; 0: a rare one
        for batch in _slices(batches):
            if splitter.full or len(splitter.pieces) > GATHERED:
                splitter.forget()
                names, tokens = [], np.zeros(0, np.int64)
            at, ends = splitter.cut(batch.column(2))
            new = list(islice(splitter.pieces, len(names), None))
            names += new
            tokens = np.concatenate([tokens, np.array([known.get(p, 0) for p in new], np.int64)])
            total = np.diff(np.concatenate([[0], np.cumsum(tokens[at])])[ends])
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            rare = tokens[at] == 0
            size = len(tokens) + 1
            each, times = np.unique(row[rare] * size + at[rare], return_counts=True)
            row, at = np.divmod(each, size)
            pieces = pa.array([names[i] for i in at.tolist()], pa.string())
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32()), pa.StructArray.from_arrays([pieces, pa.array(times, pa.int32())], ["piece", "k"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total, pa.int64()), lists], ["doc_id", "n_bytes", "n", "rare"])

    rows = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8_bytes().alias("n_bytes"), "text"), sums, "doc_id long, n_bytes long, n long, rare array<struct<piece:string,k:int>>")
    # The row's own figures travel as one more element, whose key no pre-token has: letters, digits and signs never share one.
    row = F.monotonically_increasing_id()
    own = F.struct(F.concat(F.lit("\u0000a"), F.col("row").cast("string")).alias("piece"), F.lit(0).alias("k"))
    parts = rows.withColumn("row", row).withColumn("x", F.explode(F.concat(F.array(own), "rare")))
    first = F.col("x.k") == 0
    parts = parts.select("row", F.col("x.piece").alias("piece"), F.col("x.k").alias("k"), *(F.when(first, F.col(c)).alias(c) for c in ("doc_id", "n_bytes", "n")))
    joined = parts.join(dictionary.select("piece", "pieces"), "piece", "left")
    n = F.when(F.col("k") == 0, F.col("n")).when(F.col("pieces").isNull(), F.raise_error(F.lit("a pre-token without a count"))).otherwise(F.col("k") * F.col("pieces"))
    return joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(n.cast("long")).alias("n_tokens")).drop("row")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)

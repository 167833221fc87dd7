"""Quality rules: counts within a document, and lines that many documents of a host share.

The lines of every document are normalised (lower case, white space squeezed) and hashed. For every host the
distinct documents with a line are counted; lines above the limit are boilerplate and are removed. A document that loses
more than the allowed part of its words with them is rejected, like one that fails the base rules.

The lines above the limit are few (all lines of a host, over the limit); they are broadcast if they fit,
else joined with salted keys, since the line of a third of all documents is among them. Only texts that have such lines
are read again, to be cleaned.

Nulls: a null text has no words and fails the base rules; a null host is a host of its own. Each row is a
document of its own, whatever its doc_id: repeated rows count as often as they occur and get the same verdict. Very long
texts are read whole; their lines travel as hashes. There are no ties: a line is over the limit or it isn't. An empty table
gives an empty result; other columns, whatever their names, are ignored by `apply_rules` and carried along by `cleaned`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, fits_broadcast, map_arrow, maybe_broadcast, text_hash, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line that more documents of a host have is boilerplate.
LINE_DOCUMENTS = 20
#: A document is depleted if boilerplate lines hold more than this part of its words.
MAX_LOST_PERCENT = 50
SALTS = 64
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], k: int = 3) -> int:
    """How many words lie in a window of k words that occurs twice or more."""
    n = len(words)
    if n <= k:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    windows = ids[: n - k + 1]
    for i in range(1, k):  # neighbours' pairs are numbered anew, so the numbers stay small and exact
        _, windows = np.unique(windows * len(numbers) + ids[i : n - k + 1 + i], return_inverse=True)
    found = np.bincount(windows)[windows] >= 2
    covered = np.zeros(n, dtype=bool)
    for i in range(k):
        covered[i : n - k + 1 + i] |= found
    return int(covered.sum())


def line_hash(words: list[bytes]) -> int:
    """Of a normalised line, by its words."""
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def without_lines(text: str, gone: set[int]) -> str:
    """text without the lines whose hashes are gone."""
    return "\n".join(x for x in text.split("\n") if not (n := x.lower().encode().split()) or line_hash(n) not in gone)


def measured(text: str) -> tuple[tuple[int, int, int, int, int], dict[int, int]]:
    """The base counts of a text, and the words of each distinct normalised line by the line's hash."""
    words = text.encode().split()
    seen: set[str] = set()
    lines: dict[int, int] = {}
    again = 0
    for line in text.split("\n"):
        n = line.lower().encode().split()
        if not n:
            continue
        again += line in seen
        seen.add(line)
        h = line_hash(n)
        lines[h] = lines.get(h, 0) + len(n)
    chars = len(text) - sum(map(text.count, SPACES))
    return (len(words), chars, sum(map(text.count, SYMBOLS)), again, repeated_words(words)), lines


def _keys(docs: DataFrame, host: str) -> dict[str, Column]:
    """What names a row: doc_id, the host's name (never null) and the text's hash."""
    return {"doc_id": docs["doc_id"].cast("long"), "host": F.coalesce(F.concat(F.lit("="), docs[host].cast("string")), F.lit("null")), "text_hash": text_hash(docs["text"])}


def line_table(docs: DataFrame, host: str) -> DataFrame:
    """doc_id, host, text_hash, the base counts, text_md5 and lines (hash, words) of each row, with a number for the row; as a table, without the texts."""

    def measure(batches):
        for batch in batches:
            base, hashes, words, ends, digests = [], [], [], [0], []
            for text in batch.column(3):
                text = text.as_py() or ""
                counts, lines = measured(text)
                base.append(counts)
                hashes += lines.keys()
                words += lines.values()
                ends.append(len(hashes))
                digests.append(hashlib.md5(text.encode()).hexdigest())
            columns = [pa.array(c, pa.int64()) for c in (zip(*base, strict=True) if base else [[]] * 5)]
            lines = pa.StructArray.from_arrays([pa.array(hashes, pa.int64()), pa.array(words, pa.int64())], ["line", "words"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns, pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines)], ["doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_md5", "lines"])

    rows = docs.select(*(v.alias(k) for k, v in _keys(docs, host).items()), "text")
    rows = map_arrow(rows, measure, f"doc_id long, host string, text_hash long, {BASE}, text_md5 string, lines array<struct<line:long,words:long>>")
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "lines")


def frequent_lines(lines: DataFrame, limit: int = LINE_DOCUMENTS) -> DataFrame:
    """host, line of the lines that more than `limit` documents of a host have. Summed in each task before the shuffle."""
    return lines.select("host", F.explode("lines.line").alias("line")).groupBy("host", "line").count().where(F.col("count") > limit).select("host", "line")


def apply_rules(docs: DataFrame, host: str = "source", limit: int = LINE_DOCUMENTS, lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """doc_id, host, text_hash, the base counts, text_md5, lost_words (in boilerplate lines), gone (their hashes), base_failed and kept of every row."""
    rows = line_table(docs, host)
    frequent = written(frequent_lines(rows, limit), "frequent")
    each = rows.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.line", "x.words")
    if fits_broadcast(frequent):
        hits = each.join(F.broadcast(frequent), ["host", "line"])
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        hits = each.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(frequent.select("host", "line", salt), ["host", "line", "salt"])
    lost = hits.groupBy("row").agg(F.sum("words").alias("lost"), F.collect_list("line").alias("gone"))
    out = rows.drop("lines").join(lost, "row", "left").withColumn("lost_words", F.coalesce("lost", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = 100 * F.col("lost_words") > lost_percent * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted).drop("row", "lost")


def boilerplate_removed(docs: DataFrame, rules: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, text_hash, text: what is left of the different texts that have boilerplate lines. rules: of apply_rules."""
    asked = rules.where("gone IS NOT NULL").dropDuplicates(["doc_id", "host", "text_hash"])
    asked = written(asked.select(F.col("doc_id").alias("d"), F.col("host").alias("s"), F.col("text_hash").alias("h"), "gone"), "asked")
    rows = docs.select(*(v.alias(k) for k, v in _keys(docs, host).items()), "text")
    found = rows.join(maybe_broadcast(asked), (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("host") == F.col("s")))

    def clean(batches):
        for batch in batches:
            texts = [without_lines(t.as_py(), set(gone)) for t, gone in zip(batch.column(3), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())], ["doc_id", "host", "text_hash", "text"])

    return map_arrow(found.select("doc_id", "host", "text_hash", "text", "gone"), clean, "doc_id long, host string, text_hash long, text string")


def cleaned(docs: DataFrame, host: str = "source", limit: int = LINE_DOCUMENTS, lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """The rows of docs that are kept, with their columns; text without boilerplate lines."""
    rules = written(apply_rules(docs, host, limit, lost_percent), "rules")
    verdict = rules.groupBy("doc_id", "host", "text_hash").agg(F.min("kept").alias("kept"))
    texts = boilerplate_removed(docs, rules, host).dropDuplicates(["doc_id", "host", "text_hash"])
    joined = verdict.where("kept").join(texts, (verdict["text_hash"] == texts["text_hash"]) & verdict["doc_id"].eqNullSafe(texts["doc_id"]) & (verdict["host"] == texts["host"]), "left")
    right = joined.select(verdict["doc_id"].alias("_sylva_id"), verdict["host"].alias("_sylva_host"), verdict["text_hash"].alias("_sylva_hash"), texts["text"].alias("_sylva_text"))
    keys = _keys(docs, host)
    same = (keys["text_hash"] == F.col("_sylva_hash")) & keys["doc_id"].eqNullSafe(F.col("_sylva_id")) & (keys["host"] == F.col("_sylva_host"))
    return docs.join(maybe_broadcast(written(right, "cleaned")), same).select(*(docs[c] if c != "text" else F.coalesce("_sylva_text", docs["text"]).alias("text") for c in docs.columns))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rules = written(apply_rules(docs), "rules")
    left = boilerplate_removed(docs, rules).select(F.col("doc_id").alias("d"), F.col("host").alias("s"), F.col("text_hash").alias("h"), F.md5("text").alias("left_md5"))
    left = maybe_broadcast(written(left.dropDuplicates(["d", "s", "h"]), "left"))
    out = rules.join(left, (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("host") == F.col("s")), "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words", F.coalesce("left_md5", "text_md5").alias("cleaned_md5"))


#: The same in DuckDB's SQL, with whole lines where the operator has their hashes.
OP9_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce('=' || source, 'null') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS split FROM d),
win AS (SELECT doc_id, i, words[i:i+2] AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM win) WHERE n > 1),
reps AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM rep GROUP BY doc_id),
lines AS (SELECT doc_id, host, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
          FROM (SELECT doc_id, host, unnest(split) AS line FROM w)),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE n > 0 GROUP BY doc_id),
norm AS (SELECT doc_id, host, array_to_string(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+'), ' ') AS line, n FROM lines WHERE n > 0),
freq AS (SELECT host, line FROM norm GROUP BY host, line HAVING count(DISTINCT doc_id) > {LINE_DOCUMENTS}),
lost AS (SELECT doc_id, sum(n) AS lost_words FROM norm JOIN freq USING (host, line) GROUP BY doc_id),
each AS (SELECT doc_id, host, i, line, array_to_string(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+'), ' ') AS norm FROM (SELECT doc_id, host, unnest(split) AS line, unnest(range(len(split))) AS i FROM w)),
clean AS (SELECT e.doc_id, md5(coalesce(string_agg(e.line, chr(10) ORDER BY e.i) FILTER (f.host IS NULL), '')) AS cleaned_md5 FROM each e LEFT JOIN freq f ON f.host = e.host AND f.line = e.norm GROUP BY e.doc_id),
base AS (SELECT doc_id, len(words) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(lost_words, 0) AS lost_words
  FROM w LEFT JOIN dups USING (doc_id) LEFT JOIN reps USING (doc_id) LEFT JOIN lost USING (doc_id)),
verdict AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT base_failed AND NOT 100 * lost_words > {MAX_LOST_PERCENT} * n_words AS kept, lost_words::BIGINT AS lost_words, cleaned_md5
FROM verdict JOIN clean USING (doc_id)
"""

"""Document fingerprints by one-permutation MinHash.

Each shingle of five words is hashed once; the hash says both the bin and the value in it. Bins that stay empty
take the value of a full bin that a hash of (bin, attempt) names, the first full one (optimal densification).
Of every bin's value the low bits are kept, and the share of equal bins is corrected for chance.

Nulls: a null text counts as an empty one. A text without words has the fingerprint "" and is like other such
texts (1.0) and unlike all else (0.0); with fewer than five words its words are one shingle. Equal texts have equal
fingerprints. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, documents, map_arrow, mixed, shingle_hashes, word_hashes

SHINGLE = 5
BINS = 512
BITS = 4
#: Rows are dealt by range of doc_id; a range has about so many bytes of text.
RANGE_BYTES = 8 << 20
MAX_RANGES = 8192


@lru_cache(maxsize=64)
def probes(bins: int, block: int) -> np.ndarray:
    """The bins that each bin asks at the attempts of a block: 8, then twice as many in each further block."""
    attempts = np.arange(8 << block, dtype=np.uint64) + np.uint64((8 << block) - 7)
    at = np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed(at[None, :] + attempts[:, None]) % np.uint64(bins)).astype(np.int64)


def donors(full: np.ndarray) -> np.ndarray:
    """For every bin the full bin whose value it takes: itself, or the first full one in the sequence of its hashes."""
    out = np.arange(len(full))
    empty = np.flatnonzero(~full)
    block = 0
    while len(empty):
        asked = probes(len(full), block)[:, empty]
        hit = full[asked]
        first = hit.argmax(axis=0)
        each = np.arange(len(empty))
        found = hit[first, each]
        out[empty[found]] = asked[first, each][found]
        empty = empty[~found]
        block += 1
    return out


class Fingerprinter:
    def __init__(self, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE):
        if bins & (bins - 1) or bits not in (1, 2, 4, 8):
            raise ValueError("bins must be a power of two, bits 1, 2, 4 or 8")
        self.bins, self.bits, self.shingle = bins, bits, shingle
        self.shift = np.uint64(64 - bins.bit_length() + 1)
        self.known = WordHashes()

    def values(self, text: bytes) -> np.ndarray | None:
        """The low bits of every bin; None for a text without words."""
        words = text.split()
        if not words:
            return None
        h = shingle_hashes(word_hashes(words, self.known), self.shingle)
        bin_, value = (h >> self.shift).astype(np.int64), mixed(h)
        least = np.full(self.bins, np.iinfo(np.uint64).max, dtype=np.uint64)
        np.minimum.at(least, bin_, value)
        full = np.zeros(self.bins, dtype=bool)
        full[bin_] = True
        # The bin is mixed in, so that copies of one value agree by chance with 2^-bits in each bin, not in all at once.
        taken = mixed(least[donors(full)] ^ (np.arange(self.bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        return (taken & np.uint64((1 << self.bits) - 1)).astype(np.uint8)

    def packed(self, values: np.ndarray | None) -> str:
        if values is None:
            return ""
        bits = np.unpackbits(values[:, None], axis=1, bitorder="little")[:, : self.bits]
        return np.packbits(bits.ravel(), bitorder="little").tobytes().hex()

    def likeness(self, a: np.ndarray | None, b: np.ndarray | None) -> float:
        """The estimated Jaccard similarity: r bits agree by chance with 2^-r, so that share is taken off."""
        if a is None or b is None:
            return float(a is b)
        chance = 2.0**-self.bits
        return float(np.clip((np.mean(a == b) - chance) / (1 - chance), 0, 1))


def unpacked(fingerprint: str, bits: int = BITS) -> np.ndarray | None:
    """The bins' values from a fingerprint as it is stored."""
    if not fingerprint:
        return None
    flat = np.unpackbits(np.frombuffer(bytes.fromhex(fingerprint), np.uint8), bitorder="little").reshape(-1, bits)
    return (flat << np.arange(bits, dtype=np.uint8)).sum(axis=1).astype(np.uint8)


def fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint of every row; no shuffle."""

    def kernel(batches):
        own = Fingerprinter(bins, bits)
        for batch in batches:
            out = [own.packed(own.values((t.as_py() or "").encode())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """text with its last quarter (in code points, rounded down) replaced by the first as many of the next text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def range_starts(docs: DataFrame) -> list[int]:
    """Ids at which ranges of about RANGE_BYTES of text begin, none twice: at most MAX_RANGES numbers."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n"), F.count("doc_id").alias("ids")).first()
    n = int(min(MAX_RANGES, (size.n or 0) // RANGE_BYTES))
    if n < 2 or not size.ids:
        return []
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / n for i in range(1, n)], 20 * n)).first()[0]
    return sorted(set(cuts))


def with_next(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """For each row, in ascending (doc_id, text) with null ids first: its fingerprint, that of its edited text and their likeness, and the likeness to the next row (after the last: the first).

    The texts are shuffled once, by range of doc_id, and read in order, two rows at a time. The first row of a
    range goes to the range before as well, as what follows the last row there.
    """
    starts = range_starts(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = rows.orderBy(F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit(""))).limit(1).select(F.lit(len(starts)).alias("part"), F.lit(1).alias("tail"), "doc_id", "text")
    bounds = np.array(starts, dtype=np.int64)

    def dealt(batches):
        import pyarrow.compute as pc

        for batch in batches:
            ids = batch.column(0)
            known = np.asarray(ids.is_valid())
            values = ids.fill_null(0).to_numpy(zero_copy_only=False)
            part = np.where(known, np.searchsorted(bounds, values, side="right"), 0).astype(np.int32)
            zero = pa.array(np.zeros(len(ids), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(part), zero, ids, batch.column(1)], ["part", "tail", "doc_id", "text"])
            at_start = np.flatnonzero(known & np.isin(values, bounds))
            if len(at_start):
                at = pa.array(at_start)
                yield pa.RecordBatch.from_arrays([pa.array(part[at_start] - 1, pa.int32()), pa.array(np.ones(len(at), np.int32)), pc.take(ids, at), pc.take(batch.column(1), at)], ["part", "tail", "doc_id", "text"])

    kinds = "part int, tail int, doc_id long, text string"
    parts = map_arrow(rows, dealt, kinds).unionByName(first)
    parts = parts.repartition(max(1, len(starts) + 1), "part").sortWithinPartitions("part", "tail", F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit("")))

    def kernel(batches):
        own = Fingerprinter(bins, bits)
        before = None  # (part, doc_id, text, values) of the row that waits for what follows it
        for batch in batches:
            out = []
            for part, tail, doc_id, text in zip(*(batch.column(i) for i in range(4)), strict=True):
                part, tail, text = part.as_py(), tail.as_py(), text.as_py() or ""
                if before is None and tail:
                    continue  # a further row with the id that begins the next range
                values = own.values(text.encode())
                if before is not None:
                    at, was, said = before
                    changed = edited(at[1], text)
                    altered = own.values(changed.encode())
                    out.append((at[0], len(at[1]), hashlib.sha256(changed.encode()).hexdigest(), own.packed(was), own.packed(altered), own.likeness(was, altered), own.likeness(was, values)))
                before = None if tail else ((doc_id.as_py(), text), values, part)
            names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(names))
        if before is not None:
            raise ValueError("a range without a row after its last")

    return map_arrow(parts, kernel, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    return with_next(documents(spark, sf_dir))

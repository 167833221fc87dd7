"""N-gram Jaccard join: documents whose sets of word 3-grams are 90 % alike, and their components.

1. Equal sets are one class. 2. Classes that can be alike get into one block: similar sets differ in a bounded number of
elements. The elements are dealt to more parts than that by a hash, so at least one part with elements is the same in
both; classes that share the signature of a part are candidates. Sizes are cut into classes whose neighbours cover all
partners, and a set signs for its own and the next smaller one. Candidates whose sketches (bits of their elements) say that
they can't be alike aren't put together: else chance would chain ever more of a growing table to one block. This is exact:
no similar pair is missed. 3. Inside the blocks, T-occurrence search with DivideSkip finds the links (set_joins). 4. The
links' components are those of the documents.

Nulls: a null or blank text has no set and is linked with nothing. A null doc_id counts last for the component's
least id. Rows with one doc_id and different texts are different documents; repeated rows are copies. Very long texts
give large sets; a cell holds at most two parts of a block. An empty table gives an empty result; other columns are
ignored. Elements are 64-bit hashes of the grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, documents, gathered, map_arrow, maybe_broadcast, mixed, release, shingle_hashes, text_hash, word_hashes, written
from .components import components
from .set_joins import jaccard_links, whole_groups

GRAM = 3
PERCENT = 90
#: Signatures are looked through in so many shares.
PASSES = 8
#: At most so many common n-grams are known to every task (1 MB).
COMMON = 1 << 17
#: Members of signatures that are looked at together, members up to which all pairs of a signature are compared at once, and pairs
#: compared at once.
MEMBERS, FEW, PAIRS = 20_000, 32, 100_000


def grams(text: str, known: WordHashes, n: int = GRAM) -> np.ndarray:
    """The distinct n-grams of a text as sorted hashes. A-Z are lower-cased, other letters not."""
    return np.unique(shingle_hashes(word_hashes(text.encode().lower().split(), known), n))


def set_id(elements: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(elements.tobytes())


def sketch(elements: np.ndarray) -> bytes:
    """A bit for each element, by its hash, among a power of two of bits: two to four for an element, 64 at least."""
    flags = np.zeros(1 << max(6, (2 * len(elements) - 1).bit_length()), np.uint8)
    flags[elements & np.uint64(len(flags) - 1)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


class Sketches:
    """Sketches of many sets, as matrices by width: what two have in common bounds the overlap of their sets from above."""

    def __init__(self, sizes: np.ndarray, bits: pa.Array, percent: int):
        self.percent, self.sizes = percent, sizes
        self.words = pc.binary_length(bits).to_numpy().astype(np.int64) // 8
        self.at = np.zeros(len(sizes), np.int64)  # of a set among those of its width
        self.known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for w in np.unique(self.words).tolist():
            own = np.flatnonzero(self.words == w)
            self.at[own] = np.arange(len(own))
            flat = b"".join(bits.take(pa.array(own)).to_pylist())
            rows = np.frombuffer(flat, np.uint64).reshape(len(own), w)
            self.known[w, w] = rows, np.bitwise_count(rows).sum(axis=1, dtype=np.int64)

    def folded(self, words: int, to: int) -> tuple[np.ndarray, np.ndarray]:
        """The sketches of a width, folded to a smaller one, and how many bits each has."""
        found = self.known.get((words, to))
        if found is None:
            rows = self.folded(words, 2 * to)[0]
            rows = rows[:, :to] | rows[:, to:]
            found = self.known[words, to] = rows, np.bitwise_count(rows).sum(axis=1, dtype=np.int64)
        return found

    def maybe(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Flags of the pairs that may be similar; similar ones all are among them."""
        n, m = self.sizes[a], self.sizes[b]
        out = 100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)
        left = np.flatnonzero(out)
        widths = self.words[a[left]] << 32 | self.words[b[left]]
        for w in np.unique(widths).tolist():
            x, y = w >> 32, w & 0xFFFFFFFF
            (rows_a, bits_a), (rows_b, bits_b) = self.folded(x, min(x, y)), self.folded(y, min(x, y))
            of = left[widths == w]
            for start in range(0, len(of), max(1, PAIRS // min(x, y))):
                now = of[start : start + max(1, PAIRS // min(x, y))]
                i, j = self.at[a[now]], self.at[b[now]]
                common = np.bitwise_count(rows_a[i] & rows_b[j]).sum(axis=1, dtype=np.int64)
                overlap = common + np.minimum(n[now] - bits_a[i], m[now] - bits_b[j])
                out[now] = (100 + self.percent) * overlap >= self.percent * (n[now] + m[now])
        return out


def chained(keys: np.ndarray, sketches: Sketches) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members (by their places) of one key, ascending, that may be similar: as many as join whatever may be.

    Of a key with many members each is compared only with those that nothing joins to it yet.
    """
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(keys))
    few = np.repeat(ends - starts <= FEW, ends - starts)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for d in range(1, FEW):
        a = np.flatnonzero((keys[:-d] == keys[d:]) & few[d:])
        if not len(a):
            break
        a = a[sketches.maybe(a, a + d)]
        out.append((a, a + d))
    for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
        if end - start <= FEW:
            continue
        left = np.arange(start, end)
        while len(left) > 1:
            waiting, left = [int(left[0])], left[1:]
            while waiting and len(left):
                x = waiting.pop()
                near = sketches.maybe(np.full(len(left), x), left)
                found, left = left[near], left[~near]
                out.append((np.full(len(found), x), found))
                waiting += found.tolist()
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


#: More parts than differing elements, so that sets with up to so many empty parts share one with elements.
SPARE = 2


class Signer:
    """The signatures of a set's parts; similar sets share one.

    Common elements are left out of the parts, else a line that many documents have would make parts alike: what differs
    among the rest is no more than what differs at all. Sets with few others sign with all their elements; the bounds
    overlap by what two similar sets can differ in, so a pair always has one way in common.
    """

    def __init__(self, percent: int, common: np.ndarray | None = None):
        self.percent = percent
        self.common = np.zeros(0, np.uint64) if common is None else common  # sorted
        self.ends: list[int] = [0]  # the largest size of each class of sizes; class 0 is empty

    def size_class(self, n: int) -> int:
        while self.ends[-1] < n:
            self.ends.append((self.ends[-1] + 1) * 100 // self.percent)
        return int(np.searchsorted(self.ends, n))

    def rare(self, elements: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return elements
        at = np.minimum(np.searchsorted(self.common, elements), len(self.common) - 1)
        return elements[self.common[at] != elements]

    def __call__(self, elements: np.ndarray) -> np.ndarray:
        out = []
        rare = self.rare(elements)
        own = self.size_class(len(elements))
        for c in (own - 1, own):
            differing = self.ends[c] * (100 - self.percent) // self.percent
            if c < 1 or not differing:  # only equal sets are similar
                continue
            spare = max(SPARE, (differing + 1) // 5)
            parts = differing + 1 + spare
            enough = 2 * parts
            if len(rare) >= enough:
                out.append(self.sign(rare, parts, spare, c << 1))
            if len(rare) < enough + differing:
                out.append(self.sign(elements, parts, spare, c << 1 | 1))
        return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)

    @staticmethod
    def sign(elements: np.ndarray, parts: int, spare: int, way: int) -> np.ndarray:
        h = mixed(elements)
        at = (h % np.uint64(parts)).astype(np.int64)
        sums = np.zeros(parts, dtype=np.uint64)
        np.add.at(sums, at, mixed(h + np.uint64(1)))
        full = np.bincount(at, minlength=parts) > 0
        keys = mixed(sums ^ mixed(np.arange(parts, dtype=np.uint64) + np.uint64(way << 32)))
        return keys[full] if parts - full.sum() <= spare else keys


def common_grams(docs: DataFrame, n: int, most: int = COMMON) -> np.ndarray:
    """Sorted hashes of the n-grams that several different sets of a task have, the most frequent by a histogram: at most `most`.

    They only steer the signatures; any choice gives the same result. The bound doesn't follow the input.
    """

    def kernel(batches):
        known = WordHashes()
        for batch in batches:
            different = {}
            for text in batch.column(0):
                elements = grams(text.as_py() or "", known, n)
                different[set_id(elements)] = elements
            found, counts = np.unique(np.concatenate(list(different.values()) or [np.zeros(0, np.uint64)]), return_counts=True)
            often = counts > 2
            yield pa.RecordBatch.from_arrays([pa.array(found[often].astype(np.int64)), pa.array(counts[often], pa.int64())], ["gram", "sets"])

    sums = written(map_arrow(docs.select("text"), kernel, "gram long, sets long").groupBy("gram").agg(F.sum("sets").alias("sets")), "common")
    grade = F.floor(8 * F.log2("sets"))
    left, least = most, None
    for x in sorted(sums.groupBy(grade.alias("grade")).count().collect(), reverse=True):
        left -= x["count"]
        if left < 0:
            break
        least = x.grade
    if least is None:
        return np.zeros(0, np.uint64)
    return np.sort(np.array([r.gram for r in sums.where(grade >= least).select("gram").toLocalIterator()], dtype=np.int64).astype(np.uint64))


def signed(docs: DataFrame, n: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_id, block (64 bits of it), signatures, bits (a sketch) of each row, as a table without texts."""

    common = docs.sparkSession.sparkContext.broadcast(common_grams(docs, n))

    def kernel(batches):
        known, signer = WordHashes(), Signer(percent, common.value)
        for batch in batches:
            sizes, ids, keys, ends, bits = [], [], [], [0], []
            for text in batch.column(2):
                elements = grams(text.as_py() or "", known, n)
                sizes.append(len(elements))
                ids.append(set_id(elements))
                keys.append(signer(elements))
                bits.append(sketch(elements) if len(keys[-1]) else None)
                ends.append(ends[-1] + len(keys[-1]))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64())), pa.array(bits, pa.binary())], ["doc_id", "text_hash", "n_shingles", "set_id", "signatures", "bits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), "text")
    out = map_arrow(rows, kernel, "doc_id long, text_hash long, n_shingles long, set_id string, signatures array<long>, bits binary")
    return written(out.withColumn("block", F.xxhash64("set_id")), "signed")


def blocks(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """id (the 64 bits of a set), component: the candidates, by what signatures they share and what their sketches allow.

    Signatures are many; they are looked through in PASSES, each with its share of them, so that neither a task's sums nor
    the shuffled rows on the disks are those of all. Of the few that several sets share, the sets are compared by their sketches.
    """
    keys = rows.select("block", F.explode("signatures").alias("key"))
    members = []
    for i in range(PASSES):
        own = keys.where(F.pmod("key", F.lit(PASSES)) == i)
        shared = written(own.groupBy("key").agg(F.min("block").alias("least"), F.max("block").alias("most")).where("least < most").select("key"), "shared")
        members.append(written(own.join(maybe_broadcast(shared), "key").select("key", "block"), "members"))
        release(shared)
    every = members[0]
    for more in members[1:]:
        every = every.unionByName(more)
    some = every.select("block").distinct()
    bits = written(rows.select("block", "n_shingles", "bits").dropDuplicates(["block"]).join(some, "block"), "bits")

    def kernel(batches):
        for batch, key in whole_groups(gathered(batches, MEMBERS), 1):
            block = batch.column(1).to_numpy()
            a, b = chained(key[0], Sketches(batch.column(2).to_numpy(), batch.column(3), percent))
            yield pa.RecordBatch.from_arrays([pa.array(block[a]), pa.array(block[b])], ["block", "least"])

    dealt = every.distinct().join(maybe_broadcast(bits), "block").select("key", "block", "n_shingles", "bits")
    pairs = written(map_arrow(dealt.repartition("key").sortWithinPartitions("key"), kernel, "block long, least long").distinct(), "pairs")
    out = written(components(pairs), "blocks")
    release(pairs, bits, *members)
    return out


def linked(docs: DataFrame, n: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, component (a set_id; of a row without a set, null) of each row."""
    rows = signed(docs, n, percent)
    candidates = blocks(rows, percent)
    with_signatures, rows = rows, written(rows.drop("signatures", "bits"), "rows")
    release(with_signatures)
    first = rows.where("n_shingles > 0").groupBy("set_id", "block").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("row"))
    wanted = first.join(candidates.select(F.col("id").alias("block"), F.col("component").alias("in")), "block").select("set_id", "in", F.col("row.doc_id").alias("doc_id"), F.col("row.text_hash").alias("text_hash"))
    wanted = written(wanted, "wanted")

    def kernel(batches):
        known = WordHashes()
        for batch in batches:
            sets = [grams(t.as_py() or "", known, n) for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(set_id, sets), pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], ["block", "id", "elements"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), "text")
    keys = wanted.select(F.col("in").alias("block"), F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    found = texts.join(maybe_broadcast(keys), (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("block", "text")
    sets = written(map_arrow(found, kernel, "block long, id string, elements array<long>").dropDuplicates(["block", "id"]), "sets")
    merged = components(jaccard_links(sets, percent)).select(F.col("id").alias("set_id"), F.col("component").alias("merged"))
    classes = first.select("set_id").join(merged, "set_id", "left").select("set_id", F.coalesce("merged", "set_id").alias("component"))
    classes = written(classes, "classes")  # not joined where it was summed: AQE can split the rows of a set with many copies
    some = rows.where("n_shingles > 0").select("doc_id", "text_hash", "n_shingles", "set_id").join(classes, "set_id").drop("set_id")
    none = rows.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.lit(None).cast("string").alias("component"))
    return some.unionByName(none)


def with_component_ids(rows: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id of the component) of `linked` rows."""
    rows = written(rows, "linked")
    some = rows.where(F.col("component").isNotNull())
    least = written(some.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    out = some.join(least, "component").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(rows.where(F.col("component").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, n: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, that of the least (doc_id, text hash); rows without words stay."""
    rows = written(linked(docs, n, percent), "linked")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    keep = rows.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(order).alias("row")).select("row.doc_id", "row.text_hash")
    keep = keep.unionByName(rows.where(F.col("component").isNull()).select("doc_id", "text_hash").distinct())
    keep = keep.select(F.col("doc_id").alias("_sylva_id"), F.col("text_hash").alias("_sylva_hash"))
    keep = maybe_broadcast(keep)
    kept = docs.join(keep, (text_hash(docs["text"]) == keep["_sylva_hash"]) & docs["doc_id"].eqNullSafe(keep["_sylva_id"]), "left_semi")
    counted = rows.where(F.col("component").isNotNull()).groupBy("doc_id", "text_hash").count().where("count > 1")
    return kept.dropDuplicates(["doc_id", "text"]) if counted.limit(1).count() else kept


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    return with_component_ids(linked(documents(spark, sf_dir)))


#: The same in DuckDB's SQL, pair by pair.
OP6_SQL = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
grams AS (SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, CASE WHEN len(words) < {GRAM} THEN words ELSE words[i:i + {GRAM - 1}] END AS gram
    FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - {GRAM - 2}))) AS i FROM w WHERE len(words) > 0))),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS overlap FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * overlap >= {PERCENT} * (x.n + y.n - overlap)),
reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents
  UNION
    SELECT reach.doc_id, l.b FROM reach JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = reach.other)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM documents d JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id
"""

"""Substring dedup: paragraphs that collide by MinHash bands, verified by exact Jaccard similarity, and their components.

Repeated passages stand in the midst of other text, so paragraphs can't be lines. A paragraph here is WORDS words around a
center, a shingle that is chosen by content: of each GAP neighbours the one with the least hash. So a passage that two
documents share has the same centers in both. Each center has two paragraphs, for it stands in the first or in the last
quarter, so that a changed word spoils one of them at most. Two paragraphs of 55 words have 51 shingles; 80 % of similarity
asks for 46 common ones: a run of 50 words, or 55 with a changed word among them.

1. What has no run of words in common with another document has no similar paragraph either: a run of 23 shingles
is left of each similar pair (an edited word takes five). Of each REACH neighbouring runs of RUN words one is
chosen by its hash, so such a run of shingles holds one; only around the chosen runs that two documents have, paragraphs are
made, and their shingles kept. 2. Equal paragraphs are a class. Classes collide if they agree in center and in one of BANDS bands, of ROWS MinHash
values each: a pair with 46 of 56 common shingles by a chance of 0.99, and a passage has several. 3. The classes of a center
that collide are a block, in which set_joins finds all pairs with an exact similarity of PERCENT, whatever their number.
4. The components of these links are the kinds. In a kind that several documents have, the paragraphs of the first document
(by doc_id) stay, the others are removals; of a linked paragraph only what lies between the first and the last shingle that
its partner has. 5. Spans of a document that overlap are one passage; passages that share kinds, directly or through others,
are a component.

In 300 tries each, all runs of 51 words and more were found; 60 words with one changed in the middle in 0.99, with the 16th
changed in 0.97, 70 and 100 words with one changed in the middle in 0.99 and all. A passage's ends may be missed by some words, as its
first and last paragraphs needn't begin and end where it does.

Nulls: a null text, and one with fewer than MIN_WORDS words, has no paragraph. Rows with the same doc_id and text are one
document; a null doc_id counts last. Repetition within one document alone is none across documents. Of texts with the same
words all but the first are removals from end to end, in windows of WORDS. An empty table gives an empty result; other columns
are ignored. A text is read whole, whatever its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, documents, gathered, map_arrow, maybe_broadcast, mixed, release, shingle_hashes, text_hash, word_hashes, written
from .components import components
from .set_joins import is_cut, jaccard_links, whole_groups

SHINGLE, PERCENT = 5, 80
#: Words of a paragraph; of one that a text's begin or end cuts off, at least.
WORDS, MIN_WORDS = 55, 50
#: Of so many neighbouring shingles at least one is a center; where it stands among a paragraph's shingles.
GAP, OFFSETS = 7, (12, 38)
BANDS, ROWS = 3, 1
#: Words of the runs by which texts are chosen; of so many neighbouring runs at least one counts.
RUN, REACH = 12, 17

_BASE = 0x9E3779B97F4A7C15 | 1
#: A paragraph's bands are kept in one number, so many bits of each: they tell the paragraphs of one center apart.
BITS = 64 // BANDS
#: Rows that the kernels over centers and their texts take at once.
GATHERED = 8000
_SEEDS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))


def chosen(hashes: np.ndarray, width: int) -> np.ndarray:
    """The places that are the last least of some `width` neighbours (of all, where there are fewer)."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    low = np.uint64(0xFFFFFFFF)
    least = (hashes & ~low) | (low - np.arange(len(hashes), dtype=np.uint64))
    width = min(width, len(hashes))
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: size - width], least[width - size :])
    at = (low - (least & low)).astype(np.int64)
    return at[np.append(True, at[1:] != at[:-1])]


class Reader:
    """Words, runs and paragraphs of texts."""

    def __init__(self) -> None:
        self.known = WordHashes()
        self.up = self.down = np.ones(1, np.uint64)

    def words(self, text: str | None) -> np.ndarray:
        return word_hashes((text or "").encode().split(), self.known)

    def runs(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the runs that count; none of a text too short for a paragraph."""
        if len(h) < MIN_WORDS:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        all_runs = shingle_hashes(h, RUN)
        at = chosen(all_runs, REACH)
        return at, all_runs[at]

    def paragraphs(self, h: np.ndarray, near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """class, first word, end and named center of each paragraph, and the hashes of all shingles. near: flags of the places where centers count."""
        grams = shingle_hashes(h, SHINGLE)
        center = chosen(grams, GAP)
        if near is not None:
            center = center[near[center]]
        start = (center[:, None] - np.array(OFFSETS)).ravel()
        center = np.repeat(center, len(OFFSETS))
        a, b = np.maximum(start, 0), np.minimum(start + WORDS, len(h))
        wide = b - a >= MIN_WORDS
        start, center, a, b = start[wide], center[wide], a[wide], b[wide]
        if len(h) >= len(self.up):
            self.up = np.cumprod(np.append(np.uint64(1), np.full(2 * len(h), _BASE, np.uint64)))
            self.down = np.cumprod(np.append(np.uint64(1), np.full(2 * len(h), pow(_BASE, -1, 1 << 64), np.uint64)))
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.up[: len(h)], out=sums[1:])
        whole = (sums[b] - sums[a]) * self.down[a]  # equal runs of words have equal ones wherever they stand
        named = mixed(grams[center] + (center - start).astype(np.uint64))
        return mixed(whole ^ named), a, b, named, grams

    @staticmethod
    def bands(grams: np.ndarray, a: np.ndarray, b: np.ndarray, center: np.ndarray) -> np.ndarray:
        """The keys by which paragraphs of a center collide, BITS of each band in one number."""
        edges = np.stack([a, b - SHINGLE + 1], axis=1).ravel()
        # Each second run, between a paragraph's end and the next one's begin, isn't used.
        values = np.stack([np.minimum.reduceat(np.append(mixed(grams ^ s), ~np.uint64(0)), edges)[::2] for s in _SEEDS]) if len(a) else np.zeros((len(_SEEDS), 0), np.uint64)
        keys = [mixed(center ^ mixed(sum((values[k * ROWS + r] * np.uint64(2 * r + 3) for r in range(ROWS)), np.uint64(k + 1)))) for k in range(BANDS)]
        return sum((key >> np.uint64(64 - BITS)) << np.uint64(BITS * k) for k, key in enumerate(keys))


def _lists(values: list[np.ndarray], kind: pa.DataType, ends: list[int] | None = None) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]) if ends is None else ends
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else [], kind))


def _place(doc_id: str = "doc_id", more: str = "text_hash") -> Column:
    """What orders documents: doc_id (null last), then the text's hash."""
    return F.struct(F.col(doc_id).isNull().alias("none"), doc_id, more)


def shared_runs(rows: DataFrame) -> DataFrame:
    """text_hash, keys: the runs that count and that another document has, too, for each different text that has some; as a table."""

    def kernel(batches):
        reader = Reader()
        for batch in batches:
            keys = [np.unique(reader.runs(reader.words(t.as_py()))[1]).astype(np.int64) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(keys, pa.int64())], ["doc_id", "text_hash", "keys"])

    table = written(map_arrow(rows, kernel, "doc_id long, text_hash long, keys array<long>").where(F.size("keys") > 0), "runs")
    document = F.xxhash64("doc_id", "text_hash")
    each = table.select(document.alias("document"), F.explode("keys").alias("key"))
    often = each.groupBy("key").agg(F.min("document").alias("a"), F.max("document").alias("b")).where("a != b").select("key")
    often = written(often, "often")
    hits = table.select("text_hash", F.explode("keys").alias("key")).join(maybe_broadcast(often), "key")
    out = written(hits.groupBy("text_hash").agg(F.collect_set("key").alias("keys")), "hits")
    release(table, often)
    return out


def paragraph_table(rows: DataFrame, texts: DataFrame, hits: DataFrame) -> DataFrame:
    """text_hash, copied, x (class, start, n, named center, bands), grams: the paragraphs of each different text around shared runs, as a table.

    texts: text_hash, doc_id (of the first document with it), copied. grams: 32 bits of each shingle, 0 outside of paragraphs.
    """
    names = ["class", "start", "n", "named", "bands"]

    def kernel(batches):
        reader = Reader()
        for batch in batches:
            found, ends, shingles = [], [0], []
            for text, keys in zip(batch.column(2), batch.column(3), strict=True):
                h = reader.words(text.as_py())
                at, runs = reader.runs(h)
                at = at[np.isin(runs, keys.values.to_numpy().astype(np.uint64))]
                flags = np.zeros(len(h) + 1, np.int64)  # a common run may begin and end so many words before and after
                np.add.at(flags, np.maximum(at - REACH, 0), 1)
                np.add.at(flags, np.minimum(at + RUN + REACH - SHINGLE + 1, len(h)), -1)
                class_, a, b, named, grams = reader.paragraphs(h, np.cumsum(flags) > 0)
                found.append((class_.astype(np.int64), a.astype(np.int32), (b - a).astype(np.int32), named.astype(np.int64), reader.bands(grams, a, b, named).astype(np.int64)))
                ends.append(ends[-1] + len(a))
                inside = np.zeros(len(grams) + 1, np.int64)
                np.add.at(inside, a, 1)
                np.add.at(inside, b - SHINGLE + 1, -1)
                shingles.append(np.where(np.cumsum(inside)[:-1] > 0, (grams >> np.uint64(32)).astype(np.uint32), np.uint32(0)).view(np.int32))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            columns = [pa.array(np.concatenate(c), kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)] if found else [pa.array([], kind) for kind in kinds]
            x = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), x, _lists(shingles, pa.int32())], ["text_hash", "copied", "x", "grams"])

    wanted = maybe_broadcast(hits.join(texts, "text_hash").select(F.col("text_hash").alias("h"), F.col("doc_id").alias("d"), "copied", "keys"))
    found = rows.join(wanted, (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("text_hash", "copied", "text", "keys")
    kind = "x array<struct<class:long,start:int,n:int,named:long,bands:long>>"
    return written(map_arrow(found, kernel, f"text_hash long, copied boolean, {kind}, grams array<int>"), "paragraphs")


def colliding(named: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """Flags of the classes that another one agrees with in center and in a band. named: their centers, in order."""
    center = np.cumsum(np.append(False, named[1:] != named[:-1])).astype(np.uint64)
    out = np.zeros(len(named), bool)
    for k in range(BANDS):
        band = (bands.view(np.uint64) >> np.uint64(BITS * k)) & np.uint64((1 << BITS) - 1)
        _, key, often = np.unique((center << np.uint64(BITS)) | band, return_inverse=True, return_counts=True)
        out |= often[key] > 1
    return out


def center_table(paragraphs: DataFrame) -> DataFrame:
    """class, text_hash, start, n, named, repeated, sets, first, lead: paragraphs whose class several documents have or that collides, as a table.

    repeated: whether several documents have the class. sets: how many classes of its center collide, 0 if it doesn't. first: of
    one paragraph of each class; lead: of one of each center with sets. All of a center meets in one task: its paragraphs are
    shuffled once, for classes, bands and the sizes of blocks.
    """
    each = paragraphs.select("text_hash", "copied", F.explode("x").alias("x")).select("x.named", "x.class", "text_hash", "x.start", "x.n", "x.bands", "copied")

    def centers(batch):
        named, class_, text, _, _, bands, copied = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(7))
        new = np.append(True, (named[1:] != named[:-1]) | (class_[1:] != class_[:-1]))
        first = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        repeated = np.logical_or.reduceat(copied, first) | (text[first] != text[np.append(first[1:], len(text)) - 1])
        collides = colliding(named[first], bands[first])
        center = np.cumsum(np.append(False, named[first[1:]] != named[first[:-1]]))
        sets = np.where(collides, np.bincount(center, collides).astype(np.int64)[center], 0)
        lead = np.zeros(len(named), bool)
        asked = np.flatnonzero(collides)
        lead[first[asked[np.append(True, center[asked[1:]] != center[asked[:-1]])[: len(asked)]]]] = True
        at = np.flatnonzero((repeated | collides)[of])
        columns = [batch.column(c).take(pa.array(at)) for c in (1, 2, 3, 4, 0)] + [pa.array(c) for c in (repeated[of][at], sets[of][at], new[at], lead[at])]
        return pa.RecordBatch.from_arrays(columns, ["class", "text_hash", "start", "n", "named", "repeated", "sets", "first", "lead"])

    def kernel(batches):
        for batch, _ in whole_groups(gathered(batches, GATHERED), 1):
            yield centers(batch)

    dealt = each.repartition("named").sortWithinPartitions("named", "class", "text_hash", "start")
    schema = "class long, text_hash long, start int, n int, named long, repeated boolean, sets long, first boolean, lead boolean"
    return written(map_arrow(dealt, kernel, schema), "centers")


def class_links(grams: DataFrame, centers: DataFrame) -> DataFrame:
    """a, b, lo, hi, whole: what set_joins finds in the classes that collide, as a table. grams: text_hash, grams; centers: of center_table."""
    counts = centers.where("lead").select(F.col("named").alias("block"), "sets", (F.col("sets") * (WORDS - SHINGLE + 1)).alias("total"))
    asked = centers.where("first AND sets > 0").select("text_hash", "class", "named", "start", "n", "repeated", F.lit(None).cast("array<int>").alias("grams"))
    none = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in ("class", "named", "start", "n", "repeated")]
    both = asked.unionByName(grams.select("text_hash", *none, "grams")).repartition("text_hash").sortWithinPartitions("text_hash", F.col("class").asc_nulls_first())

    def kernel(batches):
        last = np.zeros(0, np.int32)  # the shingles of the text that the batch before has ended with
        for batch in gathered(batches, GATHERED):
            lengths = batch.column(6).value_lengths().fill_null(0).to_numpy().astype(np.int64)
            values = np.concatenate([last, batch.column(6).flatten().to_numpy()])
            at = np.flatnonzero(batch.column(1).is_valid().to_numpy(zero_copy_only=False))
            is_text = np.ones(len(lengths), bool)
            is_text[at] = False
            begins = np.concatenate([[0], (len(last) + np.cumsum(lengths) - lengths)[is_text]])
            text, class_, named, start, n, repeated = (batch.column(c).take(pa.array(at)) for c in range(6))
            sizes = n.to_numpy().astype(np.int64) - SHINGLE + 1
            ends = np.cumsum(sizes)
            places = np.repeat(begins[np.cumsum(is_text)[at]] + start.to_numpy() - (ends - sizes), sizes) + np.arange(sizes.sum())
            elements = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values[places]))
            last = values[begins[-1] :]
            yield pa.RecordBatch.from_arrays([named, class_, elements, text, repeated], ["block", "id", "elements", "owner", "repeated"])

    sets = map_arrow(both, kernel, "block long, id long, elements array<int>, owner long, repeated boolean")
    return written(jaccard_links(sets, PERCENT, spans=True, counts=counts), "links")


def similar_spans(centers: DataFrame, links: DataFrame) -> DataFrame:
    """text_hash, a, b, kind: the paragraphs of each different text that other documents have, too, by their words; as a table."""
    # A class has one center: in a block of one cell, the cell has told the kinds. Only blocks of several cells have more to join.
    cut = links.where("NOT whole")
    merged = written(components(cut.select("a", "b")), "merged")
    parts = cut.groupBy(F.col("b").alias("class")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).join(merged.withColumnRenamed("id", "class"), "class")
    whole = F.col("repeated")
    there = centers.where(F.col("first") & is_cut(F.col("sets"), F.col("sets") * (WORDS - SHINGLE + 1))).select("class", "text_hash", "repeated")
    kinds = there.join(parts, "class", "left").where(whole | F.col("component").isNotNull()).select("class", "text_hash", "repeated", F.coalesce("component", "class").alias("kind"), F.when(~whole, F.col("lo")).alias("lo"), F.when(~whole, F.col("hi")).alias("hi"))
    kinds = written(kinds, "kinds")
    # A kind of which all paragraphs are in one document is none across documents.
    across = kinds.groupBy("kind").agg(F.min("text_hash").alias("x"), F.max("text_hash").alias("y"), F.max("repeated").alias("r")).where("r OR x != y").select("kind")
    kept = kinds.join(across, "kind").select("class", "kind", "lo", "hi")
    kept = kept.unionByName(links.where("whole").select(F.col("b").alias("class"), F.col("a").alias("kind"), "lo", "hi"))
    no = F.lit(None).cast("int")
    kept = kept.unionByName(centers.where("first AND repeated AND sets = 0").select("class", F.col("class").alias("kind"), no.alias("lo"), no.alias("hi")))
    kept = written(kept, "kept_kinds")
    spans = centers.select("text_hash", "class", "start", "n").join(maybe_broadcast(kept), "class")
    a, b = F.col("start") + F.coalesce("lo", F.lit(0)), F.col("start") + F.least("n", F.coalesce(F.col("hi") + SHINGLE - 1, "n"))
    out = written(spans.select("text_hash", a.alias("a"), b.alias("b"), "kind"), "text_spans")
    release(merged, kinds, kept)
    return out


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, start_word, n_words, component_id, first_doc_id, removed: the passages that several documents have."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), "text").where(F.col("text").isNotNull())
    named = written(rows.groupBy("doc_id", "text_hash").count(), "documents")
    if named.where("count > 1").limit(1).count():  # whole rows repeated
        rows = rows.dropDuplicates(["doc_id", "text_hash"])
    texts = written(named.groupBy("text_hash").agg(F.min(_place()).alias("first"), F.count("*").alias("n")).select("text_hash", "first.doc_id", (F.col("n") > 1).alias("copied")), "texts")
    hits = shared_runs(rows)
    paragraphs = paragraph_table(rows, texts, hits)
    release(hits)
    centers = center_table(paragraphs)
    grams = written(paragraphs.select("text_hash", "grams"), "grams")
    release(paragraphs)  # the shuffled paragraphs go from the disks, too
    links = class_links(grams, centers)
    release(grams)
    spans = similar_spans(centers, links)
    release(centers, links)
    first = spans.select("text_hash", "kind").distinct().join(maybe_broadcast(texts), "text_hash").groupBy("kind").agg(F.min(_place()).alias("first"))
    first = written(first.select("kind", F.col("first.doc_id").alias("first_doc"), F.col("first.text_hash").alias("first_hash")), "first_of_kind")
    spans = spans.join(maybe_broadcast(first), "kind").select("text_hash", "a", "b", "kind", "first_doc", "first_hash")
    spans = written(spans, "spans")  # of texts; the documents of a text with many copies meet them in a join that AQE can split
    every = spans.join(named.select("doc_id", "text_hash"), "text_hash")
    stays = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("text_hash") == F.col("first_hash"))
    return _passages(every.select("doc_id", "text_hash", "a", "b", "kind", (~stays).alias("removed")))


def _passages(spans: DataFrame) -> DataFrame:
    """Spans that overlap are one passage; passages with a common kind of paragraph are in one component.

    Spans to remove and spans that stay are passages apart: what stays may reach beyond what goes.
    """
    by_row = Window.partitionBy("doc_id", "text_hash").orderBy("a", "b", "kind")
    reach = F.max("b").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", (reach.isNull() | (F.col("a") >= reach)).cast("int"))
    marked = written(marked.withColumn("number", F.sum("new").over(by_row.rowsBetween(Window.unboundedPreceding, 0))), "marked")
    by_fate = Window.partitionBy("doc_id", "text_hash", "removed").orderBy("a", "b", "kind")
    reach = F.max("b").over(by_fate.rowsBetween(Window.unboundedPreceding, -1))
    apart = marked.withColumn("new", (reach.isNull() | (F.col("a") >= reach)).cast("int")).withColumn("own", F.sum("new").over(by_fate.rowsBetween(Window.unboundedPreceding, 0)))
    passages = apart.groupBy("doc_id", "text_hash", "removed", "own").agg(F.min("a").alias("start_word"), F.max("b").alias("end"), F.first(F.xxhash64("doc_id", "text_hash", "number")).alias("passage"))
    # Passages meet in their kinds: each is joined to the least passage of a kind, which for most of its kinds is the same one.
    members = marked.select(F.xxhash64("doc_id", "text_hash", "number").alias("passage"), "kind").distinct()
    least = written(members.groupBy("kind").agg(F.min("passage").alias("least")), "least")
    edges = members.join(least, "kind").select("passage", "least").where("passage != least").distinct()
    joined = written(components(edges), "joined")
    out = passages.join(maybe_broadcast(joined), passages["passage"] == joined["id"], "left").withColumn("component_id", F.coalesce("component", "passage"))
    out = written(out.select("doc_id", "text_hash", "start_word", (F.col("end") - F.col("start_word")).cast("int").alias("n_words"), "component_id", "removed"), "passages")
    release(least, collect=False)
    first = written(out.groupBy("component_id").agg(F.min("doc_id").alias("first_doc_id")), "first")
    release(marked, joined)
    return out.join(maybe_broadcast(first), "component_id").select("doc_id", "text_hash", "start_word", "n_words", "component_id", "first_doc_id", "removed")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir)).drop("text_hash")

"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, passed through up to `epochs` times. A copy
of a document gets a virtual finish time: the words of its source up to its end, divided by the source's
weight. The copies of all sources are sorted by that time, by range over all tasks, and summed up in this order; the mix
ends where the budget is used up. A source that has run out leaves its share to the others by weight, as the queue prescribes.

Nulls: a null text has no words, a null source is a source of its own, a null doc_id is a value like any
other. Documents without words take no part (taken 0). Very long texts are counted whole; one that doesn't fit in what is
left of the budget ends the mix. Rows with the same doc_id, source and text finish together and are taken alike; ties between
others go by name, then by the shuffled order. Sources are a bounded catalogue: they are summed in one task, documents never.
An empty table gives an empty result. Columns of other names are kept out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, documents, maybe_broadcast, text_hash, written

SEED = 11
EPOCHS = 3
#: The shuffled order of a source is cut into so many runs, which are summed apart.
RUNS = 4096
#: What orders the mix: the virtual finish time, and what tells apart copies that finish at one time.
ORDER = ("finish", "name", "place", "doc_id", "text_hash")


def word_count(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def queued(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, text_hash, name (of the source, never null), size, place (in the shuffled order), run (of places), as a table."""
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    out = docs.select("doc_id", "source", text_hash().alias("text_hash"), name.alias("name"), word_count().alias("size"), F.xxhash64(F.lit(seed), "doc_id", text_hash()).alias("place"))
    return written(out.withColumn("run", F.shiftright("place", 52) + RUNS // 2), "queued")


def cycled_weights(queue: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """name, weight: the sources by code point, null last, weigh as in the cycle, again and again."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return queue.select("name", "source").distinct().select("name", F.element_at(F.array(*map(F.lit, cycle)), (F.row_number().over(order) - 1) % len(cycle) + 1).cast("double").alias("weight"))


def targets(queue: DataFrame, weights: DataFrame, epochs: int = EPOCHS, budget: float | None = None) -> DataFrame:
    """name, weight, source_size, target, a row for each source (a bounded catalogue, unlike the documents).

    The budget (all words if none is given) is shared by weight; no source gets more than epochs times its size,
    and what is over goes to the others. Water filling: sources in order of the level at which they are full.
    """
    totals = queue.groupBy("name").agg(F.sum("size").alias("source_size")).join(weights, "name")
    totals = totals.withColumn("most", F.col("source_size") * epochs).withColumn("full_at", F.col("most") / F.col("weight"))
    order = Window.orderBy("full_at", "name")
    level = (F.col("budget") - F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    totals = totals.withColumn("budget", F.lit(float(budget)) if budget is not None else F.sum("source_size").over(everything).cast("double"))
    totals = totals.withColumn("level", level)
    found = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "name", "level"))).over(everything)["level"]
    return totals.withColumn("found", found).select(
        "name", "weight", "source_size", F.when(F.col("found").isNull(), F.col("most")).otherwise(F.least("most", F.col("weight") * F.col("found"))).cast("double").alias("target")
    )


def timed(queue: DataFrame, shares: DataFrame) -> DataFrame:
    """queue with done (words of the source up to the document's end, in one pass) and the source's figures, as a table.

    The running sum of a source is that of its runs plus that within a run, so that a source with most of the
    rows is summed by as many tasks as there are runs. Equal rows are peers in the window and get the same sum.
    """
    before = Window.partitionBy("name").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = queue.groupBy("name", "run").agg(F.sum("size").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words").join(shares, "name")
    within = Window.partitionBy("name", "run").orderBy("place", "doc_id", "text_hash").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = queue.join(runs, ["name", "run"]).withColumn("done", F.col("before") + F.sum("size").over(within))
    return written(out.select("doc_id", "source", "text_hash", "name", "place", "size", "source_size", "weight", "target", "done"), "timed")


def copies(times: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """A row for each pass of each document that has words: with epoch and finish, its virtual finish time."""
    finish = (F.col("epoch") * F.col("source_size") + F.col("done")) / F.col("weight")
    return times.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")).withColumn("finish", finish)


def range_sorted(queue: DataFrame) -> DataFrame:
    """The copies in the order of the mix, as a table of ranges (part), with until: the words of the mix up to each one's end.

    Ranges are sorted and summed apart, each by one task; what is before a range is the sum of those before it.
    """
    parts = queue.select(*ORDER, "size").repartitionByRange(*ORDER).withColumn("part", F.spark_partition_id())
    parts = written(parts, "sorted")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("part").agg(F.sum("size").alias("words")).select("part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("part").orderBy(*ORDER).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return parts.join(maybe_broadcast(starts), "part").withColumn("until", F.col("start") + F.sum("size").over(within))


def mix_end(queue: DataFrame, budget: int) -> Row | None:
    """The last copy in the mix, by what orders it: the copies up to there hold at most the budget. None: nothing fits."""
    return range_sorted(queue).where(F.col("until") <= budget).agg(F.max(F.struct(*ORDER)).alias("last")).first().last


def mix_sources(docs: DataFrame, weights=cycled_weights, epochs: int = EPOCHS, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """The mix's share of every document: doc_id, source, text_hash, size, source_size, target, copies, taken (words).

    weights: name, weight as a DataFrame, or a function of the queue that makes it. range_sorted(copies(timed(...))) has
    the order itself.
    """
    queue = queued(docs, seed)
    shares = written(targets(queue, weights(queue) if callable(weights) else weights, epochs, budget), "shares")
    times = timed(queue, shares)
    if budget is None:
        budget = shares.agg(F.sum("source_size")).first()[0] or 0
    last = mix_end(copies(times, epochs), int(budget))
    if last is None:
        taken = F.lit(0)
    else:
        end = F.struct(*(F.lit(last[c]).cast(times.schema[c].dataType if c != "finish" else "double").alias(c) for c in ORDER))
        passes = [F.struct(((F.lit(e) * F.col("source_size") + F.col("done")) / F.col("weight")).alias("finish"), *ORDER[1:]) for e in range(epochs)]
        taken = sum(((p <= end).cast("int") for p in passes), F.lit(0))
    out = times.withColumn("copies", F.when(F.col("size") > 0, taken).otherwise(0))
    return out.select("doc_id", "source", "text_hash", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """docs with a row for each pass of the mix over a document; rows with the same doc_id, source and text are taken alike."""
    taken = mix_sources(docs, **how).where("copies > 0").groupBy("doc_id", "source", "text_hash").agg(F.max("copies").alias("_sylva_copies"))
    taken = written(taken.select(F.col("doc_id").alias("_sylva_id"), F.col("source").alias("_sylva_source"), F.col("text_hash").alias("_sylva_hash"), "_sylva_copies"), "taken")
    right = maybe_broadcast(taken)
    same = (text_hash(docs["text"]) == F.col("_sylva_hash")) & docs["doc_id"].eqNullSafe(F.col("_sylva_id")) & docs["source"].eqNullSafe(F.col("_sylva_source"))
    passes = F.explode(F.sequence(F.lit(1), F.col("_sylva_copies").cast("int"))).alias("_sylva_pass")
    return docs.join(right, same).select(*(docs[c] for c in docs.columns), passes).drop("_sylva_pass")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")

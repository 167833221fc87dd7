"""Sharding by fixed virtual slots.

Every record hashes to one of thousands of slots; which slot a record has never changes. A small
versioned table says which shard holds a slot. It is made from the bytes of each slot, and is edited,
slot by slot, when shards are added. All of it is DataFrame and SQL operations.

Nulls: a null text counts as no bytes (size 1, CRC 0); a null doc_id is hashed as a value like any other.
Repeated rows share a slot and get places of their own there. An empty table gives an empty result, and
a map with all slots empty. Columns of other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, text_hash, utf8_bytes, written

SLOTS = 4096
SHARDS = 16


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of each record. Copies of a text differ in doc_id, so they spread over the slots."""
    return docs.select(
        "doc_id",
        (utf8_bytes() + 1).alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", text_hash()), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_map(records: DataFrame, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """virtual_slot, shard, bytes, records of every slot: version 1 of a map.

    The slots, largest first, each go to the shard with the fewest bytes so far. The fold runs over one
    array of `slots` elements, whatever the size of the input.
    """
    sums = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    sums = every.join(F.broadcast(sums), "virtual_slot", "left").na.fill(0, ["bytes", "records"])
    least = "cast(array_position(a.load, array_min(a.load)) - 1 AS int)"
    dealt = f"""aggregate(
        sorted,
        named_struct('load', array_repeat(0L, {shards}), 'dealt', cast(array() AS array<int>)),
        (a, x) -> named_struct(
            'load', transform(a.load, (v, i) -> if(i = {least}, v + x.bytes + x.records, v)),
            'dealt', concat(a.dealt, array({least}))),
        a -> a.dealt)"""
    one = sums.agg(F.expr("array_sort(collect_list(named_struct('rank', -bytes, 'virtual_slot', virtual_slot, 'bytes', bytes, 'records', records)))").alias("sorted"))
    return (
        one.selectExpr("sorted", f"{dealt} AS dealt")
        .selectExpr("explode(arrays_zip(sorted, dealt)) AS x")
        .selectExpr("x.sorted.virtual_slot", "x.dealt AS shard", "x.sorted.bytes", "x.sorted.records")
    )


def grown(slots: DataFrame, shards: int) -> DataFrame:
    """The next version of a map, with shard number `shards` added: it takes slots from the others, and no others move.

    Each old shard gives up slots, in order of their hash, while they hold less than 1/(shards + 1) of its bytes.
    """
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(shards), "virtual_slot"), "virtual_slot")
    given = F.sum(F.col("bytes") + F.col("records")).over(order)
    share = F.sum(F.col("bytes") + F.col("records")).over(Window.partitionBy("shard")) / (shards + 1)
    moved = slots.select("*", given.alias("given"), share.alias("share"))
    return moved.withColumn("shard", F.when(F.col("given") <= F.col("share"), F.lit(shards)).otherwise(F.col("shard")).cast("int")).drop("given", "share")


def save_map(slots: DataFrame, path: str, version: int) -> DataFrame:
    """Adds a version to a map's table; earlier versions stay readable."""
    slots.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")
    return load_map(slots.sparkSession, path, version)


def load_map(spark, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")


def placed(records: DataFrame, slots: DataFrame) -> DataFrame:
    """records with their shard, and slot: their place in it, from 0 without gaps.

    A place is the count of records in the shard's earlier virtual slots plus the rank within the own one,
    so no window spans more than a virtual slot.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slots.select("virtual_slot", "shard", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    ranked = records.withColumn("rank", F.row_number().over(within))
    return ranked.join(F.broadcast(starts), "virtual_slot").withColumn("slot", (F.col("start") + F.col("rank") - 1).cast("long")).drop("start", "rank")


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    import uuid

    from .common import documents

    records = written(slotted(documents(spark, sf_dir)), "slotted")
    slots = save_map(slot_map(records), f"{shared_dir(spark)}/sylva-slot-map-{uuid.uuid4().hex}", 1)
    return placed(records, slots).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )

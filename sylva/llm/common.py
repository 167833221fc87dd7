"""What the operators share: inputs, tables in the shared folder, size-checked broadcasts, word kernels."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels

#: A word is a run of other characters than these six (space, tab, line feed, VT, FF, carriage return).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast up to so many bytes, by a sum over its rows; beyond, both sides are shuffled.
BROADCAST_BYTES = 32 << 20

#: Rows that a kernel gets at once: what it keeps for a batch doesn't follow the session's batch size.
SLICE = 512
#: Rows that the JVM hands to Python at once, where the session leaves Spark's own number: whole texts are in them.
BATCH_ROWS, SPARKS_OWN = 1000, "10000"

_workspaces: dict[str, SparkSession] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == SPARKS_OWN:
        spark.conf.set(key, str(BATCH_ROWS))


def gathered(batches: Iterator[pa.RecordBatch], rows: int, size: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches: of at least so many rows or bytes, but for the last."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= rows or sum(b.nbytes for b in waiting) >= size:
            table, waiting = pa.Table.from_batches(waiting).combine_chunks(), []
            yield from table.to_batches()
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def map_arrow(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(kernel, schema); the kernel gets slices of at most SLICE rows."""

    def sliced(batches):
        return kernel(batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE))

    small_batches(df.sparkSession)
    return kernels.map_arrow(df, sliced, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sylva-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, as a table in the shared folder: cuts the lineage, and a lost executor costs no earlier stage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sylva-{name}-{uuid.uuid4().hex}"
    _workspaces[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sylva_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame, collect: bool = True) -> None:
    """Deletes tables that `written` has made and that nothing reads any more.

    collect: the driver collects its garbage, too; shuffle files stay on the executors' disks until then.
    """
    for table in tables:
        path = table._sylva_path
        spark = _workspaces.pop(path)
        _delete(spark, path)
    if collect:
        spark._jvm.System.gc()


def give_back(spark: SparkSession) -> None:
    """Each executor's JVM collects its garbage and returns free heap to the system: shuffles fill the heap, and it would stay as large beside Python workers."""
    slots = spark.sparkContext.defaultParallelism
    spark.range(0, slots, 1, slots).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def clean_up() -> None:
    """Deletes every table that `written` has made in this process; frames that read them end with it."""
    for path, spark in list(_workspaces.items()):
        del _workspaces[path]
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: its own folder goes with it
            return


atexit.register(clean_up)


def _held(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_held(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType)):
            return F.aggregate(F.coalesce(value, F.array().cast(kind)), F.lit(24).cast("long"), lambda n, x: n + _held(x, kind.elementType))
        return F.coalesce(F.size(value), F.lit(0)) * 8 + 24
    return F.lit(8)


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether all rows of df, whatever their arrays and strings hold, are small enough for each executor to keep."""
    size = sum((_held(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(24))
    return (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= limit


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it fits; else as it is, for a shuffled join that AQE splits where it is skewed."""
    return F.broadcast(df) if fits_broadcast(df, limit) else df


def text_hash(text: str | Column = "text") -> Column:
    """64 bits of a text; with doc_id it names a row, whatever the plan that reads it. Null is one value."""
    return F.xxhash64(text)


def utf8_bytes(text: str | Column = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


class WordHashes(dict):
    """64-bit hashes of words (bytes); short ones are remembered, up to a bound: some 25 MB."""

    LIMIT, LENGTH = 200_000, 40

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LENGTH:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = h
        return h


#: Odd multipliers for combining the hashes of consecutive words.
MULTIPLIERS = np.array([xxhash.xxh3_64_intdigest(b"position %d" % i) | 1 for i in range(16)], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order; with fewer words, of the whole run; none without words."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    out = np.zeros(n - k + 1, dtype=np.uint64)
    for i in range(k):
        out += hashes[i : n - k + 1 + i] * MULTIPLIERS[i % 16]
    return mixed(out + np.uint64(k))

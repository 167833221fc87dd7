"""Running Arrow kernels: the executors get this package's code first."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once to an application; a kernel is pickled by reference to its module."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="sylva-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


#: What modules keep in a Python worker from task to task, by module.
_kept: dict[str, object] = {}


def kept(cache):
    """A decorator for a cache (of functools): it stays for the module's own kernels, and goes when another's begins."""
    _kept[cache.__module__] = cache
    return cache


def drop_kept(module: str) -> None:
    """Empties the caches of all other modules. Workers are reused by later stages, which have the memory for their own work."""
    for name, cache in _kept.items():
        if name != module:
            cache.cache_clear()


def give_back() -> None:
    """Returns freed memory to the system: a Python worker that waits for its next task would keep it from the JVM beside it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, kernel, schema) -> DataFrame:
    """df.mapInArrow(kernel, schema), where the kernel may use this package's modules."""

    def whole(batches):
        drop_kept(kernel.__module__)
        yield from kernel(batches)
        give_back()

    ship(df.sparkSession)
    return df.mapInArrow(whole, schema)

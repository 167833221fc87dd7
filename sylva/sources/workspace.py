"""Folders for files that steps hand to each other: in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .publish import Place

_made: list[Place] = []


def workspace(spark: SparkSession, name: str) -> Place:
    """A new folder in spark.checkpoint.dir; where that is unset, in local mode, a temporary one. It goes with the process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='sylva-')}"
    place = Place(spark, f"{base.rstrip('/')}/sylva-{name}-{uuid.uuid4().hex}")
    place.fs.mkdirs(place.at)
    _made.append(place)
    return place


def clean_up() -> None:
    while _made:
        try:
            _made.pop().remove()
        except Exception:  # the session has ended
            return


atexit.register(clean_up)


#: Bytes that the JVM hands to Python at once, besides one document: so many long ones would be in both.
BATCH_BYTES = "4m"


def room_for_python(spark: SparkSession) -> None:
    """Documents go to Python a few at a time, and the executors' JVMs return the heap that shuffles have filled."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    slots = spark.sparkContext.defaultParallelism
    spark.range(0, slots, 1, slots).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def write_documents(sources: DataFrame, folder: Place) -> list[str]:
    """A file document_id.xml for each row of sources (document_id, content), written by the executors; the files' paths."""
    staged = folder.child(f".{uuid.uuid4().hex}")
    sources.select("document_id", "content").write.partitionBy("document_id").text(str(staged.at))
    out = []
    for one in staged.children():
        if one.name.startswith("document_id="):
            target = folder.child(f"{one.name.partition('=')[2]}.xml")
            next(x for x in one.children() if x.name.startswith("part-")).rename(target)
            out.append(str(target.at))
    staged.remove()
    return sorted(out)

"""Small tables that the driver makes of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A dictionary is broadcast up to about so many characters in its rows; beyond, it is joined by a shuffle.
BROADCAST_CHARACTERS = 8 << 20


def dictionary(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """rows as a DataFrame, with a broadcast hint if they are small. They follow the vocabulary, not the documents."""
    out = spark.createDataFrame(rows, schema)
    return F.broadcast(out) if sum(len(str(row)) for row in rows) <= BROADCAST_CHARACTERS else out

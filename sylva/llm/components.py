"""Connected components of a graph that no machine holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """One step of alternating stars, and the table that it reads; edges: u, v.

    Large: all larger neighbours of u go to the least one around u. Small: all smaller neighbours of u, and u, go to the
    least of them. A hub's least neighbour is found by partial sums and written, so that its edges meet that one row in
    a join of two shuffled sides, which AQE can split.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = written(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct(), least


def _settled(edges: DataFrame) -> bool:
    """Whether every u has one edge and no v is a u: then each v is the least of its component."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    loose = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0")
    return not loose.limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """id, component for every end of an edge: the least id that edges lead to. edges: two columns of one type.

    Alternates large and small stars until every component is one; each round is written to the shared folder, and the
    one before it deleted.
    """
    a, b = edges.columns
    edges = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges")
    while not _settled(edges):
        for large in (True, False):
            out, least = _star(edges, large)
            before, edges = edges, written(out, "edges")
            release(before, least, collect=False)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())

"""Connected components by alternating large and small stars, each round a written table.

The least neighbour of a node is aggregated before anything is shuffled and joined back, so that a node which
a third of all edges meet is no task's burden: the aggregate has one row for it, and the join's other side
can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.plans.lineage import cut



def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` BIGINT edges -> ``(id, component)``, component being its smallest id.

    Rounds grow with the logarithm of the longest path; a hub's edges never meet in driver memory.
    Self-edges, repeated edges and nulls are dropped; no edges give an empty result.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, before = cut(e), None
    while True:
        now = _digest(e)
        if now == before or not now[0]:
            break
        before = now
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        e = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        e = cut(e)
    return e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).select("id", "component").union(
        e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    ) if before else e.select(F.col("a").alias("id"), F.col("b").alias("component"))

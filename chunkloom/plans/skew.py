"""Plans for keys that a large share of all rows may hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.plans.lineage import small_side

#: Copies from which on a group is named by a broadcast join, not a shuffle: there are few groups of so many.
COPIES = 1 << 20


def named(own: DataFrame, copies: DataFrame, key: str, by: list[str]) -> DataFrame:
    """``(key, *by)``, ``(*by, rep, copies)`` -> ``(key, rep)``: the representative of the group that each row belongs to.

    ``copies`` counts the rows of each group. Groups of one, and rows of no group, represent themselves.
    """
    many = copies.where("copies > 1").select(*by, "rep", "copies")
    hot = many.where(F.col("copies") > COPIES).drop("copies")
    out, rest = [], own
    if n_hot := hot.count():
        hot = small_side(hot, n_hot)
        out.append(own.join(hot, by).select(key, "rep"))
        rest = own.join(hot, by, "left_anti")
    out.append(rest.join(many.where(F.col("copies") <= COPIES).drop("copies"), by, "left").select(key, F.coalesce("rep", key).alias("rep")))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def spread(df: DataFrame, key: str, rows: int = 1 << 13) -> DataFrame:
    """``df`` in partitions of about ``rows``, at least one for each core: for narrow rows that much work is done for each."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(n, key)

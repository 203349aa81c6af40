"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import staged


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for each node of links (a, b): label is the smallest node of its component.

    Every round links a node's larger neighbours to its smallest one and then its smaller neighbours, so
    paths shrink by half at least; a node with very many neighbours only enters aggregates and joins, which
    combine on the map side or split. The joins merge, as a broadcast a round would gather on the driver. Each round is written down, so a lost executor repeats one round.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low.hint("merge"), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u")
        small = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = staged(small.distinct())
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())

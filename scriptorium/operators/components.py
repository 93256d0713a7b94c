"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut
from .skew import HOT, met_with_one


def connected_components(pairs: DataFrame, *, hot: int = HOT, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for the nodes of ``pairs`` (a, b); the component is the smallest node of it.

    Alternating large-star and small-star steps, each a minimum per node joined back (nodes with more than ``hot`` edges, counted with
    the minimum, over several tasks), until nothing changes. Every round is cut by a table in the shared folder. Null nodes and loops link nothing.
    """

    def min_join(edges: DataFrame, least: DataFrame) -> DataFrame:
        return met_with_one(edges, least, ["u"], spread=F.col("v"), count="k", hot=hot)

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    # u > v: an edge hangs the larger node on the smaller
    edges = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    seen = state(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        around = both(edges)
        least = around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("k"))
        large = cut(min_join(around.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k"))
        hung = min_join(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        now = state(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

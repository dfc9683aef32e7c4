"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.session import cut


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is tied to the node's smallest neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them (edges point from
    the larger to the smaller node)."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(node, root)`` of every node that has an edge; the root is the component's smallest node.

    ``edges`` has two columns of one comparable type, any orientation; loops and nulls are ignored.
    A round needs two aggregations and two joins on node ids; the minimum of a hub's neighbours is
    combined map-side, and the hub's rows in the join are split by the adaptive skew join. Rounds
    grow as the logarithm of the longest path; each is checkpointed, so lost executors cost one.
    """
    a, b = edges.columns
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = cut(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = _signature(e)
    for _ in range(max_rounds):
        e = cut(_small_star(_large_star(e)))
        now = _signature(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
    )

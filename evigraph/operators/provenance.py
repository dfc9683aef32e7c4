"""Provenance closures of trees and acyclic graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.session import cut


def closure(leaves: DataFrame, inner: DataFrame, fan: int = 4, max_hops: int = 64) -> DataFrame:
    """``(child, parent, hop)``: every ancestor of every leaf in a tree whose parent is id // fan."""
    level = leaves.select("child", "parent", F.lit(1).alias("hop"))
    out = level
    for h in range(2, max_hops + 1):
        level = level.where("parent > 0").select("child", F.floor(F.col("parent") / fan).alias("parent"), F.lit(h).alias("hop"))
        if h % 4 == 0:
            level = cut(level)
            if level.isEmpty():
                break
        out = out.unionByName(level)
    return out


def ancestors(edges: DataFrame, max_hops: int = 64) -> DataFrame:
    """``(child, parent, hop)``: the closure of any acyclic ``(child, parent)`` edges by least hop; a
    cycle is an error. Squaring is not used: paths, not pairs at all distances, are what is stored."""
    e = cut(edges.select("child", "parent").where("child is not null and parent is not null").distinct())
    front, seen = e.withColumn("hop", F.lit(1)), None
    for h in range(1, max_hops + 1):
        front = cut(front if seen is None else front.join(seen, ["child", "parent"], "left_anti"))
        if front.isEmpty():
            return seen if seen is not None else front
        if not front.where("child = parent").isEmpty():
            raise ValueError("the provenance graph has a cycle")
        seen = front if seen is None else cut(seen.unionByName(front))
        front = front.join(e.toDF("parent", "up"), "parent").select("child", F.col("up").alias("parent"), F.lit(h + 1).alias("hop")).distinct()
    raise ValueError("paths are longer than max_hops")

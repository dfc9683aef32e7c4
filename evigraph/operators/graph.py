"""Edges, transitions, bounded traversals and fixed-iteration walks, all as joins on node ids.

An edge table is ``(src, dst[, etype, w])`` with both directions present unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.session import cut


def mirror(edges: DataFrame) -> DataFrame:
    """Both directions, each once; loops and nulls go."""
    e = edges.where("src is not null and dst is not null and src <> dst").select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def neighbour_edges(nodes: DataFrame, corpus_only: bool = True) -> DataFrame:
    """Directed edges from ``neighbors`` of nodes ``(node_id, type, neighbors)``: null or empty arrays,
    loops, repeats and ids that are no node give none; with ``corpus_only``, questions neither."""
    e = nodes.select(F.col("node_id").alias("src"), F.col("type").alias("st"), F.explode(F.array_distinct("neighbors")).alias("dst"))
    kinds = nodes.select(F.col("node_id").alias("dst"), F.col("type").alias("dt"))
    e = e.where("src <> dst").join(kinds, "dst")
    if corpus_only:
        e = e.where("coalesce(st, '') <> 'question' and coalesce(dt, '') <> 'question'")
    return e.select("src", "dst").distinct()


def chain(df: DataFrame, group: str, order: str) -> DataFrame:
    """Consecutive rows of a group as directed edges ``(src, dst)``."""
    w = W.partitionBy(group).orderBy(order)
    return df.select(F.lag(order).over(w).alias("src"), F.col(order).alias("dst")).where("src is not null")


def shared_entity(pairs: DataFrame, low: int = 2, high: int = 25, binary: bool = False) -> DataFrame:
    """``(src, dst, w)``, both directions: documents that share entities of low <= df <= high, by the
    sum of 1/df. The cap on df is part of the operator's meaning; it bounds the pairs of an entity
    by high squared, so a hub entity makes none."""
    p = pairs.where("doc_id is not null and entity is not null").select("doc_id", "entity").distinct()
    df = p.groupBy("entity").agg(F.count(F.lit(1)).alias("df")).where(F.col("df").between(low, high))
    k = p.join(df, "entity")
    a, b = k.select("entity", "df", F.col("doc_id").alias("src")), k.select("entity", F.col("doc_id").alias("dst"))
    w = F.lit(1.0) if binary else F.round(F.sum(1.0 / F.col("df")), 9)
    return a.join(b, "entity").where("src <> dst").groupBy("src", "dst").agg((w if not binary else F.max(w)).alias("w"))


def without(edges: DataFrame, other: DataFrame) -> DataFrame:
    """Edges that the other table has in neither direction."""
    both = other.select("src", "dst").unionByName(other.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return edges.join(both, ["src", "dst"], "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def transition(edges: DataFrame, w: str | Column | None = None) -> DataFrame:
    """``(src, dst, p)``: weights, symmetrised by their maximum, over the sum of the row. Rows
    without edges stay empty, so their mass is lost, not spread."""
    weight = F.lit(1.0) if w is None else F.col(w) if isinstance(w, str) else w
    e = edges.where("src <> dst").select("src", "dst", weight.cast("double").alias("w"))
    sym = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))
    total = sym.groupBy("src").agg(F.sum("w").alias("t"))
    return sym.join(total, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("p"))


def capped(edges: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` neighbours of each node by id; the cap is the operator's bound on hubs."""
    w = W.partitionBy("src").orderBy("dst")
    return edges.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")


def reach(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """``(query_id, node, hop)``: nodes within ``hops`` of a query's seeds ``(query_id, node)``, by
    their least hop. The seeds' side is filtered to unvisited nodes before each join."""
    seen = seeds.select("query_id", "node").distinct().withColumn("hop", F.lit(0))
    front = seen
    for h in range(1, hops + 1):
        step = front.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("query_id", F.col("dst").alias("node")).distinct()
        front = step.join(seen, ["query_id", "node"], "left_anti").withColumn("hop", F.lit(h))
        seen = seen.unionByName(front)
    return seen


def ball(seeds: DataFrame, edges: DataFrame, hops: int, cap: int) -> DataFrame:
    """``(query_id, node, hop, mass)``: nodes within ``hops``, cut at the ``cap`` of the largest mass
    after four PageRank steps; seeds always stay, outside the cap."""
    mass = pagerank(seeds.withColumn("w", F.lit(1.0)), cut(transition(edges)), 0.5, 4)
    b = reach(seeds, edges, hops).join(mass, ["query_id", "node"], "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))
    w = W.partitionBy("query_id").orderBy(F.desc("mass"), "node")
    return b.withColumn("_r", F.row_number().over(w)).where((F.col("_r") <= cap) | (F.col("hop") == 0)).drop("_r")


def pagerank(seeds: DataFrame, p: DataFrame, alpha: float, iterations: int, walk: bool = True, every: int = 3, digits: int = 12) -> DataFrame:
    """``(query_id, node, mass)``: personalised PageRank by a fixed number of power steps from seeds
    ``(query_id, node, w)`` normalised per query.

    With ``walk``, alpha is the probability of walking on, mass' = (1-alpha) s + alpha P mass; else
    of restarting. Each step is one join on the node and one aggregation, checkpointed every few
    steps. Only nodes with mass are carried."""
    total = seeds.groupBy("query_id").agg(F.sum("w").alias("t"))
    s = seeds.join(total, "query_id").select("query_id", "node", (F.col("w") / F.col("t")).alias("mass"))
    go, back = (alpha, 1 - alpha) if walk else (1 - alpha, alpha)
    base = s.withColumn("mass", F.col("mass") * back)
    mass = s
    for i in range(iterations):
        moved = mass.join(p, F.col("node") == F.col("src")).groupBy("query_id", F.col("dst").alias("node")).agg((F.sum(F.col("mass") * F.col("p")) * go).alias("mass"))
        mass = moved.unionByName(base).groupBy("query_id", "node").agg(F.sum("mass").alias("mass"))
        if (i + 1) % every == 0 and i + 1 < iterations:
            mass = cut(mass)
    return mass.withColumn("mass", F.round("mass", digits))


def walk_inside(seeds: DataFrame, p: DataFrame, alpha: float, iterations: int, every: int = 3) -> DataFrame:
    """``(query_id, node, mass)``: PageRank over a transition of each query's own, ``(query_id, src,
    dst, p)``; mass' = (1 - alpha) s + alpha P mass. Joins are on the query and the node."""
    total = W.partitionBy("query_id")
    s = cut(seeds.withColumn("mass", F.col("w") / F.sum("w").over(total)).select("query_id", "node", "mass"))
    base = s.withColumn("mass", F.col("mass") * (1 - alpha))
    mass = s
    for i in range(iterations):
        moved = mass.withColumnRenamed("node", "src").join(p, ["query_id", "src"]).groupBy("query_id", F.col("dst").alias("node")).agg((F.sum(F.col("mass") * F.col("p")) * alpha).alias("mass"))
        mass = moved.unionByName(base).groupBy("query_id", "node").agg(F.sum("mass").alias("mass"))
        if (i + 1) % every == 0 and i + 1 < iterations:
            mass = cut(mass)
    return mass


def diffuse(vectors: DataFrame, p: DataFrame, alpha: float, iterations: int) -> DataFrame:
    """APPNP: ``(node, d, x)`` with H' = (1-alpha) X + alpha A H over long-form vectors."""
    h = vectors
    for i in range(iterations):
        moved = p.join(h, p["dst"] == h["node"]).groupBy(F.col("src").alias("node"), "d").agg((F.sum(F.col("p") * F.col("x")) * alpha).alias("x"))
        h = moved.unionByName(vectors.withColumn("x", F.col("x") * (1 - alpha))).groupBy("node", "d").agg(F.sum("x").alias("x"))
        if (i + 1) % 3 == 0 and i + 1 < iterations:
            h = cut(h)
    return h


def triangles(edges: DataFrame) -> DataFrame:
    """``(node, degree, triangles, clustering)`` of an undirected graph in both directions.

    Edges are directed from the node of lower degree to that of higher (ties by id), so that a
    hub's pairs of neighbours aren't formed: a node has at most sqrt(2 m) edges outward."""
    deg = degrees(edges)
    a = edges.join(deg.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src").join(deg.select(F.col("node").alias("dst"), F.col("degree").alias("dd")), "dst")
    out = a.where("ds < dd or (ds = dd and src < dst)").select("src", "dst")
    x, y = out.toDF("a", "b"), out.toDF("a", "c")
    wedge = x.join(y, "a").where("b <> c")
    closed = wedge.join(out.toDF("b", "c"), ["b", "c"])
    corner = closed.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("t"))
    t = F.coalesce("t", F.lit(0))
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return deg.join(corner, "node", "left").select("node", "degree", t.alias("triangles"), F.when(pairs > 0, F.round(t / pairs, 6)).otherwise(0.0).alias("clustering"))


def connected_sets(members: DataFrame, edges: DataFrame, golds: DataFrame, most: int = 60) -> DataFrame:
    """``(query_id, covered, connected)``: whether a query's retrieved set holds all its golds, and
    whether they lie in one component of the graph induced on the set.

    Least labels spread inside each set, with pointer jumping, until none changes: about as many
    rounds as the logarithm of the longest path, ``most`` at the utmost."""
    m = members.select("query_id", F.col("doc_id").alias("node")).distinct()
    inner = m.join(edges, m["node"] == edges["src"]).select("query_id", "src", "dst")
    inner = inner.join(m.withColumnRenamed("node", "dst"), ["query_id", "dst"], "left_semi")
    inner = cut(inner.distinct())
    lab = m.withColumn("label", F.col("node"))
    for _ in range(most):
        before = lab
        near = inner.join(lab.withColumnRenamed("node", "src"), ["query_id", "src"]).groupBy("query_id", F.col("dst").alias("node")).agg(F.min("label").alias("l"))
        low = lab.join(near, ["query_id", "node"], "left").select("query_id", "node", F.least("label", F.coalesce("l", "label")).alias("label"))
        jump = low.select("query_id", F.col("node").alias("label"), F.col("label").alias("l2"))
        lab = cut(low.join(jump, ["query_id", "label"], "left").select("query_id", "node", F.least("label", F.coalesce("l2", "label")).alias("label")))
        moved = lab.join(before.withColumnRenamed("label", "was"), ["query_id", "node"]).where("label <> was")
        if moved.isEmpty():
            break
    else:
        raise RuntimeError(f"labels did not settle in {most} rounds")
    g = golds.select("query_id", F.col("doc_id").alias("node")).distinct().join(lab, ["query_id", "node"], "left")
    return g.groupBy("query_id").agg(
        F.bool_and(F.col("label").isNotNull()).alias("covered"),
        (F.bool_and(F.col("label").isNotNull()) & (F.count_distinct("label") == 1)).alias("connected"),
    )

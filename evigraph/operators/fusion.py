"""Rank and score fusion, votes. A ranking is ``(query_id, rnk, doc_id, score)``, ranks from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.functions.vector import ranked


def union(lists: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in lists.items():
        part = df.select(F.lit(name).alias("list"), "query_id", "rnk", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


def _weight(weights: dict[str, float]) -> Column:
    return F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("list")]


def rrf(lists: dict[str, DataFrame], k: int | None = None, k0: float = 60.0, base: int = 1, weights: dict[str, float] | None = None, digits: int = 9) -> DataFrame:
    """Reciprocal-rank fusion ``sum(w / (k0 + rank))``, ranks counted from ``base`` (both
    conventions occur); ties go to the smaller id."""
    w = weights or {name: 1.0 for name in lists}
    score = F.round(F.sum(_weight(w) / (k0 + F.col("rnk") - 1 + base)), digits)
    return ranked(union(lists).groupBy("query_id", "doc_id").agg(score.alias("score")), k)


def min_rank(lists: dict[str, DataFrame], k: int | None = None) -> DataFrame:
    """Best-of fusion: by the best rank in any list, ties to the smaller id; score is its negative."""
    return ranked(union(lists).groupBy("query_id", "doc_id").agg((-F.min("rnk")).cast("double").alias("score")), k)


def tiers(parts: list[tuple[DataFrame, int | None]], k: int) -> DataFrame:
    """Priority union: the heads of the lists one after another, each document at its first place."""
    out = None
    for tier, (df, head) in enumerate(parts):
        part = (df if head is None else df.where(F.col("rnk") <= head)).select("query_id", "doc_id", F.struct(F.lit(tier).alias("t"), F.col("rnk").alias("r")).alias("p"))
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("query_id", "doc_id").agg(F.min("p").alias("p"))
    rnk = F.row_number().over(W.partitionBy("query_id").orderBy("p.t", "p.r", "doc_id")).cast("long")
    return best.withColumn("rnk", rnk).where(F.col("rnk") <= k).select("query_id", "rnk", "doc_id", F.col("p.t").cast("long").alias("tier"))


def combsum(lists: dict[str, DataFrame], weights: dict[str, float], k: int | None = None) -> DataFrame:
    """Weighted sum of scores; a list without the document adds nothing."""
    return ranked(union(lists).groupBy("query_id", "doc_id").agg(F.round(F.sum(_weight(weights) * F.col("score")), 6).alias("score")), k)


def zscores(df: DataFrame) -> DataFrame:
    """Scores of a ranking standardised per query (population deviation; 0 if all are equal)."""
    w = W.partitionBy("query_id")
    sd = F.stddev_pop("score").over(w)
    return df.withColumn("score", F.when(sd > 0, (F.col("score") - F.avg("score").over(w)) / sd).otherwise(0.0))


def minmax(df: DataFrame) -> DataFrame:
    """Scores of a ranking scaled to 0..1 per query; 1 if all are equal."""
    w = W.partitionBy("query_id")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return df.withColumn("score", F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(1.0))


def zfuse(lists: dict[str, DataFrame], how: str = "sum", absent: float | None = None, k: int | None = None) -> DataFrame:
    """Fusion of standardised scores by sum or max; with ``absent``, a list that lacks the document
    counts as that score."""
    u = union({n: zscores(d) for n, d in lists.items()})
    if how == "max":
        agg = F.max("score")
    elif absent is None:
        agg = F.sum("score")
    else:
        agg = F.sum("score") + absent * (len(lists) - F.count_distinct("list"))
    return ranked(u.groupBy("query_id", "doc_id").agg(F.round(agg, 6).alias("score")), k)


def round_robin(lists: dict[str, DataFrame], k: int) -> DataFrame:
    """Lists in turn, rank by rank, each document at its first place."""
    order = {name: i for i, name in enumerate(lists)}
    u = union(lists).withColumn("o", _weight(order).cast("int"))
    best = u.groupBy("query_id", "doc_id").agg(F.min(F.struct("rnk", "o")).alias("p"))
    rnk = F.row_number().over(W.partitionBy("query_id").orderBy("p.rnk", "p.o", "doc_id")).cast("long")
    return best.withColumn("rnk", rnk).where(F.col("rnk") <= k).select("query_id", "rnk", "doc_id")


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """``(query_id, overlap)``: share of the first k documents that two rankings have in common."""
    x = a.where(F.col("rnk") <= k).select("query_id", "doc_id")
    both = x.join(b.where(F.col("rnk") <= k).select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    n = both.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return x.select("query_id").distinct().join(n, "query_id", "left").select("query_id", F.round(F.coalesce("n", F.lit(0)) / k, 6).alias("overlap"))


PARTITIONS = 65_536  # rows of a partition table that orders name


def votes(ranking: DataFrame, membership: DataFrame, how: str, k0: float = 60.0, k: int = 200, weight: Column | None = None) -> DataFrame:
    """``(query_id, pid, score)``: votes of the first k documents for their partitions.

    ``count`` adds 1 (or ``weight``) a document, ``sum`` and ``max`` its reciprocal rank 1/(k0+rank),
    ranks from 0."""
    r = ranking.where(F.col("rnk") <= k).join(membership, "doc_id")
    rr = 1.0 / (k0 + F.col("rnk") - 1)
    agg = {"count": F.sum(weight if weight is not None else F.lit(1.0)), "sum": F.sum(rr), "max": F.max(rr)}[how]
    return r.groupBy("query_id", "pid").agg(F.round(agg, 9).alias("score"))


def route_order(score: DataFrame, pids: DataFrame, k0: float = 60.0) -> DataFrame:
    """``(query_id, pid, rnk, rr)``: partitions by votes, those without a vote last by id, with the
    reciprocal of their rank. Of ``pids``, the partition table, at most PARTITIONS rows are taken."""
    known = sorted(r[0] for r in pids.where("pid is not null").distinct().limit(PARTITIONS + 1).collect())
    if len(known) > PARTITIONS:
        raise ValueError(f"more than {PARTITIONS} partitions to order")
    grid = score.select("query_id").distinct().withColumn("pid", F.explode(F.lit(known).cast(f"array<{pids.schema['pid'].dataType.simpleString()}>")))
    full = grid.join(score, ["query_id", "pid"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    rnk = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "pid")).cast("long")
    return full.withColumn("rnk", rnk).select("query_id", "pid", "rnk", F.round(1.0 / (k0 + F.col("rnk") - 1), 9).alias("rr"))


def project(chunks: DataFrame, documents: DataFrame, k: int, strict: bool = False) -> DataFrame:
    """``(query_id, doc, rnk)``: a ranking of chunks ``(query_id, pos, chunk)`` as one of their
    documents ``(chunk, doc)``, each at its first chunk. With ``strict`` a chunk without a document is
    an error, otherwise it is passed over."""
    if strict and not chunks.join(documents, "chunk", "left_anti").isEmpty():
        raise KeyError("a ranking names a chunk that has no document")
    first = chunks.join(documents, "chunk").groupBy("query_id", "doc").agg(F.min("pos").alias("pos"))
    rnk = F.row_number().over(W.partitionBy("query_id").orderBy("pos")).cast("long")
    return first.withColumn("rnk", rnk).where(F.col("rnk") <= k).select("query_id", "doc", "rnk")


def tree_and_dense(nodes: DataFrame, under: DataFrame, dense: DataFrame, k: int, base: float = 60.0) -> DataFrame:
    """Documents by reciprocal ranks of the tree nodes ``(query_id, node, rnk)`` that stand for them,
    ``under (node, doc_id)``, and of a dense ranking; ties to the smaller id."""
    own = nodes.join(under, "node").select("query_id", "doc_id", "rnk").unionByName(dense.select("query_id", "doc_id", "rnk"))
    return ranked(own.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (base + F.col("rnk"))), 9).alias("score")), k)


def ascend(lists: dict[str, DataFrame], golds: DataFrame, grid: tuple[float, ...], passes: int, k: int, base: float = 60.0) -> dict[str, float]:
    """One weight a list by coordinate ascent on the mean recall of the golds among the first ``k`` of
    the weighted reciprocal ranks: every list in turn takes the best weight of the grid, if that beats
    the present one. The reciprocal ranks of all candidates are written once; a trial is one ranking
    of them."""
    from evigraph.session import cut

    wide = None
    for name, own in lists.items():
        rr = own.select("query_id", "doc_id", (1.0 / (base + F.col("rnk"))).alias(name))
        wide = rr if wide is None else wide.join(rr, ["query_id", "doc_id"], "full_outer")
    gold = golds.select("query_id", "doc_id", F.lit(1).alias("_gold")).distinct()
    wide = cut(wide.fillna(0.0).join(gold, ["query_id", "doc_id"], "left"))
    total = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))

    def recall(w: dict[str, float]) -> float:
        score = sum(w[x] * F.col(x) for x in lists)
        top = ranked(wide.withColumn("score", F.round(score, 12)), k).select("query_id", "doc_id").join(gold, ["query_id", "doc_id"], "left_semi")
        hit = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("h"))
        return total.join(hit, "query_id", "left").agg(F.avg(F.coalesce("h", F.lit(0)) / F.col("n"))).first()[0] or 0.0

    weights = dict.fromkeys(lists, 1.0)
    best = recall(weights)
    for _ in range(passes):
        for name in lists:
            for w in grid:
                got = recall({**weights, name: w})
                if got > best:
                    best, weights = got, {**weights, name: w}
    return weights

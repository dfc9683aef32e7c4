"""Retrieval and answer metrics over rankings ``(query_id, rnk, doc_id)`` and golds ``(query_id, doc_id)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.functions.text import normal_answer


def gold_ranks(ranking: DataFrame, golds: DataFrame) -> DataFrame:
    """``(query_id, doc_id, rnk, n)``: each distinct gold with its rank, null if missed, and the
    length of the query's list (0 if it has none)."""
    g = golds.where("query_id is not null and doc_id is not null").select("query_id", "doc_id").distinct()
    n = ranking.groupBy("query_id").agg(F.max("rnk").alias("n"))
    return g.join(ranking.select("query_id", "doc_id", "rnk"), ["query_id", "doc_id"], "left").join(n, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def ideal(count: Column, k: int) -> Column:
    """Sum of 1/log2(i+1) over the first min(count, k) ranks."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(count, F.lit(k)).cast("int"))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))


def per_query(ranking: DataFrame, golds: DataFrame, ks: list[int], divide_by_list: bool = False, sentinel: int | None = None) -> DataFrame:
    """One row a query with golds: hit, recall, full coverage, precision and F1 at each k, nDCG,
    reciprocal rank and weakest rank.

    Precision is over k, or with ``divide_by_list`` over what the list holds up to k. A missed gold
    counts for the weakest rank as ``sentinel``, by default the list's length + 1. Queries without a
    list score 0; queries without golds have no row."""
    g = gold_ranks(ranking, golds)
    aggs = [F.count(F.lit(1)).alias("golds"), F.max("n").alias("n"), F.min("rnk").alias("first"), F.max(F.coalesce("rnk", F.lit(sentinel) if sentinel else F.col("n") + 1)).alias("weakest")]
    for k in ks:
        aggs.append(F.count_if(F.col("rnk") <= k).alias(f"_h{k}"))
        aggs.append(F.sum(F.when(F.col("rnk") <= k, 1.0 / F.log2(F.col("rnk") + 1.0)).otherwise(0.0)).alias(f"_d{k}"))
    q = g.groupBy("query_id").agg(*aggs)
    cols = ["query_id", "golds"]
    for k in ks:
        h = F.col(f"_h{k}")
        den = F.greatest(F.least(F.lit(k), F.col("n")), F.lit(1)) if divide_by_list else F.lit(k)
        p, r = h / den, h / F.col("golds")
        cols += [
            (h > 0).cast("int").alias(f"hit_{k}"), F.round(r, 6).alias(f"recall_{k}"), (h == F.col("golds")).cast("int").alias(f"full_{k}"),
            F.round(p, 6).alias(f"precision_{k}"), F.round(F.when(h > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias(f"f1_{k}"),
            F.round(F.col(f"_d{k}") / ideal(F.col("golds"), k), 6).alias(f"ndcg_{k}"),
        ]
    cols += [F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.col("weakest").cast("long").alias("weakest")]
    return q.select(*cols)


def summary(metrics: DataFrame, keys: list[str], skip: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Means times 100 to 2 places of the rates, plain means of ranks and counts, per key."""
    plain = {"weakest", "golds"}
    cols = [c for c in metrics.columns if c not in skip and c not in keys]
    aggs = [F.count(F.lit(1)).alias("queries")] + [F.round(F.avg(c) * (1 if c in plain else 100), 2).alias(c) for c in cols]
    return metrics.groupBy(*keys).agg(*aggs) if keys else metrics.agg(*aggs)


def partition_coverage(order: DataFrame, membership: DataFrame, golds: DataFrame, budgets: list[int]) -> DataFrame:
    """Overlap coverage: a gold is covered at b if any of its partitions ranks within b; per query
    whether all are, and the share that is."""
    g = golds.select("query_id", "doc_id").distinct().join(membership, "doc_id", "left")
    best = g.join(order.select("query_id", "pid", "rnk"), ["query_id", "pid"], "left").groupBy("query_id", "doc_id").agg(F.min("rnk").alias("rnk"))
    aggs = []
    for b in budgets:
        inside = F.coalesce(F.col("rnk") <= b, F.lit(False))
        aggs += [F.bool_and(inside).cast("int").alias(f"full_{b}"), F.round(F.avg(inside.cast("double")), 6).alias(f"recall_{b}")]
    return best.groupBy("query_id").agg(*aggs)


def answer_scores(rows: DataFrame, id_col: str, prediction: str, answers: str) -> DataFrame:
    """``(id, em, f1)``: exact match and token F1 against the best of the answers, after answer
    normalisation. Null or empty answers give nulls (not scored); an empty prediction matches none."""
    src = rows.select(F.col(id_col).alias("id"), normal_answer(F.col(prediction)).alias("p"), F.explode_outer(F.transform(answers, normal_answer)).alias("a"))
    split = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    src = src.withColumns({"pt": split(F.col("p")), "at": split(F.col("a"))})
    count_in = lambda arr, w: F.size(F.filter(arr, lambda y: y == w))
    same = F.aggregate(F.array_distinct("pt"), F.lit(0), lambda s, w: s + F.least(count_in(F.col("pt"), w), count_in(F.col("at"), w)))
    src = src.withColumn("same", same)
    f1 = F.when(F.col("same") > 0, 2.0 * F.col("same") / (F.size("pt") + F.size("at"))).otherwise(0.0)
    em = ((F.col("p") == F.col("a")) & (F.col("p") != "")).cast("int")
    return src.groupBy("id").agg(F.max(F.when(F.col("a").isNotNull(), em)).alias("em"), F.round(F.max(F.when(F.col("a").isNotNull(), f1)), 6).alias("f1"))


def fit_budget(chunks: DataFrame, budget: int) -> DataFrame:
    """Context chunks ``(query_id, rnk, tokens)`` within a token budget: whole chunks while they fit,
    the first that doesn't is cut: adds ``kept``, drops chunks that keep nothing."""
    before = F.sum("tokens").over(W.partitionBy("query_id").orderBy("rnk").rowsBetween(W.unboundedPreceding, -1))
    kept = F.least(F.col("tokens"), F.lit(budget) - F.coalesce(before, F.lit(0)))
    return chunks.withColumn("kept", kept).where(F.col("kept") > 0)


def latency(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and exact quantiles with linear interpolation; nulls are left out."""
    q = lambda p: F.round(F.percentile(value, F.lit(p)), 6)
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99")
    )

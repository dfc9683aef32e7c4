"""Statistics as column expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ln_factorial(n: Column) -> Column:
    """ln n! by its sum up to 255 and Stirling's series beyond (error under 1e-12)."""
    x = n.cast("double") + 1
    stirling = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), n.cast("int"))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    return F.when(n < 256, small).otherwise(stirling)


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided McNemar p-value of b and c discordant pairs; 1 if there are none."""
    n, low = (b + c), F.least(b, c)
    base = ln_factorial(n) - n * F.log(F.lit(2.0))
    # terms relative to the largest, i = low: each earlier one is a ratio of the next
    ratio = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.lit(0), low.cast("int") - 1)),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, i: F.struct(
            F.when(low - i > 0, a["t"] * (low - i) / (n - low + i + 1)).otherwise(F.lit(0.0)).alias("t"),
            (a["s"] + F.when(low - i > 0, a["t"] * (low - i) / (n - low + i + 1)).otherwise(F.lit(0.0))).alias("s"),
        ),
        lambda a: a["s"],
    )
    top = base - ln_factorial(low) - ln_factorial(n - low)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.exp(top) * ratio))


def kappa(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Raw agreement and Cohen's kappa of two binary raters per key; null if agreement is expected."""
    n, both = F.count(F.lit(1)), F.sum((F.col(a) == F.col(b)).cast("long"))
    p1, p2 = F.avg(F.col(a).cast("double")), F.avg(F.col(b).cast("double"))
    g = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys).agg(n.alias("n"), both.alias("agree"), p1.alias("_p"), p2.alias("_q"))
    po, pe = F.col("agree") / F.col("n"), F.col("_p") * F.col("_q") + (1 - F.col("_p")) * (1 - F.col("_q"))
    return g.select(*keys, "n", "agree", F.round(po, 6).alias("agreement"), F.when(pe < 1, F.round((po - pe) / (1 - pe), 6)).alias("kappa"))


def interpolate(points: DataFrame, x: str, y: str, at: list[float]) -> DataFrame:
    """Piecewise linear values of a grid at given places, clamped at its ends: ``(x, y)``.

    Each place needs the last point not after it and the first not before it, two aggregates that
    combine map-side; nothing is sorted."""
    spark = points.sparkSession
    want = spark.createDataFrame([(float(v),) for v in at], "at double")
    p = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"))
    lo, hi = F.col("px") <= F.col("at"), F.col("px") >= F.col("at")
    both = p.join(F.broadcast(want), how="cross") if len(at) <= 1000 else None
    if both is None:
        raise ValueError("at most 1000 places")
    g = both.groupBy("at").agg(
        F.max(F.when(lo, F.struct("px", "py"))).alias("a"), F.min(F.when(hi, F.struct("px", "py"))).alias("b")
    )
    a, b = F.coalesce("a", "b"), F.coalesce("b", "a")
    span = b["px"] - a["px"]
    return g.select(F.col("at").alias("x"), F.when(span == 0, a["py"]).otherwise(a["py"] + (b["py"] - a["py"]) * (F.col("at") - a["px"]) / span).alias("y"))

"""Readers of the parquet tables, with redelivered rows folded away by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.session import attach


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table as written. Only the columns that a query names reach the scan."""
    attach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Each key once. Redelivered rows are whole repeats, so any of them will do; null keys go.

    ``first`` over a struct keeps the columns of one and the same row together, and aggregates
    map-side, so a key that is repeated a million times costs one row per map task.
    """
    cols = [c for c in columns if c != key]
    one = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.first(F.struct(*cols)).alias("_r"))
    return one.select(key, *[F.col("_r")[c].alias(c) for c in cols])

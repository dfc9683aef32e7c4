"""All queries of the library with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evigraph.plans import build, nodes, pipeline, projection, registry, reports, retrieval, routing, runs, substrate, text, traversal  # noqa: F401  they register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.QUERIES["pipeline"](spark, sf_dir)

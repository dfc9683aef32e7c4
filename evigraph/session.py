"""Session plumbing shared by every operator: worker import path, lineage cuts, size checks."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package even if the driver put it on ``sys.path`` by hand.

    A union that passes the partitioning of its inputs on is switched off: in Spark 4.1 adaptive
    execution may coalesce the inputs' shuffles differently after an aggregation has been planned
    on them, which then returns a group once per input.
    """
    if spark.version >= "4.1" and spark.conf.get("spark.sql.unionOutputPartitioning", None) != "false":
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if _ROOT not in have.split(":"):
        env["PYTHONPATH"] = f"{_ROOT}:{have}" if have else _ROOT
    return spark


def local_session(cores: str | int = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks on one machine. A cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster names.

    ``spark.checkpoint.dir`` is read from the session; only where it is unset (tests, one
    machine) a temporary folder is used.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="evigraph-ckpt-"))
    return df.checkpoint(eager=True)

"""Structured Streaming: windowed aggregates with late data, and index maintenance by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators.lexical import postings
from evigraph.session import attach

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def windows(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums by tumbling window and type; rows later than ``late`` are dropped by the
    watermark, which in the modes ``append`` and ``update`` also bounds the state."""
    e = events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late)
    g = e.groupBy(F.window("t", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


def run_windows(spark: SparkSession, path: str, out: str, width: str = "1 hour", late: str = "1 day", mode: str = "update", files: int = 64) -> DataFrame:
    """Reads what is new at ``path`` as a stream into ``out`` and returns the windows so far.

    In mode ``update`` a micro-batch writes the windows that it changed, each into a directory of its
    own that a repeated batch replaces, and of a window the last one counts; in mode ``append`` only
    windows that the watermark has closed are written, once. The checkpoint lies under ``out``: a
    later call, or one after a failure, goes on where the last one ended."""
    attach(spark)
    src = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/windows/n={number}")

    q = windows(src, width, late).writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    got = spark.read.schema("start string, event_type string, n long, value double, batch long").option("recursiveFileLookup", True).parquet(f"{out}/windows")
    last = got.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "value"), "batch").alias("x"))
    return last.select("start", "event_type", "x.n", "x.value")


def maintain_postings(spark: SparkSession, schema: str, path: str, out: str) -> None:
    """Adds the postings of newly arrived documents to ``out``, a directory per micro-batch, so that a
    batch that is run again after a failure replaces itself."""
    src = attach(spark).readStream.schema(schema).parquet(path)

    def add(batch: DataFrame, number: int) -> None:
        postings(batch).write.mode("overwrite").parquet(f"{out}/postings/batch={number}")

    src.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(add).start().awaitTermination()

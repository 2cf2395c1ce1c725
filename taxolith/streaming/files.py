"""Incoming files as a stream: every micro-batch is decided like a batch and written under its number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decide_files(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, decide: Callable[[DataFrame], DataFrame], kind: str = "parquet"):
    """Start a query over all files that are there, which ends when they are done; a batch that is repeated replaces its own output."""

    def write(batch: DataFrame, number: int) -> None:
        decide(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).format(kind).load(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per window and kind, closed when the watermark passes; works on streams and on tables."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")

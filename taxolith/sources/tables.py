"""Tables written to the folder that all executors share, for what must not be computed twice or lost with an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it has been counted and has no more rows than this.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a local session without it gets one of its own."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='taxolith-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/taxolith/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcasting if a count finds it within the limit, else left to the shuffle."""
    return F.broadcast(df) if df.count() <= limit else df

"""Helpers shared by the operators: tables in the cluster's shared folder, checked broadcasts, short texts."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it has been counted and has no more rows than this; beyond it, it is shuffled.
BROADCAST_ROWS = 100_000

#: Space, tab, line feed, vertical tab, form feed and carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it; where it is unset, a local session takes one of its own, a cluster's must set it."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='taxolith-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/taxolith/{uuid.uuid4().hex}/{name}"


def kept(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or new_folder(spark, name)
    df.write.mode("overwrite").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.kept_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete what kept() wrote for tables that nothing reads any more, and let Spark drop the shuffle files of finished jobs."""
    for t in tables:
        removed(t.sparkSession, t.kept_at)
    collected(tables[0].sparkSession)


def collected(spark: SparkSession) -> None:
    """Spark drops shuffle files once the driver's garbage is collected: after a large job that is done at once."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that was written by kept() and is no longer read."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcasting if its counted rows are within the limit; else leave the join to the shuffle."""
    return F.broadcast(df) if rows <= limit else df


def checked(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """small() after a count; for tables that are already written."""
    return small(df, df.count(), limit)


def no_clash(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: other columns, whatever their names, never meet our own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def without(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns of whatever names, whose identifier is not in the written table ids(id)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"))
    return rows.join(checked(ids), "id", "left_anti").select("row.*")

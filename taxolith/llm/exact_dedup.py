"""Exact dedup by a log-structured merge index of digests. DataFrame operations only.

Memtables: each task sorts the digests of its rows and flushes them as one Parquet file, a sorted run with a Bloom
filter and minimum and maximum per row group. Compaction merges runs into the next level, one row per digest with the
smallest identifier. Digests that occur more than once are hits; a hit is believed only once the bytes agree: rows of
hits are grouped by digest and whole text, so that texts which share a digest but differ fall apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolith.llm import common

#: Runs that one compaction merges at most; more are merged level by level.
FAN_IN = 64


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII blanks is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), common.BLANKS, " ")


class MergeIndex:
    """Digests with their smallest identifiers and row counts, in levels of sorted runs below one folder."""

    def __init__(self, spark, folder: str | None = None):
        self.spark = spark
        self.folder = folder or common.new_folder(spark, "merge_index")
        self.runs: list[str] = []
        self.merges = 0

    def flush(self, entries: DataFrame) -> None:
        """Add rows (digest, doc_id): every task writes a sorted run; nothing is shuffled."""
        self._write(entries.select("digest", "doc_id", F.lit(1).cast("long").alias("n")).sortWithinPartitions("digest"))

    def _write(self, df: DataFrame) -> None:
        path = f"{self.folder}/run{self.merges:05d}_{len(self.runs):05d}"
        df.write.option("parquet.bloom.filter.enabled#digest", "true").parquet(path)
        self.runs.append(path)

    def compact(self) -> DataFrame:
        """Merge all runs into one, FAN_IN at a time: (digest, doc_id: the smallest, n: rows)."""
        while len(self.runs) > 1 or not self.merges:
            taken, self.runs = self.runs[:FAN_IN], self.runs[FAN_IN:]
            self.merges += 1
            merged = self.spark.read.schema("digest binary, doc_id long, n long").parquet(*taken)
            # partial aggregation runs before the shuffle: a digest with a third of all rows is one row a task
            self._write(merged.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.sum("n").alias("n")).sortWithinPartitions("digest"))
        return self.spark.read.schema("digest binary, doc_id long, n long").parquet(*self.runs)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty and equal empty ones. A null identifier is never the smallest unless all of its group are
    null. Rows repeated with one identifier are the same document: they share keep_id and kept. An empty table gives no
    rows. Other columns are ignored. digest_bytes shortens the index's digests (tests force collisions so).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), normalised(F.col(f"`{text_col}`")).alias("body"))
    hashed = rows.withColumn("sha", F.sha2("body", 256))
    digest = F.substring(F.unhex("sha"), 1, digest_bytes)
    entries = common.kept(hashed.select("doc_id", F.unhex("sha").alias("sha")), "entries").withColumn("digest", F.substring("sha", 1, digest_bytes))
    index = MergeIndex(spark)
    index.flush(entries)
    level = index.compact()
    hits = level.where("n > 1").select("digest")

    # hits receive byte verification: rows of hits meet by digest and whole text
    hit_rows = hashed.withColumn("digest", digest).join(common.small(hits, hits.count()), "digest", "left_semi")
    verified = common.kept(hit_rows.groupBy("digest", "body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.first("sha").alias("sha")).select("digest", F.unhex("sha").alias("sha"), "keep_id", "group_size"), "verified")
    single = level.where("n = 1").select("digest", F.lit(None).cast("binary").alias("v_sha"), F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"))
    resolved = single.unionByName(verified.select("digest", F.col("sha").alias("v_sha"), "keep_id", "group_size"))
    joined = entries.join(resolved, "digest").where(F.col("v_sha").isNull() | (F.col("v_sha") == F.col("sha")))
    return joined.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM t
"""

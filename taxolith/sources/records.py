"""Logs of calls and audits as JSON lines, and recorded runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolith.operators.runlog import occurrence

CALLS = "call_id string, ord long, provider string, model string, request_hash string, line_ids array<string>, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, latency_ms long, status int, retry_after double, error string, cache_hit boolean, response string"


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Calls; lines that are blank are skipped, lines that are no object are an error."""
    return spark.read.schema(CALLS).option("mode", "FAILFAST").json(path)


def append_calls(calls: DataFrame, path: str) -> None:
    calls.write.mode("append").option("ignoreNullFields", "false").json(path)


def recorded_run(calls: DataFrame) -> DataFrame:
    """Every attempt of a request by number, in the order of recording: what replay takes from."""
    return occurrence(calls, ["request_hash"], ["ord"])


def cacheable(calls: DataFrame) -> DataFrame:
    return calls.where((F.col("status") == 200) & F.col("error").isNull())


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of the bytes of configuration files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))

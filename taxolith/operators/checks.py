"""Data-quality assertions: DataFrames of violations that must be empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    return rows.join(known, rows[key] == known[known_key], "left_anti")


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).count().where("count > 1")


def outside(rows: DataFrame, column: str, allowed: list) -> DataFrame:
    return rows.where(~F.col(column).isin(*allowed) | F.col(column).isNull())


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other."""
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def totals_differ(parts: DataFrame, part: str, whole: DataFrame, column: str, tolerance: float) -> DataFrame:
    """One row if the parts' sum is not the whole's."""
    a, b = parts.agg(F.sum(part).alias("a")), whole.agg(F.sum(column).alias("b"))
    return a.crossJoin(b).where(F.abs(F.col("a") - F.col("b")) > tolerance * F.greatest(F.abs("b"), F.lit(1.0)))


def run(checks: dict[str, DataFrame]) -> DataFrame:
    """check, violations: a row per check."""
    return reduce(DataFrame.unionAll, [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations") for name, df in checks.items()])

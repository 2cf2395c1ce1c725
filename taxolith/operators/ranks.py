"""Numbers of rows within groups of any size: one sort by ranges, and the ranges' sizes added up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolith.sources import tables


def numbered(rows: DataFrame, groups: list[str], order: list[str], name: str = "number") -> DataFrame:
    """rows with their number, from 0, within their group in the given order (nulls first).

    Rows are dealt by ranges of (groups, order) and written with their place, so a group of most rows is spread over many
    tasks. A group's first place in each range and its size there are a row for each range and each group's end; they are
    all that is summed. Rows that are equal in groups and order are numbered in any order.
    """
    keys = [F.asc_nulls_first(c) for c in (*groups, *order)]
    at = F.monotonically_increasing_id()
    placed = tables.written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"_range": F.shiftright(at, 33), "_at": at.bitwiseAND((1 << 33) - 1)}), "ranges")
    parts = placed.groupBy("_range", *groups).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.withColumn("_start", before - F.col("_first")).select(*[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_range").alias("_r"), "_start")
    same = F.col("_range") == F.col("_r")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return placed.join(tables.small(starts), same).select(*rows.columns, (F.col("_at") + F.col("_start")).alias(name))


def nearest_ranks(rows: DataFrame, groups: list[str], column: str, percents: dict[str, float]) -> DataFrame:
    """groups, and for each name the value at its percentage by nearest rank: the smallest value that so many rows don't exceed. Nulls don't count."""
    some = rows.where(F.col(column).isNotNull()).select(*groups, column)
    sizes = some.groupBy(*groups).agg(F.count("*").alias("_n"))
    own = sizes.select(*[F.col(g).alias(f"_s_{g}") for g in groups], "_n")
    same: Column = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_s_{g}"))
    ranked = numbered(some, groups, [column]).join(tables.small(own), same)
    wanted = {n: F.greatest(F.ceil(F.col("_n") * p / 100), F.lit(1)) - 1 for n, p in percents.items()}
    chosen = ranked.where(F.col("number").isin(*wanted.values()))
    return chosen.groupBy(*groups).agg(*[F.max(F.when(F.col("number") == at, F.col(column))).alias(n) for n, at in wanted.items()])

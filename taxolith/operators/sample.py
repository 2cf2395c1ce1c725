"""Samples: alternating splits, stratified draws, bootstrap bands."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxolith.operators.ranks import numbered


def alternating(rows: DataFrame, strata: list[str], order: str) -> DataFrame:
    """rows with side: dev and held_out in turn within each stratum."""
    return numbered(rows, strata, [order], "_n").withColumn("side", F.when(F.col("_n") % 2 == 0, "dev").otherwise("held_out")).drop("_n")


def allocation(populations: DataFrame, stratum: str, size: int) -> DataFrame:
    """stratum, n: largest remainders, in whole numbers; ties to the larger population, then by name."""
    total = F.sum("population").over(Window.partitionBy())  # one row per stratum
    base = populations.withColumn("_t", total).withColumn("_floor", F.expr(f"population * {size} div _t")).withColumn("_rest", F.expr(f"population * {size} % _t"))
    short = F.lit(size) - F.sum("_floor").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc("_rest"), F.desc("population"), stratum))
    return base.withColumn("_short", short).withColumn("_rank", rank).select(stratum, (F.col("_floor") + F.when(F.col("_rank") <= F.col("_short"), 1).otherwise(0)).alias("n"))


def stratified(rows: DataFrame, stratum: str, key: str, size: int, salt: str) -> DataFrame:
    """The rows of each stratum with the smallest salted digests, as many as it is allotted."""
    n = allocation(rows.groupBy(stratum).agg(F.count("*").alias("population")), stratum, size)
    digest = F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256)
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(stratum).orderBy(digest, key)))
    # no stratum is allotted more than size: each task keeps so many of it before the shuffle
    return ranked.where(F.col("_rank") <= size).join(F.broadcast(n), stratum).where(F.col("_rank") <= F.col("n")).drop("_rank", "n")


def bootstrap_band(items: DataFrame, by: list[str], resamples: int = 1000, seed: int = 0) -> DataFrame:
    """by, resamples, low, high: 2.5 and 97.5 % of precision over resamples of items(matched, correct).

    Rows are first counted per cell, so a resample is one multinomial draw of the cells, not a row per item. The draw is
    that of numpy's default generator with the seed, over a group's cells in the order (matched, correct), false first:
    equal counts and seeds give equal bands wherever they run.
    """
    cells = items.groupBy(*by, "matched", "correct").agg(F.count("*").alias("n"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["matched", "correct"])
        n = pdf["n"].to_numpy()
        w = np.random.default_rng(seed).multinomial(n.sum(), n / n.sum(), resamples)
        matched = w @ pdf["matched"].to_numpy().astype(int)
        correct = w @ (pdf["matched"] & pdf["correct"]).to_numpy().astype(int)
        p = (correct / np.where(matched, matched, 1))[matched > 0]
        low, high = np.percentile(p, [2.5, 97.5]) if len(p) else (None, None)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "resamples": [len(p)], "low": [low], "high": [high]})

    kinds = dict(items.dtypes)
    return cells.groupBy(*by).applyInPandas(draw, ", ".join([*(f"{c} {kinds[c]}" for c in by), "resamples long, low double, high double"]))

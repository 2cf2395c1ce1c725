"""Accuracy down the levels of a taxonomy: type, usage, subtype."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolith.functions.text import lenient
from taxolith.operators.score import level_hits

NAMES = ("type", "usage", "subtype")


def lenient_equal(predicted: list[str], reference: list[str]) -> Column:
    """All levels are equal once blanks are collapsed; a blank reference never is."""
    same = F.coalesce(F.col(reference[0]), F.lit("")) != ""
    for p, r in zip(predicted, reference, strict=True):
        same = same & lenient(F.col(p)).eqNullSafe(lenient(F.col(r)))
    return same


def accuracy(pairs: DataFrame, by: list[str], predicted: list[str], reference: list[str]) -> DataFrame:
    """Cumulative accuracy at each level, leniently at the last, and of each level given the one above; null without rows."""
    hits = dict(zip(NAMES, level_hits(predicted, reference), strict=True)) | {"lenient": lenient_equal(predicted, reference)}
    counts = pairs.groupBy(*by).agg(F.count("*").alias("rows"), *[F.count_if(h).alias(n) for n, h in hits.items()])
    return counts.select(*by, *[F.try_divide(n, "rows").alias(f"at_{n}") for n in hits], F.try_divide("usage", "type").alias("usage_given_type"), F.try_divide("lenient", "usage").alias("subtype_given_usage"))


def first_wrong(kind: Column, predicted: list[str], reference: list[str]) -> Column:
    """decision for errors of the decision itself, else the first level that is not hit; the last one where all are."""
    hit_type, hit_usage, _ = level_hits(predicted, reference)
    return F.when(kind.isin("false_nm", "match_on_blank"), "decision").when(~hit_type, "type").when(~hit_usage, "usage").otherwise("subtype")


def family(reference: Column, predicted: Column) -> Column:
    """The reference's type, else the predicted one, else blank."""
    return F.coalesce(F.nullif(reference, F.lit("")), predicted, F.lit(""))


def point_figures(points: DataFrame) -> DataFrame:
    """points(correct, matched, labelled) with precision, risk, coverage and the selected share; null where nothing divides."""
    precision = F.try_divide("correct", "matched")
    return points.select("*", precision.alias("precision"), (1 - precision).alias("risk"), F.try_divide("correct", "labelled").alias("coverage"), F.try_divide("matched", "labelled").alias("selected"))

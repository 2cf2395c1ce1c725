"""Scoring of outputs against reference labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolith.functions import stats
from taxolith.operators.runlog import occurrence


def joined_by_key(reference: DataFrame, output: DataFrame, key: str, order: str) -> DataFrame:
    """Full outer join on (key, how many times it was seen before); scored says whether the reference has the row."""
    a = occurrence(reference, [key], [order]).withColumn("_in", F.lit(True))
    b = occurrence(output, [key], [order]).drop(order).withColumn("_out", F.lit(True))
    j = a.join(b, [key, "occ"], "full_outer")
    return j.withColumn("status", F.when(F.col("_in").isNull(), "unscored").when(F.col("_out").isNull(), "missing").otherwise("paired")).drop("_in", "_out")


def joined_by_position(reference: DataFrame, output: DataFrame, position: str = "position") -> DataFrame:
    return reference.join(output, position, "full_outer")


def level_hits(predicted: list[str], reference: list[str]) -> list[Column]:
    """Cumulative equality down the levels; a blank reference is never hit."""
    out, hit = [], F.lit(True)
    for p, r in zip(predicted, reference, strict=True):
        hit = hit & F.col(p).eqNullSafe(F.col(r)) & (F.coalesce(F.col(reference[0]), F.lit("")) != "")
        out.append(hit)
    return out


def report(pairs: DataFrame, by: list[list[str]]) -> DataFrame:
    """Counts, shares, precision with its bounds, and coverage, for every set of grouping columns in one pass.

    pairs: decision, correct, labelled and the grouping columns.
    """
    columns = sorted({c for s in by for c in s})
    grouped = pairs.groupingSets([[F.col(c) for c in s] for s in by], *columns).agg(
        F.count("*").alias("rows"), F.count_if(F.col("decision") == "matched").alias("matched"),
        F.count_if(F.col("decision") == "needs_review").alias("review"), F.count_if(F.col("decision") == "not_a_material").alias("skipped"),
        F.count_if((F.col("decision") == "matched") & F.col("correct")).alias("correct"), F.count_if("labelled").alias("labelled"),
        F.count_if((F.col("decision") == "not_a_material") & F.col("labelled")).alias("false_skips"),
    )
    low, high = stats.wilson(F.col("correct"), F.col("matched"))
    return grouped.select("*", F.try_divide("correct", "matched").alias("precision"), F.try_divide("correct", "labelled").alias("coverage"), low.alias("wilson_low"), high.alias("wilson_high"))


def with_exact_bound(grouped: DataFrame, alpha: float = 0.05) -> DataFrame:
    return grouped.withColumn("cp_lower", stats.clopper_pearson(F.col("correct"), F.col("matched"), alpha))


def confusion(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Class by decision, a column per decision."""
    known = ["matched", "needs_review", "not_a_material"]
    return pairs.groupBy(*by).pivot("decision", known).count().na.fill(0, known)


def key_problems(rows: DataFrame, key: str) -> DataFrame:
    """Rows too many of repeated keys, and blank keys."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    blank = F.coalesce(F.col(key).cast("string"), F.lit("")) == ""
    return counts.agg(F.coalesce(F.sum(F.when(~blank, F.col("n") - 1)), F.lit(0)).alias("duplicates"), F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("blanks"))


def kappa(pairs: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Raw agreement and Cohen's kappa per group; null where chance agreement is total."""
    cells = pairs.groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_n"))
    rows = cells.groupBy(*by, "_a").agg(F.sum("_n").alias("_x"))
    columns = cells.groupBy(*by, F.col("_b").alias("_a")).agg(F.sum("_n").alias("_y"))
    chance = rows.join(columns, [*by, "_a"]).groupBy(*by).agg(F.sum(F.col("_x") * F.col("_y")).alias("_e"))
    total = cells.groupBy(*by).agg(F.sum("_n").alias("n"), F.coalesce(F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_n"))), F.lit(0)).alias("agreed"))
    po, pe = F.col("agreed") / F.col("n"), F.coalesce("_e", F.lit(0)) / (F.col("n") * F.col("n"))
    return total.join(chance, by, "left").select(*by, "n", "agreed", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def merged_panel(first: DataFrame, second: DataFrame, rulings: DataFrame, key: str, field: str) -> DataFrame:
    """The ruling, else what both say, else blank with unresolved set."""
    j = first.select(key, F.col(field).alias("_a")).join(second.select(key, F.col(field).alias("_b")), key, "full_outer").join(rulings.select(key, F.col(field).alias("_r")), key, "left")
    value = F.coalesce("_r", F.when(F.col("_a") == F.col("_b"), F.col("_a")))
    return j.select(key, value.alias(field), value.isNull().alias("unresolved"), F.when(F.col("_r").isNotNull(), "ruling").when(value.isNotNull(), "agreed").otherwise("open").alias("by"))


def error_kind(decision: Column, reference: Column, top: Column) -> Column:
    """Null for what is right."""
    return (
        F.when((decision == "matched") & (reference == ""), "match_on_blank").when((decision == "matched") & (reference != top), "false_match")
        .when((decision == "not_a_material") & (reference != ""), "false_nm").when((decision == "needs_review") & (reference != "") & (top == ""), "missed")
        .when((decision == "needs_review") & (reference != "") & (reference != top), "wrong_proposal_reviewed")
    )

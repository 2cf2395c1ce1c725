"""Outputs reviewed against a reference: classes of rows, row problems, votes of wrong lines, causes of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Classes, decisions, gaps from weakest to strongest, kinds that weigh double, when a cause triggers.
DECISIONS = ("matched", "needs_review", "not_a_material")
NOT_ITEMS = ("H", "U")
ITEM_KEY = r"^\d{2}\.\d{2}\.\d{4}\.$"
GAPS = ("tossup", "narrow", "clear", "decisive")
HEAVY_KINDS, HEAVY = ("false_match", "match_on_blank", "false_nm"), 2
TRIGGER_ROWS, TRIGGER_SHARE = 5, 0.2


def filled(labels: list[str]) -> Column:
    """Some level of the triple is not blank."""
    return F.concat(*[F.coalesce(F.col(c), F.lit("")) for c in labels]) != ""


def row_class(labels: list[str], listed: Column, unit: Column, key: Column) -> Column:
    """L if labelled, else the listed class, else item (blank) or header (H) by the unit, without units by the key's shape; U without both."""
    def item(c):
        return F.when(c, "blank").otherwise("H")

    return F.when(filled(labels), "L").when(listed.isNotNull(), listed).when(unit.isNotNull(), item(F.trim(unit) != "")).when(key.isNotNull(), item(key.rlike(ITEM_KEY))).otherwise("U")


def is_item_class(row_class: Column) -> Column:
    return ~row_class.isin(*NOT_ITEMS)


def decision_of(present: Column, decision: Column) -> Column:
    """The decision of a pair: missing without an output row, invalid outside the closed set."""
    return F.when(~present, "missing").when(F.coalesce(decision.isin(*DECISIONS), F.lit(False)), decision).otherwise("invalid")


def row_problem(decision: Column, labels: list[str]) -> Column:
    """invalid, matched_blank, labelled_non_match, or null for a well-formed row."""
    known = F.coalesce(decision.isin(*DECISIONS), F.lit(False))
    return F.when(~known, "invalid").when((decision == "matched") & ~filled(labels), "matched_blank").when((decision != "matched") & filled(labels), "labelled_non_match")


def key_violations(reference: DataFrame, output: DataFrame, key: str) -> DataFrame:
    """key, problem: keys that one side has more often than once, keys missing from the output, keys the reference has not. Counts meet, so a hot key is one row."""
    a = reference.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("a"))
    b = output.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("b"))
    j = a.join(b, "key", "full_outer")
    found = F.array(F.when(F.col("a") > 1, "repeated_in_reference"), F.when(F.col("b") > 1, "repeated_in_output"), F.when(F.col("b").isNull(), "missing"), F.when(F.col("a").isNull(), "extra"))
    return j.select("key", F.explode(F.array_compact(found)).alias("problem"))


def weakest_gap(gap: Column) -> Column:
    """Aggregate: the weakest gap among rows."""
    names = F.array(*map(F.lit, GAPS))
    return F.get(names, (F.min(F.array_position(names, gap)) - 1).cast("int"))


def votes_read(answers: DataFrame, passes: int, line: str = "line") -> DataFrame:
    """line, top1, votes, gap of lines with a valid answer in every pass, of which a material is the single most frequent kind.

    answers: line, pass_no, valid, kind, top1, gap. The leader is the most frequent code, of equals the one of the earliest
    pass; its gap is the weakest among its own supporters. Answers are counted by line and code, then by line.
    """
    kinds = ("material", "non_material", "no_equivalent")
    of = lambda k: F.count_if(F.col("valid") & (F.col("kind") == k))
    codes = answers.groupBy(line, "top1").agg(
        F.count("*").alias("n"), F.count_if("valid").alias("votes"), F.min("pass_no").alias("first"), F.min(F.array_position(F.array(*map(F.lit, GAPS)), F.col("gap"))).alias("weakest"), *[of(k).alias(k) for k in kinds]
    )
    best = F.max(F.struct("votes", (-F.col("first")).alias("early"), "top1", "weakest")).alias("best")
    g = codes.groupBy(line).agg(F.sum("n").alias("n"), F.sum("votes").alias("valid"), *[F.sum(k).alias(k) for k in kinds], best)
    read = g.where((F.col("n") == passes) & (F.col("valid") == passes) & (F.col("material") > F.greatest("non_material", "no_equivalent")))
    return read.select(line, "best.top1", "best.votes", F.get(F.array(*map(F.lit, GAPS)), (F.col("best.weakest") - 1).cast("int")).alias("gap"))


def unanimous_answers(answers: DataFrame, passes: int, line: str = "line") -> DataFrame:
    """line, top1 of lines whose passes are complete, all for a material and all on one code. answers: line, kind, top1."""
    g = answers.groupBy(line).agg(F.count("*").alias("n"), F.min("top1").alias("top1"), F.max("top1").alias("_last"), F.bool_and(F.col("kind").eqNullSafe("material")).alias("_material"), F.count("top1").alias("_valid"))
    return g.where((F.col("n") == passes) & (F.col("_valid") == passes) & (F.col("top1") == F.col("_last")) & F.col("_material")).select(line, "top1")


def suspects(unanimous: DataFrame, coded: DataFrame, reference: DataFrame, line: str = "line") -> DataFrame:
    """Unanimous lines whose code names a row of the taxonomy other than the reference's triple (blank included)."""
    levels = ["type", "usage", "subtype"]
    known = unanimous.join(coded.select(F.col("code").alias("top1"), *[F.col(c).alias(f"_{c}") for c in levels]), "top1")
    same = F.lit(True)
    for c in levels:
        same = same & (F.coalesce(c, F.lit("")) == F.coalesce(f"_{c}", F.lit("")))
    return known.join(reference, line).where(~same).select(line, "top1")


def precision_by(votes: DataFrame, level: str) -> DataFrame:
    """level, n, correct, precision of votes(correct) at each vote count or gap."""
    return votes.groupBy(level).agg(F.count("*").alias("n"), F.count_if("correct").alias("correct")).withColumn("precision", F.try_divide("correct", "n"))


def systematic(votes: DataFrame, passes: int) -> DataFrame:
    """One row: wrong lines, those on which all passes agree, and their share."""
    wrong = F.coalesce(~F.col("correct"), F.lit(True))
    out = votes.agg(F.count_if(wrong & (F.col("votes") == passes)).alias("unanimous_wrong"), F.count_if(wrong).alias("wrong"))
    return out.withColumn("share", F.try_divide("unanimous_wrong", "wrong"))


def cause_triggers(errors: DataFrame, by: str, causes: DataFrame) -> DataFrame:
    """by, cause, n, share, triggered, weighted for every cause of the list causes(cause), also where it has no rows.

    errors: by, cause, kind. A cause triggers with TRIGGER_ROWS rows or TRIGGER_SHARE of the group's rows; kinds of
    HEAVY_KINDS weigh HEAVY. Rows are counted before groups meet the list. The share is over all rows of the group,
    also those whose cause is not on the list.
    """
    weight = F.when(F.col("kind").isin(*HEAVY_KINDS), HEAVY).otherwise(1)
    counted = errors.groupBy(by, "cause").agg(F.count("*").alias("n"), F.sum(weight).alias("weighted"))
    totals = counted.groupBy(by).agg(F.sum("n").alias("_rows"))
    listed = causes.agg(F.collect_set("cause").alias("_all"))  # one row: the closed list of causes
    every = totals.crossJoin(F.broadcast(listed)).select(by, "_rows", F.explode("_all").alias("cause"))
    out = every.join(counted, [by, "cause"], "left")
    n = F.coalesce("n", F.lit(0))
    share = n / F.col("_rows")
    return out.select(by, "cause", n.alias("n"), share.alias("share"), ((n >= TRIGGER_ROWS) | ((n > 0) & (n >= TRIGGER_SHARE * F.col("_rows")))).alias("triggered"), F.coalesce("weighted", F.lit(0)).cast("long").alias("weighted"))


def counted(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: a contingency table (decision, agreeing passes and correctness; type and section)."""
    return lines.groupBy(*keys).agg(F.count("*").alias("n"))


def taxonomy_size(rows: DataFrame) -> DataFrame:
    """One row: types, usages (per type), rows."""
    return rows.agg(F.count_distinct("type").alias("types"), F.count_distinct(F.struct("type", "usage")).alias("usages"), F.count("*").alias("rows"))

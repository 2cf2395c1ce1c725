"""Choice of an operating point: sweeps, risk and coverage, the selection rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: An operating point needs so many matches, and may lose so many correct ones against the loosest that qualifies.
LEAST_MATCHED, SLACK = 40, 3


def sweep(pool: DataFrame, by: list[str], score: list[str], correct: str = "correct") -> DataFrame:
    """by, score, matched, correct at every distinct score, strictest first; equal scores move together.

    Scores are counted before the running sum, so the window runs over distinct scores only.
    """
    counts = pool.groupBy(*by, *score).agg(F.count("*").alias("_n"), F.sum(F.col(correct).cast("long")).alias("_c"))
    w = Window.partitionBy(*by).orderBy(*[F.desc(s) for s in score]).rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(*by, *score, F.sum("_n").over(w).alias("matched"), F.sum("_c").over(w).alias("correct"))


def risk_coverage(steps: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """steps of sweep() with precision, risk and coverage of totals(by, population, labelled)."""
    p = F.try_divide("correct", "matched")
    return steps.join(totals, by).select("*", p.alias("precision"), (1 - p).alias("risk"), F.try_divide("matched", "population").alias("selective_coverage"), F.try_divide("correct", "labelled").alias("coverage")).drop("population", "labelled")


def selected(table: DataFrame, bar: float, least: int = LEAST_MATCHED, slack: int = SLACK) -> DataFrame:
    """One row: the chosen threshold of table(threshold, ord, lang, matched, correct, bound), ord 1 being the strictest.

    A threshold qualifies if every language has enough matches and precision at the bar; of those the strictest that
    loses at most slack correct matches against the loosest. If none does, the one whose worst bound is best.
    """
    ok = (F.col("matched") >= least) & (F.try_divide("correct", "matched") >= bar)
    per = table.groupBy("threshold", "ord").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("qualifies"), F.sum("correct").alias("correct"), F.min(F.coalesce("bound", F.lit(0.0))).alias("worst"))
    everything = Window.partitionBy()  # a handful of thresholds
    loosest = F.max(F.when(F.col("qualifies"), F.struct("ord", "correct"))).over(everything)["correct"]
    marked = per.withColumn("_l", loosest).withColumn("_rank", F.when(F.col("qualifies") & (F.col("correct") >= F.col("_l") - slack), 0).when(F.col("_l").isNull(), 1))
    best = marked.where(F.col("_rank").isNotNull()).withColumn("_worst", F.when(F.col("_rank") == 1, F.col("worst")))
    return best.orderBy(F.col("_rank"), F.desc("_worst"), "ord").limit(1).select("threshold", "ord", F.when(F.col("_rank") == 0, "qualified").otherwise("fallback").alias("how"), "correct", "worst")


# --- points that were not measured ------------------------------------------------------------------------------------


def bounded(points: DataFrame, labelled: DataFrame) -> DataFrame:
    """points(threshold, ord, lang, matched, correct; null where not measured) with measured and ceiling per threshold: (threshold, ord, measured, correct, ceiling).

    Looser thresholds keep all that stricter ones match, so a point's correct matches are at most those of the next looser
    measured point of its language, and at most labelled(lang, n). A threshold is measured if all its languages are; its
    ceiling is the sum of their figures or bounds.
    """
    looser = Window.partitionBy("lang").orderBy("ord").rowsBetween(0, Window.unboundedFollowing)
    bound = F.coalesce(F.first("correct", ignorenulls=True).over(looser), F.col("n"))
    each = points.join(labelled.select("lang", "n"), "lang", "left").withColumn("_bound", bound)
    return each.groupBy("threshold", "ord").agg(F.bool_and(F.col("matched").isNotNull()).alias("measured"), F.sum("correct").alias("correct"), F.sum("_bound").alias("ceiling"))


def sensitivity(table: DataFrame, bar: float, target: float | None = None, least: int = LEAST_MATCHED, slack: int = SLACK) -> DataFrame:
    """scope, threshold, ord, how, loosest, loosest_correct: the rule over all languages, for each language alone and, if given, at another bar.

    A table row takes part in up to three scopes, which are grouped at once; how is qualified or fallback, as in selected().
    """
    scopes = [F.struct(F.lit("all").alias("scope"), F.lit(bar).alias("bar")), F.struct(F.concat(F.lit("lang:"), "lang").alias("scope"), F.lit(bar).alias("bar"))]
    scopes += [] if target is None else [F.struct(F.lit("target").alias("scope"), F.lit(target).alias("bar"))]
    each = table.select("*", F.inline(F.array(*scopes)))
    ok = (F.col("matched") >= least) & (F.try_divide("correct", "matched") >= F.col("bar"))
    per = each.groupBy("scope", "threshold", "ord").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("qualifies"), F.sum("correct").alias("correct"), F.min(F.coalesce("bound", F.lit(0.0))).alias("worst"))
    w = Window.partitionBy("scope")
    loosest = F.max(F.when(F.col("qualifies"), F.struct("ord", "threshold", "correct"))).over(w)
    marked = per.withColumn("_l", loosest).withColumn("how", F.when(F.col("qualifies") & (F.col("correct") >= F.col("_l.correct") - slack), "qualified").when(F.col("_l").isNull(), "fallback")).where("how IS NOT NULL")
    order = F.row_number().over(w.orderBy(F.desc(F.when(F.col("how") == "fallback", F.col("worst"))), "ord"))
    return marked.withColumn("_k", order).where("_k = 1").select("scope", "threshold", "ord", "how", F.col("_l.threshold").alias("loosest"), F.col("_l.ord").alias("loosest_ord"), F.col("_l.correct").alias("loosest_correct"))


def checked_selection(points: DataFrame, labelled: DataFrame, bar: float, target: float | None = None, least: int = LEAST_MATCHED, slack: int = SLACK) -> DataFrame:
    """scope, threshold, how, loosest, refused: the rule over the measured thresholds, and why it can't be trusted, else null.

    refused: unmeasured points exist and no measured one meets the bar; one is looser than the loosest that qualifies; or
    one's ceiling reaches what the rule would still take. Without any measured threshold there is one row, scope all.
    """
    limits = bounded(points, labelled)
    measured = points.join(limits.where("measured").select("threshold"), "threshold", "left_semi")
    chosen = sensitivity(measured, bar, target, least, slack)
    open_ = limits.where("NOT measured")
    totals = open_.agg(F.count("*").alias("unmeasured"), F.max("ord").alias("last_ord"), F.max("ceiling").alias("highest"))  # one row
    overall = chosen.where("scope = 'all'").select(F.col("how").alias("_how"), F.col("loosest_ord").alias("_ord"), F.col("loosest_correct").alias("_correct"))  # one row
    # all sides here are a handful of rows: a threshold each at most
    judged = totals.join(F.broadcast(overall), F.lit(True), "left").select(
        F.when(F.col("unmeasured") == 0, None).when(F.col("_how").isNull(), "nothing is measured").when(F.col("_how") != "qualified", "no measured threshold meets the bar")
        .when(F.col("last_ord") > F.col("_ord"), "looser than the loosest that qualifies").when(F.col("highest") >= F.col("_correct") - slack, "a ceiling reaches the window").alias("refused")
    )
    return judged.join(F.broadcast(chosen), F.lit(True), "left").select(F.coalesce("scope", F.lit("all")).alias("scope"), "threshold", "how", "loosest", "refused")

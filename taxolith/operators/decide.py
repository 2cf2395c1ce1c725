"""The decision table: first rule that fires wins; and its thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rule, decision, reason, in the order in which rules fire.
RULES = (
    ("D0", "not_a_material", "HEADER"), ("D0a", "not_a_material", "EMPTY_ROW"), ("D0b", "needs_review", "HEADER_UNCONFIRMED"),
    ("D1", "needs_review", "LLM_FAILURE"), ("D1b", "needs_review", "LLM_FAILURE:partial_signal"), ("D2", "not_a_material", "G2_SERVICE"),
    ("D3", "needs_review", "NM_UNCONFIRMED"), ("D4", "needs_review", "NO_LIBRARY_EQUIVALENT"), ("D5", "needs_review", "INVALID_ROW_ID"),
    ("D5a", "needs_review", "EVIDENCE_NOT_IN_LINE"), ("D6", "needs_review", "NEVER_MATCH_ROW"), ("D7", "needs_review", "ATTR_CONFLICT"),
    ("D8", "needs_review", "GENERIC_PARENT"), ("D8a", "needs_review", "VERIFIER_DISAGREES"), ("D9", "matched", "SIGNAL"), ("D10", "needs_review", "LOW_SIGNAL"),
)
BUCKETS = (90, 80, 70)


def bucket(confidence: Column) -> Column:
    """3 from 90, 2 from 80, 1 from 70, else 0; outside 0..100 is an error."""
    out = F.when(~confidence.between(0, 100), F.raise_error(F.concat(F.lit("confidence outside 0..100: "), confidence.cast("string"))).cast("int"))
    for k, low in enumerate(BUCKETS):
        out = out.when(confidence >= low, len(BUCKETS) - k)
    return out.otherwise(F.when(confidence.isNotNull(), 0))


def thresholds(spark: SparkSession, passes: int) -> DataFrame:
    """T1, the strictest, to T8: v, b (1: attributes agree), bucket."""
    rows = [(f"T{4 * (1 - b) + 4 - k}", 4 * (1 - b) + 4 - k, passes, b, k) for b in (1, 0) for k in (3, 2, 1, 0)]
    return spark.createDataFrame(rows, "threshold string, ord int, min_v int, min_b int, min_bucket int")


def met(lines: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates with lines: how many of lines(votes, agrees, confidence, tie) reach each. Lines are counted by signals first."""
    cells = lines.groupBy(F.col("votes").cast("int").alias("v"), F.col("agrees").cast("int").alias("b"), bucket(F.col("confidence")).alias("k"), "tie").agg(F.count("*").alias("n"))
    reached = (F.struct("v", "b", "k") >= F.struct(F.col("min_v").alias("v"), F.col("min_b").alias("b"), F.col("min_bucket").alias("k"))) & ~F.col("tie")
    joined = F.broadcast(candidates).join(cells, F.lit(True))  # a handful of thresholds, a handful of signals
    return joined.groupBy(*candidates.columns).agg(F.sum(F.when(reached, F.col("n")).otherwise(0)).alias("lines"))


def failed_signals(v: Column, b: Column, k: Column, tie: Column) -> Column:
    """Names of the signals below the threshold, joined by +; a tie fails v."""
    return F.array_join(F.array_compact(F.array(F.when((v < F.col("min_v")) | tie, "v"), F.when(b < F.col("min_b"), "b"), F.when(k < F.col("min_bucket"), "confidence"))), "+")


def decided(lines: DataFrame) -> DataFrame:
    """lines with rule, decision, reason.

    Read: kind, measured (unit or quantity given), all_blank, failure (null or a reason that ends the line), answers and
    failed_passes (counts), all_non_material, service_gate, any_non_material, any_no_equivalent, valid_code,
    evidence_ok, never_match, attributes (agree, conflict, no_evidence), generic_parent, votes, confidence, tie,
    verifier (null: not asked; its answer), leader, min_v, min_b, min_bucket.
    """
    c = F.col
    b, k = (c("attributes") == "agree").cast("int"), bucket(c("confidence"))
    # scores compare as tuples: the first signal that differs decides
    enough = F.struct(c("votes").cast("int").alias("v"), b.alias("b"), k.alias("k")) >= F.struct(c("min_v").alias("v"), c("min_b").alias("b"), c("min_bucket").alias("k"))
    passing = enough & ~c("tie")
    rule = (
        F.when(~c("measured") & (c("kind") == "header"), "D0").when(~c("measured") & (c("kind") == "empty_row") & c("all_blank"), "D0a").when(~c("measured"), "D0b")
        .when(c("failure").isNotNull() | (c("answers") == 0), "D1").when((c("failed_passes") > 0) | (c("answers") < c("min_v")), "D1b")
        .when(c("all_non_material") & c("service_gate"), "D2").when(c("any_non_material"), "D3").when(c("any_no_equivalent"), "D4")
        .when(~c("valid_code"), "D5").when(~c("evidence_ok"), "D5a").when(c("never_match"), "D6").when(c("attributes") == "conflict", "D7").when(c("generic_parent"), "D8")
        .when(passing & c("verifier").isNotNull() & (c("verifier") != c("leader")), "D8a").when(passing, "D9").otherwise("D10")
    )
    named = lambda i: F.create_map(*[F.lit(x) for r in RULES for x in (r[0], r[i])])[c("rule")]
    out = lines.withColumn("rule", rule).withColumn("decision", named(1))
    detail = F.when(c("rule") == "D10", F.concat(F.lit("LOW_SIGNAL:"), failed_signals(c("votes"), b, k, c("tie")))).when((c("rule") == "D1") & c("failure").isNotNull(), c("failure")).when((c("rule") == "D1"), "INTERNAL_INVARIANT").otherwise(named(2))
    return out.withColumn("reason", detail)


def decided_any_valid(lines: DataFrame) -> DataFrame:
    """The baseline that matches every valid leading code."""
    return lines.withColumn("decision", F.when(~F.col("measured") & (F.col("kind") != "item"), F.when(F.col("kind") == "header_unconfirmed", "needs_review").otherwise("not_a_material")).when(F.col("valid_code"), "matched").otherwise("needs_review"))


def violations(decisions: DataFrame) -> DataFrame:
    """Rows that break what every decision keeps: rule and decision belong together, only D9 matches, reasons are never blank. Must be empty."""
    allowed = F.create_map(*[F.lit(x) for r in RULES for x in (r[0], r[1])])[F.col("rule")]
    return decisions.where(F.col("decision").isNull() | (F.col("decision") != allowed) | (F.coalesce("reason", F.lit("")) == "") | ((F.col("decision") == "matched") & (F.col("rule") != "D9")))

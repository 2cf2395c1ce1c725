"""The verifier stage: lines that the table would match are asked about again, and what comes back decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolith.operators import decide

# What a verifier says when no row fits, the failure of a code that is no candidate, failures of requests
# that never reached a model, the rules and reasons of what follows.
NONE, INVALID = "NONE", "invalid_code"
UNANSWERED = ("replay_miss", "LLM_UNAVAILABLE", "BUDGET_CAP")
SILENT, DISAGREES = ("D1b", "needs_review", "LLM_FAILURE:partial_signal"), ("D8a", "needs_review", "VERIFIER_DISAGREES")


def flagged(lines: DataFrame) -> DataFrame:
    """line, leader of the lines that the decision table matches with the verifier off."""
    off = lines.withColumn("verifier", F.lit(None).cast("string"))
    return decide.decided(off).where("rule = 'D9'").select("line", "leader")


def sibling_rows(leaders: DataFrame, coded: DataFrame) -> DataFrame:
    """line, type, candidates: all codes of the type that the leader belongs to, in order; the codes of a type are gathered once."""
    types = coded.groupBy("type").agg(F.array_sort(F.collect_list("code")).alias("candidates"))
    return leaders.join(coded.select(F.col("code").alias("leader"), "type"), "leader").join(types, "type").select("line", "leader", "type", "candidates")


def verifier_lines(asked: DataFrame, outcomes: DataFrame) -> DataFrame:
    """line, leader, answer, failure of lines asked about (sibling_rows): a valid candidate or NONE, else why there is none.

    outcomes: line, code (null: no verdict), failure. A line without an outcome never reached the model.
    """
    j = asked.join(outcomes.select("line", "code", F.col("failure").alias("_f"), F.lit(True).alias("_there")), "line", "left")
    valid = F.array_contains("candidates", F.col("code")) | (F.col("code") == NONE)
    failure = F.when(F.col("_there").isNull(), UNANSWERED[0]).when(F.col("code").isNull(), F.coalesce("_f", F.lit("api_error"))).when(~valid, INVALID)
    return j.select("line", "leader", F.when(valid, F.col("code")).alias("answer"), failure.alias("failure"))


def verified(decided: DataFrame, answers: DataFrame) -> DataFrame:
    """decided (by the table with the verifier off) once the answers count: without one a match is a partial signal, with another code it is vetoed.

    Lines that no answer belongs to keep their decision; the rest of the table is not run again.
    """
    a = answers.select("line", "answer", F.lit(True).alias("_asked"))
    j = decided.join(a, "line", "left")
    hit = F.coalesce(F.col("_asked"), F.lit(False)) & (F.col("rule") == "D9")
    silent, other = hit & F.col("answer").isNull(), hit & (F.col("answer") != F.col("leader"))
    named = {c: F.when(silent, SILENT[k]).when(other, DISAGREES[k]).otherwise(F.col(c)) for k, c in enumerate(("rule", "decision", "reason"))}
    return j.withColumns(named).drop("_asked", "answer")


def unanswered(answers: DataFrame) -> DataFrame:
    """One row: lines asked about, and those whose request never reached the model."""
    return answers.agg(F.count("*").alias("asked"), F.count_if(F.col("failure").isin(*UNANSWERED)).alias("unanswered"))

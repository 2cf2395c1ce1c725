"""Recorded votes decided again: thresholds, policies, verification groups, cross-model rules, experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolith.operators import decide


def redecided(facts: DataFrame, thresholds: DataFrame) -> DataFrame:
    """facts decided at every threshold; thresholds are a handful and are broadcast."""
    return decide.decided(facts.drop("min_v", "min_b", "min_bucket").crossJoin(F.broadcast(thresholds)))


def resolved_policy(queries: DataFrame, policies: DataFrame, strictest: str) -> DataFrame:
    """queries(model, library_hash, override) with threshold and how: the override, the exact entry, else the strictest."""
    p = policies.select("model", "library_hash", F.col("threshold").alias("_t"))
    j = queries.join(p, ["model", "library_hash"], "left")
    return j.withColumn("how", F.when(F.col("override").isNotNull(), "override").when(F.col("_t").isNotNull(), "policy").otherwise("fallback")).withColumn("threshold", F.coalesce("override", "_t", F.lit(strictest))).drop("_t")


def verifier_groups(flagged: DataFrame, coded: DataFrame, size: int, order: str = "line") -> DataFrame:
    """type, group_no, lines, candidates: flagged lines (line, leader) by the type of their leading code, cut at size, with all codes of that type."""
    typed = flagged.join(coded.select(F.col("code").alias("leader"), "type"), "leader")
    numbered = typed.withColumn("group_no", F.floor((F.row_number().over(Window.partitionBy("type").orderBy(order)) - 1) / size))
    groups = numbered.groupBy("type", "group_no").agg(F.array_sort(F.collect_list(order)).alias("lines"))
    candidates = coded.groupBy("type").agg(F.array_sort(F.collect_list("code")).alias("candidates"))
    return groups.join(candidates, "type")


def policy_figures(lines: DataFrame, policies: dict[str, Column], by: list[str]) -> DataFrame:
    """by, policy, matched, correct, precision for several rules of matching in one pass over lines(correct)."""
    each = F.array(*[F.struct(F.lit(n).alias("policy"), F.coalesce(c, F.lit(False)).alias("is_matched")) for n, c in policies.items()])
    rows = lines.select(*by, "correct", F.inline(each))
    g = rows.groupBy(*by, "policy").agg(F.count_if("is_matched").alias("matched"), F.count_if(F.col("is_matched") & F.col("correct")).alias("correct"))
    return g.withColumn("precision", F.try_divide("correct", "matched"))


def keep_verdict(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """One row: gain, discordant, improved of item-wise correctness (0 or 1) before and after, and whether gain >= max(6, 2 * sqrt(discordant))."""
    j = before.withColumnRenamed("correct", "_b").join(after.withColumnRenamed("correct", "_a"), key, "full_outer")
    delta = F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0))
    out = j.agg(F.sum(delta).alias("gain"), F.count_if(delta != 0).alias("discordant"), F.count_if(delta > 0).alias("improved"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unpaired"))
    return out.withColumn("keep", (F.col("gain") >= F.greatest(F.lit(6.0), 2 * F.sqrt("discordant"))) & (F.col("unpaired") == 0))


def reconciled(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """batch, id, state of each line asked for: settled by one answer or by equal ones, conflict by unequal ones, missing; unknown ids are dropped."""
    e = entries.groupBy("batch", "id").agg(F.countDistinct("raw").alias("kinds"), F.min("raw").alias("raw"))
    j = asked.join(e, ["batch", "id"], "left")
    return j.select("batch", "id", F.when(F.col("kinds").isNull(), "missing").when(F.col("kinds") > 1, "conflict").otherwise("settled").alias("state"), F.when(F.col("kinds") == 1, F.col("raw")).alias("raw"))

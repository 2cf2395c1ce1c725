"""What an output must keep of its input, its library and its run: each requirement is a table of breaches that must be empty.

Tables: lines(position, line_id, raw_row, unit, text), output(position, cells, decision, type, usage, subtype, reason,
call_ids), library(type, usage, subtype), audit(line_id, position, call_ids, raw), calls(call_id, cost, error, requested,
served and whatever must be complete). A breach is (requirement, item, problem).
"""

from __future__ import annotations

import fnmatch
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolith.functions import text as texts

DECISIONS = ("matched", "needs_review", "not_a_material")
# Reasons that may skip a line, reasons and prefix without an answer, limits a hundred lines and a line have.
SKIPS = ("HEADER", "EMPTY_ROW", "G2_SERVICE")
UNANSWERED, FAILURES = ("HEADER", "EMPTY_ROW", "HEADER_UNCONFIRMED"), "LLM_"
COST_PER_100, SECONDS_PER_LINE, CELL_ROUNDING = 2.0, 2.0, 5e-7


def breach(df: DataFrame, requirement: str, item: Column, problem: Column | str) -> DataFrame:
    said = F.lit(problem) if isinstance(problem, str) else problem
    return df.select(F.lit(requirement).alias("requirement"), item.cast("string").alias("item"), said.alias("problem")).where("problem IS NOT NULL")


def columns(seen: list[str], expected: list[str], df: DataFrame) -> DataFrame:
    """The first column that is not the expected one; df is any table of the session."""
    wrong = next((k for k, (a, b) in enumerate(zip(seen, expected, strict=False)) if a != b), min(len(seen), len(expected)) if len(seen) != len(expected) else None)
    rows = [] if wrong is None else [("columns", str(wrong + 1), "name" if wrong < min(len(seen), len(expected)) else "number")]
    return df.sparkSession.createDataFrame(rows, "requirement string, item string, problem string")


def rows_kept(lines: DataFrame, output: DataFrame) -> DataFrame:
    """Rows that are missing, new, or whose first cells are not the input's."""
    a, b = lines.select("position", F.col("raw_row").alias("a")), output.select("position", F.col("cells").alias("b"))
    j = a.join(b, "position", "full")
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "new").when(F.slice("b", F.lit(1), F.size("a")) != F.col("a"), "changed")
    return breach(j, "rows", F.col("position"), problem)


def decisions_known(output: DataFrame) -> DataFrame:
    return breach(output.where(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False))), "decisions", F.col("position"), "unknown")


def closed_world(output: DataFrame, library: DataFrame) -> DataFrame:
    """Matched triples that are no row of the library, and labels on rows that are not matched."""
    levels = ["type", "usage", "subtype"]
    blank = F.concat_ws("", *levels) == ""
    known = output.join(library.select(*levels).distinct().withColumn("_known", F.lit(True)), levels, "left")
    matched = F.col("decision") == "matched"
    return breach(known, "closed_world", F.col("position"), F.when(matched & F.col("_known").isNull(), "no row of the library").when(~F.coalesce(matched, F.lit(False)) & ~blank, "labels without a match"))


def service_unit(unit: Column, units: list[str], aliases: dict[str, str]) -> Column:
    """Is the unit, or what it stands for, a unit of services; case counts."""
    trimmed = F.trim(F.coalesce(unit, F.lit("")))
    canonical = F.coalesce(*[F.when(trimmed == k, F.lit(v)) for k, v in aliases.items()], trimmed)
    return trimmed.isin(*units) | canonical.isin(*units)


def skips_backed(output: DataFrame, lines: DataFrame, units: list[str], aliases: dict[str, str], markers: list[str], norm=texts.normalize) -> DataFrame:
    """Skipped rows whose reason may not skip, and services that are measured otherwise or that name a supply in the normal form of their text."""
    skipped = output.where(F.col("decision") == "not_a_material").join(lines.select("position", "unit", "text", F.lit(True).alias("_line")), "position", "left")
    supply = norm(F.col("text")).rlike(texts.phrase_pattern(markers))
    service = F.col("reason") == "G2_SERVICE"
    problem = (
        F.when(~F.coalesce(F.col("reason").isin(*SKIPS), F.lit(False)), "reason").when(service & F.col("_line").isNull(), "no line")
        .when(service & ~service_unit(F.col("unit"), units, aliases), "unit").when(service & F.coalesce(supply, F.lit(False)), "supply marker")
    )
    return breach(skipped, "skips", F.col("position"), problem)


def audit_complete(lines: DataFrame, audit: DataFrame, output: DataFrame, calls: DataFrame, fields: list[str]) -> DataFrame:
    """Audit records that are missing, repeated, unknown or out of order; unknown calls; answers without a text; incomplete calls."""
    a = lines.select("line_id", F.col("position").alias("at"))
    b = audit.groupBy("line_id").agg(F.count("*").alias("n"), F.min("position").alias("told"))
    j = a.join(b, "line_id", "full")
    one = F.when(F.col("n").isNull(), "missing").when(F.col("at").isNull(), "unknown line").when(F.col("n") > 1, "repeated").when(F.col("told") != F.col("at"), "out of order")
    records = breach(j, "audit", F.col("line_id"), one)
    first = audit.groupBy("position").agg(F.first("call_ids").alias("_ids"), F.first("raw").alias("raw"))
    used = output.select("position", "reason", "call_ids").join(first, "position", "left").withColumn("ids", F.array_distinct(F.concat("call_ids", F.coalesce("_ids", F.array().cast("array<string>")))))
    unknown = used.select("position", F.explode("ids").alias("call_id")).join(calls.select("call_id"), "call_id", "left_anti").select("position").distinct()
    answered = ~(F.col("reason").startswith(FAILURES) | F.col("reason").isin(*UNANSWERED))
    silent = used.where((F.size("ids") > 0) & answered & (F.coalesce(F.size("raw"), F.lit(0)) <= 0))
    absent = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]))
    incomplete = calls.where(F.col("error").isNull()).select("call_id", F.array_join(absent, ",").alias("absent")).where("absent <> ''")
    parts = [records, breach(unknown, "calls", F.col("position"), "unknown call"), breach(silent, "calls", F.col("position"), "no text"), breach(incomplete, "calls", F.col("call_id"), F.concat(F.lit("lacks "), F.col("absent")))]
    return reduce(DataFrame.unionByName, parts)


def cost_kept(line_costs: DataFrame, calls: DataFrame, spend: float, limit: float = COST_PER_100) -> DataFrame:
    """Breaches of a cold live run's costs: lines(cost) against calls(cost), calls against the manifest, the limit of 100 lines."""
    a = line_costs.agg(F.count("*").alias("n"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("lines"))
    b = calls.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("calls"))
    t = a.crossJoin(F.broadcast(b))  # two rows of one row each
    problems = [
        F.when(F.abs(F.col("lines") - F.col("calls")) > F.col("n") * CELL_ROUNDING + 1e-9, "lines don't sum to calls"),
        F.when(F.abs(F.lit(spend) - F.col("calls")) > 1e-6, "spend is not the calls'"), F.when(F.lit(spend) * 100 / F.greatest("n", F.lit(1)) > limit, "over the limit"),
    ]
    return breach(t.select(F.explode(F.array_compact(F.array(*problems))).alias("p")), "cost", F.lit("run"), F.col("p"))


def latency_kept(manifests: DataFrame, limit: float = SECONDS_PER_LINE) -> DataFrame:
    """Cold live runs of manifests(run, mode, cache_hits, wall_s, routed) that took too long a routed line, or routed none."""
    cold = manifests.where((F.col("mode") == "live") & (F.col("cache_hits") == 0))
    return breach(cold, "latency", F.col("run"), F.when(F.col("routed") <= 0, "nothing routed").when(F.col("wall_s") / F.col("routed") > limit, "too slow"))


def allowed_model(model: Column, patterns: list[str]) -> Column:
    """Does a pattern admit the model: wildcards, or local:<=NB for local models by their size in billions."""
    held = F.lit(False)
    for p in patterns:
        if m := re.fullmatch(r"local:<=(\d+(?:\.\d+)?)[bB]", p):
            size = F.regexp_extract(model, r"^local:.*?(\d+(?:\.\d+)?)[bB]$", 1)
            held = held | F.coalesce(size.try_cast("double") <= float(m[1]), F.lit(False))
        else:
            held = held | model.rlike("^" + fnmatch.translate(p))
    return F.coalesce(held, F.lit(False))


def models_allowed(calls: DataFrame, patterns: list[str]) -> DataFrame:
    """Models that calls asked for or were served by and that no pattern admits; each once."""
    models = calls.select(F.explode(F.array("requested", "served")).alias("model")).where("model IS NOT NULL").distinct()
    return breach(models.where(~allowed_model(F.col("model"), patterns)), "models", F.col("model"), "not allowed")


def report(found: list[DataFrame], examples: int = 5) -> DataFrame:
    """requirement, problem, n, examples: breaches counted, with the first few items of each."""
    every = reduce(DataFrame.unionByName, found)
    counts = every.groupBy("requirement", "problem").agg(F.count("*").alias("n"))
    ranked = every.withColumn("_k", F.row_number().over(Window.partitionBy("requirement", "problem").orderBy(F.length("item"), "item"))).where(F.col("_k") <= examples)
    some = ranked.groupBy("requirement", "problem").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "item"))), lambda x: x["item"]), ",").alias("examples"))
    return counts.join(some, ["requirement", "problem"])

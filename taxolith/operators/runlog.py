"""The log of calls: cost per line, percentiles, replay and cache lookups, breaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolith.operators.ranks import nearest_ranks


def attributed(calls: DataFrame) -> DataFrame:
    """calls(call_id, ord, line_ids, cost, latency_ms) → line_id, cost, latency_ms, call_ids in order: a call's cost and time are split evenly over its lines."""
    n = F.size("line_ids")
    each = calls.where(n > 0).select("call_id", "ord", (F.col("cost") / n).alias("part"), (F.col("latency_ms") / n).alias("time"), F.explode("line_ids").alias("line_id"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ord", "call_id"))), lambda s: s["call_id"])
    return each.groupBy("line_id").agg(F.sum("part").alias("cost"), F.bround(F.sum("time"), 0).cast("long").alias("latency_ms"), ids.alias("call_ids"))


def priced(calls: DataFrame, pricing: DataFrame, per_tokens: float = 1e6) -> DataFrame:
    """calls with cost from pricing(provider, model, input_price, output_price, read_price, write_price); an unknown model is an error."""
    joined = calls.join(pricing, ["provider", "model"], "left")
    cost = (F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price") + F.col("cache_read_tokens") * F.col("read_price") + F.col("cache_write_tokens") * F.col("write_price")) / per_tokens
    return joined.withColumn("cost", F.when(F.col("input_price").isNull(), F.raise_error(F.concat(F.lit("no price for "), F.col("model"))).cast("double")).otherwise(cost)).drop("input_price", "output_price", "read_price", "write_price")


def summary(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls, cache hits, spend without hits, p50 and p95 latency by nearest rank, failures, per group."""
    counts = calls.groupBy(*by).agg(
        F.count("*").alias("calls"), F.count_if("cache_hit").alias("hits"), F.sum(F.when(~F.col("cache_hit"), F.col("cost")).otherwise(0.0)).alias("spend"), F.count_if(F.col("error").isNotNull()).alias("failures"),
    )
    ranks = nearest_ranks(calls, by, "latency_ms", {"p50_ms": 50, "p95_ms": 95})
    return counts.join(ranks, by, "left").select(*by, "calls", "hits", "spend", "p50_ms", "p95_ms", "failures")


def histogram(rows: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """by, name: a map from each value of the column to its count, values in order."""
    counts = rows.groupBy(*by, column).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "_n")))).alias(name))


def run_mode(adapter: Column, cached_calls: Column) -> Column:
    """Where a run's answers came from: replay and fake adapters say so, else any answer from a cache makes it cached."""
    return F.when(adapter.isin("replay", "fake"), adapter).when(cached_calls > 0, "cached").otherwise("live")


def run_report(lines: DataFrame, calls: DataFrame, runs: DataFrame) -> DataFrame:
    """One row for each of runs(run, adapter): counts, histograms, usage, latency of routed lines, cost of 100 lines, exit code.

    lines: run, decision, reason, kind, cost, latency_ms, n_calls; calls: run, cache_hit, retry, cost, cache_read,
    cache_write. Both are summed by run before they meet; reasons and decisions are few.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    a = lines.groupBy("run").agg(F.count("*").alias("lines"), F.count_if(F.col("kind") == "item").alias("routed"), total(F.col("cost")).alias("attributed_cost"), F.count_if(F.col("reason") == "LLM_UNAVAILABLE").alias("unavailable"))
    b = calls.groupBy("run").agg(
        F.count("*").alias("calls"), F.count_if("retry").alias("retries"), F.count_if("cache_hit").alias("cache_hits"), total(F.when(~F.col("cache_hit"), F.col("cost")).otherwise(0.0)).alias("spend"), total(F.col("cache_read")).alias("cache_read"), total(F.col("cache_write")).alias("cache_write")
    )
    latency = nearest_ranks(lines.where("n_calls > 0"), ["run"], "latency_ms", {"p50_ms": 50, "p95_ms": 95})
    out = runs
    for part in (a, b, histogram(lines, ["run"], "decision", "decisions"), histogram(lines, ["run"], "reason", "reasons"), latency):
        out = out.join(part, "run", "left")
    counts = ["lines", "routed", "calls", "retries", "cache_hits", "cache_read", "cache_write", "unavailable"]
    filled = out.fillna(0, counts).fillna(0.0, ["attributed_cost", "spend"])
    per_100 = F.when(F.col("lines") > 0, F.col("attributed_cost") * 100 / F.col("lines")).otherwise(0.0)
    return filled.select(
        "run", run_mode(F.col("adapter"), F.col("cache_hits")).alias("mode"), *counts[:-1], "decisions", "reasons", "spend", "attributed_cost", per_100.alias("cost_per_100"), "p50_ms", "p95_ms", F.when(F.col("unavailable") > 0, 3).otherwise(0).alias("exit_code")
    )


def occurrence(df: DataFrame, key: list[str], order: list[str], name: str = "occ") -> DataFrame:
    """df with the 0-based number of each row among those of its key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)


def cached(requests: DataFrame, recorded: DataFrame, key: str = "request_hash") -> DataFrame:
    """The k-th request of a hash is served by the k-th recorded response; request columns, response (null: a miss), served_by."""
    r = occurrence(recorded, [key], ["ord"]).select(key, "occ", F.col("response"), F.col("call_id").alias("served_by"))
    return occurrence(requests, [key], ["ord"]).join(r, [key, "occ"], "left")


# How a call may end, in the order of the reference's list; all but the first are failures named so.
STATUSES = ("ok", "timeout", "rate_limited", "overloaded", "api_error", "truncated", "malformed", "refusal")
CONTENT = ("ok", "truncated", "malformed", "refusal")
TRANSPORT = ("timeout", "rate_limited", "overloaded")
RETRYABLE_HTTP = (408, 409)


def failure_kind(status: Column, replay_miss: Column) -> Column:
    """A replay miss comes before the status; null for a call that went well."""
    return F.when(replay_miss, "replay_miss").when(status.isin(*STATUSES[1:]), status)


def retryable(status: Column, replay_miss: Column, http: Column, should_retry: Column) -> Column:
    """Never for content and replay misses; else as the server asks, then transport failures, those without a code, and some codes."""
    code = http.isin(*RETRYABLE_HTTP) | http.between(500, 599)
    return F.when(replay_miss | status.isin(*CONTENT), False).when(should_retry.isNotNull(), should_retry).when(status.isin(*TRANSPORT) | http.isNull(), True).otherwise(code)


def exhausted(calls: DataFrame, batch: str, at_ms: str, most: int = 6, in_flight_ms: int = 90_000) -> DataFrame:
    """batch, exhausted: so many calls, or so long from the first to the last."""
    return calls.groupBy(batch).agg(((F.count("*") >= most) | (F.max(at_ms) - F.min(at_ms) >= in_flight_ms)).alias("exhausted"))


def budget_cap(lines: Column, per_hundred: float, floor: float) -> Column:
    return F.greatest(lines * per_hundred / 100, F.lit(floor))


def breaker(calls: DataFrame, group: list[str], limit: int = 10) -> DataFrame:
    """calls with failures_in_a_row (throttling neither counts nor resets) and tripped."""
    w = Window.partitionBy(*group).orderBy("ord")
    counted = calls.withColumn("_run", F.sum(F.when(F.col("succeeded"), 1).otherwise(0)).over(w))
    run = F.sum(F.when(~F.col("succeeded") & ~F.col("throttled"), 1).otherwise(0)).over(Window.partitionBy(*group, "_run").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("failures_in_a_row", run).withColumn("tripped", F.max((F.col("failures_in_a_row") >= limit).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("_run")


def admitted(calls: DataFrame, group: list[str], cap: Column) -> DataFrame:
    """calls with spent before each in order, and whether its reservation still fits under the cap."""
    before = F.coalesce(F.sum("cost").over(Window.partitionBy(*group).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return calls.withColumn("spent_before", before).withColumn("admitted", before + F.col("cost") <= cap)


def overlaid(primary: DataFrame, rescue: DataFrame, key: str) -> DataFrame:
    """Rows of rescue in place of those of primary with the same key."""
    return primary.join(rescue.select(key), key, "left_anti").unionByName(rescue)

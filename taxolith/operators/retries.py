"""Retries of failed batches in rounds: halves down to single lines, lines asked again, budgets, and the lineage of tasks.

A task is a batch of lines that is asked together. All tasks of a round are answered at once; what isn't settled goes into
the tasks of the next round. A line is in one task at a time, so rounds give what a queue of tasks would. Rounds are bounded
by the calls a line may have. A task's name is its parent's with `.0` or `.1` for a half, `.m` for its missing and `.c` for
its conflicting lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxolith.sources import tables

#: Statuses of a whole answer after which a batch is halved.
HALVED = ("truncated", "malformed")


def first_tasks(lines: DataFrame, batch: str, line: str, order: str) -> DataFrame:
    """One task for each batch, named as it: (batch, line, task, at, calls, conflicts, last)."""
    at = F.row_number().over(Window.partitionBy(batch).orderBy(order, line)) - 1
    return lines.select(
        F.col(batch).alias("batch"), F.col(line).alias("line"), F.col(batch).cast("string").alias("task"), at.cast("long").alias("at"),
        F.lit(0).alias("calls"), F.lit(0).alias("conflicts"), F.lit(None).cast("string").alias("last"),
    )


def recorded(log: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Answers from a log (batch, line, call, kind): kind of a line's n-th call, ok where the log has none.

    A kind that is a status of whole answers spoils the task's answer for all its lines; the others are missing, conflict,
    invalid and ok.
    """

    def answer(asked: DataFrame) -> DataFrame:
        found = asked.join(log.withColumnRenamed("call", "calls"), ["batch", "line", "calls"], "left").fillna("ok", ["kind"])
        whole = F.when(F.col("kind").isin("missing", "conflict", "invalid", "ok"), None).otherwise(F.col("kind"))
        # of several statuses the least name counts; halving goes on until each line has its own
        return found.withColumn("status", F.coalesce(F.min(whole).over(Window.partitionBy("task")), F.lit("ok")))

    return answer


def one_round(tasks: DataFrame, answer: Callable[[DataFrame], DataFrame], max_calls: int) -> DataFrame:
    """tasks after one round: outcome is null for lines that go on, in the task and place they then have."""
    t = Window.partitionBy("task")
    seen = tasks.withColumns({"size": F.count("*").over(t), "spent": F.max("calls").over(t) >= max_calls})
    over = seen.where("spent").withColumn("outcome", F.coalesce("last", F.lit("api_error"))).withColumn("next", F.col("task"))
    asked = answer(seen.where("NOT spent").withColumn("calls", F.col("calls") + 1))
    status, kind = F.col("status"), F.col("kind")
    halved, ok = status.isin(*HALVED), status == "ok"
    conflicts = F.col("conflicts") + (ok & (kind == "conflict")).cast("int")
    asked = asked.withColumn("conflicts", conflicts)
    outcome = (
        F.when(halved & (F.col("size") == 1), status).when(halved, None).when(~ok, status)
        .when(kind == "ok", "answered").when(kind == "invalid", "malformed").when((kind == "conflict") & (F.col("conflicts") > 1), "duplicate_conflict")
    )
    half = F.floor(F.col("size") / 2)
    suffix = F.when(halved, F.when(F.col("at") < half, ".0").otherwise(".1")).when(kind == "missing", ".m").otherwise(".c")
    last = F.when(halved, status).when(kind == "missing", "missing_item").otherwise("duplicate_conflict")
    asked = asked.withColumn("outcome", outcome).withColumns({"next": F.when(F.col("outcome").isNull(), F.concat("task", suffix)).otherwise(F.col("task")), "last": F.when(F.col("outcome").isNull(), last).otherwise(F.col("last"))})
    columns = ["batch", "line", F.col("next").alias("task"), "at", "calls", "conflicts", "last", "outcome"]
    both = over.select(*columns).unionByName(asked.select(*columns))
    return both.withColumn("at", F.when(F.col("outcome").isNull(), F.row_number().over(Window.partitionBy("task", F.col("outcome").isNull()).orderBy("at")) - 1).otherwise(F.col("at")))


def settled(tasks: DataFrame, answer: Callable[[DataFrame], DataFrame], max_calls: int = 6) -> DataFrame:
    """batch, line, task, calls, conflicts, outcome of every line: answered, or the failure it ends with.

    Each round is written to the shared folder, so that a lost executor costs a task of one round. A task with a line that
    has had max_calls calls is not asked; its lines end with the failure that used the calls up.
    """
    rounds: list[DataFrame] = []
    open_ = tasks
    for _ in range(max_calls + 1):
        rounds.append(tables.written(one_round(open_, answer, max_calls), f"round_{len(rounds)}"))
        open_ = rounds[-1].where("outcome IS NULL").drop("outcome")
        if open_.isEmpty():
            break
    done = rounds[0].where("outcome IS NOT NULL")
    for r in rounds[1:]:
        done = done.unionByName(r.where("outcome IS NOT NULL"))
    return done.select("batch", "line", "task", "calls", "conflicts", "outcome")

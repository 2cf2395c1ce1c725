"""Lineage of a line, audit records and the projection of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def call_fields(audit: DataFrame, calls: DataFrame) -> DataFrame:
    """audit(line, call_ids) with a row per call in order and what was recorded of it; recorded is false where nothing was."""
    each = audit.select("line", F.posexplode("call_ids").alias("call_order", "call_id"))
    return each.join(calls.withColumn("_known", F.lit(True)), "call_id", "left").withColumn("recorded", F.coalesce("_known", F.lit(False))).drop("_known")


def audit_record(columns: list[str]) -> Column:
    """One JSON object per line with its keys in order, nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def found(records: DataFrame, line: str, value) -> DataFrame:
    """The one record of a line; none or several are an error."""
    hit = records.where(F.col(line) == value)
    n = hit.limit(2).count()
    if n != 1:
        raise ValueError(f"{'no' if not n else 'more than one'} record of {value!r}")
    return hit


def output_cells(results: DataFrame) -> DataFrame:
    """Result columns as text: labels only where matched, cost with six digits, call ids joined by semicolons."""
    matched = F.col("decision") == "matched"
    return results.withColumns({
        **{c: F.when(matched, F.coalesce(F.col(c), F.lit(""))).otherwise("") for c in ("type", "usage", "subtype")},
        "cost": F.format_string("%.6f", "cost"), "call_ids": F.array_join("call_ids", ";"),
    })


def filter_counts(results: DataFrame) -> DataFrame:
    """One row: lines per decision, failed ones among those for review, and all."""
    d = F.col("decision")
    return results.agg(F.count("*").alias("all"), *[F.count_if(d == x).alias(x) for x in ("matched", "needs_review", "not_a_material")], F.count_if(F.col("reason").startswith("LLM_")).alias("failed"))


# The columns that an output adds to those of its input, in order.
OUTPUT = (
    "decision", "material_type", "material_usage", "material_subtype", "reason", "model", "prompt_version", "latency_ms", "cost_usd",
    "suggested_type", "suggested_usage", "suggested_subtype", "library_row_id", "call_ids", "suggested2_type", "suggested2_usage", "suggested2_subtype",
)


def output_header(header: Column) -> Column:
    """Names of an output's columns: the input's, then the added ones."""
    return F.concat(header, F.array(*map(F.lit, OUTPUT)))


def output_row(results: DataFrame) -> Column:
    """An output's cells as an array of texts.

    results: raw_row (the input's cells), decision, reason, model, prompt_version, latency_ms, cost_usd, call_ids, and row,
    suggested, suggested2: structs of type, usage, subtype, row_id, or null. Labels are given only where matched; blanks
    stand for what is missing.
    """
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    triple = lambda name, when=None: [text(F.col(f"{name}.{k}")) if when is None else F.when(when, text(F.col(f"{name}.{k}"))).otherwise("") for k in ("type", "usage", "subtype")]
    cells = [
        text(F.col("decision")), *triple("row", F.col("decision") == "matched"), *[text(F.col(c)) for c in ("reason", "model", "prompt_version", "latency_ms")], F.format_string("%.6f", F.coalesce("cost_usd", F.lit(0.0))),
        *triple("suggested"), text(F.col("suggested.row_id")), F.array_join(F.coalesce("call_ids", F.array().cast("array<string>")), ";"), *triple("suggested2"),
    ]
    return F.concat("raw_row", F.array(*cells))


def csv_record(cells: Column) -> Column:
    """Cells as one record of a CSV file: quotes only where needed, quotes doubled."""
    cell = lambda v: F.when(v.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    return F.array_join(F.transform(cells, cell), ",")

"""Requests: lines as JSON records and batches as messages whose markup can't be closed from inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolith.functions.canonical import quoted
from taxolith.sources import tables

#: All candidates together are sent to every task up to this size.
CANDIDATE_BYTES = 64 << 20

#: Characters of markup, which a request writes as JSON escapes so that no line can close the envelope it stands in.
MARKUP = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026"}


def spaced(pairs: list[tuple[str, Column]]) -> Column:
    """An object of texts that are JSON already, with keys in the given order, ", " and ": " between."""
    return F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), v) for k, v in pairs]), F.lit("}"))


def listed(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def escaped(text: Column) -> Column:
    for char, escape in MARKUP.items():
        text = F.replace(text, F.lit(char), F.lit(escape))
    return text


def line_record(with_path: bool = True) -> Column:
    """One line of id, path, short, long, unit as JSON, keys sorted; the quantity is never sent."""
    fields = sorted(("id", "short", "long", "unit", *(("path",) if with_path else ())))
    return spaced([(f, quoted(F.coalesce(F.col(f), F.lit("")))) for f in fields])


def user_payload(lines: DataFrame, with_path: bool = True) -> DataFrame:
    """batch, payload: a batch's lines in order (position) as one JSON object in its envelope. An id that a batch has twice is an error."""
    rows = lines.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("position", line_record(with_path).alias("text")))).alias("rows"), F.count("*").alias("n"), F.count_distinct("id").alias("ids"))
    body = escaped(spaced([("lines", listed(F.transform("rows", lambda r: r["text"])))]))
    twice = F.when(F.col("n") != F.col("ids"), F.raise_error(F.concat(F.lit("an id occurs twice in batch "), F.col("batch").cast("string"))).cast("string"))
    return rows.select("batch", F.coalesce(twice, F.concat(F.lit("<boq_lines>\n"), body, F.lit("\n</boq_lines>"))).alias("payload"))


def verifier_payload(lines: DataFrame, coded: DataFrame) -> DataFrame:
    """batch, type, payload: a batch's flagged lines of a type with all rows of the type as candidates, as one JSON object.

    lines: batch, type, position and what line_record() reads; batches are as small as a request may be. Candidates are
    written and measured: up to CANDIDATE_BYTES they are sent along, so that the lines' texts move once, else both are shuffled.
    """
    ours = lines.groupBy("batch", "type").agg(F.array_sort(F.collect_list(F.struct("position", line_record().alias("text")))).alias("lines"))
    row = spaced([("code", quoted(F.col("code"))), ("subtype", quoted(F.col("subtype"))), ("usage", quoted(F.col("usage")))])
    rows = tables.written(coded.groupBy("type").agg(F.array_sort(F.collect_list(F.struct("code", row.alias("text")))).alias("rows")), "candidates")
    size = rows.agg(F.coalesce(F.sum(F.aggregate("rows", F.lit(0).cast("long"), lambda n, r: n + F.octet_length(r["text"]))), F.lit(0)).alias("bytes")).first().bytes
    rows = F.broadcast(rows) if size <= CANDIDATE_BYTES else rows
    texts = lambda c: listed(F.transform(c, lambda x: x["text"]))
    body = spaced([("candidates", texts("rows")), ("lines", texts("lines")), ("type", quoted(F.col("type")))])
    return ours.join(rows, "type").select("batch", "type", escaped(body).alias("payload"))

"""Strict answers: an envelope with one list of lines, each line checked on its own and kept as it was written."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The fields of a line, the values that are allowed, and the limits.
TEXTS = ("id", "evidence", "element_or_application", "material_family", "kind", "nm_category", "top1", "top2", "self_reported_candidate_gap")
ALLOWED = {
    "kind": ("material", "non_material", "no_equivalent"),
    "nm_category": ("labour", "service", "temporary_works", "fee", "hire", "other", ""),
    "self_reported_candidate_gap": ("decisive", "clear", "narrow", "tossup"),
}
CONFIDENCE, EVIDENCE_WORDS = (0, 100), 25
REFUSED, CUT = ("refusal", "content_filter"), ("max_tokens", "length", "model_context_window_exceeded")

#: A string, or a character that opens, closes or separates.
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[][{},:]', re.DOTALL)
BLANKS = " \t\n\r"
ENTRY = T.StructType([T.StructField(n, T.StringType()) for n in ("raw", "problem", *TEXTS)] + [T.StructField("confidence", T.IntegerType())])


def slices(text: str) -> list[str]:
    """The source text of each element of the last list named lines at the top of a valid JSON object."""
    found: list[str] = []
    depth, named, begun, inside = 0, None, 0, False
    last_text = ""
    for m in TOKEN.finditer(text):
        t = m[0]
        if t[0] == '"':
            last_text = t
        elif t == ":" and depth == 1:
            named = json.loads(last_text)
        elif t in "[{":
            depth += 1
            if depth == 2 and t == "[" and named == "lines":
                found, begun, inside = [], m.end(), True
        elif t == "," and inside and depth == 2:
            found.append(text[begun : m.start()].strip(BLANKS))
            begun = m.end()
        elif t in "]}":
            if inside and depth == 2:
                found.append(text[begun : m.start()].strip(BLANKS))
                inside = False
            depth -= 1
    return [] if found == [""] else found


def problem(value: object) -> str | None:
    """What is wrong with a line: its shape, its fields, a field's raw type, a value or a limit; None if nothing is."""
    if not isinstance(value, dict):
        return "not_an_object"
    if set(value) != {*TEXTS, "confidence"}:
        return "fields"
    if wrong := [n for n in TEXTS if not isinstance(value[n], str)]:
        return f"type:{wrong[0]}"
    if type(value["confidence"]) is not int:  # neither true nor "90" nor 90.0
        return "type:confidence"
    if wrong := [n for n, allowed in ALLOWED.items() if value[n].casefold() not in allowed]:
        return f"value:{wrong[0]}"
    if not CONFIDENCE[0] <= value["confidence"] <= CONFIDENCE[1]:
        return "range:confidence"
    return "length:evidence" if len(value["evidence"].split()) > EVIDENCE_WORDS else None


def validated(text: str | None) -> list[dict] | None:
    """One entry for each line; None where the text is no object that holds just a list of lines."""
    try:
        whole = json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return None
    if not isinstance(whole, dict) or set(whole) != {"lines"} or not isinstance(whole["lines"], list):
        return None
    found = []
    for value, raw in zip(whole["lines"], slices(text), strict=True):
        wrong = problem(value)
        entry = dict.fromkeys(ENTRY.names) | {"raw": raw, "problem": wrong}
        if wrong is None:
            entry |= {n: value[n].casefold() if n in ALLOWED else value[n] for n in (*TEXTS, "confidence")}
        elif isinstance(value, dict) and isinstance(value.get("id"), str):
            entry["id"] = value["id"]
        found.append(entry)
    return found


def validated_lines(calls: DataFrame, column: str = "raw") -> DataFrame:
    """calls with entries: (raw, problem, the line's fields) of each line, null for a broken envelope.

    raw is the very text the line had. A line with a problem keeps raw and, if it names one, its id; one bad line doesn't
    spoil the others.
    """

    @F.pandas_udf(T.ArrayType(ENTRY))
    def entries(texts: pd.Series) -> pd.Series:
        return texts.map(validated)

    return calls.withColumn("entries", entries(F.col(column)))


def content_status(reasons: Column, text: Column) -> Column:
    """How an answer that arrived is to be taken: its reasons for ending come first, then whether it is a JSON object."""
    any_of = lambda names: F.arrays_overlap(F.coalesce(reasons, F.array().cast("array<string>")), F.array(*map(F.lit, names)))
    is_object = F.coalesce(F.try_parse_json(text).isNotNull() & text.rlike(r"^\s*\{"), F.lit(False))
    return F.when(any_of(REFUSED), "refusal").when(any_of(CUT), "truncated").when(~is_object, "malformed").otherwise("ok")


def by_known_id(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """Entries (batch, entry) of ids that were asked for in the batch: (batch, id, raw, problem); others are left out."""
    each = entries.select("batch", F.inline("entries")).where(F.col("id").isNotNull()).select("batch", "id", "raw", "problem")
    return each.join(asked.select("batch", "id").distinct(), ["batch", "id"], "left_semi")


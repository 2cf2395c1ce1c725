"""Equivalents of terms tagged onto the labels of a taxonomy.

Terms meet labels by their words, runs of letters and digits: marks inside a term (a-b, a_b) match any other mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxolith.functions.text import normalize
from taxolith.operators.similarity import phrase_matches


def labels(rows: DataFrame) -> DataFrame:
    """label: each type, usage and subtype once; blank ones are left out."""
    each = rows.select(F.explode(F.array("type", "usage", "subtype")).alias("label")).distinct()
    return each.where(F.coalesce(normalize(F.col("label")), F.lit("")) != "")


def matched_terms(found: DataFrame, terms: DataFrame) -> DataFrame:
    """label, term: terms that occur in a label as whole words, not only inside a longer term's occurrence."""
    texts = found.select(F.col("label").alias("id"), normalize(F.col("label")).alias("text"))
    folded = terms.select(F.col("term").alias("raw"), normalize(F.col("term")).alias("term"))
    hits = phrase_matches(texts, folded.select("term").distinct()).select("id", "term").distinct()  # without where it occurs
    return hits.join(folded, "term").select(F.col("id").alias("label"), F.col("raw").alias("term"))


def label_equivalents(found: DataFrame, equivalents: DataFrame) -> DataFrame:
    """label, also: the equivalents of a label's terms; of those that normalise alike the smallest stays, ordered by canonical text, then as written.

    equivalents: term, equivalent (a row per equivalent). Labels without a term are left out.
    """
    each = matched_terms(found, equivalents.select("term").distinct()).join(equivalents, "term")
    once = each.groupBy("label", normalize(F.col("equivalent")).alias("canonical")).agg(F.min("equivalent").alias("raw"))
    return once.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("canonical", "raw"))).alias("pairs")).select("label", F.col("pairs.raw").alias("also"))


def missing_terms(found: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms that occur in no label, not even inside a longer term's occurrence."""
    texts = found.select(F.col("label").alias("id"), normalize(F.col("label")).alias("text"))
    words = lambda c: F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = terms.select("term", words(normalize(F.col("term"))).alias("tw")).where(F.size("tw") > 0)
    lengths = grams.select(F.size("tw").alias("n")).distinct()
    # word runs of the lengths that terms have; lengths are a handful
    runs = texts.select(words(F.col("text")).alias("w")).crossJoin(F.broadcast(lengths)).where(F.size("w") >= F.col("n"))
    starts = runs.select("w", "n", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("at"))
    seen = starts.select(F.expr("array_join(slice(w, at, n), ' ')").alias("gram")).distinct()
    return terms.join(grams.join(seen, F.array_join("tw", " ") == F.col("gram")).select("term").distinct(), "term", "left_anti")


def code_also(coded: DataFrame, equivalents: DataFrame) -> DataFrame:
    """code, also: the equivalents of the node of each type, usage and row code; empty where it has none.

    coded: type, usage, subtype, parent, code. equivalents: (type, usage, subtype, also) of nodes, usage and subtype being
    null for a type's node and subtype for a usage's. A node's own list counts, never its parent's.
    """
    levels = F.array(
        F.struct(F.regexp_extract("code", r"^(T\d+)", 1).alias("node"), F.col("type"), F.lit(None).cast("string").alias("usage"), F.lit(None).cast("string").alias("subtype")),
        F.struct(F.col("parent").alias("node"), "type", "usage", F.lit(None).cast("string").alias("subtype")),
        F.struct(F.col("code").alias("node"), "type", "usage", "subtype"),
    )
    nodes = coded.select(F.inline(levels)).distinct()
    e = equivalents.select(*[F.col(c).alias(f"_{c}") for c in ("type", "usage", "subtype")], "also")
    same = (F.col("type") == F.col("_type")) & F.col("usage").eqNullSafe(F.col("_usage")) & F.col("subtype").eqNullSafe(F.col("_subtype"))
    return nodes.join(e, same, "left").select(F.col("node").alias("code"), F.coalesce("also", F.array().cast("array<string>")).alias("also"))


def enriched_tree(coded: DataFrame, equivalents: DataFrame, reverse: bool = False) -> DataFrame:
    """type_code, document: the coded tree of each type as one text, each line with its node's equivalents in brackets.

    A type's line comes before its usages, a usage's before its rows; control breaks are where a code's prefix changes.
    Types are rendered apart, so no task holds the whole tree.
    """
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("code") if reverse else F.asc("code"))) == 1
    kind = F.regexp_extract("code", r"^(T\d+)", 1)
    marked = coded.withColumns({"type_code": kind, "_type": first("type"), "_usage": first("type", "usage")})
    line = lambda k, code, indent, label: F.struct(F.lit(k).alias("k"), code.alias("node"), F.lit(indent).alias("indent"), label.alias("label"))
    parts = F.array_compact(F.array(F.when(F.col("_type"), line(0, kind, "", F.col("type"))), F.when(F.col("_usage"), line(1, F.col("parent"), "  ", F.col("usage"))), line(2, F.col("code"), "    ", F.col("subtype"))))
    lines = marked.select("type_code", "code", F.inline(parts)).join(code_also(coded, equivalents).withColumnRenamed("code", "node"), "node")
    suffix = F.when(F.size("also") > 0, F.concat(F.lit(" [also: "), F.array_join("also", "; "), F.lit("]"))).otherwise("")
    text = F.concat("indent", "node", F.when(F.col("label") != "", F.concat(F.lit(" "), "label")).otherwise(""), suffix)
    rows = lines.groupBy("type_code").agg(F.collect_list(F.struct("code", "k", text.alias("text"))).alias("rows"))
    below = lambda a, b: F.when(a["code"] < b["code"], 1).when(a["code"] > b["code"], -1).otherwise(a["k"] - b["k"])
    ordered = F.array_sort("rows", below) if reverse else F.array_sort("rows")
    return rows.select("type_code", F.array_join(F.transform(ordered, lambda r: r["text"]), "\n").alias("document"))


"""A three-level taxonomy: codes by rank, structure flags, lookups. Columns: type, usage, subtype (blank: none)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolith.functions.text import normalize, row_id


def deduplicated(rows: DataFrame, order: str) -> DataFrame:
    """Distinct triples, each where it comes first."""
    return rows.groupBy("type", "usage", "subtype").agg(F.min(order).alias(order))


def _ranked(rows: DataFrame, columns: list[str], norm) -> DataFrame:
    """Distinct values of the last column within the others, ranked by normal form, then raw; blank ranks 0."""
    *parents, value = columns
    distinct = rows.select(*columns).distinct().withColumn("_n", norm(F.col(value)))
    some = distinct.where(F.col(value) != "")
    w = Window.partitionBy(*parents).orderBy("_n", value) if parents else Window.orderBy("_n", value)  # distinct types only: few rows
    ranked = some.withColumn("rank", F.row_number().over(w)).drop("_n")
    return ranked.unionByName(distinct.where(F.col(value) == "").withColumn("rank", F.lit(0)).drop("_n"))


def assign_codes(rows: DataFrame, norm=normalize) -> DataFrame:
    """rows with code Txx.Uyy.Szz, parent code and row_id; numbers are as wide as the level's largest, two digits at least."""
    triples = rows.select("type", "usage", "subtype").distinct()
    out = triples
    for k, columns in enumerate((["type"], ["type", "usage"], ["type", "usage", "subtype"])):
        out = out.join(_ranked(triples, columns, norm).withColumnRenamed("rank", f"_r{k}"), columns)
    width = out.agg(*[F.greatest(F.lit(2), F.length(F.max(f"_r{k}").cast("string"))).alias(f"_w{k}") for k in range(3)])
    out = out.crossJoin(F.broadcast(width))  # one row
    part = lambda k, c: F.concat(F.lit(c), F.lpad(F.col(f"_r{k}").cast("string"), F.col(f"_w{k}"), F.lit("0")))
    return out.select("type", "usage", "subtype", F.concat_ws(".", part(0, "T"), part(1, "U")).alias("parent"), F.concat_ws(".", part(0, "T"), part(1, "U"), part(2, "S")).alias("code"), row_id(F.col("type"), F.col("usage"), F.col("subtype")).alias("row_id"))


def structure(coded: DataFrame) -> DataFrame:
    """Per code: is it alone under its parent, and is it a blank leaf among specific siblings."""
    w = Window.partitionBy("parent")
    n = F.count("*").over(w)
    blanks = F.sum((F.col("subtype") == "").cast("long")).over(w)
    return coded.select("*", (n == 1).alias("sole_child"), ((F.col("subtype") == "") & (n > blanks)).alias("generic_parent"))


def confusable(coded: DataFrame, norm=normalize) -> DataFrame:
    """Codes of one type that share a subtype's normal form, two or more."""
    groups = coded.where(F.col("subtype") != "").groupBy("type", norm(F.col("subtype")).alias("norm_subtype")).agg(F.array_sort(F.collect_list("code")).alias("codes"))
    return groups.where(F.size("codes") >= 2)


def checked_codes(answers: DataFrame, coded: DataFrame, code: str = "code") -> DataFrame:
    """answers with status: valid, empty, malformed, unknown_parent or unknown_code."""
    known = coded.select(F.col("code").alias("_code"))
    parents = coded.select(F.col("parent").alias("_parent")).distinct()
    c = F.col(code)
    joined = answers.join(known, c == F.col("_code"), "left").join(parents, F.regexp_extract(c, r"^(T\d+\.U\d+)\.S\d+$", 1) == F.col("_parent"), "left")
    status = F.when(F.coalesce(c, F.lit("")) == "", "empty").when(F.col("_code").isNotNull(), "valid").when(~c.rlike(r"^T\d{2,}\.U\d{2,}\.S\d{2,}$"), "malformed").when(F.col("_parent").isNull(), "unknown_parent").otherwise("unknown_code")
    return joined.withColumn("status", status).drop("_code", "_parent")


def implicit_zero(rows: DataFrame, parent: str, value: str) -> Column:
    """Within a parent an unstated percentage is 0 if a sibling states a positive one."""
    positive = F.max((F.col(value) > 0).cast("int")).over(Window.partitionBy(parent)) == 1
    return F.when(F.col(value).isNull() & positive, F.lit(0)).otherwise(F.col(value))


def never_match(rows: DataFrame, patterns: list[tuple[str, str]]) -> Column:
    """Any (column, regular expression) pair hits."""
    hit = F.lit(False)
    for column, pattern in patterns:
        hit = hit | F.col(column).rlike(pattern)
    return hit


def rendered(coded: DataFrame, reverse: bool = False) -> DataFrame:
    """The taxonomy as an indented tree: one row per line of text (line_no, line)."""
    first = lambda *cols: F.row_number().over(Window.partitionBy(*cols).orderBy(F.desc("code") if reverse else F.asc("code"))) == 1
    marked = coded.withColumns({"_type": first("type"), "_usage": first("type", "usage")})
    parts = F.array_compact(F.array(
        F.when(F.col("_type"), F.concat(F.regexp_extract("code", r"^(T\d+)", 1), F.lit(" "), F.col("type"))),
        F.when(F.col("_usage"), F.concat(F.lit("  "), F.col("parent"), F.lit(" "), F.col("usage"))),
        F.concat(F.lit("    "), F.col("code"), F.when(F.col("subtype") != "", F.concat(F.lit(" "), F.col("subtype"))).otherwise("")),
    ))
    lines = marked.select("code", F.posexplode(parts).alias("k", "line"))
    order = Window.orderBy(F.desc("code") if reverse else F.asc("code"), "k")  # a rendered taxonomy is one document
    return lines.select(F.row_number().over(order).alias("line_no"), "line")

"""Votes: several recorded passes per line, counted by plurality. Columns: line, pass_no, code, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANSWERS = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("top1", T.StringType()), T.StructField("top2", T.StringType()), T.StructField("confidence", T.IntegerType()), T.StructField("evidence", T.StringType())]))


def tally(votes: DataFrame) -> DataFrame:
    """line, leader, votes, passes, tie, weakest: the most frequent code, of equals the one of the earliest pass; weakest confidence among its supporters."""
    counts = votes.groupBy("line", "code").agg(F.count("*").alias("votes"), F.min("pass_no").alias("first_pass"), F.min("confidence").alias("weakest"))
    w = Window.partitionBy("line")
    ranked = counts.withColumn("rank", F.row_number().over(w.orderBy(F.desc("votes"), "first_pass", "code"))).withColumn("leaders", F.sum((F.col("votes") == F.max("votes").over(w)).cast("long")).over(w)).withColumn("passes", F.sum("votes").over(w))
    return ranked.where("rank = 1").select("line", F.col("code").alias("leader"), "votes", "passes", (F.col("leaders") > 1).alias("tie"), "weakest")


def without_conflicts(votes: DataFrame) -> DataFrame:
    """Drop votes marked conflict, unless all or none of a line's votes are."""
    w = Window.partitionBy("line")
    n, bad = F.count("*").over(w), F.sum(F.col("conflict").cast("long")).over(w)
    return votes.withColumn("_all", n == bad).where(~F.col("conflict") | F.col("_all")).drop("_all")


def parsed_answers(raw: DataFrame, column: str = "raw") -> DataFrame:
    """raw with answers: the array under the only key, lines; null where the text is no such object."""
    text = F.col(column)
    object_ = F.try_parse_json(text).isNotNull() & text.rlike(r"^\s*\{")
    keys = F.when(object_, F.json_object_keys(text))
    lines = F.get_json_object(text, "$.lines")
    valid = keys.eqNullSafe(F.array(F.lit("lines"))) & lines.rlike(r"^\s*\[")
    parsed = F.from_json(F.when(valid, lines), ANSWERS)
    folded = F.transform(parsed, lambda a: F.struct(a["id"].alias("id"), F.lower(a["kind"]).alias("kind"), a["top1"].alias("top1"), a["top2"].alias("top2"), a["confidence"].alias("confidence"), a["evidence"].alias("evidence")))
    return raw.withColumn("answers", folded)


def answer_problem(a: Column) -> Column:
    """malformed confidence or evidence of one answer struct, else null."""
    return F.when(a["confidence"].isNull() | ~a["confidence"].between(0, 100), "confidence").when(F.size(F.split(F.trim(a["evidence"]), r"(?U)\s+")) > 25, "evidence").when(~a["kind"].isin("material", "non_material", "no_equivalent"), "kind")


def unanimous(votes: DataFrame, passes: int) -> DataFrame:
    """Lines all of whose passes gave one code, as often as passes were asked for."""
    return votes.groupBy("line").agg(F.countDistinct("code").alias("codes"), F.count("*").alias("n")).where((F.col("codes") == 1) & (F.col("n") == passes)).select("line")

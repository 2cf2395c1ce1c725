"""How well attributes tell rows of the library apart: each labelled line against its row, and how many rows it leaves open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolith.functions import attributes
from taxolith.sources import tables

#: Families compared by equality, which a join can do, and the others, which are tested on what the join brings together.
EQUAL = tuple(f for f in attributes.HARD if f.fits is attributes.same)
LOOSE = tuple(f for f in attributes.HARD if f.fits is not attributes.same)


def signature(a: Column) -> Column:
    """The hard values of a struct of attributes."""
    return F.struct(*[a[f.name].alias(f.name) for f in attributes.HARD])


def stated(sig: Column) -> Column:
    """Which hard families have a value, as bits."""
    mask = F.lit(0)
    for k, f in enumerate(attributes.HARD):
        mask = mask + F.when(F.size(sig[f.name]) > 0, 1 << k).otherwise(0)
    return mask


def _among(sig: Column, common: Column, families) -> Column:
    """Values of the families whose bits are set, as one text; equal texts are equal values."""
    bit = {f.name: 1 << k for k, f in enumerate(attributes.HARD)}
    return F.concat_ws("|", *[F.when(common.bitwiseAND(bit[f.name]) > 0, F.to_json(sig[f.name])).otherwise("") for f in families])


def left_open(lines: DataFrame, library: DataFrame) -> DataFrame:
    """sig, open: for each signature among lines(sig), how many rows of library(sig) don't conflict with it.

    No line is compared with every row. Equal signatures are one class on either side. A row conflicts only through
    families that both state: for each set of families that lines state and each that rows state (at most 2^8 of either),
    classes are joined on the common families' equal values, and rows that then agree are counted once as a group. Families
    that fit in other ways than by equality are tested on the joined groups.
    """
    l = lines.select("sig").distinct().withColumn("mask", stated(F.col("sig")))
    r = library.groupBy("sig").agg(F.count("*").alias("n")).withColumn("mask", stated(F.col("sig")))
    masks = lambda df: F.array(*[F.lit(x.mask) for x in df.select("mask").distinct().collect()] or [F.lit(None).cast("int")])  # noqa: E731  at most 2^8
    of_rows, of_lines = masks(r), masks(l)
    asked = l.select("sig", F.col("mask"), F.explode(of_rows).alias("row_mask")).withColumn("common", F.col("mask").bitwiseAND(F.col("row_mask")))
    asked = asked.select("sig", "row_mask", "common", _among(F.col("sig"), F.col("common"), EQUAL).alias("key"))
    offered = r.select(F.col("sig").alias("row_sig"), "n", F.col("mask").alias("row_mask"), F.explode(F.array_distinct(F.transform(of_lines, lambda m: m.bitwiseAND(F.col("mask"))))).alias("common"))
    offered = offered.select("row_mask", "common", "n", _among(F.col("row_sig"), F.col("common"), EQUAL).alias("key"), F.struct(*[F.col(f"row_sig.{f.name}").alias(f.name) for f in LOOSE]).alias("loose"), _among(F.col("row_sig"), F.col("common"), LOOSE).alias("loose_key"))
    groups = offered.groupBy("row_mask", "common", "key", "loose_key").agg(F.sum("n").alias("n"), F.first("loose").alias("loose"))
    bit = {f.name: 1 << k for k, f in enumerate(attributes.HARD)}
    fits = F.lit(True)
    for f in LOOSE:
        fits = fits & ((F.col("common").bitwiseAND(bit[f.name]) == 0) | f.fits(F.col(f"sig.{f.name}"), F.col(f"loose.{f.name}")))
    counted = asked.join(groups, ["row_mask", "common", "key"]).where(fits).groupBy("sig").agg(F.sum("n").alias("open"))
    return l.select("sig").join(counted, "sig", "left").fillna(0, ["open"])


def against_library(lines: DataFrame, library: DataFrame) -> DataFrame:
    """line, verdict, conflicting, open of lines(line, label, a) against library(label, a), a being structs of attributes.

    verdict is conflict, agree, no_evidence, or missing where the library has no row of the label; such lines have no count.
    """
    ours = lines.select("line", "label", "a", signature(F.col("a")).alias("sig"))
    rows = library.select("label", F.col("a").alias("row"))
    joined = ours.join(rows, "label", "left")
    found = joined.select("line", "sig", F.coalesce(F.when(F.col("row").isNotNull(), attributes.compare(F.col("a"), F.col("row"))), F.lit("missing")).alias("verdict"), F.when(F.col("row").isNotNull(), attributes.conflicting(F.col("a"), F.col("row"))).alias("conflicting"))
    # a signature that many lines share must not be joined in one task: distinct signatures are few and are sent along
    counts = tables.small(tables.written(left_open(found.where("verdict <> 'missing'"), library.select(signature(F.col("a")).alias("sig"))), "left_open"))
    return found.join(counts, "sig", "left").select("line", "verdict", "conflicting", F.when(F.col("verdict") != "missing", F.col("open")).alias("open"))


def summary(results: DataFrame, by: list[str]) -> DataFrame:
    """Lines by verdict, and the least and median number of rows left open, per group."""
    return results.groupBy(*by).agg(F.count("*").alias("lines"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("agree", "no_evidence", "conflict", "missing")], F.min("open").alias("least_open"), F.median("open").alias("median_open"))

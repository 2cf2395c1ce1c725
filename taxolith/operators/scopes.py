"""The scorer: every figure of an output, for all its scopes, from one pass over its pairs.

pairs: decision (null: the output lacks the row), class (L labelled, E without equivalent, H header, U unclassed, others),
out and ref (structs of type, usage, subtype), and, where the output has them, suggested and suggested_2 (such structs),
unit, cost and latency.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolith.functions import stats
from taxolith.functions.text import lenient

DECISIONS = ("matched", "needs_review", "not_a_material")
#: What a pair may end as: a decision, no row, or a decision that is none of these.
ENDS = (*DECISIONS, "missing", "invalid")
LEVELS = ("type", "usage", "subtype")
#: Classes of rows that are no items, and of rows that name a material.
NO_ITEMS, MATERIAL = ("H", "U"), ("L", "E")


def hits(predicted: Column, reference: Column) -> list[Column]:
    """Equality of the first one, two and three levels; a blank reference is never hit."""
    some = F.concat_ws("", *[reference[n] for n in LEVELS]) != ""
    found, so_far = [], some
    for n in LEVELS:
        so_far = so_far & F.coalesce(predicted[n] == reference[n], F.lit(False))
        found.append(so_far)
    return found


def alike(predicted: Column, reference: Column) -> Column:
    """Equality once blanks are trimmed and collapsed; a blank reference is never hit."""
    same = F.concat_ws("", *[reference[n] for n in LEVELS]) != ""
    for n in LEVELS:
        same = same & F.coalesce(lenient(predicted[n]) == lenient(reference[n]), F.lit(False))
    return same


def judged(pairs: DataFrame) -> DataFrame:
    """pairs with what each figure counts, as booleans."""
    out, ref = F.col("out"), F.col("ref")
    decision = F.when(F.col("decision").isNull(), "missing").when(~F.col("decision").isin(*DECISIONS), "invalid").otherwise(F.col("decision"))
    pairs = pairs.withColumn("decided", decision)
    matched = F.col("decided") == "matched"
    blank = F.struct(*[F.lit("").alias(n) for n in LEVELS])
    proposal = F.when(matched, out).otherwise(blank)
    if "suggested" in pairs.columns:
        proposal = F.coalesce("suggested", proposal)
    flags = {"is_matched": matched, "labelled": F.col("class") == "L", "material": F.col("class").isin(*MATERIAL), "item": ~F.col("class").isin(*NO_ITEMS), "alike": alike(out, ref)}
    flags |= {f"hit_{n}": h for n, h in zip(LEVELS, hits(out, ref), strict=True)} | {f"proposed_{n}": h for n, h in zip(LEVELS, hits(proposal, ref), strict=True)}
    one = F.coalesce(F.col("suggested") == ref, F.lit(False)) if "suggested" in pairs.columns else F.lit(False)
    two = F.coalesce(F.col("suggested_2") == ref, F.lit(False)) if "suggested_2" in pairs.columns else F.lit(False)
    return pairs.withColumns(flags | {"first": one, "first_two": one | two})


def score_output(pairs: DataFrame, by: list[list[str]], has_classes: bool = True, alpha: float = 0.05) -> DataFrame:
    """One row for each group of each set of grouping columns, with nested blocks; a block whose column the output lacks is null.

    All groups of all sets come from one aggregation; everything else is arithmetic on its counts.
    """
    has = set(pairs.columns)
    columns = sorted({c for s in by for c in s})
    p = judged(pairs)
    n = lambda *conditions: F.count_if(_all(*conditions))
    matched, labelled, material, item = (F.col(c) for c in ("is_matched", "labelled", "material", "item"))
    review, skipped = F.col("decided") == "needs_review", F.col("decided") == "not_a_material"
    right = F.col("hit_subtype")
    sums = {
        "rows": F.count("*"), "items": n(item), "unclassed": n(F.col("class") == "U"), "n_labelled": n(labelled), "n_material": n(material), "no_equivalent": n(F.col("class") == "E"), "missing": n(F.col("decided") == "missing"),
        "n_matched": n(matched), "correct": n(matched, right), "labelled_correct": n(labelled, matched, right), "loose": n(matched, F.col("alike")), "labelled_loose": n(labelled, matched, F.col("alike")),
        "false_skips": n(material, skipped), "whitespace_only": n(matched, F.col("alike"), ~right), "in_review": n(labelled, review), "first": n(labelled, review, F.col("first")), "first_two": n(labelled, review, F.col("first_two")),
        "material_review": n(material, review), "review": n(review), "skips_with_unit": n(skipped, F.trim(F.coalesce("unit", F.lit(""))) != "") if "unit" in has else F.lit(None).cast("long"),
        "mean_cost": F.avg("cost") if "cost" in has else F.lit(None).cast("double"), "mean_latency": F.avg("latency") if "latency" in has else F.lit(None).cast("double"),
    }
    sums |= {f"m_{x}": n(matched, F.col(f"hit_{x}")) for x in LEVELS} | {f"p_{x}": n(labelled, F.col(f"proposed_{x}")) for x in LEVELS}
    sums |= {f"all_{d}": n(F.col("decided") == d) for d in ENDS} | {f"item_{d}": n(item, F.col("decided") == d) for d in ENDS}
    g = p.groupingSets([[F.col(c) for c in s] for s in by], *columns).agg(*[v.alias(k) for k, v in sums.items()])
    c, share = F.col, F.try_divide
    low, high = stats.wilson(c("correct"), c("n_matched"))
    block = lambda **parts: F.struct(*[v.alias(k) for k, v in parts.items()])
    hit = lambda k, there: block(hits=F.when(F.lit(there), c(k)), denominator=c("in_review"), value=F.when(F.lit(there), share(k, "in_review")))
    shares = lambda of, names, total: block(denominator=c(total), **{x: c(f"{of}_{x}") for x in names}, **{f"{x}_share": share(f"{of}_{x}", total) for x in names})
    with_classes = lambda value: value if has_classes else F.when(F.lit(False), value)
    return g.select(
        *columns,
        block(rows=c("rows"), items=c("items"), unclassed=c("unclassed"), labelled=c("n_labelled"), no_equivalent=with_classes(c("no_equivalent")), missing=c("missing")).alias("counts"),
        block(correct=c("correct"), matched=c("n_matched"), value=share("correct", "n_matched"), cp_lower=stats.clopper_pearson(c("correct"), c("n_matched"), alpha), wilson_low=low, wilson_high=high).alias("precision"),
        block(correct=c("labelled_correct"), denominator=c("n_labelled"), value=share("labelled_correct", "n_labelled")).alias("coverage_labelled"),
        with_classes(block(correct=c("labelled_correct"), denominator=c("n_material"), value=share("labelled_correct", "n_material"))).alias("coverage_material"),
        block(**{x: share(f"m_{x}", "n_matched") for x in LEVELS}).alias("levels_matched"),
        block(**{x: share(f"p_{x}", "n_labelled") for x in LEVELS}, source=F.lit("suggested" if "suggested" in has else "decision")).alias("levels_labelled"),
        block(usage_given_type=share("p_usage", "p_type"), subtype_given_usage=share("p_subtype", "p_usage")).alias("cascade"),
        c("false_skips"), c("whitespace_only"), c("skips_with_unit"),
        block(precision=share("loose", "n_matched"), coverage_labelled=share("labelled_loose", "n_labelled")).alias("lenient"),
        hit("first", "suggested" in has).alias("hit_at_1"), hit("first_two", {"suggested", "suggested_2"} <= has).alias("hit_at_2"),
        shares("all", ENDS, "rows").alias("all_rows"), shares("item", ENDS, "items").alias("item_rows"),
        with_classes(block(numerator=c("labelled_correct") + c("material_review"), denominator=c("n_material"), value=share(c("labelled_correct") + c("material_review"), c("n_material")))).alias("helped"),
        block(needs_review=c("review"), lines=c("rows") - c("missing"), per_100=share(c("review") * 100, c("rows") - c("missing"))).alias("review_load"),
        c("mean_cost"), c("mean_latency"),
    )


def _all(*conditions: Column) -> Column:
    held = conditions[0]
    for c in conditions[1:]:
        held = held & c
    return held

"""Experiments: ledgers, items before and after, other models' votes, and what a rule may be judged by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolith.operators.ranks import numbered

LEVELS = ("type", "usage", "subtype")
# Correct matches that a vote of another model must add, the reason of evidence that is not in its line.
LEAST_ADDED, NO_EVIDENCE = 3, "EVIDENCE_NOT_IN_LINE"


def latest(ledger: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key, all columns."""
    rows = F.max_by(F.struct(*[F.col(f"`{c}`") for c in ledger.columns]), order).alias("_row")
    return ledger.groupBy(*[F.col(k).alias(f"_k_{k}") for k in key]).agg(rows).select("_row.*")


def filled(df: DataFrame) -> DataFrame:
    """Distinct triples of which some level is not blank."""
    return df.where(F.concat_ws("", *LEVELS) != "").select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in LEVELS]).distinct()


def reference_coverage(reference: DataFrame, library: DataFrame) -> DataFrame:
    """One row: shared, total distinct labelled triples and whether any is a row of the library, without which nothing could score."""
    j = filled(reference).join(filled(library).withColumn("_known", F.lit(True)), list(LEVELS), "left")
    out = j.agg(F.count("_known").alias("shared"), F.count("*").alias("total"))
    return out.select("shared", "total", F.try_divide("shared", "total").alias("ratio"), (F.col("shared") > 0).alias("usable"))


def item_correctness(pairs: DataFrame) -> DataFrame:
    """item, correct (0 or 1) of labelled items: is one of its rows matched with the reference's triple."""
    labelled = pairs.where(F.concat_ws("", *[F.col(f"ref.{c}") for c in LEVELS]) != "")
    right = (F.col("decision") == "matched") & (F.col("out") == F.col("ref"))
    return labelled.groupBy("item").agg(F.max(F.coalesce(right, F.lit(False)).cast("int")).alias("correct"))


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """item, before, after, delta of item_correctness() of two outputs; an item that one of them lacks is an error."""
    j = before.withColumnRenamed("correct", "before").join(after.withColumnRenamed("correct", "after"), "item", "full")
    whole = F.when(F.col("before").isNull() | F.col("after").isNull(), F.raise_error(F.concat(F.lit("only one output has item "), F.col("item").cast("string"))).cast("int"))
    return j.select("item", "before", "after", F.coalesce(whole, F.col("after") - F.col("before")).alias("delta"))


def joined_votes(primary: DataFrame, second: DataFrame) -> DataFrame:
    """Items of two runs side by side: item, a (decision, top1, suggested), b (pass_top1, suggested); the sets of items must be equal."""
    a = primary.select("item", F.struct("decision", "top1", "suggested").alias("a"))
    b = second.select("item", F.struct("pass_top1", "suggested").alias("b"))
    j = a.join(b, "item", "full")
    wrong = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("the runs don't hold the same items")).cast("boolean"))
    return j.where(wrong.isNull())


def agreement(votes: DataFrame, reference: DataFrame) -> DataFrame:
    """item, decision, agreeing passes of the second model, primary_correct, second_correct, second_type_correct of labelled items."""
    label = F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in LEVELS])
    named = reference.where(F.concat_ws("", *LEVELS) != "").select("item", label.alias("label"))
    agreeing = F.size(F.filter("b.pass_top1", lambda c: (c != "") & (c == F.col("a.top1"))))
    return votes.join(named, "item").select(
        "item", "a.decision", agreeing.alias("agreeing"), (F.col("a.suggested") == F.col("label")).alias("primary_correct"), (F.col("b.suggested") == F.col("label")).alias("second_correct"), (F.col("b.suggested.type") == F.col("label.type")).alias("second_type_correct")
    )


def vote_verdict(figures: DataFrame, policy: str, shipped: str = "shipped", least: int = LEAST_ADDED) -> DataFrame:
    """One row of figures(lang, policy, matched, correct, precision): added, held, adopted. A policy must add enough and lose precision in no language."""
    own = figures.where(F.col("policy") == policy).select("lang", F.col("matched").alias("m"), F.col("correct").alias("c"), F.col("precision").alias("p"))
    j = figures.where(F.col("policy") == shipped).join(own, "lang")
    held = (F.col("m") == 0) | ~F.coalesce(F.col("p") < F.col("precision"), F.lit(False))
    out = j.agg(F.coalesce(F.sum(F.col("c") - F.col("correct")), F.lit(0)).alias("added"), F.coalesce(F.bool_and(held), F.lit(True)).alias("held"))
    return out.withColumn("adopted", (F.col("added") >= least) & F.col("held"))


def first_answering(replays: DataFrame) -> DataFrame:
    """threshold, run: of replays(threshold, run, ord, unanswered) the first run that answers everything; thresholds without one have none."""
    whole = F.when(F.col("unanswered") == 0, F.col("ord"))
    return replays.groupBy("threshold").agg(F.min_by("run", whole).alias("run"), F.min(whole).alias("_o")).select("threshold", F.when(F.col("_o").isNotNull(), F.col("run")).alias("run"))


def batch_indices(audit: DataFrame) -> DataFrame:
    """call_id, index (from 0) of the calls of audit(position, call_ids), in the order in which they are first named."""
    each = audit.select("position", F.posexplode("call_ids").alias("slot", "call_id"))
    first = each.groupBy("call_id").agg(F.min(F.struct("position", "slot")).alias("at")).select("call_id", "at.position", "at.slot")
    return numbered(first, [], ["position", "slot", "call_id"], "index").select("call_id", "index")


def strata(reference: DataFrame, side: DataFrame, classes: DataFrame, section: Column) -> DataFrame:
    """section, class, items: the side's items by section and class; labelled rows are L, those without a class blank."""
    own = reference.join(side.select("item"), "item", "left_semi").join(classes.select("item", "class"), "item", "left")
    klass = F.when(F.concat_ws("", *LEVELS) != "", "L").otherwise(F.coalesce("class", F.lit("blank")))
    return own.groupBy(section.alias("section"), klass.alias("class")).agg(F.count("*").alias("n"), F.min("item").alias("first"), F.max("item").alias("last"))


def match_all(decisions: DataFrame) -> DataFrame:
    """Every line with a valid leading code becomes a match: the figures that this gives bound all thresholds."""
    return decisions.withColumn("decision", F.when(F.col("valid_code"), "matched").otherwise(F.when(F.col("decision") == "matched", "needs_review").otherwise(F.col("decision"))))


def false_rejects(output: DataFrame, audit: DataFrame, reference: DataFrame) -> DataFrame:
    """item, evidence: lines turned away because their evidence is not in them, though the suggestion is the reference's triple; with each pass's evidence.

    output: item, reason, suggested; audit: item, raw (answers of the passes); reference: item and the triple.
    """
    label = reference.where(F.concat_ws("", *LEVELS) != "").select("item", F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in LEVELS]).alias("label"))
    turned = output.where(F.col("reason") == NO_EVIDENCE).join(label, "item").where(F.col("suggested") == F.col("label"))
    quote = F.transform("raw", lambda t: F.when(F.try_parse_json(t).isNotNull(), F.get_json_object(t, "$.evidence")))
    return turned.join(audit.select("item", "raw"), "item", "left").select("item", quote.alias("evidence"))

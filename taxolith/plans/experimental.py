"""Experiments over documents: a document is an item, its language and source are its triple."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolith.operators import experiments, scopes
from taxolith.plans.queries import query, r6, table

ITEMS = """WITH d AS (SELECT doc_id, lang, source, n_chars AS n, n_chars % 6 <> 0 AS labelled, CASE WHEN n_chars % 6 <> 0 THEN lang ELSE '' END AS type, CASE WHEN n_chars % 6 <> 0 THEN source ELSE '' END AS usage FROM documents),
v AS (SELECT *, n % 5 <> 0 AS first_right, n % 7 <> 0 AS second_right, ['matched', 'needs_review', 'not_a_material'][n % 3 + 1] AS decision FROM d)
"""


def triple(type_, usage, subtype=None):
    return F.struct(type_.alias("type"), usage.alias("usage"), (F.lit("") if subtype is None else subtype).alias("subtype"))


def items_of(spark, sf_dir) -> DataFrame:
    """item, n, decision, ref (blank for one in six), right and wrong triples."""
    n = F.col("n_chars")
    own, none = triple(F.col("lang"), F.col("source")), triple(F.lit(""), F.lit(""))
    decision = F.get(F.array(*map(F.lit, scopes.DECISIONS)), (n % 3).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), n.alias("n"), "lang", "source", decision.alias("decision"), F.when(n % 6 != 0, own).otherwise(none).alias("ref"), own.alias("own"), triple(F.col("lang"), F.lit("?")).alias("other"))


def reference_of(items: DataFrame) -> DataFrame:
    return items.select("item", "ref.*")


@query(ITEMS + """SELECT doc_id AS item, (decision = 'matched' AND first_right)::INT AS before, (decision <> 'not_a_material' AND second_right)::INT AS after, (decision <> 'not_a_material' AND second_right)::INT - (decision = 'matched' AND first_right)::INT AS delta FROM v WHERE labelled""")
def item_deltas(spark, sf_dir):
    """Labelled items before and after: the second output matches more lines and is wrong elsewhere."""
    items = items_of(spark, sf_dir)
    out = lambda k, decision: items.select("item", decision.alias("decision"), F.when(F.col("n") % k != 0, F.col("own")).otherwise(F.col("other")).alias("out"), "ref")
    later = F.when(F.col("decision") == "not_a_material", "not_a_material").otherwise("matched")
    return experiments.compared(experiments.item_correctness(out(5, F.col("decision"))), experiments.item_correctness(out(7, later)))


@query(ITEMS + """SELECT doc_id AS item, decision, CASE WHEN n % 4 = 0 THEN 0 ELSE (n % 8 <> 3)::INT + (n % 8 = 5)::INT END AS agreeing, first_right AS primary_correct, second_right AS second_correct, true AS second_type_correct FROM v WHERE labelled""")
def model_agreement(spark, sf_dir):
    """Two models' votes on the labelled items, item by item."""
    items = items_of(spark, sf_dir)
    n = F.col("n")
    primary = items.select("item", "decision", F.when(n % 4 != 0, F.col("source")).otherwise("").alias("top1"), F.when(n % 5 != 0, F.col("own")).otherwise(F.col("other")).alias("suggested"))
    second = items.select("item", F.array(F.when(n % 8 != 3, F.col("source")).otherwise("x"), F.when(n % 8 == 5, F.col("source")).otherwise("")).alias("pass_top1"), F.when(n % 7 != 0, F.col("own")).otherwise(F.col("other")).alias("suggested"))
    return experiments.agreement(experiments.joined_votes(primary, second), reference_of(items))


@query("""WITH c AS (SELECT n_chars % 1000 AS call_id, min(doc_id) AS at_ FROM documents GROUP BY 1) SELECT call_id, row_number() OVER (ORDER BY at_) - 1 AS "index" FROM c""")
def batch_indices(spark, sf_dir):
    """Calls numbered as documents first name them."""
    return experiments.batch_indices(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), F.array(F.col("n_chars") % 1000).alias("call_ids")))


@query(ITEMS + """SELECT doc_id AS item, 'q' || n || ';' AS evidence FROM v WHERE labelled AND n % 9 = 0 AND n % 5 <> 0""")
def false_rejects(spark, sf_dir):
    """Lines turned away for their evidence though their suggestion was right, with what each pass quoted."""
    items, n = items_of(spark, sf_dir), F.col("n")
    output = items.select("item", F.when(n % 9 == 0, experiments.NO_EVIDENCE).otherwise("SIGNAL").alias("reason"), F.when(n % 5 != 0, F.col("own")).otherwise(F.col("other")).alias("suggested"))
    audit = items.select("item", F.array(F.concat(F.lit('{"evidence": "q'), n, F.lit('"}')), F.lit("no json")).alias("raw"))
    found = experiments.false_rejects(output, audit, reference_of(items))
    return found.select("item", F.array_join(F.transform("evidence", lambda x: F.coalesce(x, F.lit(""))), ";").alias("evidence"))


@query("""SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, md5(arg_max(text, turn)) AS text_md5 FROM conversations GROUP BY 1""")
def latest_rows(spark, sf_dir):
    """The last turn of every conversation, as the last row of a ledger."""
    last = experiments.latest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], "turn")
    return last.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query(ITEMS + """SELECT source AS section, CASE WHEN labelled THEN 'L' WHEN n % 4 = 0 THEN 'E' ELSE 'blank' END AS class, count(*) AS n, min(doc_id) AS "first", max(doc_id) AS "last" FROM v WHERE n % 2 = 0 GROUP BY 1, 2""")
def side_strata(spark, sf_dir):
    """Items of one side by section and class."""
    items = items_of(spark, sf_dir)
    named = reference_of(items).join(items.select("item", "source"), "item")
    return experiments.strata(named, items.where("n % 2 = 0"), items.where("n % 4 = 0").select("item", F.lit("E").alias("class")), F.col("source"))


@query(ITEMS + """, w AS (SELECT DISTINCT type, usage FROM d WHERE labelled), l AS (SELECT DISTINCT lang, source FROM d WHERE doc_id % 2 = 0)
SELECT count(*) FILTER (WHERE EXISTS (SELECT 1 FROM l WHERE lang = type AND source = usage)) AS shared, count(*) AS total, round(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM l WHERE lang = type AND source = usage)) / count(*), 6) AS ratio, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM l WHERE lang = type AND source = usage)) > 0 AS usable FROM w""")
def reference_coverage(spark, sf_dir):
    """Labelled triples that are rows of a library of every second document's triple."""
    items = items_of(spark, sf_dir)
    return experiments.reference_coverage(reference_of(items), items.where("item % 2 = 0").select("own.*")).withColumn("ratio", r6("ratio"))

"""Small functions of the engine over documents: cells, prices, hits, baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxolith.functions import attributes, text
from taxolith.operators import decide, levels, review, runlog, score, votes
from taxolith.plans.queries import query, table
from taxolith.sources import records

PRICES = (("en", 1.0, 5.0, 0.1, 1.25), ("de", 2.0, 8.0, 0.2, 2.5), ("fr", 0.5, 2.5, 0.05, 0.75), ("es", 3.0, 15.0, 0.3, 3.75))


@query("""WITH p(lang, i, o, r, w) AS (VALUES """ + ", ".join(map(str, PRICES)) + """) SELECT doc_id, round((n_chars * i + n_chars % 100 * o + n_chars % 7 * r + n_chars % 3 * w) / 1e6, 9) AS cost FROM documents JOIN p USING (lang)""")
def priced_calls(spark, sf_dir):
    """Documents as calls, priced by their model, which is the language."""
    n = F.col("n_chars")
    calls = table(spark, sf_dir, "documents").select("doc_id", F.lit("p").alias("provider"), F.col("lang").alias("model"), n.alias("input_tokens"), (n % 100).alias("output_tokens"), (n % 7).alias("cache_read_tokens"), (n % 3).alias("cache_write_tokens"))
    pricing = spark.createDataFrame([("p", *row) for row in PRICES], "provider string, model string, input_price double, output_price double, read_price double, write_price double")
    return runlog.priced(calls, pricing).select("doc_id", F.round("cost", 9).alias("cost"))


@query("SELECT doc_id, lang, quality FROM documents FULL JOIN labels USING (doc_id)")
def positional_join(spark, sf_dir):
    a, b = (table(spark, sf_dir, n) for n in ("documents", "labels"))
    return score.joined_by_position(a.select("doc_id", "lang"), b.select("doc_id", "quality"), "doc_id").select("doc_id", "lang", "quality")


@query("""WITH d AS (SELECT doc_id, CASE WHEN n_chars % 9 = 0 THEN '' ELSE lang END AS r1, source AS r2, 's' || n_chars % 3 AS r3, CASE WHEN n_chars % 5 = 0 THEN 'xx' ELSE lang END AS p1, CASE WHEN n_chars % 7 = 0 THEN NULL ELSE source END AS p2, ' s' || n_chars % 2 AS p3 FROM documents)
SELECT doc_id, r1 <> '' AND p1 = r1 AS type, r1 <> '' AND p1 = r1 AND p2 IS NOT NULL AND p2 = r2 AS usage, false AS subtype, r1 <> '' AND p1 = r1 AND p2 IS NOT NULL AND trim(p3) = r3 AS "lenient" FROM d""")
def level_hits(spark, sf_dir):
    n = F.col("n_chars")
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(n % 9 == 0, "").otherwise(F.col("lang")).alias("r1"), F.col("source").alias("r2"), F.concat(F.lit("s"), n % 3).alias("r3"),
        F.when(n % 5 == 0, "xx").otherwise(F.col("lang")).alias("p1"), F.when(n % 7 != 0, F.col("source")).alias("p2"), F.concat(F.lit(" s"), n % 2).alias("p3"),
    )
    hits = score.level_hits(["p1", "p2", "p3"], ["r1", "r2", "r3"])
    return d.select("doc_id", *[h.alias(k) for h, k in zip(hits, levels.NAMES, strict=True)], levels.lenient_equal(["p1", "p2", "p3"], ["r1", "r2", "r3"]).alias("lenient"))


WORDS = "list_distinct(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_]+'))"


@query(f"""SELECT doc_id, len({WORDS.format("text[1:20]")}) > 0 AND list_has_all({WORDS.format("text")}, {WORDS.format("text[1:20]")}) AS evidence, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS squashed, CASE n_chars % 4 WHEN 0 THEN n_chars / 8.0 END AS number,
  CASE n_chars % 4 WHEN 3 THEN '' ELSE n_chars::VARCHAR END AS cell FROM documents""")
def text_cells(spark, sf_dir):
    """Evidence of a text's first twenty characters, collapsed blanks, numbers and markers of missing values in cells."""
    n = F.col("n_chars")
    cell = F.when(n % 4 == 0, (n / 8.0).cast("string")).when(n % 4 == 1, "inf").when(n % 4 == 2, "x1").otherwise("nan")
    marked = F.when(n % 4 == 3, "N/A").otherwise(n.cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", text.evidence_in(F.substring("text", 1, 20), F.col("text")).alias("evidence"), F.md5(text.lenient(F.col("text"))).alias("squashed"), text.parsed_number(cell).alias("number"), text.blank_marker(marked).alias("cell"))


@query("""SELECT doc_id, CASE n_chars % 3 WHEN 0 THEN n_chars % 4 || '/31.5' WHEN 1 THEN '0/2,4/' || (n_chars % 6 + 5) ELSE '' END AS grading, CASE WHEN n_chars % 3 = 2 THEN '25,30' ELSE '' END AS strength FROM documents""")
def gradings(spark, sf_dir):
    """Gradings, which strength classes look like but are not."""
    n = F.col("n_chars")
    stated = F.when(n % 3 == 0, F.concat(n % 4, F.lit("/31.5 gravel"))).when(n % 3 == 1, F.concat(F.lit("4/"), n % 6 + 5, F.lit(" and 0/2"))).otherwise("c25/30")
    a = table(spark, sf_dir, "documents").select("doc_id", attributes.extract(stated).alias("a"))
    return a.select("doc_id", F.array_join("a.grading", ",").alias("grading"), F.array_join("a.strength_class", ",").alias("strength"))


@query("""WITH v AS (SELECT doc_id // 4 AS line, doc_id % 4 AS pass_no, 'c' || n_chars % 3 AS code, n_chars % 5 < 2 AS conflict FROM documents), c AS (SELECT line, count(*) AS n, count(*) FILTER (WHERE conflict) AS bad FROM v GROUP BY 1)
SELECT line, pass_no, code FROM v JOIN c USING (line) WHERE NOT conflict OR n = bad""")
def unconflicted_votes(spark, sf_dir):
    """Votes without those whose row conflicts with the line, unless all do."""
    n = F.col("n_chars")
    v = table(spark, sf_dir, "documents").select(F.expr("doc_id div 4").alias("line"), (F.col("doc_id") % 4).alias("pass_no"), F.concat(F.lit("c"), n % 3).alias("code"), (n % 5 < 2).alias("conflict"))
    return votes.without_conflicts(v).select("line", "pass_no", "code")


@query("""SELECT conv_id, turn FROM conversations WHERE length(text) % 5 <> 0 AND length(text) % 7 <> 0""")
def cacheable_calls(spark, sf_dir):
    n = F.length("text")
    calls = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(n % 5 == 0, 529).otherwise(200).alias("status"), F.when(n % 7 == 0, "x").alias("error"))
    return records.cacheable(calls).select("conv_id", "turn")


@query("""WITH d AS (SELECT *, CASE WHEN n_chars % 6 = 5 THEN NULL ELSE ['matched', 'needs_review', 'not_a_material', 'maybe', ''][n_chars % 6 + 1] END AS dec FROM documents)
SELECT doc_id, CASE WHEN n_chars % 6 = 5 AND n_chars % 5 = 0 THEN 'missing' WHEN dec IN ('matched', 'needs_review', 'not_a_material') THEN dec ELSE 'invalid' END AS decision,
  CASE WHEN n_chars % 3 = 2 THEN CASE n_chars % 4 WHEN 0 THEN 'needs_review' ELSE 'not_a_material' END WHEN n_chars % 7 <> 0 THEN 'matched' ELSE 'needs_review' END AS baseline FROM d""")
def pair_decisions(spark, sf_dir):
    """Decisions of pairs, and those of the baseline that matches every valid code."""
    n = F.col("n_chars")
    named = F.get(F.array(*map(F.lit, ("matched", "needs_review", "not_a_material", "maybe", ""))), (n % 6).cast("int"))
    kind = F.when(n % 3 != 2, "item").when(n % 4 == 0, "header_unconfirmed").otherwise("header")
    d = table(spark, sf_dir, "documents").select("doc_id", review.decision_of(~((n % 6 == 5) & (n % 5 == 0)), named).alias("first"), (n % 3 != 2).alias("measured"), kind.alias("kind"), (n % 7 != 0).alias("valid_code"))
    return decide.decided_any_valid(d).select("doc_id", F.col("first").alias("decision"), F.col("decision").alias("baseline"))

"""Attributes, thresholds and scores of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolith.functions import attributes
from taxolith.operators import evaluate, scopes, select
from taxolith.plans.queries import query, r6, table
from taxolith.sources import tables

#: Values of six families drawn from a number, and the text that states them.
VALUES = """CASE WHEN n % 3 <> 0 THEN n % 7 + 10 END AS d, CASE n % 4 WHEN 1 THEN 'WMA' WHEN 2 THEN 'HMA' END AS p, CASE n % 11 WHEN 1 THEN '25,30' WHEN 2 THEN '30,37' END AS s,
  CASE n % 5 WHEN 0 THEN ['xc1'] WHEN 1 THEN ['xc1', 'xd2'] WHEN 2 THEN ['xs3'] ELSE [] END AS x, CASE n % 6 WHEN 0 THEN 'ii' WHEN 1 THEN 'ii/a' WHEN 2 THEN 'iii/b' ELSE '' END AS c, CASE n % 9 WHEN 0 THEN '1705' WHEN 1 THEN '170503' WHEN 2 THEN '1701' ELSE '' END AS w"""
STATED = """concat_ws(' ', CASE WHEN n % 3 <> 0 THEN concat('dn ', n % 7 + 10) END, CASE n % 4 WHEN 1 THEN 'warm mix' WHEN 2 THEN 'hot' END, CASE n % 11 WHEN 1 THEN 'c25/30' WHEN 2 THEN 'c30/37' END,
  CASE n % 5 WHEN 0 THEN 'xc1' WHEN 1 THEN 'xd2 xc1' WHEN 2 THEN 'xs3' END, CASE n % 6 WHEN 0 THEN 'cem ii' WHEN 1 THEN 'cem ii/a' WHEN 2 THEN 'cem iii / b' END, CASE n % 9 WHEN 0 THEN '17 05' WHEN 1 THEN '17 05 03' WHEN 2 THEN '1701' END)"""
CLASHES = """list_filter([CASE WHEN l.s <> r.s THEN 'strength_class' END, CASE WHEN len(l.x) > 0 AND len(r.x) > 0 AND NOT list_has_all(r.x, l.x) THEN 'exposure_classes' END,
  CASE WHEN l.c <> '' AND r.c <> '' AND NOT (split_part(l.c, '/', 1) = split_part(r.c, '/', 1) AND (l.c NOT LIKE '%/%' OR r.c NOT LIKE '%/%' OR l.c = r.c)) THEN 'cement_type' END, CASE WHEN l.p <> r.p THEN 'process' END,
  CASE WHEN l.w <> '' AND r.w <> '' AND NOT (starts_with(l.w, r.w) OR starts_with(r.w, l.w)) THEN 'waste_code' END, CASE WHEN l.d <> r.d THEN 'diameter_mm' END], lambda y: y IS NOT NULL)"""
BOTH = "(l.s IS NOT NULL AND r.s IS NOT NULL OR len(l.x) > 0 AND len(r.x) > 0 OR l.c <> '' AND r.c <> '' OR l.p IS NOT NULL AND r.p IS NOT NULL OR l.w <> '' AND r.w <> '' OR l.d IS NOT NULL AND r.d IS NOT NULL)"


def texts_of(df: DataFrame, *keys: str) -> DataFrame:
    """keys, a: attributes of the text that states them; equal texts are read once."""
    stated = df.select(*keys, F.expr(STATED).alias("stated"))
    read = tables.written(stated.select("stated").distinct().select("stated", attributes.extract(F.col("stated")).alias("a")), "stated")
    return stated.join(tables.small(read), "stated").select(*keys, "a")


@query(f"""WITH l AS (SELECT doc_id AS line, n, n % 2500 + 1 AS label, {VALUES} FROM (SELECT doc_id, n_chars AS n FROM documents)), r AS (SELECT label, {VALUES} FROM (SELECT p_partkey AS label, p_partkey * 7 + p_size AS n FROM part)),
k AS (SELECT l.n, count(*) FILTER (WHERE len({CLASHES}) = 0) AS open FROM (SELECT DISTINCT n, d, p, s, x, c, w FROM l) l CROSS JOIN r GROUP BY 1)
SELECT l.line, CASE WHEN r.label IS NULL THEN 'missing' WHEN len({CLASHES}) > 0 THEN 'conflict' WHEN {BOTH} THEN 'agree' ELSE 'no_evidence' END AS verdict, CASE WHEN r.label IS NOT NULL THEN array_to_string({CLASHES}, ',') END AS conflicting, CASE WHEN r.label IS NOT NULL THEN open END AS open FROM l LEFT JOIN r USING (label) JOIN k ON k.n = l.n""")
def labelled_against_library(spark, sf_dir):
    """Documents as labelled lines against parts as the library: verdict, families in conflict, rows left open."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), F.col("n_chars").alias("n"), (F.col("n_chars") % 2500 + 1).alias("label"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("label"), (F.col("p_partkey") * 7 + F.col("p_size")).alias("n"))
    found = evaluate.against_library(texts_of(docs, "line", "label"), texts_of(part, "label"))
    return found.withColumn("conflicting", F.array_join("conflicting", ","))


#: A document's reference, what an output made of it, and its suggestions, drawn from its length.
PAIR = """WITH d AS (SELECT doc_id, lang, source, n_chars AS n, CASE WHEN n_chars % 29 = 0 THEN 'H' WHEN n_chars % 31 = 0 THEN 'U' WHEN n_chars % 10 = 0 THEN 'E' WHEN n_chars % 37 = 0 THEN 'S' ELSE 'L' END AS class FROM documents),
s AS (SELECT *, CASE WHEN n % 41 = 0 THEN NULL WHEN n % 43 = 0 THEN 'other' ELSE ['matched', 'matched', 'needs_review', 'not_a_material'][n % 4 + 1] END AS decision, CASE WHEN class = 'L' THEN [lang, source, 's ' || (n % 3)] ELSE ['', '', ''] END AS ref,
  [CASE WHEN n % 7 = 0 THEN 'xx' ELSE lang END, CASE WHEN n % 7 = 1 THEN 'xx' ELSE source END, CASE n % 7 WHEN 2 THEN 'xx' WHEN 3 THEN ' s  ' || (n % 3) ELSE 's ' || (n % 3) END] AS out,
  [lang, CASE WHEN n % 5 = 0 THEN 'xx' ELSE source END, 's ' || (n % 3)] AS s1, [lang, source, 's ' || (n % 2)] AS s2, CASE WHEN n % 3 = 0 THEN ' ' ELSE 'm' END AS unit, n / 1000.0 AS cost FROM d),
j AS (SELECT *, coalesce(CASE WHEN decision IN ('matched', 'needs_review', 'not_a_material', 'other') THEN decision END, 'missing') AS e, class = 'L' AS l, class IN ('L', 'E') AS m, class NOT IN ('H', 'U') AS i, decision = 'matched' AS k, class = 'L' AND out = ref AS r, class = 'L' AND list_transform(out, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) = ref AS z FROM s)
"""


def pairs_of(spark, sf_dir) -> DataFrame:
    n = F.col("n_chars")
    three = lambda *c: F.struct(*[F.lit(x).alias(k) if isinstance(x, str) else x.alias(k) for k, x in zip(scopes.LEVELS, c, strict=True)])
    sub = lambda k: F.concat(F.lit("s "), n % k)
    own = F.col("lang"), F.col("source")
    klass = F.when(n % 29 == 0, "H").when(n % 31 == 0, "U").when(n % 10 == 0, "E").when(n % 37 == 0, "S").otherwise("L")
    decision = F.when(n % 41 == 0, None).when(n % 43 == 0, "other").when(n % 4 < 2, "matched").when(n % 4 == 2, "needs_review").otherwise("not_a_material")
    out = three(F.when(n % 7 == 0, "xx").otherwise(own[0]), F.when(n % 7 == 1, "xx").otherwise(own[1]), F.when(n % 7 == 2, "xx").when(n % 7 == 3, F.concat(F.lit(" s  "), n % 3)).otherwise(sub(3)))
    return table(spark, sf_dir, "documents").select(
        "lang", klass.alias("class"), decision.alias("decision"), out.alias("out"), F.when(klass == "L", three(*own, sub(3))).otherwise(three("", "", "")).alias("ref"),
        three(own[0], F.when(n % 5 == 0, "xx").otherwise(own[1]), sub(3)).alias("suggested"), three(*own, sub(2)).alias("suggested_2"), F.when(n % 3 == 0, " ").otherwise("m").alias("unit"), (n / 1000.0).alias("cost"),
    )


@query(PAIR + """SELECT lang, count(*) AS rows, count(*) FILTER (WHERE i) AS items, count(*) FILTER (WHERE class = 'U') AS unclassed, count(*) FILTER (WHERE l) AS labelled, count(*) FILTER (WHERE class = 'E') AS no_equivalent, count(*) FILTER (WHERE e = 'missing') AS missing, count(*) FILTER (WHERE e = 'other') AS invalid,
  count(*) FILTER (WHERE k) AS matched, count(*) FILTER (WHERE k AND r) AS correct, round(count(*) FILTER (WHERE k AND r) / count(*) FILTER (WHERE k), 6) AS precision, round(count(*) FILTER (WHERE k AND r) / count(*) FILTER (WHERE m), 6) AS coverage_material,
  round(count(*) FILTER (WHERE k AND l AND out[1] = ref[1]) / count(*) FILTER (WHERE k), 6) AS matched_type, round(count(*) FILTER (WHERE k AND l AND out[1:2] = ref[1:2]) / count(*) FILTER (WHERE k), 6) AS matched_usage,
  round(count(*) FILTER (WHERE l AND s1[1:2] = ref[1:2]) / count(*) FILTER (WHERE l), 6) AS labelled_usage, round(count(*) FILTER (WHERE l AND s1 = ref) / count(*) FILTER (WHERE l AND s1[1:2] = ref[1:2]), 6) AS subtype_given_usage,
  count(*) FILTER (WHERE m AND e = 'not_a_material') AS false_skips, count(*) FILTER (WHERE k AND z AND NOT r) AS whitespace_only, count(*) FILTER (WHERE e = 'not_a_material' AND trim(unit) <> '') AS skips_with_unit, round(count(*) FILTER (WHERE k AND z) / count(*) FILTER (WHERE k), 6) AS lenient_precision,
  count(*) FILTER (WHERE l AND e = 'needs_review' AND s1 = ref) AS hit_1, count(*) FILTER (WHERE l AND e = 'needs_review' AND (s1 = ref OR s2 = ref)) AS hit_2, round(count(*) FILTER (WHERE i AND e = 'needs_review') / count(*) FILTER (WHERE i), 6) AS item_review_share,
  round((count(*) FILTER (WHERE k AND r) + count(*) FILTER (WHERE m AND e = 'needs_review')) / count(*) FILTER (WHERE m), 6) AS helped, round(100 * count(*) FILTER (WHERE e = 'needs_review') / count(*) FILTER (WHERE e <> 'missing'), 6) AS review_per_100, round(avg(cost), 6) AS mean_cost, NULL::DOUBLE AS mean_latency
  FROM j GROUP BY GROUPING SETS ((), (lang))""")
def scored_output(spark, sf_dir):
    """Every figure of an output over documents, in all and by language, in one aggregation."""
    s = scopes.score_output(pairs_of(spark, sf_dir), [[], ["lang"]])
    return s.select(
        "lang", "counts.*", F.col("all_rows.invalid"), "precision.matched", "precision.correct", r6("precision.value").alias("precision"), r6("coverage_material.value").alias("coverage_material"), r6("levels_matched.type").alias("matched_type"), r6("levels_matched.usage").alias("matched_usage"),
        r6("levels_labelled.usage").alias("labelled_usage"), r6("cascade.subtype_given_usage").alias("subtype_given_usage"), "false_skips", "whitespace_only", "skips_with_unit", r6("lenient.precision").alias("lenient_precision"), F.col("hit_at_1.hits").alias("hit_1"), F.col("hit_at_2.hits").alias("hit_2"),
        r6("item_rows.needs_review_share").alias("item_review_share"), r6("helped.value").alias("helped"), r6("review_load.per_100").alias("review_per_100"), r6("mean_cost").alias("mean_cost"), "mean_latency",
    )


#: Which points are not measured in each case, and the case's bar.
CASES = {"whole": ("false", 0.85), "strict": ("ord <= 2 AND lang = 'en'", 0.85), "near": ("ord = 7 AND lang = 'en'", 0.85), "loose": ("ord = 8 AND lang = 'en'", 0.85), "high": ("ord = 1", 0.999), "none": ("lang = 'en'", 0.85)}
POINTS = """WITH p AS (SELECT lang, n_chars % 8 AS k, quality = 1 AS c FROM documents JOIN labels USING (doc_id)), full_ AS (SELECT ord, lang, count(*) FILTER (WHERE k < ord) AS matched, count(*) FILTER (WHERE k < ord AND c) AS correct FROM p, range(1, 9) o(ord) GROUP BY 1, 2),
cases AS (SELECT * FROM (VALUES """ + ", ".join(f"('{name}', {bar})" for name, (_, bar) in CASES.items()) + """) v(name, bar)),
x AS (SELECT name, bar, ord, lang, CASE WHEN NOT gone THEN matched END AS matched, CASE WHEN NOT gone THEN correct END AS correct FROM (SELECT *, CASE name """ + " ".join(f"WHEN '{name}' THEN {gone}" for name, (gone, _) in CASES.items()) + """ END AS gone FROM full_ CROSS JOIN cases)),
y AS (SELECT *, coalesce(first_value(correct IGNORE NULLS) OVER (PARTITION BY name, lang ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), (SELECT count(*) FROM p WHERE p.lang = x.lang)) AS top FROM x),
b AS (SELECT name, ord, bool_and(matched IS NOT NULL) AS measured, sum(top) AS ceiling FROM y GROUP BY 1, 2), s AS (SELECT name, ord, unnest(['all', 'lang:' || lang]) AS scope, matched, correct, bar FROM y WHERE (name, ord) IN (SELECT name, ord FROM b WHERE measured)),
q AS (SELECT name, scope, ord, bool_and(matched >= 10 AND correct / matched >= bar) AS ok, sum(correct) AS correct FROM s GROUP BY 1, 2, 3), m AS (SELECT name, scope, max(ord) FILTER (WHERE ok) AS loosest FROM q GROUP BY 1, 2),
z AS (SELECT m.*, (SELECT correct FROM q WHERE q.name = m.name AND q.scope = m.scope AND q.ord = m.loosest) AS best FROM m), t AS (SELECT *, CASE WHEN loosest IS NULL THEN (SELECT min(ord) FROM q WHERE q.name = z.name AND q.scope = z.scope) ELSE (SELECT min(ord) FROM q WHERE q.name = z.name AND q.scope = z.scope AND ok AND correct >= best - 3) END AS ord FROM z),
u AS (SELECT name, count(*) AS n, max(ord) AS last, max(ceiling) AS top FROM b WHERE NOT measured GROUP BY 1), r AS (SELECT c.name, CASE WHEN n IS NULL THEN NULL WHEN t.name IS NULL THEN 'nothing is measured' WHEN loosest IS NULL THEN 'no measured threshold meets the bar' WHEN last > loosest THEN 'looser than the loosest that qualifies' WHEN top >= best - 3 THEN 'a ceiling reaches the window' END AS refused
  FROM cases c LEFT JOIN u USING (name) LEFT JOIN t ON t.name = c.name AND t.scope = 'all')
"""


@query(POINTS + """SELECT r.name AS "case", coalesce(scope, 'all') AS scope, 'T' || ord AS threshold, CASE WHEN scope IS NULL THEN NULL WHEN loosest IS NULL THEN 'fallback' ELSE 'qualified' END AS how, 'T' || loosest AS loosest, refused FROM r LEFT JOIN t USING (name)""")
def checked_selection(spark, sf_dir):
    """The rule over thresholds of which some are not measured: what it takes, and where that must be refused."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") % 8).alias("k"))
    pairs = docs.join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("c")), "doc_id").groupBy("lang", "k").agg(F.count("*").alias("n"), F.count_if("c").alias("c"))
    each = pairs.select("*", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("ord"))
    full = each.groupBy("ord", "lang").agg(F.sum(F.when(F.col("k") < F.col("ord"), F.col("n")).otherwise(0)).alias("matched"), F.sum(F.when(F.col("k") < F.col("ord"), F.col("c")).otherwise(0)).alias("correct"))
    full, labelled = tables.written(full, "points"), tables.written(pairs.groupBy("lang").agg(F.sum("n").alias("n")), "labelled")
    found = None
    for name, (gone, bar) in CASES.items():
        seen = lambda c, gone=gone: F.when(~F.expr(gone), F.col(c)).alias(c)
        points = full.select(F.concat(F.lit("T"), "ord").alias("threshold"), "ord", "lang", seen("matched"), seen("correct"), F.lit(0.0).alias("bound"))
        one = select.checked_selection(points, labelled, bar, least=10).select(F.lit(name).alias("case"), "*")
        found = one if found is None else found.unionByName(one)
    return found

"""Recorded runs over conversations: a conversation is a line, its turns are the line's calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolith.plans.queries import query, table
from taxolith.sources import runs, tables

LINES = "line_id string, item_no string, decision string, top1 string, raw array<string>"
CALLS = "line_id string, ord long, call_id string, request_hash string, response string, cache_hit boolean, response_provider string, response_model string, latency_ms long"
MADE = """WITH t AS (SELECT conv_id, turn, role, text, length(text) AS n FROM conversations),
lines AS (SELECT conv_id::VARCHAR AS line_id, 'C' || conv_id AS item_no, CASE sum(n) % 3 WHEN 0 THEN 'matched' WHEN 1 THEN 'needs_review' ELSE 'not_a_material' END AS decision, CASE WHEN sum(n) % 5 = 0 THEN '' ELSE 'P' || (sum(n) % 40) END AS top1,
  list(CASE WHEN turn % 2 = 0 THEN '{"n":' || n || '}' ELSE role || ' ' || n END ORDER BY turn) AS raw FROM t GROUP BY conv_id),
calls AS (SELECT conv_id::VARCHAR AS line_id, turn AS ord, conv_id || '-' || turn AS call_id, md5(role || (n % 50)) AS request_hash, md5(text) AS response, n % 7 = 0 AS cache_hit, CASE WHEN n % 11 = 0 THEN 'p2' ELSE 'p1' END AS response_provider, CASE WHEN n % 13 = 0 THEN 'm2' ELSE 'm1' END AS response_model, n AS latency_ms FROM t)
"""
#: name, mode, provider, model of the runs that are made
RUNS = (("r1", "live", "p1", "m1"), ("r2", "replay", "p1", "m1"), ("r3", "live", "p1", "m2"), ("r4", "live", "p1", "m1"))


def lines_of(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    raw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('{"n":'), "n", F.lit("}"))).otherwise(F.concat_ws(" ", "role", "n"))
    g = t.groupBy(F.col("conv_id").cast("string").alias("line_id")).agg(F.sum("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("turn", raw.alias("raw")))), lambda x: x["raw"]).alias("raw"))
    decision = F.when(F.col("n") % 3 == 0, "matched").when(F.col("n") % 3 == 1, "needs_review").otherwise("not_a_material")
    return g.select("line_id", F.concat(F.lit("C"), "line_id").alias("item_no"), decision.alias("decision"), F.when(F.col("n") % 5 == 0, "").otherwise(F.concat(F.lit("P"), F.col("n") % 40)).alias("top1"), "raw")


def calls_of(spark, sf_dir) -> DataFrame:
    n, ident = F.length("text"), F.col("conv_id").cast("string")
    return table(spark, sf_dir, "conversations").select(
        ident.alias("line_id"), F.col("turn").alias("ord"), F.concat_ws("-", ident, "turn").alias("call_id"), F.md5(F.concat("role", n % 50)).alias("request_hash"), F.md5("text").alias("response"), (n % 7 == 0).alias("cache_hit"),
        F.when(n % 11 == 0, "p2").otherwise("p1").alias("response_provider"), F.when(n % 13 == 0, "m2").otherwise("m1").alias("response_model"), n.cast("long").alias("latency_ms"),
    )


def recorded(spark, sf_dir) -> str:
    """Four runs in the shared folder: all calls are dealt over them by their line; the last run's lines have some other decisions."""
    root = tables.folder(spark, "runs")
    lines, calls = lines_of(spark, sf_dir), calls_of(spark, sf_dir).withColumn("k", F.pmod(F.col("line_id").cast("long"), F.lit(len(RUNS))))
    for k, (run, mode, provider, model) in enumerate(RUNS):
        own = lines if k < 3 else lines.withColumn("decision", F.when(F.col("top1").like("P%7"), "matched").otherwise(F.col("decision")))
        runs.write_run(root, run, {"lines": own, "calls": calls.where(F.col("k") == k).drop("k")}, mode, provider, model, {"lines": "line_id", "calls": "line_id"})
    return root


def schema(spark, ddl: str):
    return spark.createDataFrame([], ddl).schema


DIGEST = """sum(('0x' || substr(sha256('{"decision":"' || decision || '","item_no":"' || item_no || '","line_id":"' || line_id || '","raw":[' || array_to_string(list_transform(raw, lambda x: to_json(x)::VARCHAR), ',') || '],"top1":"' || top1 || '"}'), 1, 15))::BIGINT)::VARCHAR"""


@query(MADE + f""", r AS (SELECT * FROM (VALUES ('r1', 0), ('r2', 1), ('r3', 2), ('r4', 3)) v(run, k)), d AS (SELECT r.run, line_id, item_no, top1, raw, CASE WHEN k = 3 AND top1 LIKE 'P%7' THEN 'matched' ELSE decision END AS decision FROM lines CROSS JOIN r),
g AS (SELECT run, count(*) AS rows, {DIGEST} AS digest FROM d GROUP BY 1) SELECT g.*, digest = (SELECT digest FROM g x WHERE x.run = 'r1') AS same, 0::BIGINT AS problems FROM g""")
def run_manifests(spark, sf_dir):
    """Rows and digests that four recorded runs' manifests have, whether each equals the first, and what is not as its manifest says."""
    root = recorded(spark, sf_dir)
    wrong = runs.manifest_problems(spark, root, "lines", schema(spark, LINES)).agg(F.count("*").alias("problems"))
    return runs.replay_verdicts(spark, root, "lines", "r1").crossJoin(F.broadcast(wrong))


@query(MADE + """SELECT line_id, 'decision' AS "column", decision AS before, 'matched' AS after FROM lines WHERE top1 LIKE 'P%7' AND decision <> 'matched'""")
def replay_differences(spark, sf_dir):
    """Cells in which the last run differs from the first."""
    rows = runs.part(spark, recorded(spark, sf_dir), "lines", schema(spark, LINES))
    of = lambda run: rows.where(F.col("run") == run)
    return runs.changed_cells(of("r1"), of("r4"), "line_id", ["item_no", "decision", "top1", "raw"])


@query(MADE + """, a AS (SELECT *, 'r' || (line_id::BIGINT % 4 + 1) AS source FROM calls WHERE line_id::BIGINT % 4 IN (0, 3) AND NOT cache_hit AND response_provider = 'p1' AND response_model = 'm1')
SELECT request_hash, row_number() OVER (PARTITION BY request_hash ORDER BY source, ord, call_id) - 1 AS occ, response, source FROM a""")
def seeded_cache(spark, sf_dir):
    """Answers that the two live runs of a provider and model may serve again, in order."""
    return runs.load_cache(spark, recorded(spark, sf_dir), "p1", "m1", schema(spark, CALLS))


@query(MADE + """SELECT line_id, item_no, decision, CASE WHEN top1 <> '' THEN top1 || ':' || coalesce(n_name, '?') END AS row_name,
  array_to_string(list_transform(raw, lambda x, i: i || (CASE WHEN x[1] = '{' THEN '=' ELSE '~' END) || x), ';') AS passes, coalesce((SELECT string_agg(call_id || '/' || latency_ms, ',' ORDER BY ord) FROM calls c WHERE c.line_id = l.line_id AND l.line_id::BIGINT % 4 = 0), '') AS calls
FROM lines l LEFT JOIN nation ON top1 = 'P' || n_nationkey""")
def audit_views(spark, sf_dir):
    """Every line of the first run with its passes, calls and row; the library is the nations."""
    root = recorded(spark, sf_dir)
    own = lambda name, ddl: runs.part(spark, root, name, schema(spark, ddl)).where("run = 'r1'")
    library = table(spark, sf_dir, "nation").select(F.concat(F.lit("P"), "n_nationkey").alias("code"), F.col("n_name").alias("name"))
    view = runs.audit_view(own("lines", LINES), own("calls", CALLS), library)
    passes = F.transform("passes", lambda p: F.concat(p["pass"].cast("string"), F.when(p["body"].isNotNull(), "=").otherwise("~"), p["raw"]))
    calls = F.transform("calls", lambda c: F.concat_ws("/", c["call_id"], c["latency_ms"].cast("string")))
    return view.select("line_id", "item_no", "decision", F.concat("row.code", F.lit(":"), F.coalesce("row.name", F.lit("?"))).alias("row_name"), F.array_join(passes, ";").alias("passes"), F.array_join(calls, ",").alias("calls"))

"""Calls and their answers: retries in rounds, requests, strict answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxolith.functions import canonical
from taxolith.operators import answers, decide, retries, runlog, verify
from taxolith.plans.queries import DECISIONS, decision_rows, query, table

MAX_CALLS = 6
KIND = """CASE WHEN n % 97 = 0 THEN 'refusal' WHEN n % 7 = 0 THEN 'malformed' WHEN n % 11 = 0 AND call <= 3 THEN 'missing' WHEN n % 5 = 0 AND call <= n % 4 THEN 'truncated'
  WHEN n % 13 = 0 AND call <= 2 THEN 'conflict' WHEN n % 17 = 0 THEN 'conflict' WHEN n % 19 = 0 THEN 'invalid' WHEN n % 23 = 0 THEN 'missing' ELSE 'ok' END"""


@query(f"""WITH RECURSIVE r AS (
  SELECT conv_id AS batch, turn AS line, length(text) AS n, conv_id::VARCHAR AS task, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, 0 AS calls, 0 AS conflicts, NULL::VARCHAR AS last, NULL::VARCHAR AS outcome FROM conversations
  UNION ALL
  SELECT batch, line, n, task, row_number() OVER (PARTITION BY task ORDER BY place) - 1, calls, conflicts, last, outcome FROM (
    SELECT batch, line, n, CASE WHEN outcome IS NOT NULL THEN task WHEN halved THEN task || CASE WHEN place < size // 2 THEN '.0' ELSE '.1' END WHEN kind = 'missing' THEN task || '.m' ELSE task || '.c' END AS task, place, calls, conflicts,
      CASE WHEN outcome IS NOT NULL THEN last WHEN halved THEN status WHEN kind = 'missing' THEN 'missing_item' ELSE 'duplicate_conflict' END AS last, outcome FROM (
      SELECT *, CASE WHEN spent THEN coalesce(last, 'api_error') WHEN halved AND size = 1 THEN status WHEN halved THEN NULL WHEN status <> 'ok' THEN status WHEN kind = 'ok' THEN 'answered' WHEN kind = 'invalid' THEN 'malformed' WHEN kind = 'conflict' AND conflicts > 1 THEN 'duplicate_conflict' END AS outcome FROM (
        SELECT batch, line, n, task, place, calls, last, size, spent, kind, status, NOT spent AND status IN ('truncated', 'malformed') AS halved, conflicts + (NOT spent AND status = 'ok' AND kind = 'conflict')::INT AS conflicts FROM (
          SELECT *, coalesce(min(CASE WHEN kind NOT IN ('missing', 'conflict', 'invalid', 'ok') THEN kind END) OVER (PARTITION BY task), 'ok') AS status FROM (
            SELECT *, {KIND} AS kind FROM (SELECT * REPLACE (calls + (NOT spent)::INT AS calls), calls + 1 AS call FROM (SELECT *, count(*) OVER (PARTITION BY task) AS size, max(calls) OVER (PARTITION BY task) >= {MAX_CALLS} AS spent FROM r WHERE outcome IS NULL)))))))
)
SELECT batch AS conv_id, line AS turn, task, calls, conflicts, outcome FROM r WHERE outcome IS NOT NULL""")
def bisected_batches(spark, sf_dir):
    """Conversations as batches whose turns' answers fail as their lengths have it, in rounds until every turn is settled."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    log = turns.select(F.col("conv_id").alias("batch"), F.col("turn").alias("line"), "n", F.explode(F.sequence(F.lit(1), F.lit(MAX_CALLS))).alias("call")).withColumn("kind", F.expr(KIND)).where("kind <> 'ok'").drop("n")
    done = retries.settled(retries.first_tasks(turns, "conv_id", "turn", "turn"), retries.recorded(log), MAX_CALLS)
    return done.withColumnsRenamed({"batch": "conv_id", "line": "turn"})


@query("""SELECT doc_id, sha256('{"max_tokens":' || n_chars || ',"model":' || to_json(lang)::VARCHAR || ',"schema":{"a":[1,2.5,null],"type":' || to_json(source)::VARCHAR || '},"system_blocks":[{"cache":' || (n_chars % 2 = 0) || ',"text":' || to_json(source)::VARCHAR
  || '},{"cache":false,"text":"x\\u0001\\"é"}],"temperature":' || ((n_chars % 10) / 10.0) || ',"user_payload":' || to_json(text)::VARCHAR || '}') AS request_hash, 'L' || doc_id AS transport_id FROM documents""")
def request_hashes(spark, sf_dir):
    """Each document as a request: the key under which its answers are kept."""
    block = lambda text, cache: F.struct(text.alias("text"), cache.alias("cache"))
    requests = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("model"), F.array(block(F.col("source"), F.col("n_chars") % 2 == 0), block(F.lit('x\x01"é'), F.lit(False))).alias("system_blocks"),
        F.concat(F.lit('{"type" : '), canonical.quoted(F.col("source")), F.lit(', "a":[1, 2.50, null]}')).alias("schema_json"),
        (F.col("n_chars") % 10 / 10.0).alias("temperature"), F.col("n_chars").alias("max_tokens"), F.col("text").alias("user_payload"),
    )
    return requests.select("doc_id", canonical.request_hash(requests).alias("request_hash"), canonical.transport_id(F.col("doc_id")).alias("transport_id"))


#: A line of an answer that quotes a turn; K varies what is wrong with it.
LINE = """'{"id": "' || turn || '"' || CASE WHEN k = 5 THEN ', "more": [1, {"x": "]}"}]' ELSE '' END || ',  "evidence":"' || CASE WHEN k = 7 THEN repeat('w ', 26) ELSE 'a \\"b\\", [c' END || '","element_or_application":"","material_family":"' || role || '","kind":"'
  || CASE WHEN k = 1 THEN 'Material' WHEN k = 6 THEN 'thing' ELSE 'no_equivalent' END || '","nm_category":"","top1":"T1","top2":"", "confidence" : ' || CASE k WHEN 2 THEN '"90"' WHEN 3 THEN '101' WHEN 4 THEN '90.0' ELSE (length(text) % 101)::VARCHAR END || ',"self_reported_candidate_gap":"clear"}'"""


def line_text():
    """LINE as columns."""
    k, text = F.col("k"), F.lit
    pick = lambda cases, other: F.coalesce(*[F.when(k == n, v) for n, v in cases.items()], other)
    return F.concat(
        text('{"id": "'), F.col("turn").cast("string"), text('"'), pick({5: ', "more": [1, {"x": "]}"}]'}, text("")), text(',  "evidence":"'), pick({7: "w " * 26}, text('a \\"b\\", [c')),
        text('","element_or_application":"","material_family":"'), F.col("role"), text('","kind":"'), pick({1: "Material", 6: "thing"}, text("no_equivalent")), text('","nm_category":"","top1":"T1","top2":"", "confidence" : '),
        pick({2: '"90"', 3: "101", 4: "90.0"}, (F.length("text") % 101).cast("string")), text(',"self_reported_candidate_gap":"clear"}'),
    )


@query(f"""WITH t AS (SELECT conv_id, turn, role, text, length(text) % 9 AS k FROM conversations), l AS (SELECT *, {LINE} AS line FROM t), m AS (SELECT conv_id, conv_id % 11 = 0 AS broken FROM t GROUP BY 1)
SELECT conv_id, CASE WHEN NOT broken THEN turn END AS line_no, CASE WHEN NOT broken THEN sha256(line) END AS raw_sha256, CASE WHEN NOT broken THEN turn::VARCHAR END AS id, CASE WHEN NOT broken THEN CASE k WHEN 2 THEN 'type:confidence' WHEN 3 THEN 'range:confidence' WHEN 4 THEN 'type:confidence' WHEN 5 THEN 'fields' WHEN 6 THEN 'value:kind' WHEN 7 THEN 'length:evidence' END END AS problem,
  CASE WHEN NOT broken AND k IN (0, 1, 8) THEN CASE WHEN k = 1 THEN 'material' ELSE 'no_equivalent' END END AS kind, CASE WHEN NOT broken AND k IN (0, 1, 8) THEN length(text) % 101 END AS confidence FROM l JOIN m USING (conv_id) WHERE NOT broken OR turn = (SELECT min(turn) FROM t x WHERE x.conv_id = l.conv_id)""")
def strict_answers(spark, sf_dir):
    """A conversation as one answer whose lines quote its turns, some wrong in one way; each line's verdict and verbatim text."""
    lines = table(spark, sf_dir, "conversations").withColumn("k", F.length("text") % 9).select("conv_id", "turn", line_text().alias("line"))
    calls = lines.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: F.concat(F.lit(" "), x["line"], F.lit("\n"))), ",")
    raw = F.concat(F.when(F.col("conv_id") % 11 == 0, F.lit('{"note": 1, "lines":[')).otherwise(F.lit('{ "lines" : [')), body, F.lit("] }"))
    found = answers.validated_lines(calls.select("conv_id", F.col("lines.turn").alias("turns"), raw.alias("raw")))
    return found.select("conv_id", "turns", F.posexplode_outer("entries").alias("at", "e")).select(
        "conv_id", F.get("turns", F.col("at")).alias("line_no"), F.sha2(F.col("e.raw"), 256).alias("raw_sha256"), "e.id", "e.problem", "e.kind", F.col("e.confidence").cast("long").alias("confidence")
    )


# --- the verifier stage and the report of a run -----------------------------------------------------------------------

#: The decision table over documents as votes, five in a row for a line, with the verifier off.
OFF = DECISIONS.replace("event_id // 5 AS line, event_id % 5 AS pass_no, event_type AS code, floor(value)::int % 101 AS confidence FROM events", "doc_id // 5 AS line, doc_id % 5 AS pass_no, CASE WHEN n_chars % 13 = 0 THEN 'error' ELSE 'c' || (n_chars % 3) END AS code, (60 + n_chars % 41)::INT AS confidence FROM documents").replace("WHEN passing AND line % 3 = 0 AND line % 2 <> 0 THEN 'D8a' ", "")
ASKED = OFF + """, x AS (SELECT *, CASE WHEN rule = 'D9' THEN (line // 7) % 7 END AS m FROM decided)
"""


def verified_of(spark, sf_dir):
    """Lines decided without the verifier, and the answers to those it flags: by sevenths right, another, none, no candidate, a failure, declined, never made."""
    n = F.col("n_chars")
    passes = table(spark, sf_dir, "documents").select(F.expr("doc_id div 5").alias("line"), (F.col("doc_id") % 5).alias("pass_no"), F.when(n % 13 == 0, "error").otherwise(F.concat(F.lit("c"), n % 3)).alias("code"), (60 + n % 41).cast("int").alias("confidence"))
    lines = decision_rows(spark, sf_dir, passes).withColumn("verifier", F.lit(None).cast("string"))
    coded = passes.select("code").where("code <> 'error'").distinct().withColumn("type", F.lit("T"))
    asked = verify.sibling_rows(verify.flagged(lines), coded)
    m = F.expr("line div 7") % 7
    code = F.when(m == 0, F.col("leader")).when(m == 1, F.when(F.col("leader") == "c1", "c2").otherwise("c1")).when(m == 2, "NONE").when(m == 3, "c9")
    outcomes = asked.where(m != 6).select("line", code.alias("code"), F.when(m == 4, "timeout").when(m == 5, "BUDGET_CAP").alias("failure"))
    return decide.decided(lines), verify.verifier_lines(asked, outcomes)


@query(ASKED + """SELECT line, CASE WHEN m IN (1, 2) THEN 'D8a' WHEN m >= 3 THEN 'D1b' ELSE rule END AS rule, CASE WHEN m >= 1 THEN 'needs_review' ELSE decision END AS decision, CASE WHEN m IN (1, 2) THEN 'VERIFIER_DISAGREES' WHEN m >= 3 THEN 'LLM_FAILURE:partial_signal' ELSE reason END AS reason FROM x""")
def verified_decisions(spark, sf_dir):
    decided, found = verified_of(spark, sf_dir)
    return verify.verified(decided, found).select("line", "rule", "decision", "reason")


@query(ASKED + """SELECT line, leader, CASE m WHEN 0 THEN leader WHEN 1 THEN CASE WHEN leader = 'c1' THEN 'c2' ELSE 'c1' END WHEN 2 THEN 'NONE' END AS answer, CASE m WHEN 3 THEN 'invalid_code' WHEN 4 THEN 'timeout' WHEN 5 THEN 'BUDGET_CAP' WHEN 6 THEN 'replay_miss' END AS failure,
  count(*) FILTER (WHERE m IN (5, 6)) OVER () AS unanswered FROM x WHERE m IS NOT NULL""")
def verifier_answers(spark, sf_dir):
    """What the verifier said of each line it was asked about, and how many requests never reached it."""
    found = verified_of(spark, sf_dir)[1]
    return found.crossJoin(F.broadcast(verify.unanswered(found).select("unanswered")))  # one row


REPORT = """WITH t AS (SELECT conv_id, 'r' || (conv_id % 3) AS run, turn, role, length(text) AS n FROM conversations),
l AS (SELECT run, conv_id, CASE sum(n) % 3 WHEN 0 THEN 'matched' WHEN 1 THEN 'needs_review' ELSE 'not_a_material' END AS decision, CASE WHEN run = 'r1' AND sum(n) % 13 = 0 THEN 'LLM_UNAVAILABLE' ELSE 'R' || (sum(n) % 4) END AS reason, CASE WHEN sum(n) % 6 = 0 THEN 'header' ELSE 'item' END AS kind, sum(n) / 1000.0 AS cost, sum(n) AS latency_ms, count(*) FILTER (WHERE n % 2 = 0) AS n_calls FROM t GROUP BY 1, 2),
h AS (SELECT run, k, string_agg(v || '=' || c, ',' ORDER BY v) AS s FROM (SELECT run, 'd' AS k, decision AS v, count(*) AS c FROM l GROUP BY ALL UNION ALL SELECT run, 'r', reason, count(*) FROM l GROUP BY ALL) GROUP BY 1, 2)
"""


@query(REPORT + """SELECT l.run, CASE l.run WHEN 'r2' THEN 'replay' WHEN 'r1' THEN CASE WHEN any_value(c.cache_hits) > 0 THEN 'cached' ELSE 'live' END ELSE CASE WHEN any_value(c.cache_hits) > 0 THEN 'cached' ELSE 'live' END END AS mode, count(*) AS lines, count(*) FILTER (WHERE kind = 'item') AS routed, any_value(c.calls) AS calls, any_value(c.retries) AS retries, any_value(c.cache_hits) AS cache_hits,
  any_value(c.cr)::BIGINT AS cache_read, (SELECT s FROM h WHERE h.run = l.run AND k = 'd') AS decisions, (SELECT s FROM h WHERE h.run = l.run AND k = 'r') AS reasons, round(any_value(c.spend), 4) AS spend, round(sum(cost) * 100 / count(*), 4) AS cost_per_100, quantile_disc(latency_ms, 0.5) FILTER (WHERE n_calls > 0)::BIGINT AS p50_ms, quantile_disc(latency_ms, 0.95) FILTER (WHERE n_calls > 0)::BIGINT AS p95_ms, CASE WHEN count(*) FILTER (WHERE reason = 'LLM_UNAVAILABLE') > 0 THEN 3 ELSE 0 END AS exit_code
  FROM l JOIN (SELECT run, count(*) AS calls, count(*) FILTER (WHERE turn % 5 = 4) AS retries, count(*) FILTER (WHERE run = 'r1' AND n % 7 = 0) AS cache_hits, sum(n % 10) AS cr, sum(CASE WHEN run = 'r1' AND n % 7 = 0 THEN 0 ELSE n / 1000.0 END) AS spend FROM t GROUP BY 1) c ON c.run = l.run GROUP BY l.run""")
def run_reports(spark, sf_dir):
    """Three runs of conversations as lines, turns as calls: what a run's summary says."""
    n, run = F.length("text"), F.concat(F.lit("r"), F.col("conv_id") % 3)
    t = table(spark, sf_dir, "conversations").select("conv_id", run.alias("run"), "turn", n.alias("n"))
    s = F.sum("n")
    g = t.groupBy("run", "conv_id").agg(s.alias("s"), F.count_if(F.col("n") % 2 == 0).alias("n_calls"))
    k = F.col("s")
    lines = g.select("run", F.when(k % 3 == 0, "matched").when(k % 3 == 1, "needs_review").otherwise("not_a_material").alias("decision"), F.when((F.col("run") == "r1") & (k % 13 == 0), "LLM_UNAVAILABLE").otherwise(F.concat(F.lit("R"), k % 4)).alias("reason"), F.when(k % 6 == 0, "header").otherwise("item").alias("kind"), (k / 1000.0).alias("cost"), k.alias("latency_ms"), "n_calls")
    calls = t.select("run", ((F.col("run") == "r1") & (F.col("n") % 7 == 0)).alias("cache_hit"), (F.col("turn") % 5 == 4).alias("retry"), (F.col("n") / 1000.0).alias("cost"), (F.col("n") % 10).alias("cache_read"), F.lit(0).alias("cache_write"))
    runs = t.select("run").distinct().withColumn("adapter", F.when(F.col("run") == "r2", "replay").otherwise("http"))
    r = runlog.run_report(lines, calls, runs)
    shown = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return r.select("run", "mode", "lines", "routed", "calls", "retries", "cache_hits", F.col("cache_read").cast("long").alias("cache_read"), shown("decisions").alias("decisions"), shown("reasons").alias("reasons"), F.round("spend", 4).alias("spend"), F.round("cost_per_100", 4).alias("cost_per_100"), "p50_ms", "p95_ms", "exit_code")

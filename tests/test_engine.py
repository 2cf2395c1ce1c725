"""Operators on small tables, sources and sinks, the stream, and every query against its oracle on the smallest data."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from taxolith.functions import attributes, stats, text
from taxolith.operators import decide, runlog, sample, score, select, structure, taxonomy, votes
from taxolith.plans import catalog as queries
from taxolith.sources import delimited, records
from taxolith.streaming import files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_oracle(spark, oracle, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    key = lambda r: tuple(str(round(x, 6) if isinstance(x, float) else x) for x in r)
    got = sorted(key(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    if name in queries.ORACLES:
        wanted = oracle.execute("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({queries.ORACLES[name]})").fetchall()
        assert got == sorted(map(key, wanted))
    else:
        assert got


def values(spark, expression, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    return [r.v for r in df.select(expression(F.col("x")).alias("v")).collect()]


def test_normalize(spark):
    assert values(spark, text.normalize, "ＡＢ  Straße ⌀ 1,5,7 ", None, "ﬁ x") == ["ab strasse ø 1.5.7", None, "fi x"]
    once = values(spark, text.normalize, "Ø 3,4")[0]
    assert values(spark, text.normalize, once) == [once]


def test_codes_and_evidence(spark):
    assert values(spark, text.code_segments, "01.A-00 3") == [["1", "a", "0", "3"]]
    df = spark.createDataFrame([("red pipe", "a pipe, red"), ("", "x"), ("blue", "a red pipe")], "e string, h string")
    assert [r.v for r in df.select(text.evidence_in(F.col("e"), F.col("h")).alias("v")).collect()] == [True, False, False]
    assert values(spark, text.parsed_number, "1.5", "x", "NaN", "inf") == [1.5, None, None, None]


def test_attributes(spark):
    rows = values(spark, attributes.extract, "c30/37 xc4/xa1 cem ii/a dn 160 250 g/m2 0/31.5", "c25/30 c30/37 cem ii/a cem ii/b", "30% rap warm mix", "17 05 04 other than 17 05 03", "ø 12.5", "10% ra 20% ra virgin", "hot and warm")
    assert rows[0].strength_class == ["30,37"] and rows[0].exposure_classes == ["xa1", "xc4"] and rows[0].cement_type == ["ii", "a"]
    assert rows[0].diameter_mm == ["160"] and rows[0].areal_mass == ["250"] and rows[0].grading == ["0/31.5"] and rows[0].ambiguous == []
    assert rows[1].strength_class == [] and rows[1].cement_type == ["ii"] and rows[1].ambiguous == ["strength_class"]
    assert rows[2].recycled_pct == ["30"] and rows[2].process == ["WMA"] and rows[3].waste_code == ["170504"]
    assert rows[4].diameter_mm == [] and rows[4].ambiguous == ["diameter_mm"] and rows[5].recycled_pct == [] and rows[6].process == []
    df = spark.createDataFrame([("dn 100", "dn 100"), ("dn 100", "dn 200"), ("x", "dn 1"), ("xc1 xc2", "xc1"), ("cem ii", "cem ii/a")], "a string, b string")
    assert [r.v for r in df.select(attributes.compare(attributes.extract(F.col("a")), attributes.extract(F.col("b"))).alias("v")).collect()] == ["agree", "conflict", "no_evidence", "conflict", "agree"]


def test_exact_statistics():
    for k, n in ((88, 89), (79, 80), (92, 94), (0, 5), (5, 5), (3, 10)):
        low = stats.cp_lower(k, n, 0.05)
        tail = sum(math.comb(n, i) * low**i * (1 - low) ** (n - i) for i in range(k, n + 1))
        assert (k == 0 and low == 0) or abs(tail - 0.05) < 1e-9
    # bounds that were published to three digits
    assert [round(stats.cp_lower(k, n, 0.05), 3) for k, n in ((88, 89), (79, 80), (92, 94))] == [0.948, 0.942, 0.935]
    assert abs(stats.upper_tail(8, 10, 0.5) - 56 / 1024) < 1e-12 and stats.upper_tail(0, 3, 0.5) == 1
    assert 0.98 < stats.cp_lower(990_000_000, 1_000_000_000, 0.05) < 0.99


def test_taxonomy(spark):
    rows = [("b", "u", ""), ("b", "u", "s1"), ("a", "u", "S1"), ("a", "v", "s1"), ("a", "v", "s2"), ("a", "v", "s2")]
    coded = taxonomy.assign_codes(spark.createDataFrame(rows, "type string, usage string, subtype string"))
    codes = {(r.type, r.usage, r.subtype): r.code for r in coded.collect()}
    assert codes["a", "u", "S1"] == "T01.U01.S01" and codes["b", "u", ""] == "T02.U01.S00" and codes["a", "v", "s2"] == "T01.U02.S02" and len(codes) == 5
    flags = {r.code: (r.sole_child, r.generic_parent) for r in taxonomy.structure(coded).collect()}
    assert flags["T02.U01.S00"] == (False, True) and flags["T01.U01.S01"] == (True, False)
    assert [r.codes for r in taxonomy.confusable(coded).collect()] == [["T01.U01.S01", "T01.U02.S01"]]


def test_structure(spark):
    rows = [(1, "1", "Works", "", ""), (2, "1.1", "Earth", "", ""), (3, "1.1.1", "dig", "m3", "2"), (4, "", "", "", ""), (5, "", "note", "", ""), (6, "1.2", "Pipes", "", ""), (7, "1.2.1", "lay", "m", "1"), (8, "2", "Other", "", ""), (9, "2.1", "x", "m", "")]
    lines = spark.createDataFrame([("f", *r) for r in rows], "file string, position int, code string, text string, unit string, qty string")
    kinds = structure.classified(lines)
    assert [r.kind for r in kinds.orderBy("position").collect()] == ["header", "header", "item", "empty_row", "header_unconfirmed", "header", "item", "header", "item"]
    paths = {r.position: r.p for r in structure.section_paths(kinds).select("position", text.path_text(F.col("path")).alias("p")).collect()}
    assert paths[3] == "1 Works > 1.1 Earth" and paths[7] == "1 Works > 1.2 Pipes" and paths[9] == "2 Other" and paths[1] == "" and paths[5] == ""


def test_section_paths_equal_a_stack(spark):
    import random

    rnd = random.Random(3)
    rows = []
    for f in range(12):
        for p in range(30):
            code = ".".join(str(rnd.randint(1, 2)) for _ in range(rnd.randint(1, 4)))
            rows.append((str(f), p, code, "t", rnd.choice(["header", "item"])))
    expect, stack, last = {}, [], None
    for f, p, code, _, kind in rows:
        if f != last:
            stack, last = [], f
        seg = code.split(".")
        inside = lambda h: len(h) < len(seg) and seg[: len(h)] == h  # noqa: E731,B023
        expect[f, p] = [".".join(h) for h in stack if inside(h)]
        if kind == "header":
            stack = [h for h in stack if inside(h)] + [seg]
    df = spark.createDataFrame(rows, "file string, position int, code string, text string, kind string")
    got = {(r.file, r.position): [h.item_no for h in r.path] for r in structure.section_paths(df).collect()}
    assert got == expect


def test_votes(spark):
    v = spark.createDataFrame([(1, 0, "a", 80), (1, 1, "b", 90), (2, 0, "a", 70), (2, 1, "b", 60), (2, 2, "b", 95)], "line int, pass_no int, code string, confidence int")
    got = {r.line: (r.leader, r.votes, r.tie, r.weakest) for r in votes.tally(v).collect()}
    assert got == {1: ("a", 1, True, 80), 2: ("b", 2, False, 60)}
    marked = v.withColumn("conflict", F.col("code") == "b")
    assert {r.line: r.leader for r in votes.tally(votes.without_conflicts(marked)).collect()} == {1: "a", 2: "a"}


def test_thresholds_nest(spark):
    t = decide.thresholds(spark, 2).orderBy("ord").collect()
    points = [(r.min_v, r.min_b, r.min_bucket) for r in t]
    assert [r.threshold for r in t] == [f"T{i}" for i in range(1, 9)] and points == sorted(points, reverse=True)


def test_selection_falls_back(spark):
    t = spark.createDataFrame([("T1", 1, "en", 50, 49, 0.9), ("T2", 2, "en", 60, 58, 0.91), ("T3", 3, "en", 90, 60, 0.6)], "threshold string, ord int, lang string, matched long, correct long, bound double")
    assert select.selected(t, 0.95).first().threshold == "T2" and select.selected(t, 0.95, slack=20).first().threshold == "T1"
    assert tuple(select.selected(t, 0.999).first())[:3] == ("T2", 2, "fallback")


def test_joins_and_log(spark):
    a = spark.createDataFrame([("k", 1), ("k", 2), ("m", 3)], "key string, position int")
    b = spark.createDataFrame([("k", 1, "x"), ("n", 2, "y")], "key string, position int, v string")
    assert sorted((r.key, r.occ, r.status) for r in score.joined_by_key(a, b, "key", "position").collect()) == [("k", 0, "paired"), ("k", 1, "missing"), ("m", 0, "missing"), ("n", 0, "unscored")]
    calls = spark.createDataFrame([("c1", 1, ["a", "b"], 1.0, 5), ("c2", 2, ["a"], 3.0, 2)], "call_id string, ord int, line_ids array<string>, cost double, latency_ms int")
    assert {r.line_id: (r.cost, r.latency_ms, r.call_ids) for r in runlog.attributed(calls).collect()} == {"a": (3.5, 4, ["c1", "c2"]), "b": (0.5, 2, ["c1"])}
    problems = score.key_problems(spark.createDataFrame([("a",), ("a",), ("",), (None,)], "k string"), "k").first()
    assert tuple(problems) == (1, 2)


def test_allocation_sums_up(spark):
    p = spark.createDataFrame([("a", 10), ("b", 11), ("c", 12)], "s string, population long")
    assert {r.s: r.n for r in sample.allocation(p, "s", 10).collect()} == {"a": 3, "b": 3, "c": 4}


def test_delimited_round_trip(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_bytes("﻿Pos;n° Article ;DÉSIGNATION;Description longue;Unité; QUANTITÉ \r\n1;;x;\"a;b\r\nc\";m;2\r\n\r\n2;;y\r\n\r\n".encode())
    (folder / "b.csv").write_bytes("Item No.,Short,Long,Unit,Qty,\n7,caf\xe9,l,m,1,\n".encode("cp1252"))
    lines = delimited.read_lines(spark, str(folder)).orderBy("file", "position").collect()
    assert [(r.position, r.short, r.long, r.unit, r.qty) for r in lines] == [(1, "x", "a;b\r\nc", "m", "2"), (2, "", "", "", ""), (3, "y", "", "", ""), (1, "café", "l", "m", "1")]
    assert {r.encoding for r in delimited.read_raw(spark, str(folder)).select("encoding").distinct().collect()} == {"utf-8", "cp1252"}
    with pytest.raises(ValueError, match="missing"):
        delimited.column_map(["Item No", "Short", "Long", "Unit"])
    df = spark.createDataFrame([(2, "b", 'say "x"'), (1, "a", "1,2"), (3, None, "c\nd")], "position int, x string, y string")
    delimited.write_csv(df, str(tmp_path / "out"), "position", 2)
    parts = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert parts == b'x,y\r\na,"1,2"\r\nb,"say ""x"""\r\n,"c\nd"\r\n'


def test_records(spark, tmp_path):
    calls = spark.createDataFrame([("c1", 1, "h", 200, None), ("c2", 2, "h", 500, "x")], "call_id string, ord long, request_hash string, status int, error string")
    records.append_calls(calls, str(tmp_path / "calls"))
    got = records.read_calls(spark, str(tmp_path / "calls"))
    assert {r.call_id: r.occ for r in records.recorded_run(got).collect()} == {"c1": 0, "c2": 1}
    assert [r.call_id for r in records.cacheable(got).collect()] == ["c1"]


def test_stream_of_files(spark, tmp_path):
    spark.range(10).selectExpr("id as line").write.parquet(str(tmp_path / "in"))
    q = files.decide_files(spark, str(tmp_path / "in"), "line long", str(tmp_path / "out"), str(tmp_path / "state"), lambda df: df.withColumn("decision", F.lit("x")))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert files.windowed_counts(events, "ts", "event_type").agg(F.sum("n")).first()[0] == events.count()


def test_plans_have_no_cartesian_product(spark):
    for name in ("compare_attributes", "occurrence_join", "tfidf_top1", "section_paths", "cache_lookup"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan


def test_levels_and_calls(spark):
    from taxolith.operators import levels, runlog

    rows = spark.createDataFrame([("a", "t", "u", "s ", "t", "u", "s"), ("a", "t", "x", "s", "t", "u", "s"), ("a", "", "u", "s", "", "u", "s"), ("b", "q", "u", "s", "t", "u", "s")], "k string, p1 string, p2 string, p3 string, r1 string, r2 string, r3 string")
    got = {r.k: r for r in levels.accuracy(rows, ["k"], ["p1", "p2", "p3"], ["r1", "r2", "r3"]).collect()}
    assert (got["a"].at_type, got["a"].at_usage, got["a"].at_subtype, got["a"].at_lenient, got["a"].usage_given_type) == pytest.approx((2 / 3, 1 / 3, 0, 1 / 3, 1 / 2))
    assert got["b"].at_type == 0 and got["b"].usage_given_type is None
    calls = spark.createDataFrame([("timeout", False, None, None, True), ("api_error", False, 404, None, False), ("api_error", False, 404, True, True), ("api_error", False, 409, None, True), ("refusal", False, 500, True, False), ("timeout", True, None, None, False), ("api_error", False, None, None, True)], "status string, miss boolean, http int, should boolean, expect boolean")
    for r in calls.select("expect", runlog.retryable(F.col("status"), F.col("miss"), F.col("http"), F.col("should")).alias("got")).collect():
        assert r.got == r.expect

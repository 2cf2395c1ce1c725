"""Structure, retries, requests, answers, runs and scores against plain Python on small tables."""

import collections
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from taxolith.functions import attributes, canonical
from taxolith.operators import answers, enrich, evaluate, retries, scopes, select, structure
from taxolith.sources import runs, tables

ROWS = "file string, position int, code string, text string, long string, unit string, qty string"


# --- structure ------------------------------------------------------------------------------------------------------


def segments(code):
    parts = [p for p in code.replace("-", ".").replace(" ", ".").split(".") if p]
    return tuple(str(int(p)) if p.isdigit() else p.lower() for p in parts)


def stacked(rows, kinds):
    """Paths of one file with codes, by a stack."""
    stack, paths = [], []
    for (_, _, code, text, *_), kind in zip(rows, kinds, strict=True):
        own = segments(code)
        stack_now = [h for h in stack if len(h[0]) < len(own) and own[: len(h[0])] == h[0]]
        paths.append([(h[1], h[2]) for h in stack_now])
        if kind == "header":
            stack = [*stack_now, (own, code, text)]
    return paths


def test_coded_paths_against_a_stack(spark):
    rnd = random.Random(2)
    rows = []
    for file in "abcdef":
        for k in range(60):
            code = ".".join(str(rnd.randint(1, 2)) for _ in range(rnd.randint(0, 4)))
            item = rnd.random() < 0.3
            rows.append((file, k, code, rnd.choice(["t", "u", ""]), "", "m" if item else "", "1" if item else ""))
    got = structure.classified(spark.createDataFrame(rows, ROWS)).persist()
    kinds = {(r.file, r.position): r.kind for r in got.collect()}
    paths = {(r.file, r.position): [(h.item_no, h.text) for h in r.path] for r in structure.section_paths(got).collect()}
    assert len(paths) == len(rows) and any(paths.values())
    for file in "abcdef":
        own = [r for r in rows if r[0] == file]
        assert [paths[file, r[1]] for r in own] == stacked(own, [kinds[file, r[1]] for r in own])


def codeless(rows, kinds):
    """Flags and paths of one file without codes: the last titles, level by level."""
    last = max((i for i, k in enumerate(kinds) if k != "empty_row"), default=-1)
    context = [k == "header_unconfirmed" and bool(r[3].strip()) and not r[4].strip() and i < last for i, (r, k) in enumerate(zip(rows, kinds, strict=True))]
    runs_, open_ = {}, None
    for i, kind in enumerate(kinds):
        if kind == "empty_row":
            continue
        if context[i]:
            open_ = i if open_ is None else open_
            runs_[open_] = runs_.get(open_, 0) + 1
        else:
            open_ = None
    depth, stack, paths = max(runs_.values(), default=0), [], []
    for i, kind in enumerate(kinds):
        if i in runs_:
            del stack[depth - runs_[i] :]
        paths.append([] if kind == "empty_row" else list(stack))
        if context[i]:
            stack.append((rows[i][2], rows[i][3]))
    return context, paths


def test_codeless_paths_against_a_stack(spark):
    rnd = random.Random(3)
    rows = []
    for file in range(30):
        for k in range(rnd.randint(1, 25)):
            kind = rnd.choice(["item", "title", "title", "long", "empty"])
            rows.append((f"f{file}", k, "", "" if kind == "empty" else f"t{k}", "x" if kind == "long" else "", "m" if kind == "item" else "", ""))
    classified = structure.classified(spark.createDataFrame(rows, ROWS))
    got = {(r.file, r.position): r for r in structure.codeless_paths(classified).collect()}
    for file in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == file]
        context, paths = codeless(own, [got[file, r[1]].kind for r in own])
        assert [got[file, r[1]].is_context for r in own] == context
        assert [[(h.item_no, h.text) for h in got[file, r[1]].path] for r in own] == paths
    assert structure.codeless_paths(classified.limit(0)).count() == 0


def test_caps(spark):
    rows = spark.createDataFrame([("c" * 65, "t" * 1000, "l" * 4001), ("c", None, "")], "code string, text string, long string")
    assert [r.o for r in rows.select(structure.oversized().alias("o")).collect()] == [["code", "long"], []]
    assert [(r.code and len(r.code), r.truncated) for r in structure.capped(rows).collect()] == [(64, True), (1, False)]


# --- retries --------------------------------------------------------------------------------------------------------


def queued(batches, log, limit):
    """The same by a queue of tasks."""
    state = {x: dict(calls=0, conflicts=0, last=None) for b in batches.values() for x in b}
    done, queue = {}, collections.deque((b, name) for name, b in batches.items())

    def end(lines, outcome, task):
        done.update({x: (task, state[x]["calls"], state[x]["conflicts"], outcome) for x in lines})

    def again(lines, kind, task):
        for x in lines:
            state[x]["last"] = kind
        if lines:
            queue.append((lines, task))

    while queue:
        lines, task = queue.popleft()
        if any(state[x]["calls"] >= limit for x in lines):
            for x in lines:
                end([x], state[x]["last"] or "api_error", task)
            continue
        for x in lines:
            state[x]["calls"] += 1
        kinds = {x: log.get((x, state[x]["calls"]), "ok") for x in lines}
        whole = sorted(k for k in kinds.values() if k not in ("missing", "conflict", "invalid", "ok"))
        if whole and whole[0] in ("truncated", "malformed"):
            if len(lines) == 1:
                end(lines, whole[0], task)
            else:
                middle = len(lines) // 2
                again(lines[:middle], whole[0], task + ".0")
                again(lines[middle:], whole[0], task + ".1")
            continue
        if whole:
            end(lines, whole[0], task)
            continue
        missing, conflict = [x for x in lines if kinds[x] == "missing"], []
        for x in lines:
            if kinds[x] in ("ok", "invalid"):
                end([x], "answered" if kinds[x] == "ok" else "malformed", task)
            elif kinds[x] == "conflict":
                state[x]["conflicts"] += 1
                if state[x]["conflicts"] > 1:
                    end([x], "duplicate_conflict", task)
                else:
                    conflict.append(x)
        again(missing, "missing_item", task + ".m")
        again(conflict, "duplicate_conflict", task + ".c")
    return done


def test_retries_against_a_queue(spark):
    rnd = random.Random(8)
    batches = {f"b{i}": [f"b{i}x{k}" for k in range(rnd.randint(1, 9))] for i in range(40)}
    log = {(x, c): rnd.choice(["missing", "conflict", "invalid", "truncated", "malformed", "refusal", "timeout"]) for b in batches.values() for x in b for c in range(1, 6) if rnd.random() < 0.15}
    log |= {("b0x0", c): "malformed" for c in range(1, 9)} | {("b1x0", c): "missing" for c in range(1, 9)}
    lines = spark.createDataFrame([(b, x) for b, v in batches.items() for x in v], "batch string, line string")
    recorded = spark.createDataFrame([(x.split("x")[0], x, c, k) for (x, c), k in log.items()], "batch string, line string, call int, kind string")
    got = retries.settled(retries.first_tasks(lines, "batch", "line", "line"), retries.recorded(recorded), 4)
    assert {r.line: (r.task, r.calls, r.conflicts, r.outcome) for r in got.collect()} == queued(batches, log, 4)
    assert retries.settled(retries.first_tasks(lines.limit(0), "batch", "line", "line"), retries.recorded(recorded)).count() == 0


# --- requests and answers -------------------------------------------------------------------------------------------


def test_canonical_json(spark):
    dumps = lambda v: json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    kind = "z int, a string, m map<string,array<double>>, s struct<y:boolean,b:array<struct<k:string,a:bigint>>>, d double"
    values = [
        {"z": 1, "a": 'q"\\\n\t\r\b\f\x01\x1f\x7f é日👍 / <', "m": {"b": [1.0, 0.1], "a": [], "é": None}, "s": {"y": True, "b": [{"k": None, "a": -1}, None]}, "d": 1e16},
        {"z": None, "a": None, "m": None, "s": None, "d": None}, {"z": -5, "a": "", "m": {}, "s": {"y": None, "b": []}, "d": -0.0},
    ]
    values += [{"z": 0, "a": "x", "m": {}, "s": None, "d": d} for d in (1e-5, 1e-4, 123456.75, 1e22, 1.5e300, 0.30000000000000004, 5e-324, 2.0**-44, 100.0, 1e15, 9.999e15)]
    df = spark.createDataFrame([(v,) for v in values], f"v struct<{kind.replace(' ', ':').replace(',:', ',')}>")
    assert [r.t for r in df.select(canonical.canonical(df, "v").alias("t")).collect()] == [dumps(v) for v in values]
    with pytest.raises(TypeError):
        canonical.canonical(spark.sql("SELECT current_date() AS d"), "d")


def test_request_hash(spark):
    import hashlib

    one = ("m", [("t", True)], '{"b": 1, "a": [2.50]}', 0.5, 10, "p")
    df = spark.createDataFrame([one, (*one[:2], '{"a":[2.5],"b":1}', *one[3:]), (*one[:5], "q")], "model string, system_blocks array<struct<text:string,cache:boolean>>, schema_json string, temperature double, max_tokens int, user_payload string")
    a, b, c = (r.h for r in df.select(canonical.request_hash(df).alias("h")).collect())
    want = {"model": "m", "system_blocks": [{"text": "t", "cache": True}], "schema": {"a": [2.5], "b": 1}, "temperature": 0.5, "max_tokens": 10, "user_payload": "p"}
    assert a == b == hashlib.sha256(json.dumps(want, sort_keys=True, separators=(",", ":")).encode()).hexdigest() != c
    with pytest.raises(Exception, match="no JSON object"):
        df.withColumn("schema_json", F.lit("[1]")).select(canonical.request_hash(df)).collect()


def line(**change):
    return {"id": "L1", "evidence": "a b", "element_or_application": "", "material_family": "", "kind": "Material", "nm_category": "", "top1": "T", "top2": "", "confidence": 90, "self_reported_candidate_gap": "clear"} | change


def test_strict_answers(spark):
    good = json.dumps(line(), indent=2)
    rest = [line(confidence="90"), line(confidence=90.0), line(confidence=True), line(confidence=101), line(more=1), line(kind="thing"), line(evidence="w " * 26), line(id=3), 7, [1, {"lines": []}], "a,]\"}"]
    parts = [good, *map(json.dumps, rest)]
    text = '{"lines" : [1, 2], "lines":[ ' + " ,\n".join(parts) + " ]\n}"
    assert answers.slices(text) == parts and answers.slices('{"lines": [ ]}') == [] and answers.slices('{"a":[{"lines":[1]}],"lines":[[2,3],4]}') == ["[2,3]", "4"]
    entries = answers.validated(text)
    assert [e["problem"] for e in entries] == [None, *["type:confidence"] * 3, "range:confidence", "fields", "value:kind", "length:evidence", "type:id", *["not_an_object"] * 3]
    assert entries[0]["kind"] == "material" and entries[0]["raw"] == good and [e["id"] for e in entries[1:9]] == [*["L1"] * 7, None]
    df = spark.createDataFrame([(1, text), (2, '{"lines": [1'), (3, '{"lines": [], "x": 1}'), (4, "[]"), (5, None), (6, '{"lines":[]}'), (7, '{"lines": {}}')], "batch int, raw string")
    got = {r.batch: r.entries for r in answers.validated_lines(df).collect()}
    assert [got[k] is None for k in range(1, 8)] == [False, True, True, True, True, False, True] and got[6] == [] and got[1][0].confidence == 90
    known = answers.by_known_id(answers.validated_lines(df), spark.createDataFrame([(1, "L1"), (2, "L1"), (1, "L2")], "batch int, id string"))
    assert known.count() == 8
    status = spark.createDataFrame([(["stop"], '{"a":1}'), (None, "[1]"), (["length"], "x"), (["refusal", "length"], "{}")], "r array<string>, t string")
    assert [r.s for r in status.select(answers.content_status(F.col("r"), F.col("t")).alias("s")).collect()] == ["ok", "malformed", "truncated", "refusal"]


# --- evaluation -----------------------------------------------------------------------------------------------------


def test_rows_left_open_against_all_pairs(spark):
    rnd = random.Random(6)
    parts = ["", "dn 10", "dn 20", "warm", "hot", "xc1", "xc1 xd2", "cem ii", "cem ii/a", "cem iii", "17 05", "17 05 03", "c25/30", "30% rap"]
    texts = lambda n: [(i, " ".join(rnd.sample(parts, 3))) for i in range(n)]
    make = lambda rows: spark.createDataFrame(rows, "i int, t string").select("i", attributes.extract(F.col("t")).alias("a"))
    lines, library = make(texts(60)), make(texts(80))
    sig = lambda df: df.select(evaluate.signature(F.col("a")).alias("sig"))
    counts = evaluate.left_open(sig(lines), sig(library))
    got = {r.i: r.open for r in lines.select("i", evaluate.signature(F.col("a")).alias("sig")).join(counts, "sig").collect()}
    pairs = lines.withColumnsRenamed({"a": "l"}).crossJoin(library.select(F.col("a").alias("r")))
    want = {r.i: r.n for r in pairs.groupBy("i").agg(F.count_if(attributes.compare(F.col("l"), F.col("r")) != "conflict").alias("n")).collect()}
    assert got == want and len(set(want.values())) > 3
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan
    none = evaluate.left_open(sig(lines), sig(library.limit(0))).collect()
    assert {r.open for r in none} == {0}


def test_scorer(spark):
    three = "struct<type:string,usage:string,subtype:string>"
    t, blank = ("a", "b", "c"), ("", "", "")
    rows = [("matched", "L", t, t), ("matched", "L", ("a", "b", " c "), t), ("matched", "E", t, blank), ("needs_review", "L", blank, t), ("not_a_material", "L", blank, t), (None, "L", None, t), ("what", "H", blank, blank), ("matched", "L", ("a", "x", "c"), t)]
    pairs = spark.createDataFrame(rows, f"decision string, class string, out {three}, ref {three}").withColumn("side", F.when(F.col("class") == "L", "dev"))
    out = scopes.score_output(pairs, [[], ["side"]])
    r = out.where("side IS NULL AND counts.rows = 8").first()
    assert (r.precision.correct, r.precision.matched, r.coverage_labelled.denominator, r.coverage_material.denominator) == (1, 4, 6, 7)
    assert r.whitespace_only == 1 and r.false_skips == 1 and r.counts.missing == 1 and r.all_rows.invalid == 1 and r.item_rows.denominator == 7
    assert r.levels_matched.type == 0.75 and r.levels_matched.usage == 0.5 and r.lenient.precision == 0.5 and r.review_load.lines == 7 and r.helped.numerator == 2
    assert r.hit_at_1.hits is None and r.hit_at_1.denominator == 1 and r.skips_with_unit is None and r.mean_cost is None and r.levels_labelled.source == "decision"
    with_more = pairs.withColumn("suggested", F.col("ref")).withColumn("suggested_2", F.col("ref")).withColumn("unit", F.lit("m")).withColumn("cost", F.lit(2.0))
    r = scopes.score_output(with_more, [[]], has_classes=False).first()
    assert r.hit_at_1.hits == 1 and r.hit_at_2.value == 1 and r.skips_with_unit == 1 and r.mean_cost == 2 and r.coverage_material is None and r.levels_labelled.source == "suggested"
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Expand ") == 1
    assert scopes.score_output(pairs.limit(0), [["side"]]).count() == 0


def test_selection_is_refused(spark):
    def points(gone):
        return spark.createDataFrame([(f"T{o}", o, lang, None if (o, lang) in gone else 20 * o, None if (o, lang) in gone else (20 * o if o < 3 else 18 * o), 0.5) for o in (1, 2, 3) for lang in ("en", "fr")], "threshold string, ord int, lang string, matched int, correct int, bound double")

    labelled = spark.createDataFrame([("en", 100), ("fr", 100)], "lang string, n int")
    said = lambda gone: {r.scope: (r.threshold, r.refused) for r in select.checked_selection(points(gone), labelled, 0.95, target=0.5).collect()}
    assert said(()) == {"all": ("T2", None), "lang:en": ("T2", None), "lang:fr": ("T2", None), "target": ("T3", None)}
    assert said({(1, "en")})["all"] == ("T2", None)  # 40 + 20 at most, 77 would do
    assert said({(1, "en"), (1, "fr")})["all"] == ("T2", "a ceiling reaches the window")
    assert said({(3, "en")})["all"] == ("T2", "looser than the loosest that qualifies")
    assert said({(2, "en")})["all"] == ("T1", "no measured threshold meets the bar")
    assert said({(o, "en") for o in (1, 2, 3)}) == {"all": (None, "nothing is measured")}


# --- runs -----------------------------------------------------------------------------------------------------------


def test_runs(spark):
    root = tables.folder(spark, "runs")
    lines = spark.createDataFrame([(str(i), f"C{i}", "matched", "P1" if i % 2 else "", [f'{{"n":{i}}}', "text"]) for i in range(200)], "line_id string, item_no string, decision string, top1 string, raw array<string>")
    calls = spark.createDataFrame([(str(i % 200), i, f"c{i}", f"h{i % 7}", f"r{i}", i % 5 == 0, "p1", "m1", 3) for i in range(600)], "line_id string, ord long, call_id string, request_hash string, response string, cache_hit boolean, response_provider string, response_model string, latency_ms long")
    sort = {"lines": "line_id", "calls": "line_id"}
    first = runs.write_run(root, "a", {"lines": lines, "calls": calls}, "live", "p1", "m1", sort)
    again = runs.write_run(root, "b", {"lines": lines.orderBy(F.desc("line_id")), "calls": calls}, "replay", "p1", "m1")
    other = runs.write_run(root, "c", {"lines": lines.withColumn("decision", F.when(F.col("line_id") == "7", "x").otherwise(F.col("decision"))), "calls": calls.limit(0)}, "live", "p1", "m2")
    assert first == again and first["lines"] != other["lines"] and first["lines"][0] == 200 and other["calls"] == (0, "0")
    assert {r.run: r.same for r in runs.replay_verdicts(spark, root, "lines", "a").collect()} == {"a": True, "b": True, "c": False}
    assert runs.manifest_problems(spark, root, "lines", lines.schema).count() == 0
    with pytest.raises(FileExistsError):
        runs.write_run(root, "a", {"lines": lines}, "live", "p1", "m1")
    with pytest.raises(ValueError):
        runs.write_run(root, "a/b", {"lines": lines}, "live", "p1", "m1")
    lines.limit(3).write.mode("append").parquet(f"{root}/lines/run=b")
    assert [tuple(r) for r in runs.manifest_problems(spark, root, "lines", lines.schema).collect()] == [("b", "rows")]
    of = lambda run: runs.part(spark, root, "lines", lines.schema).where(F.col("run") == run)
    assert [tuple(r) for r in runs.changed_cells(of("a"), of("c").where("line_id <> '9'"), "line_id", ["decision", "top1", "raw"]).orderBy("line_id").collect()] == [("7", "decision", "matched", "x"), ("9", "row", "there", None)]
    cache = runs.load_cache(spark, root, "p1", "m1", calls.schema)
    served = [r for r in cache.collect() if r.request_hash == "h3"]
    assert sorted((r.occ, r.response) for r in served) == list(enumerate(f"r{i}" for i in range(600) if i % 7 == 3 and i % 5)) and {r.source for r in served} == {"a"}
    assert "dynamicpruning" in cache._jdf.queryExecution().toString()
    library = spark.createDataFrame([("P1", "pipe")], "code string, name string")
    one = runs.explain_item(spark, root, "a", "C7", lines.schema, calls.schema, library)
    row = one.first()
    assert row.row.name == "pipe" and [c.ord for c in row.calls] == [7, 207, 407] and [(p["pass"], p.body is not None) for p in row.passes] == [(1, True), (2, False)]
    plan = one._jdf.queryExecution().toString()
    assert plan.count("EqualTo(line_id,7)") >= 2 and "PartitionFilters: [isnotnull(run" in plan
    with pytest.raises(LookupError):
        runs.explain_item(spark, root, "a", "nothing", lines.schema, calls.schema, library)


def test_enriched_tree(spark):
    from taxolith.operators import taxonomy

    coded = taxonomy.assign_codes(spark.createDataFrame([("A", "u", "x"), ("A", "u", ""), ("B", "v", "y")], "type string, usage string, subtype string"))
    also = spark.createDataFrame([("A", None, None, ["alpha", "a"]), ("A", "u", "x", ["ex"])], "type string, usage string, subtype string, also array<string>")
    docs = {r.type_code: r.document for r in enrich.enriched_tree(coded, also).collect()}
    assert docs["T01"] == "T01 A [also: alpha; a]\n  T01.U01 u\n    T01.U01.S00\n    T01.U01.S01 x [also: ex]" and docs["T02"].startswith("T02 B\n")
    back = {r.type_code: r.document for r in enrich.enriched_tree(coded, also, reverse=True).collect()}
    assert back["T01"].split("\n")[2:] == ["    T01.U01.S01 x [also: ex]", "    T01.U01.S00"]
    from taxolith.operators import requests

    lines = spark.createDataFrame([(1, 1, "L1", "A", "<b>"), (1, 2, "L2", "A", None), (2, 3, "L3", "B", "")], "batch int, position int, id string, type string, long string")
    lines = lines.select("*", *[F.lit("").alias(c) for c in ("path", "short", "unit")])
    user = {r.batch: r.payload for r in requests.user_payload(lines).collect()}
    assert json.loads(user[1].removeprefix("<boq_lines>\n").removesuffix("\n</boq_lines>"))["lines"][0] == {"id": "L1", "long": "<b>", "path": "", "short": "", "unit": ""} and user[1].count("<") == 2
    with pytest.raises(Exception, match="twice in batch 1"):
        requests.user_payload(lines.unionByName(lines.limit(1))).collect()
    payload = {(r.batch, r.type): r.payload for r in requests.verifier_payload(lines, coded).collect()}
    assert "<" not in payload[1, "A"] and json.loads(payload[1, "A"])["lines"][0]["long"] == "<b>" and [c["code"] for c in json.loads(payload[1, "A"])["candidates"]] == ["T01.U01.S00", "T01.U01.S01"]
    assert list(itertools.chain(payload)) == [(1, "A"), (2, "B")] or len(payload) == 2


# --- reader, outputs and votes --------------------------------------------------------------------------------------


def test_read_boq(spark, tmp_path):
    from taxolith.sources import delimited

    (tmp_path / "a.csv").write_bytes("Item No.,Short Description,Long Description,Unit,BoQ Qty,Note\r\n1,Roads,,,,n\r\n1.1,\"Kerb, grey\",laid,m,5,\r\n,,,,,\r\n2.1,Wall,,m,2\r\n\r\n".encode())
    (tmp_path / "b.csv").write_bytes("N°;Désignation;Descriptif;Unité;Qté\nx;y;z;m;1".replace("x;y;z;m;1", ";Lot 1;;;\n;Béton " + "é" * 1000 + ";;m;3\n;Fin;;;").encode("cp1252"))
    rows = delimited.read_boq(spark, str(tmp_path)).orderBy("file", "position").collect()
    a, b = [r for r in rows if r.file.endswith("a.csv")], [r for r in rows if r.file.endswith("b.csv")]
    assert [r.kind for r in a] == ["header", "item", "empty_row", "item"] and [[h.text for h in r.path] for r in a] == [[], ["Roads"], [], []]
    assert a[0].extra == {"Note": "n"} and a[3].raw_row == ["2.1", "Wall", "", "m", "2", ""] and a[1].short == "Kerb, grey"
    assert [r.kind for r in b] == ["header_unconfirmed", "item", "header_unconfirmed"] and [[h.text for h in r.path] for r in b] == [[], ["Lot 1"], ["Lot 1"]]
    assert b[1].oversized == ["short"] and a[1].oversized == [] and b[0].encoding == "cp1252" and len({r.line_id for r in rows}) == len(rows)
    (tmp_path / "c.csv").write_bytes(b"Item No.,Short,Long,Unit,Qty\n1,a,b,m,1,extra\n")
    with pytest.raises(Exception, match="more cells"):
        delimited.read_boq(spark, str(tmp_path)).collect()


def test_votes_read(spark):
    from taxolith.operators import review

    rnd = random.Random(9)
    rows = [(line, p, rnd.random() > 0.05, rnd.choice(["material", "material", "material", "non_material", "no_equivalent"]), rnd.choice("xyz"), rnd.choice(review.GAPS)) for line in range(300) for p in range(3 if line % 17 else 2)]
    want = {}
    for line, own in itertools.groupby(rows, key=lambda r: r[0]):
        own = list(own)
        kinds = collections.Counter(r[3] for r in own).most_common()
        if len(own) != 3 or not all(r[2] for r in own) or kinds[0][0] != "material" or len(kinds) > 1 and kinds[0][1] == kinds[1][1]:
            continue
        codes = collections.Counter(r[4] for r in own)
        leader = next(r[4] for r in own if codes[r[4]] == max(codes.values()))
        want[line] = (leader, codes[leader], min((r[5] for r in own if r[4] == leader), key=review.GAPS.index))
    answers_ = spark.createDataFrame(rows, "line int, pass_no int, valid boolean, kind string, top1 string, gap string")
    assert {r.line: (r.top1, r.votes, r.gap) for r in review.votes_read(answers_, 3).collect()} == want and want


def test_top1_against_all_pairs(spark):
    import math

    from taxolith.operators import similarity

    rnd = random.Random(12)
    words = ["béton", "armé", "concrete", "pipe", "grey", "wall", "Straße", "kerb", "an", "of", "tube", "dalle"]
    lines = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 6)))) for i in range(60)] + [(90, ""), (91, "zzz qqq"), (92, None)]
    library = [(i, " ".join(rnd.choices(words, k=4))) for i in range(40)]
    frame = lambda rows: spark.createDataFrame(rows, "id int, text string")
    got = {r.line: (r.row, r.score) for r in similarity.top1(frame(lines), frame(library), frame(lines + library)).collect()}

    def fold(t):
        import unicodedata

        return "".join(c for c in unicodedata.normalize("NFKD", t or "") if not unicodedata.combining(c)).lower()

    def grams(t):
        w = fold(t).split()
        out = collections.Counter()
        for x in w:
            p = f" {x} "
            for n in (3, 4, 5):
                out.update("c" + p[k : k + n] for k in range(len(p) - n + 1))
        w = [x for x in w if len(x) > 1]
        out.update("w" + x for x in w)
        out.update("w" + a + " " + b for a, b in itertools.pairwise(w))
        return out

    corpus = [grams(t) for _, t in lines + library]
    df = collections.Counter(g for c in corpus for g in c)

    def vector(t):
        v = {g: (1 + math.log(n)) * (math.log((1 + len(corpus)) / (1 + df[g])) + 1) for g, n in grams(t).items()}
        norm = {k: math.sqrt(2 * sum(x * x for g, x in v.items() if g[0] == k)) for k in "cw"}
        return {g: x / norm[g[0]] for g, x in v.items()}

    rows = {i: vector(t) for i, t in library}
    for i, t in lines:
        v = vector(t)
        best = max(((round(sum(x * r.get(g, 0) for g, x in v.items()), 9), -k) for k, r in rows.items()), default=(0, 0))
        assert (i in got) == (best[0] > 0) and (i not in got or (got[i][0] == -best[1] and abs(got[i][1] - best[0]) < 1e-8))


def test_numbers_within_groups(spark):
    from taxolith.operators import ranks

    rnd = random.Random(5)
    rows = [(rnd.choice(["big", "big", "big", "small", None]), rnd.choice([None, *range(40)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranks.numbered(df, ["g"], ["v", "i"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for g in ("big", "small", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: k for k, r in enumerate(own)}
    assert {r.i: r.number for r in got} == want
    values = {g: sorted(r[1] for r in rows if r[0] == g and r[1] is not None) for g in ("big", "small", None)}
    near = lambda v, p: v[max(-(-len(v) * p // 100), 1) - 1]
    assert {r.g: (r.a, r.b) for r in ranks.nearest_ranks(df, ["g"], "v", {"a": 50, "b": 95}).collect()} == {g: (near(v, 50), near(v, 95)) for g, v in values.items()}
    assert ranks.numbered(df.limit(0), ["g"], ["v"]).count() == 0


def test_bootstrap_band_against_rows(spark):
    """Resampled row by row: the share of rows of each cell decides, so bands agree up to the draw."""
    import numpy as np

    from taxolith.operators import sample

    items = [("a", i % 3 > 0, i % 7 > 1) for i in range(400)] + [("b", False, True)] * 5
    df = spark.createDataFrame(items, "g string, matched boolean, correct boolean")
    got = {r.g: r for r in sample.bootstrap_band(df, ["g"], 4000, 7).collect()}
    again = {r.g: r for r in sample.bootstrap_band(df.repartition(7), ["g"], 4000, 7).collect()}
    assert got == again and got["b"].resamples == 0 and got["b"].low is None
    m, c = (np.array([r[k] for r in items if r[0] == "a"]) for k in (1, 2))
    pick = np.random.default_rng(1).integers(0, len(m), (4000, len(m)))
    low, high = np.percentile((m & c)[pick].sum(1) / m[pick].sum(1), [2.5, 97.5])
    assert abs(got["a"].low - low) < 0.01 and abs(got["a"].high - high) < 0.01


# --- libraries and tables to be scored ------------------------------------------------------------------------------


def test_library_files(spark, tmp_path):
    from taxolith.sources import library

    def load(data, name="lib.csv", **limits):
        folder = tmp_path / str(abs(hash((data, name))))
        folder.mkdir(exist_ok=True)
        (folder / name).write_bytes(data.encode("utf-8-sig"))
        return library.load_library(spark, str(folder), **limits)

    head = "x;Material_Type; material_usage ;MATERIAL_SUBTYPE\n"
    found = load(head + '1;Pipe;Sewer;"a; b"\n\n2;Pipe;Sewer;\n3;Pipe;Sewer;"a; b"\n4;Éclat;U;z;;\n')
    rows = {r.code: (r.type, r.usage, r.subtype) for r in found.rows.collect()}
    assert found.repeated == 1 and not found.large and set(rows.values()) == {("Pipe", "Sewer", "a; b"), ("Pipe", "Sewer", ""), ("Éclat", "U", "z")} and rows["T01.U01.S00"] == ("Pipe", "Sewer", "")
    for data, said in (("", "no header"), ("material_type,material_usage\na,b\n", "no column"), ("material_type,material_usage,material_subtype,Material_Type\n", "more than one"), (head, "no rows"), (head + "1;a;b\n", "fields"), (head + "1;a;b;c;d\n", "fields"), (head + "1; ;b;c\n", "blank")):
        with pytest.raises(Exception, match=said):
            load(data)
    with pytest.raises(ValueError, match="tokens"):
        load(head + "1;a;b;c\n", most_tokens=5)
    assert load(head + "1;a;b;c\n", warn_tokens=5).large


def test_tables_to_be_scored(spark, tmp_path):
    from taxolith.sources import library

    assert library.resolved(["Item No", "Type", "usage"])["labels"] is None and library.resolved(["a", "Ref"], "ref")["key"] == 1 and library.resolved(["N° article"], "zz")["key"] == 0
    (tmp_path / "ref").mkdir()
    (tmp_path / "out").mkdir()
    (tmp_path / "ref" / "r.csv").write_text("Item No.,material_type,material_usage,material_subtype\n01.01.0001.,A,B,C\n01.01.0002.,nan,,\nheader,,,\n01.01.0003.,A,B,D\n")
    (tmp_path / "out" / "o.csv").write_text("Item No.,decision,material_type,material_usage,material_subtype,cost_usd,suggested_type,suggested_usage,suggested_subtype\n01.01.0001.,matched,A,B,C,0.5,A,B,C\n01.01.0002.,needs_review,,,,x,A,B,C\n01.01.0003.,matched,A,B,C,,,,\n")
    ref, out = (library.read_scored(spark, str(tmp_path / d)) for d in ("ref", "out"))
    assert ref.where("position = 2").first().nan_cells == 1 and ref.first().decision is None and [r.cost for r in out.orderBy("position").collect()] == [0.5, None, None]
    listed = spark.createDataFrame([("01.01.0002.", "E")], "key string, class string")
    pairs = library.joined_pairs(ref, out, listed)
    assert {r.key: (r["class"], r.decision) for r in pairs.collect()} == {"01.01.0001.": ("L", "matched"), "01.01.0002.": ("E", "needs_review"), "header": ("H", None), "01.01.0003.": ("L", "matched")}
    r = scopes.score_output(pairs, [[]]).first()
    assert (r.precision.correct, r.precision.matched, r.coverage_material.denominator, r.counts.missing) == (1, 2, 3, 1)


# --- requirements, verifier, report ---------------------------------------------------------------------------------


def test_requirements(spark):
    from taxolith.operators import requirements as q

    said = lambda df: sorted((r.item, r.problem) for r in df.collect())
    lines = spark.createDataFrame([(1, "a", ["x", "y"], "h", "Mowing"), (2, "b", ["z"], "m", "Supply  OF pipe"), (3, "c", [], "hr", "supply of"), (4, "d", ["q"], "h", None)], "position int, line_id string, raw_row array<string>, unit string, text string")
    out = spark.createDataFrame([(1, ["x", "y", "o"], "not_a_material", "", "", "", "G2_SERVICE", ["k1"]), (2, ["Z", "o"], "matched", "T", "U", "S", "SIGNAL", ["k2"]), (3, ["o"], "not_a_material", "T", "", "", "G2_SERVICE", []), (5, ["n"], "what", "", "", "", "r", ["k9"])], "position int, cells array<string>, decision string, type string, usage string, subtype string, reason string, call_ids array<string>")
    library = spark.createDataFrame([("T", "U", "other")], "type string, usage string, subtype string")
    assert said(q.rows_kept(lines, out)) == [("2", "changed"), ("4", "missing"), ("5", "new")] and said(q.decisions_known(out)) == [("5", "unknown")]
    assert said(q.closed_world(out, library)) == [("2", "no row of the library"), ("3", "labels without a match")]
    assert said(q.skips_backed(out, lines, ["h"], {"hr": "h"}, ["supply of"])) == [("3", "supply marker")]
    assert said(q.skips_backed(out, lines, ["H"], {}, ["supply of"])) == [("1", "unit"), ("3", "unit")]
    audit = spark.createDataFrame([("a", 1, ["k1"], ["t"]), ("b", 3, ["k3"], []), ("c", 2, [], ["t"]), ("c", 4, [], ["t"]), ("zz", 9, [], [])], "line_id string, position int, call_ids array<string>, raw array<string>")
    calls = spark.createDataFrame([("k1", 1.0, None, "m", "m"), ("k2", None, None, "m", "n"), ("k3", None, "timeout", "m", None)], "call_id string, cost double, error string, requested string, served string")
    assert said(q.audit_complete(lines, audit, out, calls, ["cost"])) == [("3", "no text"), ("5", "no text"), ("5", "unknown call"), ("b", "out of order"), ("c", "repeated"), ("d", "missing"), ("k2", "lacks cost"), ("zz", "unknown line")]
    assert said(q.models_allowed(calls, ["m*"])) == [("n", "not allowed")] and said(q.models_allowed(calls, ["m*", "?"])) == []
    models = spark.createDataFrame([("local:llama3.1:8b",), ("local:x:70B",), ("local:x",), ("Mini",), ("mini-4",)], "m string")
    assert [r.a for r in models.select(q.allowed_model(F.col("m"), ["local:<=8B", "mini-*"]).alias("a")).collect()] == [True, False, False, False, True]
    cost = spark.createDataFrame([(1.0,), (2.0,)], "cost double")
    assert said(q.cost_kept(cost, cost, 3.0, 1000)) == [] and said(q.cost_kept(cost, cost.limit(1), 3.0)) == [("run", "lines don't sum to calls"), ("run", "over the limit"), ("run", "spend is not the calls'")]
    runs_ = spark.createDataFrame([("a", "live", 0, 9.0, 3), ("b", "live", 0, 1.0, 0), ("c", "live", 1, 9.0, 1), ("d", "live", 0, 2.0, 1)], "run string, mode string, cache_hits int, wall_s double, routed int")
    assert said(q.latency_kept(runs_)) == [("a", "too slow"), ("b", "nothing routed")]
    assert said(q.columns(["a", "c"], ["a", "b"], cost)) == [("2", "name")] and said(q.columns(["a"], ["a", "b"], cost)) == [("2", "number")] and said(q.columns(["a"], ["a"], cost)) == []
    assert {(r.problem, r.n, r.examples) for r in q.report([q.rows_kept(lines, out)], 1).collect()} == {("changed", 1, "2"), ("missing", 1, "4"), ("new", 1, "5")}


def test_verifier_stage(spark):
    from taxolith.operators import verify

    coded = spark.createDataFrame([("c1", "T"), ("c2", "T"), ("d1", "D")], "code string, type string")
    leaders = spark.createDataFrame([(1, "c1"), (2, "c1"), (3, "c1"), (4, "c2"), (5, "d1"), (6, "d1"), (7, "d1")], "line int, leader string")
    asked = verify.sibling_rows(leaders, coded)
    assert {r.line: r.candidates for r in asked.collect()}[4] == ["c1", "c2"]
    outcomes = spark.createDataFrame([(1, "c1", None), (2, "c2", None), (3, "d1", None), (4, "NONE", None), (5, None, "timeout"), (6, None, "BUDGET_CAP")], "line int, code string, failure string")
    answers_ = verify.verifier_lines(asked, outcomes)
    assert {r.line: (r.answer, r.failure) for r in answers_.collect()} == {1: ("c1", None), 2: ("c2", None), 3: (None, "invalid_code"), 4: ("NONE", None), 5: (None, "timeout"), 6: (None, "BUDGET_CAP"), 7: (None, "replay_miss")}
    assert tuple(verify.unanswered(answers_).first()) == (7, 2)
    decided = leaders.unionByName(spark.createDataFrame([(8, "c1")], "line int, leader string")).select("*", F.when(F.col("line") == 1, "D9").when(F.col("line") == 8, "D7").otherwise("D9").alias("rule"), F.lit("matched").alias("decision"), F.lit("SIGNAL").alias("reason"))
    assert {r.line: r.rule for r in verify.verified(decided, answers_).collect()} == {1: "D9", 2: "D8a", 3: "D1b", 4: "D8a", 5: "D1b", 6: "D1b", 7: "D1b", 8: "D7"}


def test_run_report(spark):
    from taxolith.operators import runlog

    lines = spark.createDataFrame([("a", "matched", "S", "item", 1.0, 10, 1), ("a", "needs_review", "LLM_UNAVAILABLE", "item", 0.0, 99, 0), ("b", "matched", "S", "header", 2.0, 5, 1)], "run string, decision string, reason string, kind string, cost double, latency_ms long, n_calls int")
    calls = spark.createDataFrame([("a", False, True, 1.5, 3, 4), ("a", True, False, 9.0, 1, 0)], "run string, cache_hit boolean, retry boolean, cost double, cache_read int, cache_write int")
    named = spark.createDataFrame([("a", "http"), ("b", "replay"), ("c", "http")], "run string, adapter string")
    r = {x.run: x for x in runlog.run_report(lines, calls, named).collect()}
    assert (r["a"]["mode"], r["a"].calls, r["a"].retries, r["a"].spend, r["a"].cache_read, r["a"].p95_ms, r["a"].cost_per_100, r["a"].exit_code) == ("cached", 2, 1, 1.5, 4, 10, 50.0, 3)
    assert r["a"].decisions == {"matched": 1, "needs_review": 1} and r["b"]["mode"] == "replay" and r["b"].calls == 0 and r["b"].routed == 0 and (r["c"].lines, r["c"].cost_per_100, r["c"]["mode"]) == (0, 0.0, "live")


def test_experiments(spark):
    from taxolith.operators import experiments as x

    three = "struct<type:string,usage:string,subtype:string>"
    ledger = spark.createDataFrame([("a", "en", 1, "old"), ("a", "en", 3, "new"), ("a", "fr", 2, None)], "id string, lang string, n int, note string")
    assert sorted(map(tuple, x.latest(ledger, ["id", "lang"], "n").collect())) == [("a", "en", 3, "new"), ("a", "fr", 2, None)]
    ref = spark.createDataFrame([("i1", "A", "B", "C"), ("i2", "A", "B", ""), ("i3", "", None, ""), ("i4", "A", "B", "C")], "item string, type string, usage string, subtype string")
    library = spark.createDataFrame([("A", "B", "C")], "type string, usage string, subtype string")
    assert tuple(x.reference_coverage(ref, library).first()) == (1, 2, 0.5, True) and not x.reference_coverage(ref, library.limit(0)).first().usable
    pairs = spark.createDataFrame([("i1", "matched", ("A", "B", "C"), ("A", "B", "C")), ("i1", "needs_review", None, ("A", "B", "C")), ("i2", "matched", ("A", "B", "x"), ("A", "B", "")), ("i3", "matched", ("", "", ""), ("", "", ""))], f"item string, decision string, out {three}, ref {three}")
    items = x.item_correctness(pairs)
    assert {r.item: r.correct for r in items.collect()} == {"i1": 1, "i2": 0}
    assert {r.item: r.delta for r in x.compared(items.withColumn("correct", F.lit(0)), items).collect()} == {"i1": 1, "i2": 0}
    with pytest.raises(Exception, match="only one output"):
        x.compared(items, items.limit(1)).collect()
    first = spark.createDataFrame([("i1", "matched", "k", ("A", "B", "C")), ("i2", "needs_review", "k", ("A", "x", ""))], f"item string, decision string, top1 string, suggested {three}")
    second = spark.createDataFrame([("i1", ["k", "", "k"], ("A", "z", "")), ("i2", ["j"], ("A", "B", ""))], f"item string, pass_top1 array<string>, suggested {three}")
    got = {r.item: tuple(r)[1:] for r in x.agreement(x.joined_votes(first, second), ref).collect()}
    assert got == {"i1": ("matched", 2, True, False, True), "i2": ("needs_review", 0, False, True, True)}
    with pytest.raises(Exception, match="same items"):
        x.joined_votes(first, second.limit(1)).collect()
    figures = lambda p: spark.createDataFrame([("en", "shipped", 10, 9, 0.9), ("en", "rescue", 14, 13, p), ("fr", "shipped", 5, 5, 1.0), ("fr", "rescue", 0, 5, None)], "lang string, policy string, matched int, correct int, precision double")
    assert tuple(x.vote_verdict(figures(0.93), "rescue").first()) == (4, True, True) and tuple(x.vote_verdict(figures(0.8), "rescue").first()) == (4, False, False)
    replays = spark.createDataFrame([("T1", "r1", 1, 2), ("T1", "r2", 2, 0), ("T1", "r3", 3, 0), ("T2", "r1", 1, 1)], "threshold string, run string, ord int, unanswered int")
    assert {r.threshold: r.run for r in x.first_answering(replays).collect()} == {"T1": "r2", "T2": None}
    audit = spark.createDataFrame([(3, ["c", "a"]), (1, ["b", "a"]), (2, [])], "position int, call_ids array<string>")
    assert {r.call_id: r["index"] for r in x.batch_indices(audit).collect()} == {"b": 0, "a": 1, "c": 2}
    groups = x.strata(ref, ref.where("item <> 'i4'"), spark.createDataFrame([("i3", "E")], "item string, class string"), F.lit("s"))
    assert {r["class"]: (r.n, r.first) for r in groups.collect()} == {"L": (2, "i1"), "E": (1, "i3")}
    out = spark.createDataFrame([("i1", "EVIDENCE_NOT_IN_LINE", ("A", "B", "C")), ("i2", "EVIDENCE_NOT_IN_LINE", ("A", "B", "C")), ("i4", "x", ("A", "B", "C"))], f"item string, reason string, suggested {three}")
    raw = spark.createDataFrame([("i1", ['{"evidence": "q"}', "bad"])], "item string, raw array<string>")
    assert [(r.item, r.evidence) for r in x.false_rejects(out, raw, ref).collect()] == [("i1", ["q", None])]
    lines = spark.createDataFrame([("matched", False), ("needs_review", True), ("not_a_material", False)], "decision string, valid_code boolean")
    assert [r.decision for r in x.match_all(lines).collect()] == ["needs_review", "matched", "not_a_material"]

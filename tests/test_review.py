"""Classes, problems, votes and causes of reviewed outputs; equivalents of terms."""

from pyspark.sql import functions as F

from taxolith.operators import enrich, review


def test_row_classes(spark):
    rows = [("a", None, None, None), ("", "E", None, None), ("", None, " ", None), ("", None, "m", None), ("", None, None, "01.02.0003."), ("", None, None, "01.02"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "type string, listed string, unit string, key string")
    got = [r[0] for r in df.select(review.row_class(["type"], F.col("listed"), F.col("unit"), F.col("key"))).collect()]
    assert got == ["L", "E", "H", "blank", "blank", "H", "U"]
    classes = spark.createDataFrame([(c,) for c in got], "c string")
    assert [r[0] for r in classes.select(review.is_item_class(F.col("c"))).collect()] == [True, True, False, True, True, False, False]


def test_decisions_and_problems(spark):
    rows = [(True, "matched", "a"), (True, "matched", ""), (True, "needs_review", "a"), (True, "x", ""), (True, None, None), (False, None, None)]
    df = spark.createDataFrame(rows, "present boolean, decision string, type string")
    assert [r[0] for r in df.select(review.decision_of(F.col("present"), F.col("decision"))).collect()] == ["matched", "matched", "needs_review", "invalid", "invalid", "missing"]
    assert [r[0] for r in df.select(review.row_problem(F.col("decision"), ["type"])).collect()] == [None, "matched_blank", "labelled_non_match", "invalid", "invalid", "invalid"]


def test_key_violations(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "k string")
    b = spark.createDataFrame([("x",), ("z",), ("z",)], "k string")
    assert sorted(map(tuple, review.key_violations(a, b, "k").collect())) == [("x", "repeated_in_reference"), ("y", "missing"), ("z", "extra"), ("z", "repeated_in_output")]
    assert review.key_violations(a.limit(0), b.limit(0), "k").count() == 0


def test_suspects(spark):
    answers = [(1, "material", "A"), (1, "material", "A"), (2, "material", "A"), (2, "material", "B"), (3, "material", "A"), (4, "material", "A"), (4, "service", "A"), (5, "material", "B"), (5, "material", "B"), (6, "material", "no row"), (6, "material", "no row"), (7, "material", "A"), (7, "material", None), (8, "material", "A"), (8, "material", "A")]
    found = review.unanimous_answers(spark.createDataFrame(answers, "line int, kind string, top1 string"), 2)
    assert sorted(r.line for r in found.collect()) == [1, 5, 6, 8]
    coded = spark.createDataFrame([("A", "t", "u", ""), ("B", "t", "v", "s")], "code string, type string, usage string, subtype string")
    reference = spark.createDataFrame([(1, "t", "u", None), (5, "t", "u", ""), (6, "t", "u", ""), (8, "", "", "")], "line int, type string, usage string, subtype string")
    assert sorted(r.line for r in review.suspects(found, coded, reference).collect()) == [5, 8]


def test_causes(spark):
    rows = [("en", "a", "missed")] * 5 + [("en", "b", "false_match")] + [("en", "x", "missed")] * 20 + [("fr", "b", "false_nm")]
    causes = spark.createDataFrame([("a",), ("b",), ("c",)], "cause string")
    got = {(r.lang, r.cause): (r.n, r.triggered, r.weighted) for r in review.cause_triggers(spark.createDataFrame(rows, "lang string, cause string, kind string"), "lang", causes).collect()}
    assert got == {("en", "a"): (5, True, 5), ("en", "b"): (1, False, 2), ("en", "c"): (0, False, 0), ("fr", "a"): (0, False, 0), ("fr", "b"): (1, True, 2), ("fr", "c"): (0, False, 0)}
    gaps = spark.createDataFrame([("clear",), ("narrow",), (None,)], "gap string").agg(review.weakest_gap(F.col("gap"))).first()[0]
    assert gaps == "narrow"


def test_equivalents(spark):
    rows = spark.createDataFrame([("Asphalt Concrete", "Road", ""), ("Concrete", "Road", "Lean Concrete"), (" ", "Steel", None)], "type string, usage string, subtype string")
    found = enrich.labels(rows)
    assert sorted(r.label for r in found.collect()) == ["Asphalt Concrete", "Concrete", "Lean Concrete", "Road", "Steel"]
    eq = spark.createDataFrame([("Concrete", "Béton"), ("concrete", "béton"), ("Asphalt concrete", "Enrobé"), ("Timber", "Bois"), ("Road", "Route"), ("Road", "Chaussée")], "term string, equivalent string")
    got = {r.label: r.also for r in enrich.label_equivalents(found, eq).collect()}
    assert got == {"Asphalt Concrete": ["Enrobé"], "Concrete": ["Béton"], "Lean Concrete": ["Béton"], "Road": ["Chaussée", "Route"]}
    assert [r.term for r in enrich.missing_terms(found, eq.select("term").distinct()).collect()] == ["Timber"]

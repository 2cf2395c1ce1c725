"""Queries on rows and sizes that the given tables lack, each against its SQL or a plain computation."""

import os

import duckdb
from pyspark.sql import functions as F

from taxolith.plans import catalog

SF = "/root/testdata/sf0.001"


def against_sql(spark, name, folder):
    """Rows of the query and of its SQL over a folder of tables, both sorted."""
    got = catalog.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        at = os.path.join(folder, f)
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{at}{'/*.parquet' if os.path.isdir(at) else ''}')")
    wanted = con.execute("select " + ", ".join(f'"{c}"' for c in got.columns) + f" from ({catalog.ORACLES[name]})").fetchall()
    return sorted(map(str, (tuple(r) for r in got.collect()))), sorted(map(str, wanted))


def test_supply_markers_are_sought_in_the_text_as_it_is(spark, tmp_path):
    texts = ["one of the rows", "one of\nthe rows", "one of  the rows", "ONE OF THE ROWS", "one ｏf the rows", "one of the™ rows", "one of thé rows", "roof the rows", "of_the", "_of the", None]
    rows = [(i, texts[i % len(texts)], "en", f"src{i % 3}", i % 211) for i in range(4_000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got, wanted = against_sql(spark, "broken_requirements", tmp_path)
    assert got == wanted and any("supply marker" in r for r in got)


def test_a_file_of_section_paths_holds_a_whole_region(spark):
    """The path of a row far below its headers, behind those of other nations; files are no smaller than regions."""
    from taxolith.plans import queries

    rows = queries.region_rows_of(spark, SF)
    regions, customers = (spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("region", "customer"))
    assert rows.select("file").distinct().count() == regions and rows.count() == regions + spark.read.parquet(f"{SF}/nation.parquet").count() + customers
    got, wanted = against_sql(spark, "section_paths", SF)
    assert got == wanted and "FROM customer JOIN nation" in catalog.ORACLES["section_paths"] and "c_custkey //" not in catalog.ORACLES["section_paths"]


def test_large_groups_of_lines_are_compared_in_full(spark):
    """150 lines with the same heavy words: the classes that a comparison of all with all gives."""
    import random

    from taxolith.llm import line_dedup
    from taxolith.llm.graph import connected_components

    rnd = random.Random(4)
    heavy = " ".join(x * 60 for x in "jkq")
    made = [[rnd.choice("abcdefgh") * 2 + str(rnd.randint(0, 30)) for _ in range(40)] for _ in range(75)]
    lines = [f"{heavy} {' '.join(w)}" for m in made for w in (m, [*m[:30], *(rnd.choice("xyz") * rnd.randint(2, 4) for _ in range(10))])]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {}
    for r in line_dedup.classes(docs).collect():
        got.setdefault(r.class_key, set()).add(r.doc_id)
    rows = line_dedup.keyed(line_dedup.lines_of(docs)).select("doc_id", "simhash", "size", line_dedup.block_numbers().alias("numbers")).join(docs, "doc_id")
    side = lambda x: rows.select(F.col("doc_id").alias(x), F.col("simhash").alias(f"h{x}"), F.col("size").alias(f"n{x}"), F.col("text").alias(f"t{x}"), F.col("numbers").alias(f"k{x}"))
    pairs = side("a").crossJoin(side("b")).where((F.col("a") < F.col("b")) & F.arrays_overlap("ka", "kb")).where((F.bit_count(F.col("ha").bitwiseXOR(F.col("hb"))) <= line_dedup.RADIUS) & line_dedup.similar("ta", "tb"))
    wanted = {}
    for r in connected_components(pairs.select("a", "b")).collect():
        wanted.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, wanted.values())) and len(wanted) > 1


def test_a_large_library_file_is_never_whole_in_python(tmp_path):
    import tracemalloc

    import pyarrow as pa

    from taxolith.sources.library import library_rows

    data = pa.py_buffer(b"material_type;material_usage;material_subtype\n" + b"".join(b"type;usage;name %d\n" % k for k in range(200_000)))
    tracemalloc.start()
    n = sum(1 for _ in library_rows("f", data))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 200_000 and peak < data.size / 4


def test_folding_sends_no_ascii_text_to_python(spark):
    from taxolith.functions import text

    rows = ["ABC  1,5", "", None, "Straße ﬁ", "É́ Ⅷ", "\t a b "] * 200
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = [r.n for r in df.select("i", text.normalize(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got[:6] == ["abc 1.5", "", None, "strasse fi", "é́ viii", "a b"] and got == got[:6] * 200
    plan = df.select(text.normalize(F.col("t")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "_folded(CASE WHEN" in plan


def test_equal_codes_are_counted_before_they_are_looked_up(spark):
    from taxolith.plans import queries

    plan = queries.code_check(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("Aggregate [code") and "lineitem" in plan[plan.rindex("Aggregate [code") :].lower() or "l_partkey" in plan[plan.rindex("Aggregate [code") :]


def test_equal_statements_are_read_once(spark):
    from taxolith.plans import evaluation

    df = spark.range(30_000).selectExpr("id AS label", "id % 5 AS n")
    got = evaluation.texts_of(df, "label")
    assert got.count() == 30_000 and "regexp" not in got._jdf.queryExecution().optimizedPlan().toString().lower()


def test_jaccard_join_moves_texts_and_not_sets(spark, monkeypatch):
    """Round 3: the numbers of the fragments are gone when blocks are compared, and what is moved is smaller than the sets."""
    import numpy as np
    from taxolith.llm import common, jaccard

    rnd = np.random.default_rng(3)
    base = [[f"word{k}" for k in rnd.integers(0, 3_000, 400)] for _ in range(5)]
    texts = [" ".join([*w[:at], "other", *w[at + 1 :]]) for w in base for at in range(0, 200, 10)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(7, "the same identifier with another text"), (900, None)], "doc_id long, text string")
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 8)
    left, kept, seen = {}, common.kept, []

    def watched(df, name, path=None):
        if name == "links":
            seen.append(os.path.exists(left["fragments"].removeprefix("file://")))
        found = kept(df, name, path)
        left[name] = found.kept_at
        return found

    monkeypatch.setattr(common, "kept", watched)
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.jaccard_join(docs, n=5, num=80).collect()}
    assert seen == [False]
    assert all(got[i, len(jaccard.shingle_set(t, 5))] == i // 20 * 20 for i, t in enumerate(texts))
    assert got[7, 2] == 7 and got[900, 0] == 900
    assert len(jaccard.packed(texts[0])) < 0.5 * jaccard.shingle_set(texts[0], 5).nbytes


def test_lines_apart_are_compared_nearest_first(spark, monkeypatch):
    """Round 3: what the nearest pairs of a group connect is not compared again; the classes are the same."""
    import random

    from taxolith.llm import common, line_dedup

    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    heavy, words, rows = [word(14) for _ in range(5)], [word(6) for _ in range(40)], []
    for k in range(40):
        rows.append((k, " ".join([*heavy, *words])))
        words[k] = word(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept, pairs = common.kept, []

    def watched(df, name, path=None):
        found = kept(df, name, path)
        if name == "near_lines":
            pairs.append(found.count())
        return found

    monkeypatch.setattr(common, "kept", watched)
    found = {}
    for rounds in (line_dedup.ROUNDS, (line_dedup.RADIUS,)):
        monkeypatch.setattr(line_dedup, "ROUNDS", rounds)
        pairs.clear()
        classes = line_dedup.classes(docs).select("doc_id", "first_doc", "n").collect()
        found[len(rounds)] = sum(pairs), sorted((r.doc_id, r.first_doc, r.n) for r in classes)
    assert found[2][1] == found[1][1] == [(k, 0, 40) for k in range(40)]
    assert found[2][0] < found[1][0]


def test_long_documents_that_share_passages_are_no_cluster(spark, monkeypatch):
    """Each shares half its words with the next, so numbers by chance; only the two that link go to the blocks."""
    import numpy as np

    from taxolith.llm import common, jaccard

    rnd = np.random.default_rng(5)
    passages = [" ".join(f"w{k}" for k in rnd.integers(0, 1_000_000, 1_500)) for _ in range(25)]
    texts = [f"{a} {b}" for a, b in zip(passages[:-1], passages[1:], strict=True)]
    docs = spark.createDataFrame([*enumerate(texts), (100, texts[3] + " and more")], "doc_id long, text string")
    rows, kept = {}, common.kept

    def watched(df, name, path=None):
        found = kept(df, name, path)
        rows[name] = found.count()
        return found

    monkeypatch.setattr(common, "kept", watched)
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard.jaccard_join(docs, n=5, num=80).collect()}
    assert got == {**{i: (i, 0) for i in range(24)}, 3: (3, 1), 100: (3, 1)}
    assert rows["clusters"] == 2


def test_counts_per_cell_drop_no_link():
    """Sets about the threshold, of sizes whose cells differ in number, with and without known counts."""
    import numpy as np

    from taxolith.llm import jaccard

    rnd = np.random.default_rng(6)
    sets = [np.zeros(0, np.uint64)]
    for n in (3, 30, 60, 250, 256, 1_000, 5_000):
        pool = rnd.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2)
        sets += [np.unique(pool[k : k + m]) for m in (n, n * 4 // 5, n + n // 5) for k in (0, n // 20, n // 12, n // 2)]
    sets.append(np.arange(300, dtype=np.uint64))  # all in one cell
    sets.append(np.arange(20, 310, dtype=np.uint64))
    size, cells = np.array([len(s) for s in sets]), [jaccard.cells_of(s) for s in sets]
    assert [len(c) for c in cells[-2:]] == [0, 0] and len({len(c) for c in cells}) > 4
    label = np.arange(len(sets)) % 3
    for num, den in ((80, 100), (85, 100)):
        got, apart = jaccard.plausible(size, cells, num, den), jaccard.plausible(size, cells, num, den, label)
        links = 0
        for i in range(1, len(sets)):
            for j in range(1, i):
                both = len(np.intersect1d(sets[i], sets[j]))
                link = den * both >= num * (size[i] + size[j] - both)
                links += link
                assert got[i, j] == got[j, i] == jaccard.may_link(size[i], size[j], cells[i], cells[j], num, den) >= link
                assert apart[i, j] == (got[i, j] and label[i] != label[j])
        assert links > 10 and got.sum() < len(sets) ** 2 // 4

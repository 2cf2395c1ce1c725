"""Each operator of the subpackage on small tables: brute force, round trips, and the odd rows every one must bear."""

import hashlib
import itertools
import random
import unicodedata

import pytest

from taxolith.llm import decontaminate, exact_dedup, graph, jaccard, licenses, line_dedup, pieces, quality, shingles, token_counts, toxicity, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
ODD = [(None, "no identifier here at all"), (1, None), (2, ""), (3, " \t\n "), (4, "same row twice, word for word"), (4, "same row twice, word for word"), (5, LONG), (6, LONG), (7, "Größe ﬁ 日本語 👍 ▁x \x00 <s>")]


def docs_of(spark, rows, extra=False):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:  # names that operators use themselves
        docs = docs.selectExpr("*", "'x' as body", "1 as n", "'k' as key", "2 as k1", "3 as score", "0 as label", "'s' as source", "7 as `first.id`", "1 as keys", "2 as node", "1 as line_no", "5 as window")
    return docs


def as_dict(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def near_texts(seed, n=60, size=40):
    """Groups of texts with a few words changed."""
    rnd = random.Random(seed)
    rows, base = [], None
    for i in range(n):
        if i % 6 == 0:
            base = [rnd.choice(WORDS) + str(rnd.randint(0, 30)) for _ in range(rnd.randint(3, size))]
        words = list(base)
        for _ in range(rnd.choice([0, 0, 1, 2, 3])):
            words[rnd.randrange(len(words))] = "changed" + str(rnd.randint(0, 99))
        rows.append((i, rnd.choice([" ", "  ", "\n"]).join(words)))
    return rows


def brute_components(rows, n, num, den):
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    root = {i: i for i in sets}
    links = dict.fromkeys(sets, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), links[i]) for i in sets}


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_jaccard_equals_brute_force(spark, n, num, den):
    rows = near_texts(n) + [(900, None), (901, ""), (902, "one two"), (903, "One  two"), (904, "two one")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.jaccard_join(docs_of(spark, rows, True), n, num, den).collect()}
    assert got == brute_components(rows, n, num, den)


def test_jaccard_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 3)  # every cluster is split, so links cross blocks
    rows = near_texts(3, 36, 60)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.jaccard_join(docs_of(spark, rows)).collect()}
    assert got == brute_components(rows, 4, 85, 100)


def test_jaccard_odd_rows(spark):
    rows = jaccard.jaccard_join(docs_of(spark, ODD, True)).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[5].component_id == by[6].component_id == 5 and by[1].component_id == 1 and by[None].component_id is None
    assert jaccard.jaccard_join(docs_of(spark, [])).collect() == []


def test_jaccard_identifiers_with_two_texts(spark):
    one = " ".join(f"a{i}" for i in range(40))
    two = " ".join(f"b{i}" for i in range(40))
    rows = [(1, one), (1, two), (2, one + " x"), (3, two + " y"), (3, two + " y")]
    got = sorted((r.doc_id, r.component_id, r.n_links) for r in jaccard.jaccard_join(docs_of(spark, rows)).collect())
    assert got == [(1, 1, 1), (1, 1, 2), (2, 1, 1), (3, 1, 2), (3, 1, 2)]


def test_licenses_odd_rows(spark):
    rows = licenses.license_scan(docs_of(spark, ODD, True)).collect()
    assert len(rows) == len(ODD) and sum(r.doc_id is None for r in rows) == 1
    assert licenses.license_scan(docs_of(spark, [])).count() == 0


def test_suppression_by_brute_force():
    rnd = random.Random(3)
    for _ in range(300):
        reach, taken = licenses.Reach(20), []
        for _ in range(12):
            s = rnd.randrange(19)
            e = rnd.randint(s + 1, 20)
            inside = any(a <= s and e <= b for a, b in taken)
            assert (reach.upto(s) >= e) == inside
            if not inside:
                taken.append((s, e))
                reach.add(s, e)


def test_fragment_keys_meet():
    rnd = random.Random(5)
    import numpy as np

    for _ in range(300):
        n = rnd.randint(1, 300)
        a = {rnd.getrandbits(64) for _ in range(n)}
        b = set(a)
        while b and 100 * len(a & b) >= 85 * len(a | b):
            kept = b
            b = set(b)
            b.remove(rnd.choice(sorted(b))) if rnd.random() < 0.5 else b.add(rnd.getrandbits(64))
            if 100 * len(a & kept) >= 85 * len(a | kept) and kept:
                one, two = (set(jaccard.fragment_keys(np.array(sorted(x), np.uint64), 85, 100).tolist()) for x in (a, kept))
                assert one & two


def test_shingles_match_words():
    for text in ["", " ", "One", "one TWO three four five", "a\x0bb\x0cc d  e\x1ff", "É é"]:
        words = [w for w in text.encode().lower().split()]
        assert len(shingles.word_hashes(text)) == len(words)
    old, shingles.PIECE = shingles.PIECE, 16
    try:
        cut = shingles.word_hashes("some words that are cut in pieces of sixteen bytes")
    finally:
        shingles.PIECE = old
    assert (cut == shingles.word_hashes("some words that are cut in pieces of sixteen bytes")).all()


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (7, 7), (None, 3), (20, 21), (21, 22), (22, 20)] + [(100 + i, 101 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(50)]
    got = {}
    for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == sorted([[1, 2, 3, 4], [7], [8, 9], [20, 21, 22], list(range(100, 161)), [5000, *range(6000, 6050)]])
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def random_texts(seed, n):
    rnd = random.Random(seed)
    pool = [*" \t\n\r\x0b\x1c\x85abcdehtinrsAÉéßäΣσςİŉ日本👍▁<>|0123.,!'_́", " ", "　", " the", "ing", "'re", "'ll", "<|endoftext|>", "</w>", "<0x0A>", "   "]
    return ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_pieces_equal_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    codec = pieces.codec(pieces.model_path())
    for text in [*random_texts(1, 3000), LONG, "x" * 500, "thing" * 200]:
        ids = model.encode(text)
        assert codec.encode(text) == ids
        assert codec.decode(ids) == model.decode(ids)
    rows = as_dict(pieces.encoded(docs_of(spark, ODD, True), with_ids=True))
    assert rows[1].n_tokens == rows[2].n_tokens == 0 and rows[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[5].ids == model.encode(LONG) and rows[5].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert pieces.encoded(docs_of(spark, [])).count() == 0


def test_token_counts_equal_library(spark):
    from tokenizers import Tokenizer

    path = pieces.model_path(token_counts.VOCABULARY)
    library, own = Tokenizer.from_file(path), token_counts.counter(path)
    texts = [*random_texts(2, 3000), LONG, "antidisestablishment" * 30]
    assert list(map(own.count, texts)) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    for text in ["they're internationalisation, 3 of 'em!!", "Größe ﬁ 日本語 👍 we'll", *random_texts(3, 40)]:
        if "<|" in text:
            continue
        body = own.normalised(text)
        table = own.prefixes(body)
        for k in range(len(body) + 1):
            if unicodedata.normalize("NFC", body[:k]) == body[:k]:
                assert table[k] == len(library.encode(body[:k], add_special_tokens=False).ids)
        fit = own.fitting(body, 5)
        assert own.count(fit) <= 5
    rows = as_dict(token_counts.token_counts(docs_of(spark, ODD, True)))
    assert (rows[1].n_bytes, rows[1].n_tokens, rows[1].over_limit) == (0, 0, False) and rows[5].over_limit
    assert token_counts.token_counts(docs_of(spark, [])).count() == 0


def test_licenses_by_brute_force(spark):
    import re

    rnd = random.Random(4)
    parts = ["CC BY", "cc-by-sa 4.0", "GNU General Public License, version 3", "All Rights Reserved.", "licensed under the MIT License", "Apache License 2.0", "all rights", "über", "x", "\n", "cc", "by", "general"]
    texts = [" ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, LONG)]
    got = as_dict(licenses.license_scan(docs_of(spark, rows, True)))
    for i, text in rows:
        lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scan("Licensed under CC BY-NC 4.0.")[5] == "cc-by,cc-by-nc-4.0"
    assert licenses.scan("GNU Lesser General Public License v2.1 text")[5].split(",") == ["gpl", "lgpl-2.1"]


def test_license_gates_open_for_every_match():
    for text in ["released under the Apache License, Version 2.0", "SPDX-License-Identifier: GPL-3.0-or-later", "the BSD 3-Clause License", "in the public domain", "https://opensource.org/licenses/MIT", "EUPL 1.2", "Creative Commons Attribution 4.0"]:
        words = licenses.words_of(text)
        line = b" ".join(words).decode()
        matching = {r for r in licenses.rules() if r.pattern.search(line)}
        assert matching
        assert all(any(g <= set(words) for g in r.gates) for r in matching)


def test_warc_round_trip(spark):
    page = "<p>" + "same page " * 30
    rows = [(3, "http://a/ b\r\nc", page), (1, None, page), (2, "u", page), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", "é" * 100_000 + "\r\n\r\nWARC/1.1\r\n"), (None, "u", "x" * 200), (9, "u", page), (9, "u", page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as body", "1 as stored", "2 as chunk_no", "'d' as payload_digest")
    got = warc.round_trip(pages, chunk=1000).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(h or "" for i, _, h in rows if i == r.page_id).encode()
        assert (r.payload_bytes, r.payload_digest) == (len(text), hashlib.sha256(text).hexdigest())
        revisit = text == page.encode() and r.page_id != 1
        assert (r.record_type, r.refers_to) == (("revisit", 1) if revisit else ("response", None))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_exact_dedup(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (1, "other"), (2, None), (8, ""), (7, " "), (6, " "), *ODD[4:]]
    for size in (32, 1):  # with digests of one byte, unequal texts share a digest
        got = exact_dedup.exact_dedup(docs_of(spark, rows, True), digest_bytes=size).collect()
        assert len(got) == len(rows)
        import re

        body = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        groups = {}
        for i, t in rows:
            groups.setdefault(body(t), []).append(i)
        expect = sorted((i, min(groups[body(t)]), len(groups[body(t)]), i == min(groups[body(t)]), hashlib.sha256(body(t).encode()).hexdigest()) for i, t in rows)
        assert sorted(map(tuple, got)) == expect
    assert exact_dedup.exact_dedup(docs_of(spark, [])).count() == 0


def test_merge_index_compacts_in_levels(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FAN_IN", 2)
    index = exact_dedup.MergeIndex(spark)
    for k in range(5):
        index.flush(spark.range(k, k + 3).selectExpr("cast(cast(id as string) as binary) as digest", f"id * 10 + {k} as doc_id"))
    got = {bytes(r.digest).decode(): (r.doc_id, r.n) for r in index.compact().collect()}
    assert got == {str(d): (d * 10 + max(0, d - 2), sum(k <= d < k + 3 for k in range(5))) for d in range(7)}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def test_line_dedup_by_brute_force(spark):
    import re

    rnd = random.Random(6)
    base = [" ".join(rnd.choice(WORDS) + str(rnd.randint(0, 50)) for _ in range(40)) for _ in range(6)]
    pool = []
    for b in base:
        for _ in range(4):
            words = b.split()
            words[rnd.randrange(40)] = rnd.choice(WORDS)
            pool += [" ".join(words), b.upper() + "!"]
    pool += ["", "--", "short line", "Short  line."]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 6)))) for i in range(30)] + [(900, None), (901, "")]
    docs = docs_of(spark, rows, True)
    lines = [(i, k, " ".join(w for w in re.split(r"[\W_]+", line.lower()) if w)) for i, t in rows for k, line in enumerate((t or "").split("\n"))]
    norms = sorted({n for *_, n in lines if n})
    root = {n: n for n in norms}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    linked = 0
    for a, b in itertools.combinations(norms, 2):
        if min(len(set(x.split())) for x in (a, b)) >= line_dedup.MIN_WORDS and edit_distance(a, b) <= 0.2 * max(len(a), len(b)):
            root[find(a)] = find(b)
            linked += 1
    assert linked
    first = {}
    for i, k, n in sorted(lines):
        first.setdefault(find(n) if n else None, (i, k))
    expect = {i: None if t is None else "\n".join(line for k, line in enumerate(t.split("\n")) for n in [next(n for a, b, n in lines if (a, b) == (i, k))] if not n or first[find(n)] == (i, k)) for i, t in rows}
    got = line_dedup.line_dedup(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.select("doc_id", "text").collect()} == expect


def test_line_dedup_recall(spark):
    rnd = random.Random(16)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 9)))
    sizes, rows = {}, []
    for n in (4, 6, 10, 20, 30, 50, 100):
        while sizes.setdefault(n, 0) < 40:
            a = [word() for _ in range(n)]
            b = list(a)
            for _ in range(rnd.randint(1, max(1, n // 6))):
                b[rnd.randrange(n)] = word()
            x, y = " ".join(a), " ".join(b)
            if edit_distance(x, y) <= 0.2 * max(len(x), len(y)):
                sizes[n] += 1
                rows += [(len(rows), x), (len(rows) + 1, y)]
    found = {r.doc_id: r.class_key for r in line_dedup.classes(docs_of(spark, rows)).collect()}
    k = 0
    for n, size in sizes.items():
        met = sum(i in found and found[i] == found.get(i + 1) for i in range(k, k + 2 * size, 2))
        print(n, met, size)
        assert met >= 0.9 * size
        k += 2 * size


def test_line_dedup_odd_rows(spark):
    got = line_dedup.line_dedup(docs_of(spark, ODD, True)).collect()
    assert len(got) == len(ODD)
    assert {r.doc_id: r.text for r in got}[6] == "" and {r.doc_id: r.text for r in got}[5] == LONG
    assert line_dedup.line_dedup(docs_of(spark, [])).count() == 0


def test_decontamination(spark):
    item = "A train leaves Paris at 9 with 120 passengers and arrives after 3 hours, so how many km did Alice travel if it ran at 80 km each hour?"
    other = "Which of the following rivers flows through more than four of the countries that are listed in the table below?"
    benchmark = spark.createDataFrame([(1, item), (2, other), (3, None), (None, item), (4, "too short")], "item_id long, text string").selectExpr("*", "1 as doc_id")
    changed = item.replace("Paris", "Lyon").replace("120", "77").replace("Alice", "Robert").replace("80", "95")
    # 9 and 120 both become 5 and 6 in one text, and one number stands for two in the other: only the second clashes
    rows = [(1, f"Intro text here. {item} And more."), (2, f"Said before. {changed}"), (3, "A train leaves the station."), (4, None), (5, ""), (6, other.upper()), (7, LONG), (7, LONG), (None, item), (8, "x " * 300 + other)]
    got = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.contaminated(docs_of(spark, rows, True), benchmark).collect()}
    assert set(got) >= {(1, 1), (2, 1), (8, 2)} and not {k for k in got if k[0] in (3, 4, 5, 7)}
    assert got[1, 1] == 1.0
    left = decontaminate.decontaminated(docs_of(spark, rows, True), benchmark)
    assert {3, 4, 5, 7, None} <= {r.doc_id for r in left.collect()} and not {1, 2, 8} & {r.doc_id for r in left.collect()}
    assert decontaminate.contaminated(docs_of(spark, []), benchmark).count() == 0
    assert decontaminate.contaminated(docs_of(spark, rows), benchmark.limit(0)).count() == 0


def test_slots_must_be_consistent(spark):
    item = "Start with 7 apples in the big basket here then take the 7 apples from the big basket there and count what is left of them"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item.replace("7", "9")), (2, item.replace("7", "9", 1))]
    got = {r.doc_id: r.coverage for r in decontaminate.contaminated(docs_of(spark, rows), benchmark).collect()}
    assert got[1] == 1.0 and got.get(2, 0) < 1.0


def test_decontamination_of_moved_words(spark):
    item = "when the old farmer in Paris sells his brown horses at the market each of them brings him much less money than before"
    timed = "the train to town leaves the main hall at 9:30 each day and the bus there leaves the hall at 8:30 each day"
    benchmark = spark.createDataFrame([(1, item), (2, timed)], "item_id long, text string")
    rows = [(1, item.replace("at the", "right at the")), (2, item.replace("brown horses", "horses")), (3, item.replace("Paris", "New York")), (4, timed.replace("9:30", "7:15").replace("8:30", "6:15")), (5, item[:50])]
    got = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.contaminated(docs_of(spark, rows), benchmark).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 2)}
    assert got[3, 1] == got[4, 2] == 1.0


def test_template_windows_without_filter(spark):
    docs = docs_of(spark, [(1, "one two three four five six seven eight nine")])
    assert decontaminate.template_windows(docs).count() == 2
    assert decontaminate.template_windows(docs, short=(5, 6)).count() == 2 + 5 + 4


def test_short_items(spark):
    benchmark = spark.createDataFrame([(1, "What is the capital of France?"), (2, "Too short")], "item_id long, text string")
    rows = [(1, "He asked: what is the capital of Spain? Nobody knew."), (2, "What is the capital here"), (3, "too short a text to say")]
    got = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.contaminated(docs_of(spark, rows), benchmark).collect()}
    assert got == {(1, 1): 1.0}


def test_decontamination_by_brute_force(spark):
    """Without placeholders an item is found where enough of its windows stand at one shift."""
    rnd = random.Random(12)
    items = [(i, [rnd.choice(WORDS) for _ in range(rnd.randint(10, 30))]) for i in range(12)]
    docs = []
    for d in range(60):
        words = [rnd.choice(WORDS) for _ in range(rnd.randint(0, 20))]
        _, item = rnd.choice(items)
        a = rnd.randrange(len(item))
        docs.append((d, words + item[a : a + rnd.randint(4, 30)] + [rnd.choice(WORDS)]))
    w = decontaminate.WINDOW
    windows = lambda t: [tuple(t[k : k + w]) for k in range(len(t) - w + 1)]
    expect = {}
    for d, text in docs:
        for i, item in items:
            own = windows(item)
            hits = {k for k, x in enumerate(own) if x in set(windows(text))}
            if len(hits) / len(own) >= decontaminate.COVERAGE:
                expect[d, i] = len(hits) / len(own)
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.contaminated(docs_of(spark, [(d, " ".join(t)) for d, t in docs]), benchmark).collect()}
    assert expect and got == pytest.approx(expect)


def labelled(spark, bad, good, n=400):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        poor = i % 4 == 0
        words = [rnd.choice(WORDS) for _ in range(rnd.randint(10, 60))]
        rows.append((i, bad(rnd, words) if poor else good(rnd, words)))
        labels.append((i, 0 if poor else 1))
    return rows, labels


def test_quality(spark):
    rows, labels = labelled(spark, lambda r, w: " ".join(x.upper() + "!!%%" for x in w), lambda r, w: (" ".join(w) + ".").capitalize())
    docs = docs_of(spark, rows + [(9000, None), (9001, ""), (None, "text"), (9002, LONG)], True)
    table = spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id long, quality int")
    model = quality.fit(docs, table)
    got = quality.scored(docs, model).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out]
    assert held and all(__import__("zlib").crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert sum(r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth) >= 0.97 * sum(r.doc_id in truth for r in held)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert 0 < len(model.rules) < 200
    assert quality.scored(docs.limit(0), model).count() == 0
    only = quality.fit(docs, table.where("quality = 1"))
    assert all(r.predicted == 1 for r in quality.scored(docs, only).collect())
    assert quality.fit(docs, table.limit(0)).rules == ()


def test_toxicity(spark):
    insult = ["grumpf", "blarg", "zonkel"]
    rows, labels = labelled(spark, lambda r, w: " ".join([*w, r.choice(insult), *w[:3], r.choice(insult) + "s."]), lambda r, w: " ".join(w), 800)
    labels = [(i, 1 - q) for i, q in labels]
    docs = docs_of(spark, rows + [(9000, None), (9001, ""), (None, "text"), (9002, LONG)], True)
    grammar = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.scored(docs, grammar).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert as_dict(toxicity.scored(docs, grammar))[9001].predicted == 0
    assert toxicity.scored(docs.limit(0), grammar).count() == 0
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")).weights == {}


def test_toxicity_grammar():
    lexicon, arcs = toxicity.Lexicon({"=idiot": 2.0, "moro": 1.5}), toxicity.composed()
    score = lambda t: toxicity.features(t, lexicon, arcs)[0]
    assert score("you idiot") > score("an idiot") > score("she said idiot") > 0
    assert score("you are not an idiot") < score("you are an idiot")
    assert score("not. an idiot") == score("an idiot")  # a clause ends there
    assert score("morons") > 0 == score("more")
    assert toxicity.features("idiot. idiot", lexicon, arcs)[2] > toxicity.features("idiot idiot", lexicon, arcs)[2]


def test_toxicity_target_behind():
    lexicon, arcs = toxicity.Lexicon({"=idiot": 2.0}), toxicity.composed()
    score = lambda t: toxicity.features(t, lexicon, arcs)[0]
    assert score("i will kill you") == score("you i will kill") > score("i will not kill you") > 0
    assert score("i will kill. you") == score("i will kill time") == 0
    assert score("an idiot are you") == score("you are an idiot") > score("an idiot")

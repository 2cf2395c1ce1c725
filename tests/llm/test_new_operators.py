"""Importance resampling, line labelling and conversation repair against brute force on small tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from taxolith.llm import conversations, line_labels, resampling

CLASH = ["'x' as word", "1 as row", "2 as bucket", "3 as gain", "4 as score", "5 as rank", "'k' as words", "6 as n_words", "7 as position", "8 as block", "9 as hash", "10 as `a.b`"]


# --- importance resampling ------------------------------------------------------------------------------------------


def brute_resampled(docs, target, most, buckets, seed, least, percent):
    def features(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return w, [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = collections.Counter(bucket(f) for (x,) in target for f in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for i, text in docs:
        w, f = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    order = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(order[: percent * len(order) // 100], 1)}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


@pytest.mark.parametrize("most", [1, 3])
def test_importance_resampling(spark, most):
    rnd = random.Random(most)
    vocabulary = [f"Word{i}é" if i % 9 == 0 else f"w{i}" for i in range(60)]
    docs = [(i, rnd.choice([" ", "-", "\n"]).join(rnd.choices(vocabulary, k=rnd.randint(0, 40)))) for i in range(150)]
    docs += [(900, None), (901, ""), (902, "\x00 ..!"), (None, " ".join(vocabulary)), (3, docs[3][1]), (3, docs[3][1]), (903, "the " * 30_000)]
    target = [(" ".join(vocabulary[:12] * 3),), (None,), ("",)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", *CLASH)
    t = spark.createDataFrame(target, "text string").selectExpr("*", "1 as doc_id", *CLASH)
    got = resampling.resampled(d, t, most, 50, 7, 5, 40)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {k for _, k in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == brute_resampled(docs, target, most, 50, 7, 5, 40)


def test_importance_resampling_empty(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    assert resampling.resampled(docs.limit(0), none).count() == 0
    rows = {r.doc_id: r for r in resampling.resampled(docs, none, least_words=1, percent=100).collect()}
    assert rows[1].rank == 1 and rows[1].n_features == 3 and rows[2].rank is None and rows[2].weight == 0


def test_importance_resampling_ranks_over_ranges(spark):
    scored = spark.range(5000).selectExpr("id as row", "id as doc_id", "if(id % 7 = 0, 1L, 30L) as n_words", "1L as n_features", "0L as weight", "(id * 7919) % 100 as score")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = resampling.ranked(scored, 20, 50).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    drawn = sorted((r for r in got if r.rank is not None), key=lambda r: r["rank"])
    able = sorted((i for i in range(5000) if i % 7), key=lambda i: (-(i * 7919 % 100), i))
    assert [r.doc_id for r in drawn] == able[: len(able) // 2] and [r["rank"] for r in drawn] == list(range(1, len(able) // 2 + 1))


# --- line labelling -------------------------------------------------------------------------------------------------


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = collections.Counter(windows)
    covered = {k for i, x in enumerate(windows) if often[x] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_line_counts():
    rnd = random.Random(3)
    texts = [None, "", "\n\n", " \t ", "a", "é日本 👍\n\né日本 👍\r\n", "x " * 9, "one line\n" * 5, "\x00 \x85 \xa0 b", "<a|b>#*$%& !?"]
    for _ in range(200):
        texts.append("".join(rnd.choice(["a b", "ab ", "a", "\n", "#", " ", "\t", "é ", "b a a b a\n"]) for _ in range(rnd.randint(1, 120))))
    texts.append("\n".join(f"line {i % 4000} of a long text" for i in range(60_000)))  # several pieces
    texts.append("word " * 400_000)  # a line longer than a piece
    for text in texts:
        x = line_labels.lines(text)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute_counts(text), text and text[:80]
        assert len(x.features) == len(x.words) == sum(bool(re.search(r"[^\x20\x09-\x0D]", s)) for s in (text or "").split("\n")) and x.words.sum() == x.n_words


def path_score(field, features, path):
    total = field.start[path[0]] + sum(float(features[i] @ np.array(field.weights)) * y for i, y in enumerate(path))
    return total + sum(field.pairs[a][b] for a, b in itertools.pairwise(path))


def test_viterbi_and_likelihood_against_all_paths():
    rng = np.random.default_rng(5)
    lengths = np.array([6, 4, 4, 1])
    texts = [rng.random((n, 3)) > 0.5 for n in lengths]
    for _ in range(20):
        theta = rng.normal(size=9)
        field = line_labels.Field(tuple(theta[:3]), tuple(theta[3:5]), tuple(map(tuple, theta[5:].reshape(2, 2))))
        x, y = np.concatenate(texts).astype(float), (rng.random(lengths.sum()) > 0.5).astype(float)
        want, at = 0.0, 0
        for f in texts:
            paths = list(itertools.product((0, 1), repeat=len(f)))
            scores = {p: path_score(field, f, p) for p in paths}
            assert scores[tuple(map(int, field.labels(f)))] == pytest.approx(max(scores.values()))
            want += scores[tuple(y[at : at + len(f)].astype(int))] - math.log(sum(map(math.exp, scores.values())))
            at += len(f)
        value, gradient = line_labels.likelihood(theta, x, y, lengths)
        assert value == pytest.approx(want / len(x))
        for k in range(len(theta)):
            step = np.eye(len(theta))[k] * 1e-5
            slope = (line_labels.likelihood(theta + step, x, y, lengths)[0] - line_labels.likelihood(theta - step, x, y, lengths)[0]) / 2e-5
            assert gradient[k] == pytest.approx(slope, abs=1e-6)


def test_line_labelling(spark):
    rnd = random.Random(11)
    good = lambda: ". ".join(" ".join(rnd.choices("the of rain over hills comes down again in spring and".split(), k=9)).capitalize() for _ in range(4)) + "."
    bad = lambda: " | ".join(rnd.choices("home login cart menu share about".split(), k=8))
    rows = [(i, "\n".join((good if i % 2 else bad)() for _ in range(5))) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(None, 1), (999, None)], "doc_id long, quality int")
    mixed = [(1000, "\n".join([good(), good(), bad(), good()])), (1001, "\n".join([bad(), good(), *[bad() for _ in range(9)]]))]
    odd = [(None, None), (1002, ""), (1003, "few words"), (7, rows[7][1]), (1004, "a b c d e f g h\n" * 40), (1005, "\n".join(good() for _ in range(9000)))]
    docs = spark.createDataFrame(rows + mixed + odd, "doc_id long, text string").selectExpr("*", "'l' as lines", "1 as kept", "2 as label", "3 as features", "4 as n_words")
    field = line_labels.fit(docs, labels)
    got = line_labels.labelled(docs, field).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    held = [r for r in got if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 40 and all(r.kept == bool(r.doc_id % 2) for r in held)
    assert by[1000].kept and by[1000].n_content_lines == 3 and not by[1001].kept and by[1001].n_content_lines <= 1
    assert [by[i].base_failed for i in (None, 1002, 1003, 1004, 1005)] == [True, True, True, True, False] and by[1005].kept
    assert not any(r.kept for r in got if r.base_failed)
    texts = dict(rows + mixed + odd)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(texts[r.doc_id])
    assert line_labels.labelled(docs.limit(0), field).count() == 0
    assert line_labels.fit(docs, labels.limit(0)) is None and {r.doc_id: r.kept for r in line_labels.labelled(docs, None).collect()}[0]


# --- conversation repair --------------------------------------------------------------------------------------------


def brute_damage(turns):
    found = collections.defaultdict(list)
    text = lambda x: " " if x is None else str(x)
    for conv, turn, role, body in turns:
        kind, role, body = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20, text(role), text(body)
        found[conv]  # every conversation stays
        if kind:
            body = "" if kind == 1 else re.sub("[.!?]", "", body) if kind == 2 else body
            found[conv] += [(turn, "user" if kind == 4 else role, body)] * (2 if kind == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for k, v in found.items()}


def brute_repair(rows):
    """All audits in order of cost, then text, until one gives legal roles: a search without states."""
    import heapq

    faults, seen = [], set()
    for _, role, body in rows:
        tail = body.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not tail else "duplicate" if (role, body) in seen else "truncated" if tail[-1] not in ".!?" else "")
        seen.add((role, body))
    turns = [t for t, _, _ in rows if t is not None]
    counts = [max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")]]
    counts.append(sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows)))
    heap = [(0, "", 0, ())]
    while heap:
        cost, audit, at, lines = heapq.heappop(heap)
        roles = "".join(r[:1] for r, _ in lines)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return (*counts, cost, audit, hashlib.sha256("\n".join(f"{r}:{b}" for r, b in lines).encode()).hexdigest())
        steps = [("I", 3, at, (role, "")) for role in ("user", "assistant") if audit[-2:] != "II"]
        if at < len(rows):
            _, role, body = rows[at]
            extra = 3 * (faults[at] == "truncated")
            steps.append(("D", 4, at + 1, None))
            if faults[at] not in ("blank", "duplicate"):
                steps += [("K", extra, at + 1, (role, body)), *[("R", 3 + extra, at + 1, (r, body)) for r in ("user", "assistant")]]
        for edit, price, then, line in steps:
            new = lines if line is None else (*lines, line)
            if re.fullmatch("s?(ua)*u?", "".join(r[:1] for r, _ in new)):
                heapq.heappush(heap, (cost + price, audit + edit, then, new))


def some_turns(seed, n):
    rnd = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rnd.randint(1, 7)):
            if rnd.random() < 0.9:
                rows.append((conv, rnd.choice([turn, turn, turn, None, 2]), rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", None]), rnd.choice(["yes.", "no", "why? ", "\t", None, "", "stop!\n", "über"])))
    return [*rows, (None, None, None, None), (None, 1, "user", "hi."), (None, 1, "user", "hi."), (999, 5, "user", "x" * 200_000)]


@pytest.mark.parametrize("block", [512, 2])
def test_conversation_repair(spark, block):
    turns = some_turns(block, 120)
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", *CLASH, "'t' as there", "1 as fault", "2 as copy")
    got = {r[0]: tuple(r)[1:] for r in conversations.repair(df, block).collect()}
    assert got == {k: brute_repair(v) for k, v in brute_damage(turns).items()}


def test_conversation_that_loses_all_rows(spark):
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "gone.")], "conv_id long, turn long, role string, text string")
    assert tuple(conversations.repair(df).first()) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations.repair(df.limit(0)).count() == 0


def test_long_conversation_in_blocks(spark):
    rnd = random.Random(4)
    turns = [(1, i, rnd.choice(["user", "assistant"]), f"turn {i}.") for i in range(3000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    small, large = (conversations.repair(df, b).first() for b in (64, 4096))
    assert small == large and len(small.audit.replace("I", "")) == len(brute_damage(turns)[1])

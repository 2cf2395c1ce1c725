"""Toxicity: a weighted finite-state pattern grammar over clauses.

A lexical transducer maps words to symbols: insult (with a weight learned from labels), threat, target, negation,
report, clause end. Three small machines read the symbols: polarity (a negation holds for three words), report (from a
verb of saying to the end of the clause) and address (a target seen in the clause). Their composition is one
deterministic machine whose arcs carry the multiplier of an insult or a threat in that state. A clause scores the sum
of weight times multiplier along its path; insults and threats before its first target wait for the clause's end: with
a target they are addressed too, without one threats do not count. A document's score is logistic in its best clause, the sum of its clauses
and their number.

Training reads a bounded sample of labelled rows (at most SAMPLE): one half gives the lexicon (at most LEXICON
entries: words and the beginnings of words), the other half the logistic weights. Scoring covers all rows and whole
texts.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolith.llm import common
from taxolith.llm.quality import held_out, labelled_sample

SAMPLE = 20_000
LEXICON = 4_000
THRESHOLD = 0.3
#: Beginnings of words of these lengths enter the lexicon as well as whole words.
STEMS = (4, 5, 6)
#: Words that one Python worker remembers at most.
CACHE = 200_000

# Fixed word lists of the grammar, in four languages.
THREATS = "kill hurt destroy beat crush attack shoot burn tuer frapper détruire töten schlagen vernichten matar golpear destruir".split()
TARGETS = "you your yours u he she they them him her people vous tu toi votre ton ils elles du dich dir ihr euch sie usted ustedes tú ti ellos ellas".split()
NEGATIONS = "not no never none nor without isn aren wasn don doesn didn won cannot pas jamais aucun sans nicht kein keine nie ohne nunca jamás sin ningún".split()
REPORTS = "said says say wrote writes quoted quotes claimed claims called according reported told dit écrit cité selon sagte schrieb zitierte laut dijo escribió citó según".split()

WORD, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
#: Words that a negation holds for.
REACH = 3
FACTOR = {"negated": 0.3, "reported": 0.5, "addressed": 1.4}
THREAT_WEIGHT = 1.0
TOKEN = re.compile(r"\w+|[.!?;\n]+")


def polarity(state: int, symbol: int) -> int:
    return 0 if symbol == END else REACH if symbol == NEGATION else max(0, state - 1)


def report(state: int, symbol: int) -> int:
    return 0 if symbol == END else 1 if symbol == REPORT else state


def address(state: int, symbol: int) -> int:
    return 0 if symbol == END else 1 if symbol == TARGET else state


def composed() -> list[list[tuple[int, float]]]:
    """arcs[state][symbol] = (next state, multiplier) of the product of the three machines."""
    states = list(itertools.product(range(REACH + 1), (0, 1), (0, 1)))
    number = {s: i for i, s in enumerate(states)}
    arcs = []
    for p, r, a in states:
        row = []
        for symbol in range(7):
            after = number[polarity(p, symbol), report(r, symbol), address(a, symbol)]
            factor = (FACTOR["negated"] if p else 1.0) * (FACTOR["reported"] if r else 1.0) * (FACTOR["addressed"] if a else 1.0)
            row.append((after, factor if symbol in (INSULT, THREAT) else 0.0))
        arcs.append(row)
    return arcs


class Lexicon(dict):
    """word → (symbol, weight); unseen words are looked up by themselves, then by their longest known beginning."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights
        self.fixed = {w: (s, THREAT_WEIGHT if s == THREAT else 0.0) for s, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) > CACHE:
            self.clear()
        if not (word[0].isalnum() or word[0] == "_"):
            found = (END, 0.0)
        elif (w := self.weights.get("=" + word)) is not None:
            found = (INSULT, w)
        elif word in self.fixed:
            found = self.fixed[word]
        else:
            w = next((self.weights[word[:k]] for k in reversed(STEMS) if word[:k] in self.weights and len(word) >= k), None)
            found = (WORD, 0.0) if w is None else (INSULT, w)
        self[word] = found
        return found


def features(text: str | None, lexicon: Lexicon, arcs) -> tuple[float, float, float]:
    """Best clause, sum of clauses and number of scored clauses, damped by logarithms."""
    best = total = clause = insults = threats = 0.0
    clauses = state = idle = 0
    target = False
    for symbol, weight in map(lexicon.__getitem__, TOKEN.findall((text or "").lower())):
        if symbol == WORD:
            idle += 1  # only the reach of a negation sees how many plain words there were
            continue
        if idle:
            for _ in range(min(idle, REACH)):
                state = arcs[state][WORD][0]
            idle = 0
        state, factor = arcs[state][symbol]
        target |= symbol == TARGET
        if factor and target:
            clause += factor * weight
        elif symbol == INSULT:
            insults += factor * weight
        elif symbol == THREAT:
            threats += factor * weight
        elif symbol == END:
            clause += (insults + threats) * FACTOR["addressed"] if target else insults
            if clause:
                best, total, clauses = max(best, clause), total + clause, clauses + 1
            clause, insults, threats, target = 0.0, 0.0, 0.0, False
    clause += (insults + threats) * FACTOR["addressed"] if target else insults
    if clause:
        best, total, clauses = max(best, clause), total + clause, clauses + 1
    return float(np.log1p(best)), float(np.log1p(total)), float(np.log1p(clauses))


@dataclass(frozen=True)
class Grammar:
    weights: dict[str, float]
    logistic: tuple[float, float, float, float]

    def score(self, x) -> float:
        b, *w = self.logistic
        return float(1.0 / (1.0 + np.exp(-np.clip(b + sum(a * c for a, c in zip(w, x, strict=True)), -30, 30))))


def words_and_stems(text: Column) -> Column:
    """Distinct words of a text, marked by =, and their beginnings."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"))
    words = F.filter(words, lambda w: F.length(w) >= 3)

    def stems(k: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) >= k), lambda w: F.substring(w, 1, k))

    return F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(F.lit("="), w)), *map(stems, STEMS)))


def learned(sample: DataFrame, limit: int = LEXICON) -> dict[str, float]:
    """Log odds of words and stems that toxic documents have and others hardly do; copies of one text count once."""
    rows = sample.dropDuplicates(["text"]).select("label", F.explode(words_and_stems(F.col("text"))).alias("f"))
    n1, n0 = sample.dropDuplicates(["text"]).agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.coalesce(F.sum(1 - F.col("label")), F.lit(0.0))).first()
    counts = rows.groupBy("f").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    odds = F.log((F.col("p") + 0.5) / (n1 + 1.0)) - F.log((F.col("q") + 0.5) / (n0 + 1.0))
    # a word that says no more than its stem adds nothing: of equal weight, the more frequent entries stay
    top = counts.where((F.col("p") >= F.lit(max(4.0, 0.003 * n1))) & (odds >= 3.0) & (F.col("p") >= 4 * F.col("q"))).select("f", odds.alias("w"), "p").orderBy(F.desc("p"), "f").limit(limit)
    return {r.f: float(r.w) for r in top.collect()}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Newton steps on at most SAMPLE rows of three features."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
    return tuple(float(v) for v in w)


def featured(docs: DataFrame, weights: dict[str, float], carry: str) -> DataFrame:
    """carry columns plus x0, x1, x2 of each row of docs(carry..., text)."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches):
        lexicon, arcs = Lexicon(weights), composed()
        for b in batches:
            x = np.array([features(t, lexicon, arcs) for t in b.column("text").to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *[pa.array(x[:, i]) for i in range(3)]], [*names, "x0", "x1", "x2"])

    return docs.mapInArrow(run, f"{carry}, x0 double, x1 double, x2 double")


def fit(docs: DataFrame, labels: DataFrame, mod: int = 4, remainder: int = 2, size: int = SAMPLE) -> Grammar:
    """Learn lexicon and logistic weights from two halves of the sample. Without rows of both labels the score is the share."""
    sample = common.kept(labelled_sample(docs, labels, "toxic", mod, remainder, size), "toxic_sample")
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))
    weights = learned(sample.where(half == 0))
    rows = featured(sample.where(half == 1).select("label", "text"), weights, "label double").collect()  # at most SAMPLE rows of four numbers
    y = np.array([r.label for r in rows])
    if not len(y) or not 0 < y.sum() < len(y):
        return Grammar(weights, (-2.0, 1.0, 1.0, 0.0))
    rows.sort(key=lambda r: (r.label, r.x0, r.x1, r.x2))
    y = np.array([r.label for r in rows])
    return Grammar(weights, logistic(np.array([[r.x0, r.x1, r.x2] for r in rows]), y))


def scored(docs: DataFrame, grammar: Grammar, mod: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null and empty texts have no clause and score the intercept."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    b, w0, w1, w2 = grammar.logistic
    x = featured(narrow, grammar.weights, "doc_id long")
    total = F.lit(b) + F.lit(w0) * F.col("x0") + F.lit(w1) * F.col("x1") + F.lit(w2) * F.col("x2")
    return x.select(
        "doc_id", held_out(F.col("doc_id"), mod, remainder).alias("held_out"), (1.0 / (1.0 + F.exp(-total))).alias("score"),
        (F.exp(F.col("x2")) - 1).cast("int").alias("n_clauses"), (F.exp(F.col("x0")) - 1).alias("best_clause"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).select("doc_id", "held_out", "score", "predicted", "n_clauses", "best_clause")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, fit(docs, common.table(spark, sf_dir, "labels")))

"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, names (capitalised words inside a sentence) and units behind numbers are typed
placeholders (a run of equal ones is one), all else is the lower-cased word. Windows of WINDOW template tokens, most of them literal, are hashed;
windows of documents meet those of benchmark items in a join on the hash. Windows of one document and one item that
agree on their distance make one alignment, and so do those whose distances follow each other by at most NEAR tokens, as
words put in or left out move them; the values behind its placeholders must be consistent: one value of the item never
stands for two values of the document. A document is contaminated if the consistent windows of an alignment cover at
least COVERAGE of the item's windows, so a question is caught with other numbers and names in it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxolith.llm import common
from taxolith.llm.shingles import _powers_to, mix

WINDOW = 8
#: Literal tokens a window has at least.
LITERAL = 5
COVERAGE = 0.5
#: An item too short for a window is one window as long as itself, if it has so many tokens and literals at least.
SHORTEST, SHORT_LITERAL = 4, 3
#: Tokens that distances of one alignment are apart at most, each from the next.
NEAR = 8
#: Benchmark windows that are sent to all tasks as a filter at most; beyond it every window is joined.
FILTER_WINDOWS = 2_000_000
CACHE = 200_000

# Units that may stand behind a number.
UNITS = frozenset("km m cm mm mi ft in kg g mg lb oz l ml h hr hrs hour hours min mins minute minutes s sec second seconds day days week weeks month months year years mph kmh usd eur gbp dollar dollars euro euros cent cents percent degrees celsius fahrenheit watt watts kw volts meters metres kilometers miles feet inches grams kilograms pounds liters litres".split())
NUMBER = re.compile(r"\d[\d.,:/]*$")
STRIP = "\"'“”‘’«»()[]{}<>*_~`#&|$%^=+\\/!?.,;:¡¿…-–—"
NUM, NAME, UNIT = 1, 2, 3
HIT = "doc_id long, at long, window long, slots array<string>, width int"


class Numbers(dict):
    """token → its number, given when it is first seen."""

    def __init__(self, templates):
        super().__init__()
        self.number = templates.number

    def __missing__(self, token: str) -> int:
        return self.number(token)


class Templates:
    """Template tokens of texts; tokens are remembered within bounds by number."""

    def __init__(self):
        self.marks = {name: self.hash(f"#{name}") for name in ("number", "name", "unit")}
        self.clear()

    def clear(self) -> None:
        self.known = Numbers(self)
        self.values: list[str] = []
        size = 1 << 12
        self.first, self.inner = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.kind_first, self.kind_inner = np.zeros(size, np.int8), np.zeros(size, np.int8)
        self.unit, self.ends = np.zeros(size, bool), np.zeros(size, bool)

    hash = staticmethod(xxhash.xxh3_64_intdigest)

    def number(self, token: str) -> int:
        at = self.known[token] = len(self.values)
        if at == len(self.first):
            for name in ("first", "inner", "kind_first", "kind_inner", "unit", "ends"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate((old, np.zeros_like(old))))
        if token.isalpha() and token.islower():
            self.values.append(token)
            self.first[at] = self.inner[at] = self.hash("=" + token)
            self.unit[at] = token in UNITS
            return at
        bare = token.strip(STRIP)
        low = bare.lower()
        self.values.append(low)
        self.unit[at] = low in UNITS
        self.ends[at] = token.rstrip("\"'”’»)]*_")[-1:] in (".", "!", "?")
        if bare[:1].isdigit() and NUMBER.match(bare):
            self.first[at] = self.inner[at] = self.marks["number"]
            self.kind_first[at] = self.kind_inner[at] = NUM
        elif bare:
            name = len(bare) > 1 and bare[0].isupper() and bare[1:].islower()
            self.first[at] = self.hash("=" + low)
            self.inner[at] = self.marks["name"] if name else self.first[at]
            self.kind_inner[at] = NAME if name else 0
        return at

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, kind, place of its first word) of each template token, and the numbers of the words, without those that are punctuation alone."""
        if len(self.known) > CACHE:
            self.clear()
        codes = np.fromiter(map(self.known.__getitem__, (text or "").split()), np.int64)
        if not len(codes):
            return np.zeros(0, np.uint64), np.zeros(0, np.int8), codes, codes
        begins = np.concatenate(([True], self.ends[codes[:-1]]))
        hashes = np.where(begins, self.first[codes], self.inner[codes])
        kinds = np.where(begins, self.kind_first[codes], self.kind_inner[codes])
        kept = hashes != 0
        hashes, kinds, codes = hashes[kept], kinds[kept], codes[kept]
        units = self.unit[codes] & np.concatenate(([False], kinds[:-1] == NUM))
        hashes, kinds = np.where(units, np.uint64(self.marks["unit"]), hashes), np.where(units, np.int8(UNIT), kinds)
        first = np.flatnonzero(np.concatenate((kinds[:1] >= 0, (kinds[1:] == 0) | (kinds[1:] != kinds[:-1]))))
        return hashes[first], kinds[first], first, codes

    def windows(self, tokens, width: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of each window of so many tokens with enough literals."""
        hashes, kinds, *_ = tokens
        n = len(hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        power, inverse = _powers_to(len(hashes) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power[: len(hashes)])))
        window = mix((sums[width:] - sums[:-width]) * inverse[:n])
        literal = np.concatenate(([0], np.cumsum(kinds == 0)))
        start = np.flatnonzero(literal[width:] - literal[:-width] >= literals)
        return start, window[start]

    def slots(self, tokens, start: int, width: int) -> list[str]:
        """Values behind the placeholders of the window that starts there, with their places."""
        _, kinds, first, codes = tokens
        return [f"{k}:{self.run(first, codes, start + k)}" for k in range(width) if kinds[start + k]]

    def run(self, first: np.ndarray, codes: np.ndarray, at: int) -> str:
        """The words of a template token."""
        return " ".join(self.values[c] for c in codes[first[at] : first[at + 1] if at + 1 < len(first) else None])


def template_windows(texts: DataFrame, only: np.ndarray | None = None, short: tuple[int, ...] | None = None) -> DataFrame:
    """doc_id, at, window, slots, width of every window of texts(doc_id, text), or of those whose hash is in the sorted array only.

    Besides windows of WINDOW tokens, those of the widths in short; without short texts are items: one without a
    window is one itself.
    """

    def found(t, tokens):
        start, window = t.windows(tokens, WINDOW, LITERAL)
        yield WINDOW, start, window
        n = len(tokens[0])
        widths = short if short is not None else (n,) if not len(start) and n >= SHORTEST else ()
        for width in widths:
            yield width, *t.windows(tokens, width, SHORT_LITERAL)

    def run(batches):
        t = Templates()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                tokens = t.tokens(text)
                for width, start, window in found(t, tokens):
                    if only is not None and len(window):
                        if not len(only):
                            continue
                        place = np.searchsorted(only, window)
                        place[place == len(only)] = 0
                        hit = only[place] == window
                        start, window = start[hit], window[hit]
                    rows += [(doc_id, s, w, t.slots(tokens, s, width), width) for s, w in zip(start.tolist(), window.view(np.int64).tolist(), strict=True)]
                if len(rows) > 20_000:
                    yield batch(rows)
                    rows = []
            yield batch(rows)

    def batch(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "at", "window", "slots", "width"])

    return texts.mapInArrow(run, HIT)


def found_windows(hits: DataFrame, alignment: str) -> DataFrame:
    """doc_id, item_id, found: the item's windows that the consistent windows of each alignment, named by a column of hits, cover."""
    keys = ["doc_id", "item_id", alignment]
    # slot consistency: windows with a value of the item that stands for two values in the alignment do not count
    bound = hits.select(*keys, "at", "item_at", F.explode(F.arrays_zip("item_slots", "slots")).alias("s"))
    value = lambda c: F.expr(f"substring({c}, instr({c}, ':') + 1)")
    bound = bound.select(*keys, "at", "item_at", value("s.item_slots").alias("item_value"), value("s.slots").alias("doc_value"))
    clashing = bound.groupBy(*keys, "item_value").agg(F.countDistinct("doc_value").alias("values")).where("values > 1")
    broken = bound.join(clashing, [*keys, "item_value"], "left_semi").select(*keys, "at", "item_at").distinct()
    sound = hits.select(*keys, "at", "item_at").join(broken, [*keys, "at", "item_at"], "left_anti")
    return sound.groupBy(*keys).agg(F.countDistinct("item_at").alias("found")).select("doc_id", "item_id", "found")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, coverage of every document and item found in it.

    An item without a window of enough literals is found where its whole template stands; one of fewer than SHORTEST
    tokens or SHORT_LITERAL literals can't be found. Null and empty
    texts match nothing; rows without an identifier are not reported; rows that repeat one are one document. Without
    items or documents the result is empty.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    item_windows = common.kept(template_windows(items).withColumnsRenamed({"doc_id": "item_id", "at": "item_at", "slots": "item_slots"}), "item_windows")
    short = tuple(sorted(r.width for r in item_windows.where(F.col("width") != WINDOW).select("width").distinct().collect()))
    known = item_windows.select("window").distinct()
    n = known.count()
    only = np.sort(np.array([r.window for r in known.collect()], np.int64).view(np.uint64)) if n <= FILTER_WINDOWS else None
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("doc_id is not null")
    sizes = item_windows.groupBy("item_id").agg(F.countDistinct("item_at").alias("n_windows"))
    hits = common.kept(template_windows(texts, only, short), "window_hits").drop("width").join(common.checked(item_windows.drop("width")), "window").withColumn("shift", F.col("at") - F.col("item_at"))
    # an alignment is one shift, or a chain of shifts; the chain counts where it covers more
    w = Window.partitionBy("doc_id", "item_id").orderBy("shift")
    shifts = hits.select("doc_id", "item_id", "shift").distinct().withColumn("_new", F.coalesce((F.col("shift") - F.lag("shift").over(w) > NEAR).cast("int"), F.lit(0)))
    chains = shifts.select("doc_id", "item_id", "shift", F.sum("_new").over(w).alias("chain"))
    hits = common.kept(hits.join(chains, ["doc_id", "item_id", "shift"]), "aligned_hits")
    counted = found_windows(hits, "shift").union(found_windows(hits, "chain")).join(sizes, "item_id")
    covered = counted.groupBy("doc_id", "item_id").agg(F.max(F.col("found") / F.col("n_windows")).alias("coverage"))
    return covered.where(F.col("coverage") >= COVERAGE)


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all their columns, in which no item is found; rows without an identifier stay."""
    found = common.kept(contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("id")).distinct(), "contaminated")
    return common.without(docs, id_col, found)


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Per document: whether it is contaminated, by which items, and how much of the best found one it holds."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, common.table(spark, sf_dir, "benchmark"))
    by_doc = common.kept(found.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage")), "found")
    joined = docs.select("doc_id").join(common.checked(by_doc), "doc_id", "left")
    return joined.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))

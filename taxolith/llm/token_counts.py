"""Token counts by prefix: how many tokens every prefix of a text has, without encoding any of them.

For a word-end BPE vocabulary the table of a word is filled by dynamic programming (bpe.Merges.prefix_counts); a
text's table adds the words before. It answers how long a text is, what a cut costs and which prefix fits a budget.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolith.llm import common
from taxolith.llm.bpe import Memory, Merges
from taxolith.llm.pieces import model_path

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Stands for the vocabulary's mark of a word's end, so that a last symbol is two characters.
END = "\ue000"


def byte_symbols() -> list[str]:
    """The usual printable symbol of each byte: itself if it prints, else the next code point from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class PrefixCounter:
    """Counts for the tokenizer description (JSON) at path: NFC, lower case, words, word-end BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        suffix = said["model"]["end_of_word_suffix"]
        mark = lambda t: t.removesuffix(suffix) + END if t.endswith(suffix) else t
        pairs = [m.split(" ") if isinstance(m, str) else m for m in said["model"]["merges"]]
        ranks = {(mark(a), mark(b)): r for r, (a, b) in enumerate(pairs)}
        units = lambda s: [*s[:-2], s[-2:]] if s.endswith(END) else list(s)
        self.merges = Merges({mark(t): i for t, i in said["model"]["vocab"].items()}, lambda a, b: ranks.get((a, b)), units, END)
        self.symbols = byte_symbols()
        split = next(p["pattern"]["Regex"] for p in said["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in said["added_tokens"]) or r"(?!)")
        self.words = Memory(lambda word: self.table(word)[-1])
        self.chunks = Memory(lambda chunk: self.words[chunk] if chunk.isalpha() and chunk.isascii() else sum(map(self.words.__getitem__, self.word.findall(chunk))))

    @staticmethod
    def normalised(text: str) -> str:
        # one character at a time has no word-final sigma
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def table(self, word: str) -> list[int]:
        """table[k]: tokens of the first k UTF-8 bytes of a word, as a word of its own."""
        return self.merges.prefix_counts("".join(self.symbols[b] for b in word.encode()))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "<|" in text and (found := self.special.findall(text)):
            return len(found) + sum(self.count(t) for t in self.special.split(text))
        body = self.normalised(text)
        if any(c in body for c in "\x1c\x1d\x1e\x1f"):  # str.split takes these for blanks
            return self.chunks.make(body)
        return sum(map(self.chunks.__getitem__, body.split()))

    def prefixes(self, text: str) -> list[int]:
        """prefixes[k]: tokens of the first k characters of the normalised text (no special strings in it)."""
        body = self.normalised(text)
        out, before, done = [0], 0, 0
        for m in self.word.finditer(body):
            out += [before] * (m.start() - done)
            word, table, used = m.group(), self.table(m.group()), 0
            for k, c in enumerate(word, 1):
                used += len(c.encode())
                part = word[:k]
                whole = k == len(word) or (m2 := self.word.match(part)) and m2.end() == k
                out.append(before + (table[used] if whole else sum(self.table(w)[-1] for w in self.word.findall(part))))
            before, done = out[-1], m.end()
        return out + [before] * (len(body) - done)

    def fitting(self, text: str, budget: int) -> str:
        """The longest prefix of the normalised text with at most budget tokens."""
        table = self.prefixes(text)
        return self.normalised(text)[: max(k for k, n in enumerate(table) if n <= budget)]


@functools.cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row's whole text; null texts count as empty: 0 bytes, 0 tokens."""

    def run(batches):
        c = counter(path or model_path(VOCABULARY))
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(list(map(c.count, texts)), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"))

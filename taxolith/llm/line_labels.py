"""Quality rules by labelling a document's lines: a linear-chain conditional random field marks content and boilerplate.

Each line with a word is a set of binary features of its characters, its repeats and its place. The field adds a weight per
feature to the label content, and weights to the first label and to each pair of neighbouring labels; Viterbi's algorithm
finds the best labels of all lines together. A document is kept if its content lines hold enough of its words.

Fitting reads a bounded sample: at most SAMPLE labelled rows (the smallest hashes of their identifiers) of at most
SAMPLE_LINES lines each; its features, not its texts, go to the driver. Lines have no labels of their own: those of good
documents are content unless they repeat an earlier line, and those of bad ones are boilerplate unless a first fit without
neighbours takes them for content. Labelling covers all rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolith.llm import common, quality, shingles

SAMPLE, SAMPLE_LINES = 2_000, 400
#: A document is kept if so large a share of its words is in content lines.
CONTENT_SHARE = 0.5
#: The plain rules that come first.
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 20, 30, 8
STEPS, RATE, PENALTY = 80, 0.3, 1e-3


# --- lines of a text ------------------------------------------------------------------------------------------------


def _table(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


_BLANK = _table(b" \t\n\x0b\x0c\r")
_LETTERS = _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_KINDS = {"upper": _table(bytes(range(65, 91))), "letters": _LETTERS, "digits": _table(b"0123456789"), "symbols": _table(b"#*$%&|<>"), "bars": _table(b"|"), "exclaims": _table(b"!"), "stops": _table(b".!?"), "commas": _table(b",;:")}
_STARTS_CHAR = np.array([b & 0xC0 != 0x80 for b in range(256)])


def pieces(data: bytes) -> Iterator[bytes]:
    """The text in pieces of about a megabyte, cut behind line feeds; a longer line is a piece of its own."""
    at = 0
    while at < len(data):
        end = data.find(b"\n", at + shingles.PIECE) + 1
        yield data[at : end or len(data)]
        at = end or len(data)


@dataclass
class Lines:
    """Counts of one text, and the features and words of its lines that have a word."""

    n_words: int = 0
    word_chars: int = 0
    n_symbols: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0
    words: np.ndarray = None
    features: np.ndarray = None


#: Names of the features, in order; the last two are set for the first and the last line.
FEATURES = (
    "bias", "words>1", "words>3", "words>7", "words>15", "words>31", "upper>.3", "upper>.6", "digits>.1", "digits>.3", "symbols>.02", "symbols>.08", "symbols>.2",
    "exclaims>.02", "exclaims>.06", "bars", "bars>.05", "commas>.03", "stops>.02", "ends with stop", "starts upper", "word length>4", "word length>8", "letters>.7", "repeats", "first", "last",
)


def lines(text: str | None) -> Lines:
    """Everything that is counted or labelled of a whole text; null counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out, hashes, masks, words = Lines(), [], [], []
    seen: set[bytes] = set()
    for piece in pieces(data):
        b = np.frombuffer(piece, np.uint8)
        solid = ~_BLANK[b]
        cuts = np.flatnonzero(b == 10)
        starts, ends = np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(b)]))

        def per_line(mask, starts=starts, ends=ends):
            total = np.concatenate(([0], np.cumsum(mask)))
            return total[ends] - total[starts]

        first_of_word = solid.copy()
        first_of_word[1:] &= ~solid[:-1]
        n_words = per_line(first_of_word)
        some = np.flatnonzero(n_words)
        out.word_chars += int(np.count_nonzero(solid & _STARTS_CHAR[b]))
        out.n_symbols += int(np.count_nonzero(_KINDS["symbols"][b]))
        if not len(some):
            continue
        n_words = n_words[some]
        hashes.append(_word_hashes(piece))
        at = np.flatnonzero(solid)
        head, tail = b[at[np.searchsorted(at, starts[some])]], b[at[np.searchsorted(at, ends[some]) - 1]]
        repeats = np.zeros(len(some), bool)
        each = piece.split(b"\n")
        for k, i in enumerate(some):
            if each[i] in seen:
                repeats[k] = True
            else:
                seen.add(each[i])
        n = per_line(solid)[some]
        part = {kind: per_line(t[b])[some] / n for kind, t in _KINDS.items()}
        per_word = n / n_words
        masks.append(np.stack([
            np.ones(len(some), bool), n_words > 1, n_words > 3, n_words > 7, n_words > 15, n_words > 31, part["upper"] > 0.3, part["upper"] > 0.6, part["digits"] > 0.1, part["digits"] > 0.3,
            part["symbols"] > 0.02, part["symbols"] > 0.08, part["symbols"] > 0.2, part["exclaims"] > 0.02, part["exclaims"] > 0.06, part["bars"] > 0, part["bars"] > 0.05, part["commas"] > 0.03,
            part["stops"] > 0.02, _KINDS["stops"][tail], _KINDS["upper"][head], per_word > 4, per_word > 8, part["letters"] > 0.7, repeats, np.zeros(len(some), bool), np.zeros(len(some), bool),
        ], axis=1))
        words.append(n_words)
        out.n_dup_lines += int(repeats.sum())
    out.features = np.concatenate(masks) if masks else np.zeros((0, len(FEATURES)), bool)
    out.words = np.concatenate(words) if words else np.zeros(0, np.int64)
    if masks:
        out.features[0, -2] = out.features[-1, -1] = True
        out.n_words = int(out.words.sum())
        out.n_repeat_words = repeated(np.concatenate(hashes), WINDOW)
    return out


def _word_hashes(piece: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return shingles._piece_hashes(piece)


def repeated(words: np.ndarray, width: int) -> int:
    """Words that lie in a window of width words which occurs twice or more; windows are compared by 64-bit hashes."""
    count = len(words) - width + 1
    if count < 2:
        return 0
    with np.errstate(over="ignore"):
        total = np.zeros(count, np.uint64)
        for k in range(width):
            total = shingles.mix(total * np.uint64(0x9E3779B97F4A7C15) + words[k : k + count])
    order = np.argsort(total, kind="stable")
    same = total[order[1:]] == total[order[:-1]]
    again = np.zeros(count, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    turns = np.zeros(len(words) + 1, np.int64)
    np.add.at(turns, np.flatnonzero(again), 1)
    np.add.at(turns, np.flatnonzero(again) + width, -1)
    return int(np.count_nonzero(np.cumsum(turns)[:-1]))


# --- the field ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """Weights of the features for content, of the first label, and of pairs of labels; 0 is boilerplate, 1 content."""

    weights: tuple[float, ...]
    start: tuple[float, float]
    pairs: tuple[tuple[float, float], tuple[float, float]]

    def labels(self, features: np.ndarray) -> np.ndarray:
        """The best labels of a text's lines (Viterbi); of equal ones, content."""
        scores = (features @ np.array(self.weights)).tolist()
        if not scores:
            return np.zeros(0, bool)
        (bb, bc), (cb, cc) = self.pairs
        b, c = self.start[0], self.start[1] + scores[0]
        from_b, from_c = [], []
        for s in scores[1:]:
            to_b, to_c = c + cb >= b + bb, c + cc >= b + bc
            from_b.append(to_b)
            from_c.append(to_c)
            b, c = (c + cb if to_b else b + bb), (c + cc if to_c else b + bc) + s
        found = [c >= b]
        for to_b, to_c in zip(reversed(from_b), reversed(from_c), strict=True):
            found.append(to_c if found[-1] else to_b)
        return np.array(found[::-1])


def likelihood(theta: np.ndarray, x: np.ndarray, y: np.ndarray, lengths: np.ndarray, chained: bool = True) -> tuple[float, np.ndarray]:
    """Mean log-likelihood a line of the labels y of lines with features x, and its gradient.

    The lines of all texts follow each other, texts by falling length. theta: the features' weights, two for the first
    label, four for pairs; an unchained field keeps the last six at 0.
    """
    n_features, n_texts, most = x.shape[1], len(lengths), int(lengths[0])
    w, start, pairs = theta[:n_features], theta[n_features : n_features + 2], theta[n_features + 2 :].reshape(2, 2)
    held = np.arange(most) < lengths[:, None]
    live = held.sum(axis=0)  # texts with more than t lines
    flat = x @ w
    e, forward, backward = np.zeros((n_texts, most)), np.zeros((n_texts, most, 2)), np.zeros((n_texts, most, 2))
    e[held] = flat
    forward[:, 0] = start
    forward[:, 0, 1] += e[:, 0]
    for t in range(1, most):
        k = live[t]
        forward[:k, t] = np.logaddexp(forward[:k, t - 1, :1] + pairs[0], forward[:k, t - 1, 1:] + pairs[1])
        forward[:k, t, 1] += e[:k, t]
    for t in range(most - 2, -1, -1):
        k = live[t + 1]
        ahead = backward[:k, t + 1].copy()
        ahead[:, 1] += e[:k, t + 1]
        backward[:k, t] = np.logaddexp(pairs[:, 0] + ahead[:, :1], pairs[:, 1] + ahead[:, 1:])
    last = forward[np.arange(n_texts), lengths - 1]
    z = np.logaddexp(last[:, 0], last[:, 1])
    forward, backward, of_text = forward[held], backward[held], np.repeat(z, lengths)  # a row per line from here on
    p = np.exp(forward + backward - of_text[:, None])
    gold = np.stack((1 - y, y), axis=1)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    later = np.setdiff1d(np.arange(len(x)), first)
    gradient = np.zeros_like(theta)
    gradient[:n_features] = x.T @ (y - p[:, 1])
    gradient[n_features : n_features + 2] = (gold[first] - p[first]).sum(axis=0)
    total = float(flat @ y + (gold[first] * start).sum() - z.sum())
    for i in range(2):
        for j in range(2):
            seen = float(gold[later - 1, i] @ gold[later, j])
            both = np.exp(forward[later - 1, i] + pairs[i, j] + backward[later, j] + j * flat[later] - of_text[later])
            total += seen * pairs[i, j]
            gradient[n_features + 2 + 2 * i + j] = seen - both.sum()
    if not chained:
        gradient[n_features:] = 0
    return total / len(x), gradient / len(x)


def trained(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, chained: bool = True) -> Field:
    """Ascend the likelihood less a quadratic penalty, with steps scaled by each weight's past gradients."""
    theta = np.zeros(x.shape[1] + 6)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, STEPS + 1):
        g = likelihood(theta, x, y, lengths, chained)[1] - PENALTY * theta
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        theta += RATE * (1 - k / (STEPS + 1)) * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    n = x.shape[1]
    return Field(tuple(theta[:n].tolist()), tuple(theta[n : n + 2].tolist()), tuple(map(tuple, theta[n + 2 :].reshape(2, 2).tolist())))


def fitted(texts: list[tuple[bool, np.ndarray]]) -> Field | None:
    """A field from (is the document good, features of its lines); None without lines of both kinds of documents."""
    texts = sorted((t for t in texts if len(t[1])), key=lambda t: -len(t[1]))
    if len({good for good, _ in texts}) < 2:
        return None
    lengths = np.array([len(f) for _, f in texts])
    x, good = np.concatenate([f for _, f in texts]).astype(np.float64), np.repeat([g for g, _ in texts], lengths)
    new = x[:, FEATURES.index("repeats")] == 0
    alone = trained(x, np.where(good, new, 0), lengths, chained=False)
    return trained(x, np.where(good | (x @ np.array(alone.weights) > 0), new, 0), lengths)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 5, remainder: int = 0, size: int = SAMPLE) -> Field | None:
    """Learn from labelled rows outside the held-out fold. A doc_id labelled both ways counts as good."""

    def packed(batches):
        for b in batches:
            found = [(good, f) for good, f in zip(b.column("label").to_pylist(), (lines(t).features for t in b.column("text").to_pylist()), strict=True) if 0 < len(f) <= SAMPLE_LINES]
            yield pa.RecordBatch.from_arrays([pa.array([g == 1 for g, _ in found], pa.bool_()), pa.array([np.packbits(f, axis=1).tobytes() for _, f in found], pa.binary())], ["good", "features"])

    sample = quality.labelled_sample(common.no_clash(docs, "doc_id", "text"), labels, label, mod, remainder, size).select("label", "text")
    rows = sample.mapInArrow(packed, "good boolean, features binary").collect()  # bounded by SAMPLE and SAMPLE_LINES
    width = (len(FEATURES) + 7) // 8
    unpack = lambda raw: np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, width), axis=1)[:, : len(FEATURES)]
    return fitted(sorted(((r.good, unpack(r.features)) for r in rows), key=lambda t: (t[0], t[1].tobytes())))


def labelled(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_content_lines, content_share.

    One row per row of docs, repeated rows and null identifiers included. Null and empty texts have no words, fail the plain
    rules and are not kept; their content share is 0. Texts of any length are read in pieces. Without a field (no labels to
    learn from) all lines are content. An empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                x = lines(text)
                good = field.labels(x.features) if field else np.ones(len(x.words), bool)
                share = float(x.words[good].sum() / x.n_words) if x.n_words else 0.0
                failed = x.n_words < LEAST_WORDS or 100 * x.n_repeat_words > MOST_REPEATED_PERCENT * x.n_words
                rows.append((x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, failed, not failed and share >= CONTENT_SHARE, len(x.words), int(good.sum()), share))
            columns = list(zip(*rows, strict=True)) or [()] * 10
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], NAMES)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_content_lines long, content_share double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_content_lines", "content_share"]


def op12_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return labelled(docs, fit(docs, common.table(spark, sf_dir, "labels")))

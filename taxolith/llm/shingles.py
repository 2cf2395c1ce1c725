"""Word shingles of a text as sorted 64-bit hashes, vectorised over the bytes of one text."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Texts are hashed in pieces of about so many bytes, cut between words.
PIECE = 1 << 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0], _powers[1]


def _piece_hashes(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    solid = np.concatenate(([False], (b != 32) & ((b < 9) | (b > 13)), [False]))
    turns = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = turns[::2], turns[1::2]
    power, inverse = _powers_to(len(b) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)])))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _ODD)


def word_hashes(text: str | None) -> np.ndarray:
    """A hash per word [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased, in order."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    if len(data) <= PIECE:
        return _piece_hashes(data)
    found, at = [], 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and data[end] not in b"\t\n\x0b\x0c\r ":
            end += 1
        found.append(_piece_hashes(data[at:end]))
        at = end
    return np.concatenate(found)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of fewer words, one of the whole sequence; of none, none."""
    words = word_hashes(text)
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        width = min(n, len(words))
        count = len(words) - width + 1
        total = np.full(count, np.uint64(width), np.uint64)
        for k in range(width):
            total = mix(total * _ODD + words[k : k + count])
    return np.unique(total)

"""Exact byte-pair encoding without a merge queue: backtracking over longest matches, and prefix tables of counts.

A token sequence is what merging gives if, and only if, every token and every two adjacent tokens come out of merging
unchanged. So an encoder may try, at each position, the longest token that an Aho-Corasick automaton finds, check it
against its neighbour by merging the two again, take shorter tokens next and step back when none is left; a bitfield
of positions from which the rest failed makes it linear. The same check gives, for every prefix of a text, its last
token from those of shorter prefixes, and with it the number of tokens.
"""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick

#: Remembered pairs of tokens and words; a full memory is emptied.
PAIRS, WORDS, LONGEST_WORD = 300_000, 300_000, 64


class Merges:
    """Tokens as strings; unit(s) cuts a string to first symbols; rank(a, b) of merging two symbols, None if they don't.

    Tokens that merging does not leave whole can't occur and are left out. With a mark end, tokens that end in it stand
    at the end of a text only, and the automaton knows them without it.
    """

    def __init__(self, ids: dict[str, int], rank: Callable[[str, str], int | None], units: Callable[[str], list[str]] = list, end: str = ""):
        self.ids, self.rank, self.units, self.end = ids, rank, units, end
        self.pairs: dict[tuple[str, str], bool] = {}
        stable = [t for t in ids if self.merged(t) == [t]]
        inside = {t for t in stable if not (end and t.endswith(end))}
        ending = {t.removesuffix(end): t for t in stable if end and t.endswith(end) and t != end}
        self.automaton = ahocorasick.Automaton()
        for text in inside | ending.keys():
            self.automaton.add_word(text, (len(text), text if text in inside else None, ending.get(text)))
        self.automaton.make_automaton()

    def merged(self, text: str) -> list[str]:
        """Merging itself: the best-ranked pair first, of equal ones the leftmost."""
        parts, rank = self.units(text), self.rank
        while len(parts) > 1:
            best = at = None
            for i in range(len(parts) - 1):
                r = rank(parts[i], parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, key: tuple[str, str]) -> bool:
        """Two adjacent tokens come out of merging their text as they are; remembered in pairs."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        left, right = key
        found = self.pairs[key] = self.merged(left + right) == [left, right]
        return found

    def encode(self, text: str) -> list[str]:
        """The tokens of a text all of whose first symbols are tokens (of a vocabulary without a mark)."""
        at: list[list[str]] = [[] for _ in text]
        for stop, (size, token, _) in self.automaton.iter(text):
            at[stop - size + 1].append(token)  # shorter ones come first
        pairs, compatible = self.pairs, self.compatible
        open_ = bytearray(b"\1") * (len(text) + 1)  # 0: from here the rest is known to fail
        tokens: list[str] = []
        tried: list[int] = []
        pos, choice = 0, len(at[0]) - 1 if text else 0
        while pos < len(text):
            options = at[pos]
            while choice >= 0:
                token = options[choice]
                if open_[pos + len(token)]:
                    if not tokens:
                        break
                    ok = pairs.get(key := (tokens[-1], token))
                    if compatible(key) if ok is None else ok:
                        break
                choice -= 1
            if choice >= 0:
                tokens.append(options[choice])
                tried.append(choice)
                pos += len(options[choice])
                choice = len(at[pos]) - 1 if pos < len(text) else 0
            elif tokens:
                open_[pos] = 0
                pos -= len(tokens.pop())
                choice = tried.pop() - 1
            else:
                raise ValueError(f"no token sequence for {text!r}")
        return tokens

    def prefix_counts(self, text: str) -> list[int]:
        """counts[k]: exact number of tokens of text[:k], with the mark of the end behind it if there is one."""
        n = len(text) + 1
        last, inner, counts = [""] * n, [0] * n, [0] * n
        pairs, compatible = self.pairs, self.compatible
        for stop, (size, token, ending) in self.automaton.iter(text):
            k, j = stop + 1, stop + 1 - size
            before = last[j]
            if j and not before:
                continue
            if token is not None and not last[k]:
                ok = pairs.get(key := (before, token)) if j else True
                if compatible(key) if ok is None else ok:
                    last[k], inner[k] = token, inner[j] + 1
            if ending is not None and not counts[k]:
                ok = pairs.get(key := (before, ending)) if j else True
                if compatible(key) if ok is None else ok:
                    counts[k] = inner[j] + 1
        return counts if self.end else inner


class Memory(dict):
    """value of make(word) for each word, remembered within bounds."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        found = self.make(word)
        if len(word) <= LONGEST_WORD:
            if len(self) >= WORDS:
                self.clear()
            self[word] = found
        return found

"""Text columns: canonical text, word sets, item codes, ids."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Texts that are turned at once: a batch of Arrow's may hold thousands of long ones.
FOLDED = 256


@F.arrow_udf(T.StringType())
def _folded(text: pa.Array) -> pa.Array:
    """NFKC and case folding, which no built-in function gives (lower() keeps ß and ligatures); plain ASCII is lower-cased."""

    def one(t: str | None) -> str | None:
        if t is None or t.isascii():
            return t and t.lower()
        return unicodedata.normalize("NFKC", t).translate({0x2205: "ø", 0x2300: "ø", 0xD8: "ø"}).casefold()

    # no more than a few hundred texts are Python's at a time
    parts = [pa.array([one(t) for t in text.slice(k, FOLDED).to_pylist()], pa.string()) for k in range(0, len(text), FOLDED)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def tail(folded: Column) -> Column:
    """Decimal comma to point between digits, blanks collapsed, trimmed."""
    pointed = F.regexp_replace(folded, r"(?<=\d),(?=\d)", ".")
    return F.trim(F.regexp_replace(pointed, r"(?U)\s+", " "))


def normalize(text: Column) -> Column:
    """Canonical text; idempotent; null stays null."""
    other = text.rlike(r"[^\x00-\x7F]")  # plain ASCII, the most of most tables, is not sent to Python
    return tail(F.coalesce(_folded(F.when(other, text)), F.lower(text)))


def lenient(text: Column) -> Column:
    """Blanks collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def header_key(name: str) -> str:
    """A header's name as aliases are looked up: NFKC, folded, without blanks, dots, dashes and underscores."""
    return "".join(c for c in unicodedata.normalize("NFKC", name).casefold() if not (c.isspace() or c in ".-_"))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"((?U)\w+)"), 1))


def evidence_in(evidence: Column, haystack: Column) -> Column:
    """At least one word, and every word of the evidence is a word of the haystack."""
    words = word_set(evidence)
    return (F.size(words) > 0) & (F.size(F.array_except(words, word_set(haystack))) == 0)


def code_segments(code: Column) -> Column:
    """Parts between dots, dashes and blanks; leading zeros of numbers go, letters are folded."""
    parts = F.filter(F.split(code, r"[.\-\s]+"), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(x.rlike("^[0-9]+$"), F.regexp_replace(x, r"^0+(?=\d)", "")).otherwise(F.lower(x)))


def strict_prefix(outer: Column, inner: Column) -> Column:
    return (F.size(outer) < F.size(inner)) & (F.slice(inner, 1, F.greatest(F.size(outer), F.lit(0))) == outer)


def path_text(path: Column) -> Column:
    """array<struct<item_no, text>> → "1 Title > 1.2 Section"."""
    return F.array_join(F.transform(path, lambda h: F.concat_ws(" ", F.when(h["item_no"] != "", h["item_no"]), F.when(h["text"] != "", h["text"]))), " > ")


def row_id(*columns: Column, size: int = 12) -> Column:
    """First hex digits of SHA-256 over values joined by U+001F."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *columns), 256), 1, size)


def line_id(position: Column, *cells: Column, size: int = 16) -> Column:
    """First hex digits of SHA-256 over the compact JSON list of a line's position and cells; null cells are blank."""
    rest = F.to_json(F.array(*[F.coalesce(c, F.lit("")) for c in cells]))
    return F.substring(F.sha2(F.concat(F.lit("["), position.cast("string"), F.lit(","), F.substring(rest, 2, 1 << 30)), 256), 1, size)


def estimated_tokens(text: Column) -> Column:
    """A token for every four characters begun."""
    return F.ceil(F.length(text) / 4.0)


def parsed_number(text: Column) -> Column:
    """A finite number, or null."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def blank_marker(text: Column) -> Column:
    """Cells that spell a missing value become blank."""
    return F.when(text.rlike(r"^(nan|NaN|None|NULL|<NA>|N/A)$"), "").otherwise(text)


def phrase_pattern(phrases: list[str]) -> str:
    """One alternation that finds any of the phrases between characters that are no letters, numbers or underscores."""
    import re

    word = r"[\p{L}\p{N}_]"
    return f"(?<!{word})(" + "|".join(re.escape(p) for p in sorted(phrases, key=len, reverse=True)) + f")(?!{word})"


def register(spark) -> None:
    """Named SQL functions for the text functions that need Python."""
    spark.udf.register("fold_text", _folded)

"""Canonical JSON of nested columns: keys sorted, no blanks, characters beyond ASCII kept. Byte for byte what
json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")) gives, as column expressions.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The short escapes of JSON; other control characters are \u and four lower-case digits.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once."""
    return F.transform(F.array(value), use)[0]


def quoted(text: Column) -> Column:
    """A JSON string."""
    out = text
    for char, escape in ESCAPES.items():
        out = F.replace(out, F.lit(char), F.lit(escape))
    rare = out
    for code in range(32):
        if chr(code) not in ESCAPES:
            rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), rare).otherwise(out), F.lit('"'))


def number(value: Column) -> Column:
    """A double by its shortest digits: plain from 1e-4 below 1e16, else with an exponent of two digits at least.

    Of two equally short texts of one double the JVM's is taken, which is not always the nearer one (some 1 in 20,000 doubles
    of random bits, all of 16 digits or more).
    """

    def parts(x: Column) -> Column:
        """The digits without point and outer zeros, and the exponent of the first one."""
        text = F.regexp_replace(F.abs(x).cast("string"), r"^([0-9.]+)$", "$1E0")
        digits = F.regexp_replace(F.regexp_extract(text, r"^([0-9.]+)E", 1), r"\.", "")
        lead = F.length(F.regexp_extract(text, r"^(\d+)", 1)) - 1
        zeros = F.length(F.regexp_extract(digits, "^(0*)", 1))
        return F.struct(F.regexp_replace(digits, "^0+|0+$", "").alias("d"), (F.regexp_extract(text, r"E(-?\d+)$", 1).cast("int") + lead - zeros).alias("e"))

    def shorter(x: Column, p: Column) -> Column:
        """One digit less where that still is the same double: the JVM does not always find the shortest."""
        n = F.length(p["d"])
        less = F.floor((p["d"].cast("decimal(20,0)") + 5) / 10).cast("string")
        e = p["e"] + F.length(less) - (n - 1)
        cut = F.struct(F.regexp_replace(less, "0+$", "").alias("d"), e.alias("e"))
        same = F.concat(F.lit("0."), less, F.lit("E"), (e + 1).cast("string")).cast("double") == F.abs(x)
        return F.when(same, cut).otherwise(p)

    def shown(p: Column) -> Column:
        d, e, n = p["d"], p["e"], F.length(p["d"])
        exponent = F.concat(F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
        scientific = F.concat(F.substring(d, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substr(d, F.lit(2)))).otherwise(""), exponent)
        plain = (
            F.when(e < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d))
            .when(e >= n - 1, F.concat(d, F.repeat(F.lit("0"), e - n + 1), F.lit(".0")))
            .otherwise(F.concat(F.substr(d, F.lit(1), e + 1), F.lit("."), F.substr(d, e + 2)))
        )
        return F.when((e < -4) | (e >= 16), scientific).otherwise(plain)

    def written(x: Column) -> Column:
        sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
        some = bound(parts(x), lambda p: bound(shorter(x, p), lambda q: bound(shorter(x, q), shown)))
        body = F.when(x == 0, "0.0").when(F.abs(x) == float("inf"), "Infinity").otherwise(some)
        return F.when(F.isnan(x), "NaN").otherwise(F.concat(sign, body))

    return bound(value.cast("double"), written)


def json_of(value: Column, kind: T.DataType) -> Column:
    """The canonical text of a column of the type; null is the word null. Maps need string keys; a type JSON lacks is refused."""
    if isinstance(kind, T.StringType):
        text = quoted(value)
    elif isinstance(kind, T.BooleanType | T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        text = value.cast("string")
    elif isinstance(kind, T.FloatType | T.DoubleType):
        text = number(value)
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: json_of(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        pair = lambda e: F.concat(quoted(e["key"]), F.lit(":"), json_of(e["value"], kind.valueType))
        keys = F.array_sort(F.map_keys(value))
        text = F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: pair(F.struct(k.alias("key"), F.element_at(value, k).alias("value")))), ","), F.lit("}"))
    elif isinstance(kind, T.StructType):
        text = object_of({f.name: json_of(value[f.name], f.dataType) for f in kind.fields})
    else:
        raise TypeError(f"JSON has no {kind.simpleString()}")
    return F.when(value.isNull(), "null").otherwise(text)


def object_of(texts: dict[str, Column]) -> Column:
    """An object of texts that are canonical already."""
    parts = [F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), texts[k]) for k in sorted(texts)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def canonical(df: DataFrame, column: str) -> Column:
    """The canonical text of one of df's columns."""
    return json_of(F.col(f"`{column}`"), df.schema[column].dataType)


@F.pandas_udf(T.StringType())
def reserialised(text: pd.Series) -> pd.Series:
    """JSON text of any shape in its canonical form; null where it is none or no object."""

    def one(t):
        try:
            value = json.loads(t)
        except (TypeError, ValueError, RecursionError):
            return None
        return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")) if isinstance(value, dict) else None

    known = {t: one(t) for t in text.unique()}
    return text.map(known)


def request_hash(requests: DataFrame) -> Column:
    """The key under which a request's answers are kept: SHA-256 of its content, whoever serves it and whichever lines it holds.

    requests: model, system_blocks (array of text, cache), schema_json, temperature, max_tokens, user_payload. A schema that
    is no JSON object is an error.
    """
    schema = reserialised(F.col("schema_json"))
    blocks = requests.schema["system_blocks"].dataType
    texts = {name: canonical(requests, name) for name in ("model", "max_tokens", "user_payload")}
    texts |= {"system_blocks": json_of(F.col("system_blocks"), blocks), "temperature": number(F.col("temperature")), "schema": F.coalesce(schema, F.raise_error(F.lit("schema_json is no JSON object")).cast("string"))}
    return F.sha2(object_of(texts), 256)


def transport_id(position: Column) -> Column:
    """The name of a line inside a batch."""
    return F.concat(F.lit("L"), position.cast("string"))

"""A taxonomy read from delimited files, with the guards that keep a broken file from being used; and tables to be scored."""

from __future__ import annotations

import csv
import io
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolith.functions import text
from taxolith.operators import taxonomy
from taxolith.sources import tables
from taxolith.sources.delimited import decoded, records

# The columns of a library and of tables to be scored by the names they may have (header_key() makes them
# comparable), how a rendered library is estimated, and its limits in tokens.
LEVELS = {"type": "material_type", "usage": "material_usage", "subtype": "material_subtype"}
KEYS = ("Item No.", "Item No", "N° article", "No article")
TRIPLES = {
    "labels": (("material_type", "type"), ("material_usage", "usage"), ("material_subtype", "subtype")),
    "suggested": (("suggested_type",), ("suggested_usage",), ("suggested_subtype",)),
    "suggested_2": (("suggested2_type",), ("suggested2_usage",), ("suggested2_subtype",)),
}
SINGLES = {"decision": ("decision",), "unit": ("unit", "unité", "unite"), "cost": ("cost_usd",), "latency": ("latency_ms",)}
CODE_REPEATS, LAYOUT_CHARS, CHARS_PER_TOKEN = 3, 24, 3
WARN_TOKENS, MOST_TOKENS = 30_000, 150_000


def library_rows(name: str, data: pa.Buffer) -> Iterator[tuple[int, str, str, str]]:
    """(line, type, usage, subtype) of one file, as it is read; a file without header, column or rows, or with a row that doesn't fit, is an error."""
    first = io.TextIOWrapper(pa.BufferReader(data), encoding="utf-8-sig", newline="\n").readline().removesuffix("\n")
    if not first.strip():
        raise ValueError(f"{name}: no header")
    lines = io.TextIOWrapper(pa.BufferReader(data), encoding="utf-8-sig", newline="")
    reader = csv.reader(lines, delimiter=";" if first.count(";") > first.count(",") else ",")
    header = [h.strip().casefold() for h in next(reader)]
    for column in LEVELS.values():
        if header.count(column) != 1:
            raise ValueError(f"{name}: {'no' if column not in header else 'more than one'} column {column}")
    at = [header.index(c) for c in LEVELS.values()]
    some = False
    for row in reader:
        if not any(c.strip() for c in row):
            continue
        if len(row) < len(header) or any(c.strip() for c in row[len(header) :]):
            raise ValueError(f"{name}: line {reader.line_num} has {len(row)} fields, the header {len(header)}")
        cells = [row[k] for k in at]
        if not cells[0].strip() or not cells[1].strip():
            raise ValueError(f"{name}: line {reader.line_num} has a blank type or usage")
        some = True
        yield reader.line_num, *cells
    if not some:
        raise ValueError(f"{name}: no rows")


ROWS = "file string, position int, type string, usage string, subtype string"
#: Rows of a file that are Python's at a time.
BATCH = 10_000


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """file, position, type, usage, subtype of library files, in the files' order of lines; see library_rows() for errors.

    A file's bytes are read where Arrow put them, and its rows are handed on in batches: neither its text nor its list of
    rows is ever whole in Python.
    """
    kinds = [("file", pa.string()), ("position", pa.int32()), *[(level, pa.string()) for level in LEVELS]]

    def run(batches):
        for b in batches:
            for name, content in zip(b.column("path"), b.column("content"), strict=True):
                for rows in itertools.batched(library_rows(name.as_py(), content.as_buffer()), BATCH):
                    columns = [[name.as_py()] * len(rows), *zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds, strict=True)], [k for k, _ in kinds])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ROWS)


def estimated_size(coded: DataFrame) -> DataFrame:
    """One row, tokens: what the rendered library is reckoned to take."""
    chars = CODE_REPEATS * F.length("code") + F.length("type") + F.length("usage") + F.length("subtype") + LAYOUT_CHARS
    return coded.agg(F.ceil(F.coalesce(F.sum(chars), F.lit(0)) / CHARS_PER_TOKEN).alias("tokens"))


@dataclass(frozen=True)
class Library:
    """rows: type, usage, subtype, parent, code, row_id, sole_child, generic_parent; repeated: rows that came more than once."""

    rows: DataFrame
    repeated: int
    tokens: int
    large: bool


def load_library(spark: SparkSession, path: str, most_tokens: int = MOST_TOKENS, warn_tokens: int = WARN_TOKENS) -> Library:
    """Read, deduplicate, code and measure a library. Different rows with one identifier, and a library too large, are errors.

    Ranks of codes follow canonical texts. The coded rows are written once, so that what is built on them doesn't read the
    files again.
    """
    read = read_library(spark, path)
    counted = tables.written(read.groupBy(*LEVELS).agg(F.count("*").alias("n"), F.min("position").alias("position")), "library_rows")
    coded = tables.written(taxonomy.structure(taxonomy.assign_codes(counted, text.normalize)), "library")
    clash = coded.groupBy("row_id").count().where("count > 1").limit(1).collect()
    if clash:
        raise ValueError(f"two rows have the identifier {clash[0].row_id}")
    tokens, repeated = estimated_size(coded).first().tokens, counted.agg(F.count_if(F.col("n") > 1).alias("r")).first().r
    if tokens > most_tokens:
        raise ValueError(f"the library takes some {tokens} tokens, more than {most_tokens}: take candidates from an index instead")
    return Library(coded, repeated, tokens, tokens > warn_tokens)


# --- tables to be scored --------------------------------------------------------------------------------------------


def column_at(header: list[str], names: tuple[str, ...]) -> int | None:
    """The first column that has one of the names, in the names' order."""
    keys = [text.header_key(h) for h in header]
    return next((keys.index(k) for k in map(text.header_key, names) if k in keys), None)


def resolved(header: list[str], key: str | None = None) -> dict[str, object]:
    """Where a table's columns are: key (by the given name if the table has it), triples that are whole, single columns."""
    own = column_at(header, (key,)) if key else None
    found: dict[str, object] = {"key": column_at(header, KEYS) if own is None else own}
    for name, levels in TRIPLES.items():
        at = [column_at(header, names) for names in levels]
        found[name] = None if None in at else at
    return found | {name: column_at(header, names) for name, names in SINGLES.items()}


def read_scored(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """position, key, labels, suggested, suggested_2 (structs of type, usage, subtype), decision, unit, cost, latency, nan_cells of a table.

    Columns that the table lacks are null; cells of labels that spell a missing value are blank and counted in nan_cells.
    """
    schema = "position int, key string, " + ", ".join(f"{t} struct<type:string,usage:string,subtype:string>" for t in TRIPLES) + ", decision string, unit string, cost double, latency double, nan_cells int"

    def run(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                _, rows = records(decoded(bytes(content))[0])
                if not rows:
                    raise ValueError(f"{name} is empty")
                at, out = resolved(rows[0], key), []
                cell = lambda row, k: row[k] if k is not None and k < len(row) else ("" if k is not None else None)
                for k, row in enumerate(rows[1:], 1):
                    triples, nans = [], 0
                    for t in TRIPLES:
                        cells = None if at[t] is None else [cell(row, i) for i in at[t]]
                        if cells is not None:
                            nans += sum(c in MISSING for c in cells)
                            cells = dict(zip(LEVELS, ["" if c in MISSING else c for c in cells], strict=True))
                        triples.append(cells)
                    out.append((k, cell(row, at["key"]), *triples, cell(row, at["decision"]), cell(row, at["unit"]), number(cell(row, at["cost"])), number(cell(row, at["latency"])), nans))
                yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in schema.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


#: How tables spell a missing value.
MISSING = ("nan", "NaN", "None", "NULL", "<NA>", "N/A")


def number(cell: str | None) -> float | None:
    """A finite number, or None."""
    try:
        value = float(cell)
    except (TypeError, ValueError):
        return None
    return value if abs(value) < float("inf") else None


def joined_pairs(reference: DataFrame, output: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Pairs as the scorer reads them: rows of the reference, each with its output row or none, by key; listed(key, class) names classes."""
    from taxolith.operators import review

    ref = reference.select("key", F.col("labels").alias("ref"), F.col("unit").alias("_unit"))
    out = output.select("key", F.col("labels").alias("out"), "suggested", "suggested_2", "decision", "unit", "cost", "latency", F.lit(True).alias("_there"))
    joined = ref.join(out, "key", "left")
    joined = joined.join(listed, "key", "left") if listed is not None else joined.withColumn("class", F.lit(None).cast("string"))
    level: dict[str, Column] = {k: F.coalesce(F.col(f"ref.{k}"), F.lit("")) for k in LEVELS}
    flat = joined.withColumns({f"_{k}": c for k, c in level.items()})
    klass = review.row_class([f"_{k}" for k in LEVELS], F.col("class"), F.col("_unit"), F.col("key"))
    decision = F.when(F.col("_there"), F.coalesce("decision", F.lit("")))
    return flat.withColumns({"class": klass, "decision": decision, "ref": F.struct(*[F.col(f"_{k}").alias(k) for k in LEVELS])}).drop("_unit", "_there", *[f"_{k}" for k in LEVELS])

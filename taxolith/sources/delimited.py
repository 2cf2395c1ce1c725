"""Delimited files as raw rows: encoding and delimiter found per file, positions kept, blanks never null; and their sink."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolith.functions.text import header_key, line_id
from taxolith.operators import structure

RAW = "file string, encoding string, delimiter string, position int, raw_row array<string>"

# Names of the five columns in English and French; header_key() makes them comparable.
ALIASES = {
    "item_no": ("Item No.", "Item number", "Item code", "N° article", "N° d'article", "No article", "Numéro d'article", "Numéro", "N°", "Réf", "Référence"),
    "short": ("Short Description", "Short desc", "Short", "Description courte", "Désignation", "Designation", "Libellé", "Libelle", "Intitulé"),
    "long": ("Long Description", "Long desc", "Long", "Description longue", "Description détaillée", "Descriptif", "Description"),
    "unit": ("Unit", "Units", "UoM", "Unité", "Unite", "Unités"),
    "qty": ("BoQ Qty", "BoQ Quantity", "Qty", "Quantity", "Quantité", "Quantite", "Qté", "Qte", "Qté BoQ"),
}


def decoded(data: bytes) -> tuple[str, str]:
    """UTF-8, with or without a mark, else Windows-1252."""
    try:
        return data.decode("utf-8-sig"), "utf-8"
    except UnicodeDecodeError:
        return data.decode("cp1252"), "cp1252"


def records(text: str, delimiter: str | None = None) -> tuple[str, list[list[str]]]:
    """The delimiter that splits the first record into more cells (a comma if neither), and all records but blank ones at the end."""
    if delimiter is None:
        width = lambda d: len(next(csv.reader(io.StringIO(text, newline=""), delimiter=d), []))
        delimiter = ";" if width(";") > width(",") else ","
    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter))
    while rows and not rows[-1]:
        rows.pop()
    return delimiter, rows


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, the header at position 0; a file is one record's list of a task, files are spread over tasks."""

    def run(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                text, encoding = decoded(bytes(content))
                delimiter, rows = records(text)
                for start in range(0, len(rows), 10_000):
                    part = rows[start : start + 10_000]
                    yield pd.DataFrame({"file": name, "encoding": encoding, "delimiter": delimiter, "position": range(start, start + len(part)), "raw_row": part})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, RAW)


def column_map(header: list[str], aliases: dict[str, tuple[str, ...]] = ALIASES) -> dict[str, int]:
    """Canonical column → cell number; a missing or doubly named column is an error."""
    keys = [header_key(h) for h in header]
    found = {name: [i for i, k in enumerate(keys) if k in {header_key(a) for a in names}] for name, names in aliases.items()}
    if missing := [n for n, at in found.items() if not at]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if twice := [n for n, at in found.items() if len(at) > 1]:
        raise ValueError(f"ambiguous columns: {', '.join(twice)}")
    return {n: at[0] for n, at in found.items()}


LINES = "file string, encoding string, delimiter string, header array<string>, position int, item_no string, short string, long string, unit string, qty string, extra map<string,string>, raw_row array<string>"


def fit(row: list[str], width: int, name: str, position: int) -> list[str]:
    """As many cells as the header: short rows are padded, blank cells too many are dropped, others are an error."""
    if any(cell.strip() for cell in row[width:]):
        raise ValueError(f"{name}: row {position} has more cells than the header")
    return row[:width] + [""] * (width - len(row))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, encoding, delimiter, header, position (from 1), item_no, short, long, unit, qty, extra, raw_row of files with one header each.

    A file's header is resolved where the file is parsed. extra has the cells of other columns by name; raw_row is the row
    as it is written again, of no cells for a blank line. Files without a header, without a column or with a row that is too
    long are errors.
    """

    def run(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                text, encoding = decoded(bytes(content))
                delimiter, rows = records(text)
                if not rows:
                    raise ValueError(f"no header in {name}")
                header, at = rows[0], column_map(rows[0])
                others = [k for k in range(len(header)) if k not in at.values()]
                for start in range(1, len(rows), 10_000):
                    part = []
                    for k, row in enumerate(rows[start : start + 10_000], start):
                        cells = fit(row, len(header), name, k)
                        part.append((name, encoding, delimiter, header, k, *[cells[at[c]] for c in ALIASES], {header[o]: cells[o] for o in others}, cells if row else []))
                    yield pd.DataFrame(part, columns=[f.split(" ")[0] for f in LINES.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, LINES)


def read_boq(spark: SparkSession, path: str, header_patterns: tuple[str, ...] = ()) -> DataFrame:
    """read_lines() with line_id, kind, path (outermost header first), oversized: names of fields beyond their caps.

    Files with a code take their paths from codes, the others from runs of titles; both kinds may lie in one folder.
    """
    raw = read_lines(spark, path)
    shaped = raw.select("file", "position", F.col("item_no").alias("code"), F.col("short").alias("text"), "long", "unit", "qty")
    rows = structure.classified(shaped, list(header_patterns))
    found = structure.paths(rows).select("file", "position", "path")
    joined = raw.join(rows.select("file", "position", "kind", F.array_join(structure.oversized(), ",").alias("_over")), ["file", "position"]).join(found, ["file", "position"])
    over = F.transform(F.filter(F.split("_over", ","), lambda n: n != ""), lambda n: F.when(n == "code", "item_no").when(n == "text", "short").otherwise(n))
    # positions in identifiers count from 0
    return joined.select(raw["*"], line_id(F.col("position") - 1, F.col("item_no"), F.col("short"), F.col("long")).alias("line_id"), "kind", "path", over.alias("oversized"))


def csv_line(columns: list[str], delimiter: str = ",") -> Column:
    """A record with quotes only where they are needed, quotes doubled."""
    def cell(c):
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(v.rlike(f'["\\r\\n{delimiter}]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    return F.concat_ws(delimiter, *map(cell, columns))


def write_csv(df: DataFrame, path: str, order: str, files: int | None = None) -> None:
    """CRLF lines in order; part files follow each other in the order of their names. The header is the first part's first line."""
    columns = [c for c in df.columns if c != order]
    head = df.sparkSession.createDataFrame([(None, ",".join(columns))], df.select(order).schema.add("value", "string"))
    body = df.select(order, csv_line(columns).alias("value"))
    sorted_ = head.unionAll(body)
    n = files or max(1, sorted_.rdd.getNumPartitions() - 1)
    sorted_.repartitionByRange(n, F.col(order).asc_nulls_first()).sortWithinPartitions(F.col(order).asc_nulls_first()).select("value").write.option("lineSep", "\r\n").text(path)

"""Recorded runs: parts as tables partitioned by run, a manifest written last, comparison by digests, caches and audits.

A run is seen once its manifest is there: parts are staged, moved into place as whole folders, and counted while they are
written. Digests don't depend on order, so two runs are compared without a sort.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxolith.functions import canonical

MANIFEST = "run string, mode string, provider string, model string, parts map<string,struct<rows:bigint,digest:string>>"


def row_digest(df: DataFrame) -> Column:
    """The first 60 bits of the SHA-256 of each row's canonical JSON, as a number that can be summed."""
    text = canonical.object_of({f.name: canonical.json_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields})
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(20,0)")


def counters(df: DataFrame) -> list[Column]:
    """rows and digest of a table: the same whatever the order of its rows or partitions."""
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_digest(df)).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest")]


def _move(spark: SparkSession, source: str, target: str) -> None:
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(b.getParent())
    if fs.exists(b):
        raise FileExistsError(f"the run has a part at {target}")
    if not fs.rename(a, b):
        raise OSError(f"cannot move {source} to {target}")


def write_run(root: str, run: str, parts: dict[str, DataFrame], mode: str, provider: str, model: str, sort: dict[str, str] | None = None) -> dict[str, tuple[int, str]]:
    """Write a run's parts and then its manifest; returns rows and digest of each part, observed during the write.

    sort names a column for each part by which its files are ranged and sorted, so that a look-up of one value skips files.
    A run that exists is never written over; one without a manifest, left by a failure, must be removed first.
    """
    if not re.fullmatch(r"[\w.-]+", run):
        raise ValueError(f"{run!r} is no plain folder name")
    found = {}
    for name, df in parts.items():
        spark = df.sparkSession
        by = (sort or {}).get(name)
        ranged = df.repartitionByRange(F.col(by)).sortWithinPartitions(by) if by else df
        seen = Observation()
        ranged.observe(seen, *counters(ranged)).write.mode("overwrite").parquet(f"{root}/_staging/{run}/{name}")
        _move(spark, f"{root}/_staging/{run}/{name}", f"{root}/{name}/run={run}")
        found[name] = (seen.get["rows"], seen.get["digest"])
    row = (mode, provider, model, {n: {"rows": r, "digest": d} for n, (r, d) in found.items()})
    spark.createDataFrame([row], MANIFEST.removeprefix("run string, ")).coalesce(1).write.mode("overwrite").parquet(f"{root}/_staging/{run}/manifest")
    _move(spark, f"{root}/_staging/{run}/manifest", f"{root}/manifests/run={run}")
    return found


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """run, mode, provider, model, parts: a row for each run."""
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifests")


def part(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """A part of all runs, with run as a column that prunes folders."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("run", T.StringType())])).parquet(f"{root}/{name}")


def manifest_problems(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """run, problem of runs whose part isn't what their manifest says: other rows or another digest. None if all is well."""
    rows = part(spark, root, name, schema)
    there = rows.groupBy("run").agg(*counters(rows.drop("run")))
    said = manifests(spark, root).select("run", F.col("parts")[name]["rows"].alias("said_rows"), F.col("parts")[name]["digest"].alias("said_digest"))
    problem = F.when(F.col("said_rows").isNull(), "no manifest").when(F.coalesce("rows", F.lit(0)) != F.col("said_rows"), "rows").when(F.coalesce("digest", F.lit("0")) != F.col("said_digest"), "digest")
    return said.join(there, "run", "full").select("run", problem.alias("problem")).where("problem IS NOT NULL")


def replay_verdicts(spark: SparkSession, root: str, name: str, first: str) -> DataFrame:
    """run, rows, digest, same: does each run's part equal that of the first run, by the manifests alone."""
    told = manifests(spark, root).select("run", F.col("parts")[name].alias("p"))
    base = told.where(F.col("run") == first).select(F.col("p").alias("base"))
    return told.crossJoin(F.broadcast(base)).select("run", F.col("p.rows").alias("rows"), F.col("p.digest").alias("digest"), (F.col("p") == F.col("base")).alias("same"))  # base is one row


def changed_cells(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, column, before, after of every cell that differs, nulls included; a row that one side lacks differs in column `row`."""
    text = lambda side, c: F.col(f"{side}.{c}").cast("string")
    a, b = before.select(key, F.struct(*columns).alias("a")), after.select(key, F.struct(*columns).alias("b"))
    one_sided = F.col("a").isNull() != F.col("b").isNull()
    row = F.struct(F.lit("row").alias("column"), F.when(F.col("a").isNotNull(), "there").alias("before"), F.when(F.col("b").isNotNull(), "there").alias("after"))
    cells = [F.when(~one_sided & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.struct(F.lit(c).alias("column"), text("a", c).alias("before"), text("b", c).alias("after"))) for c in columns]
    return a.join(b, key, "full").select(key, F.inline(F.array_compact(F.array(F.when(one_sided, row), *cells))))


# --- cache ----------------------------------------------------------------------------------------------------------


def admitted(spark: SparkSession, root: str, provider: str, model: str) -> DataFrame:
    """Runs whose answers may be served again: live ones of the provider that asked for the model."""
    return manifests(spark, root).where((F.col("mode") == "live") & (F.col("provider") == provider) & (F.col("model") == model)).select("run")


def load_cache(spark: SparkSession, root: str, provider: str, model: str, schema: T.StructType) -> DataFrame:
    """request_hash, occ, response, source: recorded answers in the order of runs and calls; the k-th serves the k-th request.

    Manifests are joined first: folders of other runs are pruned before any call is read. Of the runs that are admitted only
    calls count that the same provider and model answered, and none that was served from a cache itself.
    """
    calls = part(spark, root, "calls", schema).join(F.broadcast(admitted(spark, root, provider, model)), "run", "left_semi")  # a row for each run
    own = calls.where(~F.col("cache_hit") & (F.col("response_provider") == provider) & (F.col("response_model") == model))
    occ = F.row_number().over(Window.partitionBy("request_hash").orderBy("run", "ord", "call_id")) - 1
    return own.select("request_hash", occ.cast("long").alias("occ"), "response", F.col("run").alias("source"))


# --- audit ----------------------------------------------------------------------------------------------------------


def pass_answers(raw: Column) -> Column:
    """Answers of passes numbered from 1: body is canonical JSON where the text is an object, else null; raw is the text."""
    return F.transform(raw, lambda t, k: F.struct((k + 1).alias("pass"), F.when(F.try_parse_json(t).isNotNull() & t.rlike(r"^\s*\{"), t).alias("body"), t.alias("raw")))


def audit_view(lines: DataFrame, calls: DataFrame, library: DataFrame) -> DataFrame:
    """Each line of lines(line_id, decision, top1, raw) with its passes, its calls in order, and its row of the library.

    An empty code has no row; an unknown one a row that says so.
    """
    fields = [c for c in ("ord", "call_id", "request_hash", "cache_hit", "latency_ms") if c in calls.columns]
    made = calls.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("calls"))
    rows = library.select(F.col("code").alias("top1"), F.struct("code", "name", F.lit(True).alias("in_library")).alias("row"))
    unknown = F.struct(F.col("top1").alias("code"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("in_library"))
    joined = lines.join(made, "line_id", "left").join(rows, "top1", "left")
    return joined.select("line_id", "item_no", "decision", F.when(F.col("top1") != "", F.coalesce("row", unknown)).alias("row"), pass_answers(F.col("raw")).alias("passes"), F.coalesce("calls", F.array().cast(made.schema["calls"].dataType)).alias("calls"))


def explain_item(spark: SparkSession, root: str, run: str, item: str, lines: T.StructType, calls: T.StructType, library: DataFrame) -> DataFrame:
    """The audit of one line of a run, by its number or id; unknown and ambiguous items are errors.

    Run and line are filters on every part, so that folders and, where parts are sorted, files are skipped.
    """
    of_run = F.col("run") == run
    found = part(spark, root, "lines", lines).where(of_run & ((F.col("item_no") == item) | (F.col("line_id") == item))).limit(2)
    ids = [r.line_id for r in found.select("line_id").collect()]  # at most two
    if len(ids) != 1:
        raise LookupError(f"{item!r} is {'ambiguous' if ids else 'unknown'} in run {run}")
    own = of_run & (F.col("line_id") == ids[0])
    return audit_view(part(spark, root, "lines", lines).where(own), part(spark, root, "calls", calls).where(own), library)

"""Structure of a list of lines: kinds of rows, section paths, batches. Columns: file, position, code, unit, qty, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolith.functions.text import code_segments, strict_prefix


def blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit(""))) == ""


def classified(rows: DataFrame, header_patterns: list[str] = ()) -> DataFrame:
    """rows with kind: empty_row, item, header or header_unconfirmed; a header's code matches a pattern whole or is a strict prefix of the next code below."""
    # what texts say is settled before rows are sorted: texts then move only where they are asked for
    named = F.lit(False)
    for p in header_patterns:
        named = named | F.coalesce(F.col("code"), F.lit("")).rlike(f"^(?:{p})$")
    told = {"_coded": ~blank("code"), "_measured": ~(blank("unit") & blank("qty")), "_empty": blank("code") & blank("text") & blank("unit") & blank("qty"), "_named": named, "_segments": code_segments(F.trim("code"))}
    # read upwards, the nearest code below is the last one seen: a running frame, not one taken anew for every row
    below = Window.partitionBy("file").orderBy(F.desc("position")).rowsBetween(Window.unboundedPreceding, -1)
    next_segments = F.last(F.when(F.col("_coded"), F.col("_segments")), ignorenulls=True).over(below)
    prefix = strict_prefix(F.col("_segments"), F.coalesce("_next", F.array().cast("array<string>")))
    kind = F.when(F.col("_empty"), "empty_row").when(F.col("_measured"), "item").when(~F.col("_coded"), "header_unconfirmed").when(F.col("_named") | ((F.size("_segments") > 0) & F.coalesce(prefix, F.lit(False))), "header").otherwise("header_unconfirmed")
    return rows.withColumns(told).withColumn("_next", next_segments).withColumn("kind", kind).drop("_next", *told)


PATH = "array<struct<item_no:string,text:string>>"


def section_paths(rows: DataFrame) -> DataFrame:
    """file, position, path: the headers above a row whose code is a strict prefix of its own and that no header between them ended.

    A header is open as long as the headers after it, without a gap, extend its code. Headers are numbered in each file and
    listed under all their prefixes: under one prefix, numbers that follow each other from a header of just that code are its
    stretch. A row asks under each of its strict prefixes for the last number before it: if that is listed there, its stretch
    is open. So rows meet the one header that answers by equality; only headers are ordered within a prefix.
    """
    coded = rows.select("file", "position", "code", "text", "kind", code_segments(F.coalesce("code", F.lit(""))).alias("seg"))
    above = Window.partitionBy("file").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    is_head = F.col("kind") == "header"
    coded = coded.withColumn("before", F.coalesce(F.sum(is_head.cast("long")).over(above), F.lit(0)))
    prefixes = lambda least, most: F.transform(F.filter(F.sequence(F.lit(0), F.size("seg")), lambda n: (n >= least) & (n <= most)), lambda n: F.slice(F.col("seg"), 1, n))
    title = F.struct(F.col("position").alias("at"), F.col("code").alias("item_no"), "text")
    heads = coded.where(is_head & (F.size("seg") > 0)).select("file", F.explode(prefixes(1, F.size("seg"))).alias("prefix"), (F.col("before") + 1).alias("number"), "seg", title.alias("title"))
    heads = heads.withColumn("title", F.when(F.col("prefix") == F.col("seg"), F.col("title"))).drop("seg")
    w = Window.partitionBy("file", "prefix").orderBy("number")
    begins = F.col("title").isNotNull() | F.coalesce(F.lag("number").over(w) != F.col("number") - 1, F.lit(True))
    stretches = heads.withColumn("_begins", begins).withColumn("open", F.last(F.when(F.col("_begins"), F.struct("title")), ignorenulls=True).over(w)["title"])
    asked = coded.select("file", F.explode(prefixes(1, F.size("seg") - 1)).alias("prefix"), F.col("before").alias("number"), "position")
    found = asked.join(stretches.where("open is not null").select("file", "prefix", "number", "open"), ["file", "prefix", "number"])
    paths = found.groupBy("file", "position").agg(F.array_sort(F.collect_list("open")).alias("path"))
    joined = rows.select("file", "position").join(paths, ["file", "position"], "left")
    return joined.select("file", "position", F.coalesce(F.transform("path", lambda h: F.struct(h["item_no"].alias("item_no"), h["text"].alias("text"))), F.array().cast(PATH)).alias("path"))


def context_runs(rows: DataFrame) -> DataFrame:
    """rows of files without codes with is_context, run (number of the last run begun) and place (of a context row in its run, from 0).

    Context rows are unconfirmed headers with a title and no long text that a filled row follows. Empty rows are
    transparent: they neither break nor extend a run.
    """
    w = Window.partitionBy("file").orderBy("position")
    above = w.rowsBetween(Window.unboundedPreceding, -1)
    filled = F.col("kind") != "empty_row"
    last = F.max(F.when(filled, F.col("position"))).over(Window.partitionBy("file"))
    context = (F.col("kind") == "header_unconfirmed") & F.col("_title") & (F.col("position") < last)
    flagged = rows.withColumn("_title", ~blank("text") & blank("long")).withColumn("is_context", F.coalesce(context, F.lit(False))).drop("_title")
    behind = F.last(F.when(filled, F.col("is_context")), ignorenulls=True).over(above)
    begun = flagged.withColumn("_begins", F.col("is_context") & ~F.coalesce(behind, F.lit(False)))
    counted = begun.withColumns({"run": F.sum(F.col("_begins").cast("long")).over(w), "_seen": F.coalesce(F.sum(F.col("is_context").cast("long")).over(above), F.lit(0))})
    at_begin = F.last(F.when(F.col("_begins"), F.col("_seen")), ignorenulls=True).over(w)
    return counted.withColumn("place", F.when(F.col("is_context"), F.col("_seen") - at_begin)).drop("_begins", "_seen")


def codeless_paths(rows: DataFrame) -> DataFrame:
    """file, position, kind, is_context, run, path of files without codes: a run of n titles fills the innermost n of the file's levels.

    The file's depth is its longest run. After run k the path has min(depth, titles so far) levels, of which the run's own
    are the innermost; each level above keeps the last title it had. Levels are filled run by run, not row by row: a row's
    path is the beginning of its run's.
    """
    marked = context_runs(rows)
    title = F.struct("position", F.col("code").alias("item_no"), "text")
    runs = marked.where("is_context").groupBy("file", "run").agg(F.array_sort(F.collect_list(title)).alias("titles"))
    of_file, so_far = Window.partitionBy("file"), Window.partitionBy("file").orderBy("run")
    n = F.size("titles").cast("long")
    sized = runs.withColumns({"levels": F.least(F.max(n).over(of_file), F.sum(n).over(so_far)), "n": n})
    each = sized.select("file", "run", "levels", "n", F.posexplode(F.concat(F.array_repeat(F.lit(None).cast(marked.select(title.alias("t")).schema["t"].dataType), (F.col("levels") - F.col("n")).cast("int")), "titles")).alias("level", "title"))
    kept = F.last("title", ignorenulls=True).over(Window.partitionBy("file", "level").orderBy("run"))
    stacks = each.withColumn("title", kept).groupBy("file", "run").agg(F.first("levels").alias("levels"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("level", "title"))).alias("stack"))
    joined = marked.select("file", "position", "kind", "is_context", "run", "place").join(stacks, ["file", "run"], "left")
    length = F.when(F.col("kind") == "empty_row", 0).when(F.col("is_context"), F.col("levels") - F.col("n") + F.col("place")).otherwise(F.col("levels"))
    path = F.transform(F.slice("stack", F.lit(1), F.coalesce(length, F.lit(0)).cast("int")), lambda x: F.struct(x["title"]["item_no"].alias("item_no"), x["title"]["text"].alias("text")))
    return joined.select("file", "position", "kind", "is_context", "run", F.coalesce(path, F.array().cast(PATH)).alias("path"))


def paths(rows: DataFrame) -> DataFrame:
    """file, position, path: by codes in files that have any, by runs of titles in the others."""
    coded = F.max((~blank("code")).cast("int")).over(Window.partitionBy("file")) == 1
    marked = rows.withColumn("_coded", coded)
    with_codes, without = (marked.where(c).drop("_coded") for c in (F.col("_coded"), ~F.col("_coded")))
    return section_paths(with_codes).unionByName(codeless_paths(without).select("file", "position", "path"))


#: Characters of a field that are kept for a request.
CAPS = {"code": 64, "text": 1_000, "long": 4_000}


def oversized(caps: dict[str, int] = CAPS) -> Column:
    """Names of the fields that exceed their cap, in the caps' order."""
    return F.array_compact(F.array(*[F.when(F.length(n) > cap, F.lit(n)) for n, cap in caps.items()]))


def capped(rows: DataFrame, caps: dict[str, int] = CAPS) -> DataFrame:
    """rows with their capped fields cut, and truncated: was any cut."""
    return rows.withColumns({"truncated": F.size(oversized(caps)) > 0} | {n: F.substring(n, 1, cap) for n, cap in caps.items()})


def batches(lines: DataFrame, size: int, group: str = "file", order: str = "position", path: str = "path") -> DataFrame:
    """lines with island and batch_no: adjacent lines under one path, cut at size."""
    w = Window.partitionBy(group).orderBy(order)
    continues = (F.col(order) == F.lag(order).over(w) + 1) & F.col(path).eqNullSafe(F.lag(path).over(w))
    marked = lines.withColumn("_new", F.when(F.coalesce(continues, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("_new").over(w)).drop("_new")
    return marked.withColumn("batch_no", F.floor((F.row_number().over(Window.partitionBy(group, "island").orderBy(order)) - 1) / size))

"""Structure of files without codes: a document is a file, its lines are the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolith.functions import text
from taxolith.operators import structure
from taxolith.plans.queries import query, table

LINES = """WITH RECURSIVE split_ AS (SELECT doc_id AS file, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT file, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS position FROM split_),
k AS (SELECT *, CASE WHEN trim(line, ' ') = '' THEN 'empty_row' WHEN length(line) % 5 < 2 THEN 'item' ELSE 'header_unconfirmed' END AS kind FROM l),
c AS (SELECT *, coalesce(kind = 'header_unconfirmed' AND length(line) % 5 > 2 AND position < max(position) FILTER (WHERE kind <> 'empty_row') OVER (PARTITION BY file), false) AS ctx FROM k),
"""


def lines_of(spark, sf_dir) -> DataFrame:
    """Lines of documents as rows without codes: two of five lengths are items, one has a long text, the others may be titles."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("position", "text"))
    some, k = F.trim("text") != "", F.length("text") % 5
    when = lambda c, value: F.when(some & c, value).otherwise("")
    return rows.select("file", "position", F.lit("").alias("code"), "text", when(k == 2, "note").alias("long"), when(k < 2, "m").alias("unit"), when(k < 2, "1").alias("qty"))


@query(LINES + """f AS (SELECT file, position, ctx, ctx AND NOT coalesce(lag(ctx) OVER (PARTITION BY file ORDER BY position), false) AS begins FROM c WHERE kind <> 'empty_row'),
g AS (SELECT *, sum(begins::INT) OVER (PARTITION BY file ORDER BY position) AS run FROM f),
n AS (SELECT file, run, count(*) AS n, min(position) AS position FROM g WHERE ctx GROUP BY 1, 2),
a AS (SELECT c.file, c.position, line, kind, ctx, coalesce(n.n, 0) AS n, max(n.n) OVER (PARTITION BY c.file) AS depth, sum((n.n IS NOT NULL)::INT) OVER (PARTITION BY c.file ORDER BY c.position)::BIGINT AS run FROM c LEFT JOIN n USING (file, position)),
s AS (SELECT DISTINCT file, -1::BIGINT AS position, []::VARCHAR[] AS path, []::VARCHAR[] AS stack FROM c
  UNION ALL SELECT file, position, CASE WHEN kind = 'empty_row' THEN [] ELSE t END, CASE WHEN ctx THEN list_append(t, line) ELSE t END
  FROM (SELECT a.file, a.position, kind, ctx, line, CASE WHEN n > 0 THEN s.stack[1:greatest(depth - n, 0)] ELSE s.stack END AS t FROM s JOIN a ON a.file = s.file AND a.position = s.position + 1))
SELECT a.file AS doc_id, a.position, a.kind, a.ctx AS is_context, a.run, len(path)::INT AS depth, md5(array_to_string(path, ' > ')) AS path_md5 FROM a JOIN s USING (file, position)""")
def codeless_paths(spark, sf_dir):
    """Section paths of documents' lines from runs of titles, with the rows' kinds, flags and runs."""
    found = structure.codeless_paths(structure.classified(lines_of(spark, sf_dir)))
    return found.select(
        F.col("file").alias("doc_id"), F.col("position").cast("long"), "kind", "is_context", "run", F.size("path").alias("depth"), F.md5(text.path_text(F.col("path"))).alias("path_md5")
    )


@query("""SELECT page_id, concat_ws(',', CASE WHEN length(url) > 64 THEN 'code' END, CASE WHEN length(html) > 1000 THEN 'text' END, CASE WHEN length(html) > 4000 THEN 'long' END) AS oversized,
  coalesce(length(url) > 64, false) OR coalesce(length(html) > 1000, false) AS truncated, md5(html[1:1000]) AS text_md5, md5(html[1:4000]) AS long_md5 FROM pages""")
def capped_fields(spark, sf_dir):
    """Fields of pages that exceed their caps, and what is left of them."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("code"), F.col("html").alias("text"), F.col("html").alias("long"))
    over = rows.withColumn("oversized", F.array_join(structure.oversized(), ","))
    return structure.capped(over).select("page_id", "oversized", "truncated", F.md5("text").alias("text_md5"), F.md5("long").alias("long_md5"))

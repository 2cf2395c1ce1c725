"""Equivalents on a taxonomy's nodes, and what is rendered from them; the taxonomy is the parts'."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolith.operators import enrich, requests, taxonomy
from taxolith.plans.queries import TAXONOMY, query, table, taxonomy_of
from taxolith.sources import library, tables
from taxolith.sources.delimited import csv_line

ALSO = TAXONOMY + """, leaf AS (SELECT p_type AS type, p_brand AS usage, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END AS subtype, 'size ' || p_size AS kind, p_name, p_size FROM part),
eq AS (SELECT type, NULL::VARCHAR AS usage, NULL::VARCHAR AS subtype, list_sort(list(DISTINCT p_name)) AS also FROM leaf WHERE p_size % 3 = 0 GROUP BY 1 UNION ALL SELECT type, usage, NULL, list_sort(list(DISTINCT kind)) FROM leaf WHERE p_size % 5 = 0 GROUP BY 1, 2
  UNION ALL SELECT type, usage, subtype, list_sort(list(DISTINCT kind)) FROM leaf WHERE p_size % 4 = 0 GROUP BY 1, 2, 3),
nodes AS (SELECT DISTINCT split_part(code, '.', 1) AS node, type, NULL::VARCHAR AS usage, NULL::VARCHAR AS subtype FROM coded UNION SELECT parent, type, usage, NULL FROM coded UNION SELECT code, type, usage, subtype FROM coded),
also AS (SELECT node, coalesce(also, []) AS also FROM nodes n LEFT JOIN eq e ON n.type = e.type AND n.usage IS NOT DISTINCT FROM e.usage AND n.subtype IS NOT DISTINCT FROM e.subtype)
"""


def equivalents_of(spark, sf_dir) -> DataFrame:
    """Lists on three levels: names of a type's parts, sizes of a usage's and of a row's."""
    part = table(spark, sf_dir, "part").select(F.col("p_type").alias("type"), F.col("p_brand").alias("usage"), F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_name")).alias("subtype"), F.concat(F.lit("size "), "p_size").alias("kind"), "p_name", "p_size")
    none = F.lit(None).cast("string")
    some = lambda k, c, *by: part.where(F.col("p_size") % k == 0).groupBy(*by).agg(F.array_sort(F.collect_set(c)).alias("also"))
    types, usages, rows = some(3, "p_name", "type"), some(5, "kind", "type", "usage"), some(4, "kind", "type", "usage", "subtype")
    return types.select("type", none.alias("usage"), none.alias("subtype"), "also").unionByName(usages.select("type", "usage", none.alias("subtype"), "also")).unionByName(rows)


@query(ALSO + "SELECT node AS code, array_to_string(also, ';') AS also FROM also")
def code_equivalents(spark, sf_dir):
    return enrich.code_also(taxonomy_of(spark, sf_dir), equivalents_of(spark, sf_dir)).withColumn("also", F.array_join("also", ";"))


@query(ALSO + """, f AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY code) = 1 AS ft, row_number() OVER (PARTITION BY type, usage ORDER BY code) = 1 AS fu FROM coded),
l AS (SELECT type, code, 0 AS k, split_part(code, '.', 1) AS node, '' AS pad, type AS label FROM f WHERE ft UNION ALL SELECT type, code, 1, parent, '  ', usage FROM f WHERE fu UNION ALL SELECT type, code, 2, code, '    ', subtype FROM f)
SELECT split_part(code, '.', 1) AS type_code, sha256(string_agg(pad || l.node || CASE WHEN label <> '' THEN ' ' || label ELSE '' END || CASE WHEN len(also) > 0 THEN ' [also: ' || array_to_string(also, '; ') || ']' ELSE '' END, chr(10) ORDER BY code, k)) AS document_sha256 FROM l JOIN also USING (node) GROUP BY 1""")
def enriched_tree(spark, sf_dir):
    tree = enrich.enriched_tree(taxonomy_of(spark, sf_dir), equivalents_of(spark, sf_dir))
    return tree.select("type_code", F.sha2("document", 256).alias("document_sha256"))


#: The parts' types and brands alone: a library small enough to be sent along with every request.
COARSE = TAXONOMY.replace("CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END AS subtype", "'' AS subtype")


@query(COARSE + """, l AS (SELECT doc_id // 20 AS batch, doc_id, (SELECT list(type ORDER BY type) FROM t)[n_chars % (SELECT count(*) FROM t) + 1] AS type, '{"id": "L' || doc_id || '", "long": ' || to_json(text)::VARCHAR || ', "path": "' || lang || ' > <x>", "short": ' || to_json(source)::VARCHAR || ', "unit": ""}' AS rec FROM documents),
a AS (SELECT batch, type, string_agg(rec, ', ' ORDER BY doc_id) AS x FROM l GROUP BY 1, 2),
b AS (SELECT type, string_agg('{"code": "' || code || '", "subtype": ' || to_json(subtype)::VARCHAR || ', "usage": ' || to_json(usage)::VARCHAR || '}', ', ' ORDER BY code) AS y FROM coded GROUP BY 1)
SELECT batch, type, sha256(replace(replace(replace('{"candidates": [' || y || '], "lines": [' || x || '], "type": ' || to_json(type)::VARCHAR || '}', '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026')) AS payload_sha256 FROM a JOIN b USING (type)""")
def verifier_payloads(spark, sf_dir):
    """Documents as flagged lines of the parts' types, batches of 20, each type's lines of a batch with its rows in one request."""
    coded = taxonomy.assign_codes(table(spark, sf_dir, "part").select(F.col("p_type").alias("type"), F.col("p_brand").alias("usage"), F.lit("").alias("subtype")))
    types = coded.select("type").distinct().agg(F.array_sort(F.collect_list("type")).alias("types"))  # a dictionary: one row
    docs = table(spark, sf_dir, "documents").crossJoin(F.broadcast(types))
    lines = docs.select(
        F.floor(F.col("doc_id") / 20).alias("batch"), F.col("doc_id").alias("position"), F.concat(F.lit("L"), "doc_id").alias("id"), F.get("types", (F.col("n_chars") % F.size("types")).cast("int")).alias("type"),
        F.concat("lang", F.lit(" > <x>")).alias("path"), F.col("source").alias("short"), F.col("text").alias("long"), F.lit("").alias("unit"),
    )
    return requests.verifier_payload(lines, coded).select("batch", "type", F.sha2("payload", 256).alias("payload_sha256"))


@query(TAXONOMY + """, z AS (SELECT *, count(*) OVER (PARTITION BY parent) = 1 AS sole_child, subtype = '' AND count(*) FILTER (WHERE subtype <> '') OVER (PARTITION BY parent) > 0 AS generic_parent FROM coded)
SELECT code, type, usage, subtype, sole_child, generic_parent, (SELECT ceil(sum(3 * length(code) + length(type) + length(usage) + length(subtype) + 24) / 3)::BIGINT FROM coded) AS tokens, (SELECT count(*) FROM (SELECT 1 FROM part GROUP BY p_type, p_brand, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END HAVING count(*) > 1)) AS repeated FROM z""")
def library_files(spark, sf_dir):
    """The parts written as a delimited file and loaded again as a library, with its estimated size and repeated rows."""
    part = table(spark, sf_dir, "part").select(F.col("p_size").alias("other"), F.col("p_type").alias("a"), F.col("p_brand").alias("b"), F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_name")).alias("c"))
    head = spark.range(1).select(F.lit("Other; Material_Type ;material_usage;MATERIAL_SUBTYPE").alias("value"))
    path = tables.folder(spark, "library")
    head.unionAll(part.select(csv_line(["other", "a", "b", "c"], ";").alias("value"))).coalesce(1).write.text(path)  # a library is one file
    found = library.load_library(spark, path, most_tokens=1 << 40)
    return found.rows.select("code", "type", "usage", "subtype", "sole_child", "generic_parent", F.lit(found.tokens).alias("tokens"), F.lit(found.repeated).cast("long").alias("repeated"))


@query("""WITH l AS (SELECT doc_id // 10 AS batch, doc_id, '{"id": "L' || doc_id || '", "long": ' || to_json(text)::VARCHAR || ', "path": ' || to_json(lang || ' & ' || source)::VARCHAR || ', "short": "", "unit": "m"}' AS rec FROM documents)
SELECT batch, sha256('<boq_lines>' || chr(10) || replace(replace(replace('{"lines": [' || string_agg(rec, ', ' ORDER BY doc_id) || ']}', '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026') || chr(10) || '</boq_lines>') AS payload_sha256 FROM l GROUP BY 1""")
def user_payloads(spark, sf_dir):
    """Documents as lines of batches of ten, each batch as the message that is sent."""
    lines = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 10).alias("batch"), F.col("doc_id").alias("position"), F.concat(F.lit("L"), "doc_id").alias("id"), F.concat_ws(" & ", "lang", "source").alias("path"), F.lit("").alias("short"), F.col("text").alias("long"), F.lit("m").alias("unit"))
    return requests.user_payload(lines).select("batch", F.sha2("payload", 256).alias("payload_sha256"))

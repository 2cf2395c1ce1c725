"""The engine's operators applied to the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxolith.functions import attributes, stats, text
from taxolith.operators import checks, decide, enrich, levels, lineage, replay, review, runlog, sample, score, select, similarity, structure, taxonomy, votes
from taxolith.plans.registry import ORACLES, QUERIES


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> Column:
    """Rounded as both sides of a comparison are."""
    return F.round(c, 6)


# --- taxonomy -------------------------------------------------------------------------------------------------------

TAXONOMY = """
WITH tri AS (SELECT DISTINCT p_type AS type, p_brand AS usage, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END AS subtype FROM part),
t AS (SELECT type, dense_rank() OVER (ORDER BY lower(type), type) AS r FROM (SELECT DISTINCT type FROM tri)),
u AS (SELECT type, usage, row_number() OVER (PARTITION BY type ORDER BY lower(usage), usage) AS r FROM (SELECT DISTINCT type, usage FROM tri)),
s AS (SELECT type, usage, subtype, CASE WHEN subtype = '' THEN 0 ELSE row_number() OVER (PARTITION BY type, usage, subtype = '' ORDER BY lower(subtype), subtype) END AS r FROM tri),
w AS (SELECT (SELECT greatest(2, length(max(r)::varchar)) FROM t) AS a, (SELECT greatest(2, length(max(r)::varchar)) FROM u) AS b, (SELECT greatest(2, length(max(r)::varchar)) FROM s) AS c),
coded AS (SELECT s.type, s.usage, s.subtype, 'T' || lpad(t.r::varchar, w.a::int, '0') || '.U' || lpad(u.r::varchar, w.b::int, '0') AS parent,
  'T' || lpad(t.r::varchar, w.a::int, '0') || '.U' || lpad(u.r::varchar, w.b::int, '0') || '.S' || lpad(s.r::varchar, w.c::int, '0') AS code
  FROM s JOIN t USING (type) JOIN u USING (type, usage) CROSS JOIN w)
"""


def taxonomy_of(spark, sf_dir) -> DataFrame:
    """part as a taxonomy: type, brand and name; every seventh size has a blank leaf."""
    part = table(spark, sf_dir, "part")
    return taxonomy.assign_codes(part.select(F.col("p_type").alias("type"), F.col("p_brand").alias("usage"), F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_name")).alias("subtype")))


@query(TAXONOMY + "SELECT type, usage, subtype, parent, code, substr(sha256(type || chr(31) || usage || chr(31) || subtype), 1, 12) AS row_id FROM coded")
def taxonomy_codes(spark, sf_dir):
    return taxonomy_of(spark, sf_dir)


@query(TAXONOMY + """SELECT code, count(*) OVER (PARTITION BY parent) = 1 AS sole_child,
  subtype = '' AND count(*) FILTER (WHERE subtype <> '') OVER (PARTITION BY parent) > 0 AS generic_parent FROM coded""")
def taxonomy_structure(spark, sf_dir):
    return taxonomy.structure(taxonomy_of(spark, sf_dir)).select("code", "sole_child", "generic_parent")


@query(TAXONOMY + """SELECT type, lower(subtype) AS norm_subtype, array_to_string(list_sort(list(code)), ',') AS codes FROM coded WHERE subtype <> '' GROUP BY 1, 2 HAVING count(*) >= 2""")
def taxonomy_confusable(spark, sf_dir):
    return taxonomy.confusable(taxonomy_of(spark, sf_dir)).withColumn("codes", F.array_join("codes", ","))


@query(TAXONOMY + """, f AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY code) = 1 AS ft, row_number() OVER (PARTITION BY type, usage ORDER BY code) = 1 AS fu FROM coded),
l AS (SELECT code, 0 AS k, split_part(code, '.', 1) || ' ' || type AS line FROM f WHERE ft
  UNION ALL SELECT code, 1, '  ' || parent || ' ' || usage FROM f WHERE fu
  UNION ALL SELECT code, 2, '    ' || code || CASE WHEN subtype <> '' THEN ' ' || subtype ELSE '' END FROM f)
SELECT row_number() OVER (ORDER BY code, k) AS line_no, line FROM l""")
def tree_render(spark, sf_dir):
    return taxonomy.rendered(taxonomy_of(spark, sf_dir))


@query(TAXONOMY + """, a AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'T01.U01.S01' WHEN 2 THEN 'T99.U01.S01' WHEN 3 THEN 'bad' ELSE 'T01.U01.S999' END AS code FROM lineitem)
SELECT status, count(*) AS n FROM (SELECT CASE WHEN a.code = '' THEN 'empty' WHEN c.code IS NOT NULL THEN 'valid' WHEN NOT regexp_full_match(a.code, 'T\\d{2,}\\.U\\d{2,}\\.S\\d{2,}') THEN 'malformed'
  WHEN NOT EXISTS (SELECT 1 FROM coded p WHERE p.parent = regexp_extract(a.code, '^(T\\d+\\.U\\d+)', 1)) THEN 'unknown_parent' ELSE 'unknown_code' END AS status
  FROM a LEFT JOIN coded c ON a.code = c.code) GROUP BY 1""")
def code_check(spark, sf_dir):
    k = F.col("l_partkey") % 5
    answers = table(spark, sf_dir, "lineitem").select(F.when(k == 0, "").when(k == 1, "T01.U01.S01").when(k == 2, "T99.U01.S01").when(k == 3, "bad").otherwise("T01.U01.S999").alias("code"))
    # answers repeat few codes: equal ones are counted before any is looked up, so none is a task's alone
    counted = answers.groupBy("code").agg(F.count("*").alias("n"))
    return taxonomy.checked_codes(counted, taxonomy_of(spark, sf_dir)).groupBy("status").agg(F.sum("n").alias("n"))


@query("""SELECT l_orderkey, l_partkey, l_linenumber, l_shipdate, CASE WHEN pct IS NULL AND max(pct > 0) OVER (PARTITION BY l_orderkey) THEN 0 ELSE pct END AS pct
FROM (SELECT *, CASE WHEN l_quantity >= 45 THEN l_quantity::int END AS pct FROM lineitem)""")
def implicit_zero(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("pct", F.when(F.col("l_quantity") >= 45, F.col("l_quantity").cast("int")))
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", taxonomy.implicit_zero(rows, "l_orderkey", "pct").alias("pct"))


@query(r"SELECT p_partkey, regexp_matches(p_type, '^(STANDARD|SMALL)') OR regexp_matches(p_name, 'ring$') AS never_match FROM part")
def never_match(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", taxonomy.never_match(part, [("p_type", "^(STANDARD|SMALL)"), ("p_name", "ring$")]).alias("never_match"))


# --- text and attributes --------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '(\d),(\d)', '\1.\2', 'g'), '\s+', ' ', 'g'))) AS norm_sha256 FROM documents""")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalize(F.col("text")), 256).alias("norm_sha256"))


COMPOSED = "CASE p_partkey % 8 WHEN 0 THEN 'c25/30 dn ' || p_size WHEN 1 THEN 'dn ' || p_size || ' dn ' || (p_size + 1) WHEN 2 THEN p_size || ' % rap' WHEN 3 THEN 'virgin hot mix' WHEN 4 THEN '17 05 0' || (p_size % 9) || ' other than 17 03 01' WHEN 5 THEN p_size || ' g/m2' WHEN 6 THEN 'warm mix c30/37 c30/37' ELSE 'cem ii/a xc' || (p_size % 4 + 1) END"


@query(f"""WITH t AS (SELECT p_partkey, p_size, {COMPOSED} AS x FROM part) SELECT p_partkey,
  CASE p_partkey % 8 WHEN 0 THEN p_size WHEN 1 THEN NULL END AS diameter_mm, CASE p_partkey % 8 WHEN 2 THEN p_size WHEN 3 THEN 0 END AS recycled_pct,
  CASE p_partkey % 8 WHEN 3 THEN 'HMA' WHEN 6 THEN 'WMA' END AS process, CASE WHEN p_partkey % 8 = 4 THEN '17050' || (p_size % 9) END AS waste_code,
  CASE WHEN p_partkey % 8 = 5 THEN p_size END AS areal_mass, CASE p_partkey % 8 WHEN 0 THEN '25,30' WHEN 6 THEN '30,37' ELSE '' END AS strength,
  CASE WHEN p_partkey % 8 = 7 THEN 'xc' || (p_size % 4 + 1) ELSE '' END AS exposure, CASE WHEN p_partkey % 8 = 7 THEN 'ii,a' ELSE '' END AS cement,
  CASE WHEN p_partkey % 8 = 1 THEN 'diameter_mm' ELSE '' END AS ambiguous, p_partkey % 8 NOT IN (1) OR p_partkey % 8 = 1 AS hard FROM t""")
def extract_attributes(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(COMPOSED).alias("x")).withColumn("a", attributes.extract(F.col("x")))
    joined = lambda n: F.coalesce(F.array_join(f"a.{n}", ","), F.lit(""))
    one = lambda n: F.get(F.col(f"a.{n}"), F.lit(0))
    numbers = [attributes.number(F.col(f"a.{n}")).alias(n) for n in ("diameter_mm", "recycled_pct", "areal_mass")]
    return rows.select("p_partkey", *numbers, one("process").alias("process"), one("waste_code").alias("waste_code"), joined("strength_class").alias("strength"), joined("exposure_classes").alias("exposure"), joined("cement_type").alias("cement"), joined("ambiguous").alias("ambiguous"), attributes.has_hard_attribute(F.col("a")).alias("hard"))



@query("""SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN l_linenumber % 3 = 0 THEN 'no_evidence' WHEN l_quantity::int = p_size THEN 'agree' ELSE 'conflict' END AS verdict
FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1""")
def compare_attributes(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", attributes.extract(F.concat(F.lit("dn "), F.col("p_size"))).alias("row"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.when(F.col("l_linenumber") % 3 == 0, "none").otherwise(F.concat(F.lit("ø "), F.col("l_quantity").cast("int"))).alias("text"))
    # equal texts of a row are compared once
    counted = lines.groupBy("l_partkey", "text").agg(F.count("*").alias("n"))
    texts = counted.select("text").distinct().select("text", attributes.extract(F.col("text")).alias("line"))
    joined = counted.join(texts, "text").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(attributes.compare(F.col("line"), F.col("row")).alias("verdict")).agg(F.sum("n").alias("n"))



PHRASES = ["the", "of the", "for the", "in of", "is the of"]


@query("""WITH t(term, gram, len) AS (VALUES ('the', 'the', 1), ('of the', 'of the', 2), ('for the', 'for the', 2), ('in of', 'in of', 2), ('is the of', 'is the of', 3)),
b AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT id, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM b),
l AS (SELECT id, pos, x, lead(x) OVER v AS y, lead(x, 2) OVER v AS z FROM p WINDOW v AS (PARTITION BY id ORDER BY pos)),
g AS (SELECT id, pos, x AS gram FROM l UNION ALL SELECT id, pos, x || ' ' || y FROM l UNION ALL SELECT id, pos, x || ' ' || y || ' ' || z FROM l),
m AS (SELECT DISTINCT id, term, pos, t.len AS len FROM g JOIN t USING (gram))
SELECT id, term, pos AS "at", len FROM m a WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.id = a.id AND o.len > a.len AND o.pos <= a.pos AND a.pos + a.len <= o.pos + o.len)""")
def phrase_theta_join(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return similarity.phrase_matches(texts, spark.createDataFrame([(p,) for p in PHRASES], "term string"))


# --- structure ------------------------------------------------------------------------------------------------------

ROWS = """
WITH blocks AS (SELECT DISTINCT n_nationkey AS n, n_regionkey AS g, n_name, r_name, c_custkey // 500 AS b FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
rows_ AS (
  SELECT n || '-' || b AS file, ((n * 1000000 + b) * 1000000000 + r)::bigint AS position, code, text, unit, qty FROM (
    SELECT n::bigint AS n, b::bigint AS b, 0 AS r, (g + 1)::varchar AS code, r_name AS text, '' AS unit, '' AS qty FROM blocks
    UNION ALL SELECT n, b, 1, (g + 1) || '.' || (n + 1), n_name, '', '' FROM blocks
    UNION ALL SELECT n_nationkey, c_custkey // 500, 2 + c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE (n_regionkey + 1) || '.' || (n_nationkey + 1) || '.' || (c_custkey + 1) END, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE c_name END,
      CASE WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 THEN '' ELSE 'm' END, CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN '' ELSE '1' END
    FROM customer JOIN nation ON c_nationkey = n_nationkey)),
nx AS (SELECT *, first_value(nullif(code, '') IGNORE NULLS) OVER (PARTITION BY file ORDER BY position ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM rows_),
kinds AS (SELECT file, position, code, text, unit, qty, CASE WHEN code = '' AND text = '' AND unit = '' AND qty = '' THEN 'empty_row' WHEN unit <> '' OR qty <> '' THEN 'item' WHEN code = '' THEN 'header_unconfirmed'
  WHEN starts_with(coalesce(nxt, ''), code || '.') THEN 'header' ELSE 'header_unconfirmed' END AS kind FROM nx)
"""


def rows_of(spark, sf_dir) -> DataFrame:
    """Regions, nations and customers with hierarchical codes, a file for each nation and 500 customers."""
    none, k = F.lit(""), F.col("c_custkey")
    code = lambda *c: F.concat_ws(".", *[(F.col(x) + 1).cast("string") for x in c])
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, sf_dir, "customer").join(both, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("b", F.expr("c_custkey div 500"))
    blocks = customers.select("n_nationkey", "n_regionkey", "n_name", "r_name", "b").distinct()
    keys = [F.col("n_nationkey").cast("long").alias("n"), F.col("b")]
    heads = [blocks.select(*keys, F.lit(r).cast("long").alias("r"), c.alias("code"), F.col(name).alias("text"), none.alias("unit"), none.alias("qty")) for r, c, name in ((0, code("n_regionkey"), "r_name"), (1, code("n_regionkey", "n_nationkey"), "n_name"))]
    given = lambda value: F.when((k % 11 == 0) | (k % 13 == 0), "").otherwise(value)
    items = customers.select(*keys, (2 + k).cast("long").alias("r"), F.when(k % 11 == 0, "").otherwise(code("n_regionkey", "n_nationkey", "c_custkey")).alias("code"), F.when(k % 13 == 0, "").otherwise(F.col("c_name")).alias("text"), given("m").alias("unit"), given("1").alias("qty"))
    rows = heads[0].unionByName(heads[1]).unionByName(items)
    return rows.select(F.concat_ws("-", "n", "b").alias("file"), ((F.col("n") * 1000000 + F.col("b")) * 1000000000 + F.col("r")).alias("position"), "code", "text", "unit", "qty")


@query(ROWS + "SELECT position, kind FROM kinds")
def classify_rows(spark, sf_dir):
    return structure.classified(rows_of(spark, sf_dir)).select("position", "kind")


#: The same with a file for each region, which holds all its nations and their customers.
REGION_ROWS = """
WITH rows_ AS (
  SELECT n::varchar AS file, (n::bigint * 1000000000 + r)::bigint AS position, code, text, unit, qty FROM (
    SELECT r_regionkey AS n, 0 AS r, (r_regionkey + 1)::varchar AS code, r_name AS text, '' AS unit, '' AS qty FROM region
    UNION ALL SELECT n_regionkey, (n_nationkey + 1) * 10000000, (n_regionkey + 1) || '.' || (n_nationkey + 1), n_name, '', '' FROM nation
    UNION ALL SELECT n_regionkey, (n_nationkey + 1) * 10000000 + 1 + c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE (n_regionkey + 1) || '.' || (n_nationkey + 1) || '.' || (c_custkey + 1) END, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE c_name END,
      CASE WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 THEN '' ELSE 'm' END, CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN '' ELSE '1' END
    FROM customer JOIN nation ON c_nationkey = n_nationkey)),
nx AS (SELECT *, first_value(nullif(code, '') IGNORE NULLS) OVER (PARTITION BY file ORDER BY position ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM rows_),
kinds AS (SELECT file, position, code, text, unit, qty, CASE WHEN code = '' AND text = '' AND unit = '' AND qty = '' THEN 'empty_row' WHEN unit <> '' OR qty <> '' THEN 'item' WHEN code = '' THEN 'header_unconfirmed'
  WHEN starts_with(coalesce(nxt, ''), code || '.') THEN 'header' ELSE 'header_unconfirmed' END AS kind FROM nx)
"""


def region_rows_of(spark, sf_dir) -> DataFrame:
    """Regions, nations and customers with hierarchical codes, a file per region."""
    region, nation, customer = (table(spark, sf_dir, n) for n in ("region", "nation", "customer"))
    none = F.lit("")
    code = lambda *c: F.concat_ws(".", *[(F.col(x) + 1).cast("string") for x in c])
    a = region.select(F.col("r_regionkey").alias("n"), F.lit(0).cast("long").alias("r"), code("r_regionkey").alias("code"), F.col("r_name").alias("text"), none.alias("unit"), none.alias("qty"))
    b = nation.select("n_regionkey", ((F.col("n_nationkey") + 1) * 10000000).cast("long"), code("n_regionkey", "n_nationkey"), "n_name", none, none)
    k = F.col("c_custkey")
    c = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "n_regionkey", ((F.col("n_nationkey") + 1) * 10000000 + 1 + k).cast("long"), F.when(k % 11 == 0, "").otherwise(code("n_regionkey", "n_nationkey", "c_custkey")),
        F.when(k % 13 == 0, "").otherwise(F.col("c_name")), F.when((k % 11 == 0) | (k % 13 == 0), "").otherwise("m"), F.when((k % 11 == 0) | (k % 13 == 0), "").otherwise("1"),
    )
    n = F.col("n").cast("long")
    return a.union(b).union(c).select(n.cast("string").alias("file"), (n * 1000000000 + F.col("r")).alias("position"), "code", "text", "unit", "qty")


@query(REGION_ROWS + """, h AS (SELECT file, position, code, text FROM kinds WHERE kind = 'header'),
e AS (SELECT a.file, a.position, a.code, a.text, (SELECT min(b.position) FROM h b WHERE b.file = a.file AND b.position > a.position AND NOT starts_with(b.code, a.code || '.')) AS until FROM h a)
SELECT k.position, coalesce((SELECT string_agg(trim(e.code || ' ' || e.text), ' > ' ORDER BY e.position) FROM e WHERE e.file = k.file AND e.position < k.position AND (e.until IS NULL OR k.position < e.until) AND starts_with(k.code, e.code || '.')), '') AS path FROM kinds k""")
def section_paths(spark, sf_dir):
    paths = structure.section_paths(structure.classified(region_rows_of(spark, sf_dir)))
    return paths.select("position", text.path_text(F.col("path")).alias("path"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position FROM events),
m AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY position) AND position > 1 THEN 0 ELSE 1 END AS n FROM e),
i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY position) AS island FROM m)
SELECT event_id, island::bigint AS island, ((row_number() OVER (PARTITION BY user_id, island ORDER BY position) - 1) // 2)::bigint AS batch_no FROM i""")
def batches(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("position", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return structure.batches(e, 2, "user_id", "position", "event_type").select("event_id", "island", "batch_no")


# --- votes and decisions --------------------------------------------------------------------------------------------

TALLY = """
WITH v AS (SELECT event_id // 5 AS line, event_id % 5 AS pass_no, event_type AS code, floor(value)::int % 101 AS confidence FROM events),
c AS (SELECT line, code, count(*) AS votes, min(pass_no) AS first_pass, min(confidence) AS weakest FROM v GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY votes DESC, first_pass, code) AS rn, max(votes) OVER (PARTITION BY line) AS mx, sum(votes) OVER (PARTITION BY line) AS passes FROM c),
tally AS (SELECT line, code AS leader, votes, passes, (SELECT count(*) FROM c x WHERE x.line = r.line AND x.votes = r.mx) > 1 AS tie, weakest FROM r WHERE rn = 1)
"""


def votes_of(spark, sf_dir) -> DataFrame:
    """events as five passes per line."""
    e = table(spark, sf_dir, "events")
    return e.select(F.expr("event_id div 5").alias("line"), (F.col("event_id") % 5).alias("pass_no"), F.col("event_type").alias("code"), (F.floor("value").cast("int") % 101).alias("confidence"))


@query(TALLY + "SELECT line, leader, votes, passes::bigint AS passes, tie, weakest FROM tally")
def plurality_vote(spark, sf_dir):
    return votes.tally(votes_of(spark, sf_dir))


def decision_rows(spark, sf_dir, passes: DataFrame | None = None) -> DataFrame:
    """Tallied lines with every fact the decision table reads, drawn from the line's number, and threshold T7 of two votes; passes are the events' votes unless given."""
    t = votes.tally(votes_of(spark, sf_dir) if passes is None else passes)
    n = F.col("line")
    return t.select(
        "line", "leader", "votes", "tie", F.col("weakest").alias("confidence"),
        F.when(n % 17 == 0, "header").when(n % 19 == 0, "empty_row").when(n % 23 == 0, "header_unconfirmed").otherwise("item").alias("kind"),
        ((n % 17 != 0) & (n % 19 != 0) & (n % 23 != 0)).alias("measured"), (n % 19 == 0).alias("all_blank"),
        F.when(n % 29 == 0, "LLM_UNAVAILABLE").alias("failure"), F.col("passes").alias("answers"), F.when(n % 31 == 0, 1).otherwise(0).alias("failed_passes"),
        (n % 7 == 0).alias("all_non_material"), (n % 14 == 0).alias("service_gate"), (n % 7 == 0).alias("any_non_material"), (n % 11 == 0).alias("any_no_equivalent"),
        (F.col("leader") != "error").alias("valid_code"), (n % 13 != 0).alias("evidence_ok"), (n % 37 == 0).alias("never_match"),
        F.when(n % 5 == 0, "conflict").when(n % 5 == 1, "agree").otherwise("no_evidence").alias("attributes"), (n % 41 == 0).alias("generic_parent"),
        F.when(n % 3 == 0, F.when(n % 2 == 0, F.col("leader")).otherwise("other")).alias("verifier"), F.lit(2).alias("min_v"), F.lit(0).alias("min_b"), F.lit(1).alias("min_bucket"),
    )


DECISIONS = TALLY + """, f AS (SELECT *, CASE WHEN weakest >= 90 THEN 3 WHEN weakest >= 80 THEN 2 WHEN weakest >= 70 THEN 1 ELSE 0 END AS k, CASE WHEN line % 5 = 1 THEN 1 ELSE 0 END AS b FROM tally),
g AS (SELECT *, (votes > 2 OR (votes = 2 AND (b > 0 OR (b = 0 AND k >= 1)))) AND NOT tie AS passing FROM f),
ruled AS (SELECT *, CASE WHEN line % 17 = 0 THEN 'D0' WHEN line % 19 = 0 THEN 'D0a' WHEN line % 23 = 0 THEN 'D0b' WHEN line % 29 = 0 THEN 'D1' WHEN line % 31 = 0 OR passes < 2 THEN 'D1b' WHEN line % 7 = 0 AND line % 14 = 0 THEN 'D2'
  WHEN line % 7 = 0 THEN 'D3' WHEN line % 11 = 0 THEN 'D4' WHEN leader = 'error' THEN 'D5' WHEN line % 13 = 0 THEN 'D5a' WHEN line % 37 = 0 THEN 'D6' WHEN line % 5 = 0 THEN 'D7' WHEN line % 41 = 0 THEN 'D8'
  WHEN passing AND line % 3 = 0 AND line % 2 <> 0 THEN 'D8a' WHEN passing THEN 'D9' ELSE 'D10' END AS rule FROM g),
decided AS (SELECT *, CASE WHEN rule IN ('D0', 'D0a', 'D2') THEN 'not_a_material' WHEN rule = 'D9' THEN 'matched' ELSE 'needs_review' END AS decision,
  CASE rule WHEN 'D0' THEN 'HEADER' WHEN 'D0a' THEN 'EMPTY_ROW' WHEN 'D0b' THEN 'HEADER_UNCONFIRMED' WHEN 'D1' THEN 'LLM_UNAVAILABLE' WHEN 'D1b' THEN 'LLM_FAILURE:partial_signal' WHEN 'D2' THEN 'G2_SERVICE' WHEN 'D3' THEN 'NM_UNCONFIRMED'
  WHEN 'D4' THEN 'NO_LIBRARY_EQUIVALENT' WHEN 'D5' THEN 'INVALID_ROW_ID' WHEN 'D5a' THEN 'EVIDENCE_NOT_IN_LINE' WHEN 'D6' THEN 'NEVER_MATCH_ROW' WHEN 'D7' THEN 'ATTR_CONFLICT' WHEN 'D8' THEN 'GENERIC_PARENT' WHEN 'D8a' THEN 'VERIFIER_DISAGREES'
  WHEN 'D9' THEN 'SIGNAL' ELSE 'LOW_SIGNAL:' || concat_ws('+', CASE WHEN votes < 2 OR tie THEN 'v' END, CASE WHEN k < 1 THEN 'confidence' END) END AS reason FROM ruled)
"""


@query(DECISIONS + "SELECT line, leader, rule, decision, reason FROM decided")
def decision_table(spark, sf_dir):
    return decide.decided(decision_rows(spark, sf_dir)).select("line", "leader", "rule", "decision", "reason")


@query(DECISIONS + "SELECT decision, reason, count(*) AS n FROM decided GROUP BY 1, 2")
def decision_histogram(spark, sf_dir):
    return decide.decided(decision_rows(spark, sf_dir)).groupBy("decision", "reason").agg(F.count("*").alias("n"))


@query(DECISIONS + """, b AS (SELECT line, rule, CASE WHEN line % 50 = 7 THEN 'matched' WHEN line % 70 = 9 THEN NULL ELSE decision END AS decision, CASE WHEN line % 60 = 11 THEN '' ELSE reason END AS reason, decision AS right_ FROM decided)
SELECT count(*) AS violations FROM b WHERE decision IS NULL OR decision <> right_ OR reason = ''""")
def decision_invariants(spark, sf_dir):
    """Decisions of which some were broken on purpose: those that no rule gives."""
    n, d = F.col("line"), decide.decided(decision_rows(spark, sf_dir))
    broken = d.withColumns({"decision": F.when(n % 50 == 7, "matched").when(n % 70 == 9, None).otherwise(F.col("decision")), "reason": F.when(n % 60 == 11, "").otherwise(F.col("reason"))})
    return decide.violations(broken).agg(F.count("*").alias("violations"))


@query("""SELECT event_id, CASE WHEN json_valid(raw) AND kind = 'lines' THEN json_extract_string(raw, '$.lines[0].top1') END AS top1, NOT (kind = 'lines') AS malformed
FROM (SELECT event_id, event_type, CASE event_id % 4 WHEN 0 THEN 'lines' WHEN 1 THEN 'lines' ELSE 'bad' END AS kind,
 CASE event_id % 4 WHEN 0 THEN '{"lines": [{"id": "L1", "kind": "Material", "top1": "' || event_type || '", "confidence": 80, "evidence": "x"}]}' WHEN 1 THEN '{"lines": [{"id": "L1", "top1": "' || event_type || '"}]}' WHEN 2 THEN '{"rows": []}' ELSE 'no json' END AS raw FROM events)""")
def json_answers(spark, sf_dir):
    k, c = F.col("event_id") % 4, F.col("event_type")
    one = F.concat(F.lit('{"lines": [{"id": "L1", "kind": "Material", "top1": "'), c, F.lit('", "confidence": 80, "evidence": "x"}]}'))
    two = F.concat(F.lit('{"lines": [{"id": "L1", "top1": "'), c, F.lit('"}]}'))
    raw = table(spark, sf_dir, "events").select("event_id", F.when(k == 0, one).when(k == 1, two).when(k == 2, '{"rows": []}').otherwise("no json").alias("raw"))
    return votes.parsed_answers(raw).select("event_id", F.get("answers", F.lit(0))["top1"].alias("top1"), F.col("answers").isNull().alias("malformed"))


# --- scoring --------------------------------------------------------------------------------------------------------

PAIRS = """
WITH pairs AS (SELECT doc_id, lang, CASE WHEN n_chars % 3 = 0 THEN 'matched' WHEN n_chars % 3 = 1 THEN 'needs_review' ELSE 'not_a_material' END AS decision,
  quality = 1 AS correct, toxic = 0 AS labelled, n_chars % 100 AS score FROM documents JOIN labels USING (doc_id))
"""


def pairs_of(spark, sf_dir) -> DataFrame:
    m = F.col("n_chars") % 3
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(m == 0, "matched").when(m == 1, "needs_review").otherwise("not_a_material").alias("decision"), (F.col("n_chars") % 100).alias("score"))
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("correct"), (F.col("toxic") == 0).alias("labelled"))
    return docs.join(labels, "doc_id")


@query(PAIRS + """SELECT lang, count(*) AS rows, count(*) FILTER (WHERE decision = 'matched') AS matched, count(*) FILTER (WHERE decision = 'needs_review') AS review, count(*) FILTER (WHERE decision = 'not_a_material') AS skipped,
  count(*) FILTER (WHERE decision = 'matched' AND correct) AS correct, count(*) FILTER (WHERE labelled) AS labelled, count(*) FILTER (WHERE decision = 'not_a_material' AND labelled) AS false_skips,
  round(count(*) FILTER (WHERE decision = 'matched' AND correct) / nullif(count(*) FILTER (WHERE decision = 'matched'), 0), 6) AS precision,
  round(count(*) FILTER (WHERE decision = 'matched' AND correct) / nullif(count(*) FILTER (WHERE labelled), 0), 6) AS coverage FROM pairs GROUP BY GROUPING SETS ((), (lang))""")
def score_report(spark, sf_dir):
    out = score.report(pairs_of(spark, sf_dir), [[], ["lang"]])
    return out.select("lang", "rows", "matched", "review", "skipped", "correct", "labelled", "false_skips", r6("precision").alias("precision"), r6("coverage").alias("coverage"))


@query(PAIRS + """, g AS (SELECT lang, count(*) FILTER (WHERE correct) AS k, count(*) AS n FROM pairs WHERE decision = 'matched' GROUP BY 1),
b AS (WITH RECURSIVE r AS (SELECT lang, k, n, 0 AS i, 0.0::double AS lo, 1.0::double AS hi FROM g UNION ALL
  SELECT lang, k, n, i + 1, CASE WHEN tail < 0.05 THEN mid ELSE lo END, CASE WHEN tail < 0.05 THEN hi ELSE mid END FROM (
    SELECT *, (lo + hi) / 2 AS mid, (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln((lo + hi) / 2) + (n - j) * ln(1 - (lo + hi) / 2))) FROM (SELECT unnest(range(k, n + 1)) AS j)) AS tail FROM r WHERE i < 50))
  SELECT lang, k AS correct, n AS matched, CASE WHEN k = 0 THEN 0 ELSE lo END AS cp FROM r WHERE i = 50)
SELECT lang, correct, matched, round(cp, 6) AS cp_lower,
  round((correct / matched + 1.959963984540054 ^ 2 / (2 * matched) - 1.959963984540054 * sqrt((correct / matched) * (1 - correct / matched) / matched + 1.959963984540054 ^ 2 / (4 * matched * matched))) / (1 + 1.959963984540054 ^ 2 / matched), 6) AS wilson_low,
  round((correct / matched + 1.959963984540054 ^ 2 / (2 * matched) + 1.959963984540054 * sqrt((correct / matched) * (1 - correct / matched) / matched + 1.959963984540054 ^ 2 / (4 * matched * matched))) / (1 + 1.959963984540054 ^ 2 / matched), 6) AS wilson_high FROM b""")
def cp_wilson(spark, sf_dir):
    g = score.report(pairs_of(spark, sf_dir).where("decision = 'matched'"), [["lang"]])
    return score.with_exact_bound(g).select("lang", "correct", "matched", r6("cp_lower").alias("cp_lower"), r6("wilson_low").alias("wilson_low"), r6("wilson_high").alias("wilson_high"))


@query(PAIRS + "SELECT lang, correct, count(*) FILTER (WHERE decision = 'matched') AS matched, count(*) FILTER (WHERE decision = 'needs_review') AS needs_review, count(*) FILTER (WHERE decision = 'not_a_material') AS not_a_material FROM pairs GROUP BY 1, 2")
def confusion(spark, sf_dir):
    return score.confusion(pairs_of(spark, sf_dir), ["lang", "correct"])


@query("""WITH a AS (SELECT o_custkey AS k, o_orderkey AS position, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS occ FROM orders),
b AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS other, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber, l_partkey) - 1 AS occ FROM lineitem)
SELECT k, occ, position, other, CASE WHEN position IS NULL THEN 'unscored' WHEN other IS NULL THEN 'missing' ELSE 'paired' END AS status FROM a FULL JOIN b USING (k, occ)""")
def occurrence_join(spark, sf_dir):
    """The n-th order of a customer meets the n-th line of the supplier of the same number."""
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("position"))
    at = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    b = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), at.alias("position"), at.alias("other"))
    return score.joined_by_key(a, b, "k", "position").select("k", "occ", "position", "other", "status")


@query("""WITH p AS (SELECT lang, quality, toxic FROM labels JOIN documents USING (doc_id)), n AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality = toxic) AS agreed, count(*) FILTER (WHERE quality = 1) AS q, count(*) FILTER (WHERE toxic = 1) AS t FROM p GROUP BY 1),
e AS (SELECT *, (q * t + (n - q) * (n - t)) / (n * n) AS pe FROM n) SELECT lang, n, agreed, round(agreed / n, 6) AS agreement, CASE WHEN pe < 1 THEN round((agreed / n - pe) / (1 - pe), 6) END AS kappa FROM e""")
def kappa(spark, sf_dir):
    p = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return score.kappa(p, "quality", "toxic", ["lang"]).select("lang", "n", "agreed", r6("agreement").alias("agreement"), r6("kappa").alias("kappa"))


@query("""WITH g AS (SELECT lang, count(*) FILTER (WHERE quality > toxic) AS k, count(*) FILTER (WHERE quality <> toxic) AS d FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT lang, k AS improved, d AS discordant, round((SELECT sum(exp(lgamma(d + 1) - lgamma(j + 1) - lgamma(d - j + 1) - d * ln(2))) FROM (SELECT unnest(range(k, d + 1)) AS j)), 6) AS p FROM g""")
def sign_test(spark, sf_dir):
    p = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    g = p.groupBy("lang").agg(F.count_if(F.col("quality") > F.col("toxic")).alias("improved"), F.count_if(F.col("quality") != F.col("toxic")).alias("discordant"))
    return g.select("*", r6(stats.sign_test(F.col("improved"), F.col("discordant"))).alias("p"))


@query("""SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 7 WHEN quality = toxic THEN quality END AS verdict, NOT (doc_id % 50 = 0 OR quality = toxic) AS unresolved, CASE WHEN doc_id % 50 = 0 THEN 'ruling' WHEN quality = toxic THEN 'agreed' ELSE 'open' END AS "by" FROM labels""")
def panel_merge(spark, sf_dir):
    l = table(spark, sf_dir, "labels")
    rulings = l.where("doc_id % 50 = 0").select("doc_id", F.lit(7).alias("verdict"))
    return score.merged_panel(l.select("doc_id", F.col("quality").alias("verdict")), l.select("doc_id", F.col("toxic").alias("verdict")), rulings, "doc_id", "verdict")


@query(PAIRS + """SELECT coalesce(kind, 'right') AS kind, count(*) AS n FROM (SELECT CASE WHEN decision = 'matched' AND NOT labelled THEN 'match_on_blank' WHEN decision = 'matched' AND NOT correct THEN 'false_match' WHEN decision = 'not_a_material' AND labelled THEN 'false_nm'
 WHEN decision = 'needs_review' AND labelled AND NOT correct THEN 'wrong_proposal_reviewed' END AS kind FROM pairs) GROUP BY 1""")
def error_kinds(spark, sf_dir):
    p = pairs_of(spark, sf_dir)
    kind = score.error_kind(F.col("decision"), F.when(F.col("labelled"), "x").otherwise(""), F.when(F.col("correct"), "x").otherwise("y"))
    return p.groupBy(F.coalesce(kind, F.lit("right")).alias("kind")).agg(F.count("*").alias("n"))


# --- selection ------------------------------------------------------------------------------------------------------


@query(PAIRS + "SELECT DISTINCT lang, score, count(*) OVER w AS matched, (count(*) FILTER (WHERE correct) OVER w) AS correct FROM pairs WINDOW w AS (PARTITION BY lang ORDER BY score DESC RANGE UNBOUNDED PRECEDING)")
def threshold_sweep(spark, sf_dir):
    return select.sweep(pairs_of(spark, sf_dir), ["lang"], ["score"])


@query(PAIRS + """, s AS (SELECT DISTINCT lang, score, count(*) OVER w AS matched, (count(*) FILTER (WHERE correct) OVER w) AS correct FROM pairs WINDOW w AS (PARTITION BY lang ORDER BY score DESC RANGE UNBOUNDED PRECEDING)),
t AS (SELECT lang, count(*) AS population, count(*) FILTER (WHERE labelled) AS labelled FROM pairs GROUP BY 1)
SELECT lang, score, round(correct / matched, 6) AS precision, round(1 - correct / matched, 6) AS risk, round(matched / population, 6) AS selective_coverage, round(correct / nullif(labelled, 0), 6) AS coverage FROM s JOIN t USING (lang)""")
def risk_coverage(spark, sf_dir):
    p = pairs_of(spark, sf_dir)
    totals = p.groupBy("lang").agg(F.count("*").alias("population"), F.count_if("labelled").alias("labelled"))
    out = select.risk_coverage(select.sweep(p, ["lang"], ["score"]), totals, ["lang"])
    return out.select("lang", "score", *[r6(c).alias(c) for c in ("precision", "risk", "selective_coverage", "coverage")])


@query(PAIRS + """, t AS (SELECT i AS ord, 'T' || i AS threshold, 90 - 10 * i AS least FROM (SELECT unnest(range(1, 9)) AS i)),
g AS (SELECT ord, threshold, lang, count(*) AS matched, count(*) FILTER (WHERE correct) AS correct FROM t JOIN pairs ON score >= least GROUP BY ALL),
q AS (SELECT ord, threshold, bool_and(matched >= 5 AND correct / matched >= 0.8) AS ok, sum(correct)::bigint AS correct, min(correct / matched) AS worst FROM g GROUP BY ALL),
l AS (SELECT max_by(correct, ord) FILTER (WHERE ok) AS c FROM q)
SELECT threshold, ord::int AS ord, CASE WHEN ok AND c IS NOT NULL THEN 'qualified' ELSE 'fallback' END AS how, correct, round(worst, 6) AS worst FROM q, l WHERE (ok AND q.correct >= c - 3) OR c IS NULL ORDER BY CASE WHEN c IS NULL THEN -worst ELSE 0 END, ord LIMIT 1""")
def selection_rule(spark, sf_dir):
    t = spark.createDataFrame([(i, f"T{i}", 90 - 10 * i) for i in range(1, 9)], "ord int, threshold string, least int")
    # cumulative counts at each threshold from one count per score, not from pairs of rows and thresholds
    counts = pairs_of(spark, sf_dir).groupBy("lang", "score").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("c"))
    g = counts.join(F.broadcast(t), F.col("score") >= F.col("least")).groupBy("threshold", "ord", "lang").agg(F.sum("n").alias("matched"), F.sum("c").alias("correct"))
    chosen = select.selected(g.withColumn("bound", F.col("correct") / F.col("matched")), 0.8, least=5)
    return chosen.withColumn("worst", r6("worst"))


@query(TALLY + """, t AS (SELECT * FROM (VALUES ('T1',1,5,1,3),('T2',2,5,1,2),('T3',3,5,1,1),('T4',4,5,1,0),('T5',5,5,0,3),('T6',6,5,0,2),('T7',7,5,0,1),('T8',8,5,0,0)) t(threshold, ord, min_v, min_b, min_bucket)),
l AS (SELECT CASE WHEN line % 3 = 0 THEN 5 ELSE votes END AS v, (line % 5 = 1)::INT AS b, CASE WHEN weakest >= 90 THEN 3 WHEN weakest >= 80 THEN 2 WHEN weakest >= 70 THEN 1 ELSE 0 END AS k, tie FROM tally)
SELECT t.*, (SELECT count(*) FROM l WHERE NOT tie AND (v > min_v OR v = min_v AND (b > min_b OR b = min_b AND k >= min_bucket))) AS lines FROM t""")
def candidate_thresholds(spark, sf_dir):
    """The thresholds of five passes and how many lines reach each; every third line counts as unanimous."""
    n = F.col("line")
    lines = votes.tally(votes_of(spark, sf_dir)).select(F.when(n % 3 == 0, 5).otherwise(F.col("votes")).alias("votes"), (n % 5 == 1).alias("agrees"), F.col("weakest").alias("confidence"), "tie")
    return decide.met(lines, decide.thresholds(spark, 5))


# --- run log --------------------------------------------------------------------------------------------------------

CALLS = """WITH calls AS (SELECT l_orderkey AS call_id, l_partkey % 1000 AS line_id, o_totalprice AS cost FROM (SELECT DISTINCT l_orderkey, l_partkey % 1000 AS l_partkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey),"""


@query(CALLS + """ n AS (SELECT call_id, count(*) AS n FROM calls GROUP BY 1) SELECT line_id, round(sum(cost / n), 1) AS cost, array_to_string(list(call_id ORDER BY call_id), ';') AS call_ids FROM calls JOIN n USING (call_id) GROUP BY 1""")
def cost_attribution(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 1000).alias("line_ids"))
    calls = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("call_id"), F.col("l_orderkey").alias("ord"), "line_ids", F.col("o_totalprice").alias("cost"), F.lit(0).alias("latency_ms"))
    return runlog.attributed(calls).select("line_id", F.round("cost", 1).alias("cost"), F.array_join(F.col("call_ids").cast("array<string>"), ";").alias("call_ids"))


@query("""SELECT event_type, count(*) AS calls, count(*) FILTER (WHERE user_id % 3 = 0) AS hits, round(sum(CASE WHEN user_id % 3 = 0 THEN 0 ELSE value END), 4) AS spend, quantile_disc(value, 0.5) AS p50_ms, quantile_disc(value, 0.95) AS p95_ms, count(*) FILTER (WHERE user_id % 7 = 0) AS failures FROM events GROUP BY 1""")
def latency_percentiles(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 3 == 0).alias("cache_hit"), F.col("value").alias("cost"), F.col("value").alias("latency_ms"), F.when(F.col("user_id") % 7 == 0, "x").alias("error"))
    return runlog.summary(e, ["event_type"]).withColumn("spend", F.round("spend", 4))


@query("""WITH a AS (SELECT event_id, user_id || event_type AS h, row_number() OVER (PARTITION BY user_id || event_type ORDER BY event_id) - 1 AS occ FROM events),
b AS (SELECT event_id AS served_by, value AS response, (user_id + 1) || event_type AS h, row_number() OVER (PARTITION BY (user_id + 1) || event_type ORDER BY event_id) - 1 AS occ FROM events)
SELECT event_id, occ, response, served_by FROM a LEFT JOIN b USING (h, occ)""")
def cache_lookup(spark, sf_dir):
    """Every event asks, and every event was recorded under the next user's requests."""
    e = table(spark, sf_dir, "events")
    a = e.select("event_id", F.concat("user_id", "event_type").alias("request_hash"), F.col("event_id").alias("ord"))
    b = e.select(F.concat(F.col("user_id") + 1, "event_type").alias("request_hash"), F.col("event_id").alias("ord"), F.col("value").alias("response"), F.col("event_id").alias("call_id"))
    return runlog.cached(a, b).select("event_id", "occ", "response", "served_by")


@query("""WITH e AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events),
f AS (SELECT event_id, user_id, (sum(CASE WHEN event_type NOT IN ('purchase', 'view') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY event_id))::bigint AS failures_in_a_row FROM e)
SELECT event_id, failures_in_a_row, max(failures_in_a_row >= 10) OVER (PARTITION BY user_id ORDER BY event_id) AS tripped FROM f""")
def breaker_islands(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_id").alias("ord"), (F.col("event_type") == "purchase").alias("succeeded"), (F.col("event_type") == "view").alias("throttled"))
    return runlog.breaker(e, ["user_id"]).select("event_id", "failures_in_a_row", "tripped")


@query("""SELECT event_id, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS spent_before, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + value, 4) <= 500.00001 AS admitted FROM events""")
def budget_admission(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_id").alias("ord"), F.col("value").alias("cost"))
    out = runlog.admitted(e, ["user_id"], F.lit(500.00001))
    return out.select("event_id", F.round("spent_before", 4).alias("spent_before"), "admitted")


CALL_STATUS = """SELECT event_id, user_id, event_id % 23 = 0 AS replay_miss, (list_value('ok', 'timeout', 'rate_limited', 'overloaded', 'api_error', 'truncated', 'malformed', 'refusal'))[(event_id % 8 + 1)::int] AS status,
  (list_value(NULL, 400, 404, 408, 409, 500, 503))[(event_id % 7 + 1)::int] AS http, (list_value(NULL, NULL, NULL, true, false))[(event_id % 5 + 1)::int] AS should_retry FROM events"""


def statuses_of(spark, sf_dir) -> DataFrame:
    """events as results of calls: status, replay_miss, http, should_retry."""
    at = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % n).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 23 == 0).alias("replay_miss"), at(runlog.STATUSES, 8).alias("status"), at((None, 400, 404, 408, 409, 500, 503), 7).alias("http"), at((None, None, None, True, False), 5).alias("should_retry"))


@query("SELECT event_id, CASE WHEN replay_miss THEN 'replay_miss' WHEN status <> 'ok' THEN status END AS kind FROM (" + CALL_STATUS + ")")
def failure_kinds(spark, sf_dir):
    return statuses_of(spark, sf_dir).select("event_id", runlog.failure_kind(F.col("status"), F.col("replay_miss")).alias("kind"))


@query("""SELECT event_id, CASE WHEN replay_miss OR status IN ('ok', 'truncated', 'malformed', 'refusal') THEN false WHEN should_retry IS NOT NULL THEN should_retry
  WHEN status IN ('timeout', 'rate_limited', 'overloaded') OR http IS NULL THEN true ELSE http IN (408, 409) OR http BETWEEN 500 AND 599 END AS retry FROM (""" + CALL_STATUS + ")")
def retryable_calls(spark, sf_dir):
    return statuses_of(spark, sf_dir).select("event_id", runlog.retryable(F.col("status"), F.col("replay_miss"), F.col("http"), F.col("should_retry")).alias("retry"))


@query("SELECT user_id, count(*) >= 6 OR max(event_id * 1000 - first) >= 90000 AS exhausted FROM (SELECT *, min(event_id * 1000) OVER (PARTITION BY user_id) AS first FROM (" + CALL_STATUS + ")) GROUP BY 1")
def exhausted_batches(spark, sf_dir):
    calls = statuses_of(spark, sf_dir).select(F.col("user_id").alias("batch"), (F.col("event_id") * 1000).alias("at_ms"))
    return runlog.exhausted(calls, "batch", "at_ms").select(F.col("batch").alias("user_id"), "exhausted")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'rescued' ELSE c_mktsegment END AS answer FROM customer""")
def rescue_overlay(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("answer"))
    return runlog.overlaid(c, c.where("c_custkey % 10 = 0").withColumn("answer", F.lit("rescued")), "c_custkey")


# --- samples and similarity -----------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT c_mktsegment, count(*) AS population FROM customer GROUP BY 1), t AS (SELECT *, sum(population) OVER () AS t FROM s),
a AS (SELECT *, population * 100 // t AS fl, population * 100 % t AS rest FROM t), b AS (SELECT *, row_number() OVER (ORDER BY rest DESC, population DESC, c_mktsegment) AS rk, 100 - sum(fl) OVER () AS short FROM a),
n AS (SELECT c_mktsegment, fl + CASE WHEN rk <= short THEN 1 ELSE 0 END AS n FROM b),
r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('salt' || c_custkey), c_custkey) AS rk FROM customer)
SELECT c_custkey, c_mktsegment FROM r JOIN n USING (c_mktsegment) WHERE rk <= n""")
def stratified_sample(spark, sf_dir):
    return sample.stratified(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 100, "salt")


@query("SELECT c_custkey, CASE WHEN (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) % 2 = 0 THEN 'dev' ELSE 'held_out' END AS side FROM customer")
def alternating_split(spark, sf_dir):
    return sample.alternating(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_custkey").select("c_custkey", "side")


@query()
def bootstrap_band(spark, sf_dir):
    p = pairs_of(spark, sf_dir).select("lang", (F.col("decision") == "matched").alias("matched"), "correct")
    return sample.bootstrap_band(p, ["lang"], 200, 7).select("lang", "resamples", r6("low").alias("low"), r6("high").alias("high"))


GRAMS = r"""
WITH texts AS (SELECT 'l' AS side, p_partkey AS id, p_name || ' ' || p_type AS text FROM part UNION ALL SELECT 'b', -1 - item_id, text FROM benchmark),
w AS (SELECT side, id, unnest(list_filter(string_split_regex(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(string_split_regex(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda x: x <> ''), 1) AS at_ FROM texts),
cg AS (SELECT 'c' AS kind, side, id, substr(p, i::int, n::int) AS gram FROM (SELECT side, id, ' ' || w || ' ' AS p, n, unnest(range(1, greatest(length(w) + 2 - n + 1, 1) + 1)) AS i FROM w CROSS JOIN (SELECT unnest([3, 4, 5]) AS n) WHERE length(w) + 2 >= n OR n = 3)),
ww AS (SELECT side, id, w, lead(w) OVER (PARTITION BY side, id ORDER BY at_) AS nxt FROM w WHERE length(w) >= 2), wg AS (SELECT 'w', side, id, w FROM ww UNION ALL SELECT 'w', side, id, w || ' ' || nxt FROM ww WHERE nxt IS NOT NULL),
tf AS (SELECT kind, side, id, gram, 1 + ln(count(*)) AS tf FROM (SELECT * FROM cg UNION ALL SELECT * FROM wg) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM texts), idf AS (SELECT kind, gram, ln((1 + (SELECT n FROM n)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY ALL),
v AS (SELECT kind, side, id, gram, tf * idf AS w, sqrt(sum((tf * idf) ^ 2) OVER (PARTITION BY kind, side, id)) AS norm FROM tf JOIN idf USING (kind, gram)),
s AS (SELECT a.id AS line, b.id AS "row", sum(a.w / a.norm * b.w / b.norm) / 2 AS score FROM v a JOIN v b USING (kind, gram) WHERE a.side = 'l' AND b.side = 'b' GROUP BY 1, 2)
"""


@query(GRAMS + 'SELECT line, "row", round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY round(score, 9) DESC, "row") AS r FROM s) WHERE r = 1')
def tfidf_top1(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    lines = part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    library = table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).cast("long").alias("id"), "text")
    return similarity.top1(lines, library, lines.unionByName(library)).select("line", "row", r6("score").alias("score"))


# --- checks ---------------------------------------------------------------------------------------------------------


@query("""SELECT 'orphan_lines' AS "check", count(*) AS violations FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'duplicate_orders', (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) UNION ALL SELECT 'unknown_status', count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F', 'P')
UNION ALL SELECT 'row_loss', (SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45)) - 2 * (SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45) JOIN orders ON l_orderkey = o_orderkey) + (SELECT count(*) FROM orders)
UNION ALL SELECT 'cost_total', (SELECT (abs(sum(CASE WHEN l_returnflag = 'R' THEN 1.01 ELSE 1 END * l_quantity) - sum(l_quantity)) > 1e-6 * greatest(sum(l_quantity), 1))::INT FROM lineitem) UNION ALL SELECT 'cost_total_kept', 0""")
def dq_checks(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    parts = lines.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("q"))
    return checks.run({
        "orphan_lines": checks.orphans(lines, "l_orderkey", orders, "o_orderkey"),
        "duplicate_orders": checks.duplicates(orders, ["o_orderkey"]),
        "unknown_status": checks.outside(orders, "o_orderstatus", ["O", "F", "P"]),
        "row_loss": checks.differences(orders.select("o_orderkey"), lines.where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct()),
        "cost_total": checks.totals_differ(parts.withColumn("q", F.when(F.col("l_returnflag") == "R", F.col("q") * 1.01).otherwise(F.col("q"))), "q", lines, "l_quantity", 1e-6),
        "cost_total_kept": checks.totals_differ(parts, "q", lines, "l_quantity", 1e-6),
    })


# --- replay and lineage ---------------------------------------------------------------------------------------------


@query(TALLY + """, f AS (SELECT *, CASE WHEN weakest >= 90 THEN 3 WHEN weakest >= 80 THEN 2 WHEN weakest >= 70 THEN 1 ELSE 0 END AS k, CASE WHEN line % 5 = 1 THEN 1 ELSE 0 END AS b FROM tally WHERE line % 17 <> 0 AND line % 19 <> 0 AND line % 23 <> 0 AND line % 29 <> 0 AND line % 31 <> 0 AND passes >= 2 AND line % 7 <> 0 AND line % 11 <> 0 AND leader <> 'error' AND line % 13 <> 0 AND line % 37 <> 0 AND line % 5 <> 0 AND line % 41 <> 0 AND NOT (line % 3 = 0 AND line % 2 <> 0)),
t AS (SELECT * FROM (VALUES ('T1',1,3),('T2',1,2),('T3',1,1),('T4',1,0),('T5',0,3),('T6',0,2),('T7',0,1),('T8',0,0)) x(threshold, mb, mk))
SELECT threshold, count(*) FILTER (WHERE NOT tie AND (votes > 2 OR (votes = 2 AND (b > mb OR (b = mb AND k >= mk))))) AS matched FROM f, t GROUP BY 1""")
def redecide_thresholds(spark, sf_dir):
    out = replay.redecided(decision_rows(spark, sf_dir), decide.thresholds(spark, 2))
    return out.groupBy("threshold").agg(F.count_if(F.col("decision") == "matched").alias("matched"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'T3' WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 'T7' ELSE 'T1' END AS threshold,
CASE WHEN o_orderkey % 10 = 0 THEN 'override' WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 'policy' ELSE 'fallback' END AS how FROM orders""")
def policy_lookup(spark, sf_dir):
    q = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("library_hash"), F.when(F.col("o_orderkey") % 10 == 0, "T3").alias("override"))
    p = spark.createDataFrame([("1-URGENT", "F", "T7")], "model string, library_hash string, threshold string")
    return replay.resolved_policy(q, p, "T1").select("o_orderkey", "threshold", "how")


@query(TAXONOMY + """, f AS (SELECT p_partkey AS line, code AS leader, c.type FROM part JOIN coded c ON c.type = p_type AND c.usage = p_brand AND c.subtype = CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END),
n AS (SELECT *, (row_number() OVER (PARTITION BY type ORDER BY line) - 1) // 8 AS group_no FROM f)
SELECT type, group_no::bigint AS group_no, array_to_string(list(line ORDER BY line), ';') AS lines, (SELECT count(*) FROM coded c WHERE c.type = n.type) AS candidates FROM n GROUP BY type, group_no""")
def verifier_groups(spark, sf_dir):
    coded = taxonomy_of(spark, sf_dir)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line"), F.col("p_type").alias("type"), F.col("p_brand").alias("usage"), F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_name")).alias("subtype"))
    flagged = part.join(coded, ["type", "usage", "subtype"]).select("line", F.col("code").alias("leader"))
    out = replay.verifier_groups(flagged, coded, 8)
    return out.select("type", "group_no", F.array_join(F.col("lines").cast("array<string>"), ";").alias("lines"), F.size("candidates").cast("long").alias("candidates"))


@query(PAIRS + """, p AS (SELECT lang, correct, decision = 'matched' AS a, score >= 50 AS b FROM pairs), e AS (SELECT lang, correct, 'shipped' AS policy, a AS m FROM p UNION ALL SELECT lang, correct, 'rescue', a OR b FROM p UNION ALL SELECT lang, correct, 'veto', a AND b FROM p)
SELECT lang, policy, count(*) FILTER (WHERE m) AS matched, count(*) FILTER (WHERE m AND correct) AS correct, round(count(*) FILTER (WHERE m AND correct) / nullif(count(*) FILTER (WHERE m), 0), 6) AS precision FROM e GROUP BY 1, 2""")
def policy_figures(spark, sf_dir):
    p = pairs_of(spark, sf_dir)
    a, b = F.col("decision") == "matched", F.col("score") >= 50
    return replay.policy_figures(p, {"shipped": a, "rescue": a | b, "veto": a & b}, ["lang"]).withColumn("precision", r6("precision"))


@query("""SELECT sum(quality - toxic)::bigint AS gain, count(*) FILTER (WHERE quality <> toxic) AS discordant, count(*) FILTER (WHERE quality > toxic) AS improved, 0::bigint AS unpaired, sum(quality - toxic) >= greatest(6, 2 * sqrt(count(*) FILTER (WHERE quality <> toxic))) AS keep FROM labels""")
def keep_verdict(spark, sf_dir):
    l = table(spark, sf_dir, "labels")
    return replay.keep_verdict(l.select("doc_id", F.col("toxic").alias("correct")), l.select("doc_id", F.col("quality").alias("correct")), ["doc_id"])


@query("""WITH a AS (SELECT DISTINCT user_id AS batch, id FROM events, unnest(range(10)) r(id)), e AS (SELECT user_id AS batch, event_id % 10 AS id, count(DISTINCT event_type) AS k, min(event_type) AS raw FROM events GROUP BY 1, 2)
SELECT a.batch, a.id, CASE WHEN k IS NULL THEN 'missing' WHEN k > 1 THEN 'conflict' ELSE 'settled' END AS state, CASE WHEN k = 1 THEN raw END AS raw FROM a LEFT JOIN e ON a.batch = e.batch AND a.id = e.id""")
def batch_reconcile(spark, sf_dir):
    """Each user is a batch that asks for ten lines; events answer them."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("batch"), (F.col("event_id") % 10).alias("id"), F.col("event_type").alias("raw"))
    asked = e.select("batch").distinct().select("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("id"))
    return replay.reconciled(asked, e)


@query("""SELECT l_orderkey AS line, l_linenumber AS call_order, l_partkey AS call_id, p_brand AS model, p_partkey IS NOT NULL AS recorded FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS l_linenumber FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem))
LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) ON l_partkey = p_partkey""")
def call_lineage(spark, sf_dir):
    audit = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("line")).agg(F.array_sort(F.collect_set("l_partkey")).alias("call_ids"))
    calls = table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("call_id"), F.col("p_brand").alias("model"))
    return lineage.call_fields(audit, calls).select("line", "call_order", "call_id", "model", "recorded")


@query("""SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":' || CASE WHEN c_custkey % 4 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || ',"c_name":"' || c_name || '"}') AS record_sha256 FROM customer""")
def audit_records(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return c.select("c_custkey", F.sha2(lineage.audit_record(c.columns), 256).alias("record_sha256"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END AS type, printf('%.6f', o_totalprice / 7) AS cost, o_orderkey || ';' || o_custkey AS call_ids FROM orders""")
def output_cells(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "matched").otherwise("needs_review").alias("decision"), *[F.col("o_orderpriority").alias(c) for c in ("type", "usage", "subtype")], (F.col("o_totalprice") / 7).alias("cost"), F.array(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")).alias("call_ids"))
    return lineage.output_cells(o).select("o_orderkey", "type", "cost", "call_ids")


@query(DECISIONS + """SELECT count(*) AS "all", count(*) FILTER (WHERE decision = 'matched') AS matched, count(*) FILTER (WHERE decision = 'needs_review') AS needs_review, count(*) FILTER (WHERE decision = 'not_a_material') AS not_a_material, count(*) FILTER (WHERE starts_with(reason, 'LLM_')) AS failed FROM decided""")
def filter_counts(spark, sf_dir):
    return lineage.filter_counts(decide.decided(decision_rows(spark, sf_dir)))


# --- levels, line ids, estimates ------------------------------------------------------------------------------------

LEVELS = """WITH p AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_type END AS type, p_brand AS usage, p_name AS subtype,
  CASE WHEN p_partkey % 7 = 0 THEN 'OTHER' ELSE p_type END AS p_t, CASE WHEN p_partkey % 5 = 0 THEN 'OTHER' ELSE p_brand END AS p_u, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE '  ' || p_name END AS p_s FROM part),
h AS (SELECT *, p_t = type AND type <> '' AS h1, p_t = type AND type <> '' AND p_u = usage AS h2, p_t = type AND type <> '' AND p_u = usage AND p_s = subtype AS h3, p_t = type AND type <> '' AND p_u = usage AND trim(p_s) = subtype AS lenient FROM p)
"""


def leveled_of(spark, sf_dir) -> DataFrame:
    """part as references (type, usage, subtype) and predictions (p_t, p_u, p_s)."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k, "p_size", F.when(k % 9 == 0, "").otherwise(F.col("p_type")).alias("type"), F.col("p_brand").alias("usage"), F.col("p_name").alias("subtype"),
        F.when(k % 7 == 0, "OTHER").otherwise(F.col("p_type")).alias("p_t"), F.when(k % 5 == 0, "OTHER").otherwise(F.col("p_brand")).alias("p_u"),
        F.when(k % 3 == 0, F.upper("p_name")).otherwise(F.concat(F.lit("  "), "p_name")).alias("p_s"),
    )


@query(LEVELS + """SELECT p_size, round(avg(h1::int), 6) AS at_type, round(avg(h2::int), 6) AS at_usage, round(avg(h3::int), 6) AS at_subtype, round(avg(lenient::int), 6) AS at_lenient,
  round(count_if(h2) / nullif(count_if(h1), 0), 6) AS usage_given_type, round(count_if(lenient) / nullif(count_if(h2), 0), 6) AS subtype_given_usage FROM h GROUP BY 1""")
def level_accuracy(spark, sf_dir):
    return levels.accuracy(leveled_of(spark, sf_dir), ["p_size"], ["p_t", "p_u", "p_s"], ["type", "usage", "subtype"]).select("p_size", *[r6(c).alias(c) for c in ("at_type", "at_usage", "at_subtype", "at_lenient", "usage_given_type", "subtype_given_usage")])


@query(LEVELS + """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'decision' WHEN NOT h1 THEN 'type' WHEN NOT h2 THEN 'usage' ELSE 'subtype' END AS level, CASE WHEN type <> '' THEN type ELSE p_t END AS family FROM h""")
def first_wrong_level(spark, sf_dir):
    kind = F.when(F.col("p_partkey") % 4 == 0, "false_nm").otherwise("false_match")
    rows = leveled_of(spark, sf_dir)
    return rows.select("p_partkey", levels.first_wrong(kind, ["p_t", "p_u", "p_s"], ["type", "usage", "subtype"]).alias("level"), levels.family(F.col("type"), F.col("p_t")).alias("family"))


@query("""SELECT c_custkey, substr(sha256('[' || c_custkey || ',' || substr(to_json([coalesce(c_mktsegment, ''), c_name || ' "x"', 'größe'])::varchar, 2)), 1, 16) AS line_id FROM customer""")
def line_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.line_id(F.col("c_custkey"), F.col("c_mktsegment"), F.concat("c_name", F.lit(' "x"')), F.lit("größe")).alias("line_id"))


@query("""SELECT p_type, ceil(sum(length(p_name) + length(p_brand) + 3 * length(p_size::varchar) + 24) / 3.0)::bigint AS taxonomy_tokens, sum(ceil(length(p_name) / 4.0))::bigint AS text_tokens FROM part GROUP BY 1""")
def token_estimates(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    size = F.length("p_name") + F.length("p_brand") + 3 * F.length(F.col("p_size").cast("string")) + 24
    return part.groupBy("p_type").agg(F.ceil(F.sum(size) / 3.0).alias("taxonomy_tokens"), F.sum(text.estimated_tokens(F.col("p_name"))).alias("text_tokens"))


@query("""SELECT o_orderpriority, round(greatest(2.0 * count(*) / 100, 5.0), 6) AS cap, count_if(o_orderstatus = 'F') AS correct, count_if(o_orderstatus <> 'O') AS matched,
  round(count_if(o_orderstatus = 'F') / nullif(count_if(o_orderstatus <> 'O'), 0), 6) AS precision, round(1 - count_if(o_orderstatus = 'F') / nullif(count_if(o_orderstatus <> 'O'), 0), 6) AS risk,
  round(count_if(o_orderstatus = 'F') / count(*), 6) AS coverage, round(count_if(o_orderstatus <> 'O') / count(*), 6) AS selected FROM orders GROUP BY 1""")
def point_figures(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("correct"), F.count_if(F.col("o_orderstatus") != "O").alias("matched"), F.count("*").alias("labelled"))
    found = levels.point_figures(rows).withColumn("cap", runlog.budget_cap(F.col("labelled"), 2.0, 5.0))
    return found.select("o_orderpriority", r6("cap").alias("cap"), "correct", "matched", *[r6(c).alias(c) for c in ("precision", "risk", "coverage", "selected")])


# --- review and enrichment ------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'L' WHEN o_orderkey % 9 = 0 THEN 'S' WHEN o_orderkey % 4 <> 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'H' ELSE 'blank' END
  WHEN o_orderkey % 7 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 8 = 0 THEN 'blank' ELSE 'H' END ELSE 'U' END AS class FROM orders""")
def row_classes(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("type"), F.lit("").alias("usage"), F.when(k % 9 == 0, "S").alias("listed"),
        F.when(k % 4 != 0, F.when(k % 5 == 0, " ").otherwise("m")).alias("unit"), F.when(k % 7 != 0, F.when(k % 8 == 0, "01.02.0003.").otherwise("01.02")).alias("key"))
    return o.select("o_orderkey", review.row_class(["type", "usage"], F.col("listed"), F.col("unit"), F.col("key")).alias("class"))


@query("""SELECT coalesce(problem, 'none') AS problem, count(*) AS n FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 'invalid' WHEN l_returnflag = 'A' AND l_linenumber % 3 = 0 THEN 'matched_blank' WHEN l_returnflag = 'N' AND l_linenumber % 3 <> 0 THEN 'labelled_non_match' END AS problem FROM lineitem) GROUP BY 1""")
def row_problems(spark, sf_dir):
    flag = F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(F.when(flag == "A", "matched").when(flag == "N", "needs_review").otherwise("maybe").alias("decision"), F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(flag).alias("type"))
    return rows.groupBy(F.coalesce(review.row_problem(F.col("decision"), ["type"]), F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT o_custkey AS key, count(*) AS a FROM orders GROUP BY 1), b AS (SELECT c_custkey AS key, count(*) AS b FROM customer GROUP BY 1), j AS (SELECT key, a, b FROM a FULL JOIN b USING (key))
SELECT key, 'repeated_in_reference' AS problem FROM j WHERE a > 1 UNION ALL SELECT key, 'repeated_in_output' FROM j WHERE b > 1 UNION ALL SELECT key, 'missing' FROM j WHERE b IS NULL UNION ALL SELECT key, 'extra' FROM j WHERE a IS NULL""")
def key_violations(spark, sf_dir):
    return review.key_violations(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k"), table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k"), "k")


@query("""WITH g AS (SELECT event_id // 3 AS line, count(*) AS n, min(event_type) AS top1, max(event_type) AS t2, bool_and(user_id % 10 <> 0) AS m FROM events GROUP BY 1)
SELECT line, top1 FROM g WHERE n = 3 AND top1 = t2 AND m""")
def unanimous_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.expr("event_id div 3").alias("line"), F.when(F.col("user_id") % 10 != 0, "material").otherwise("service").alias("kind"), F.col("event_type").alias("top1"))
    return review.unanimous_answers(e, 3)


@query(TALLY + "SELECT votes, count(*) AS n, count(*) FILTER (WHERE line % 3 = 0) AS correct, round(count(*) FILTER (WHERE line % 3 = 0) / count(*), 6) AS precision FROM tally GROUP BY 1")
def precision_by_votes(spark, sf_dir):
    t = votes.tally(votes_of(spark, sf_dir)).select("votes", (F.col("line") % 3 == 0).alias("correct"))
    return review.precision_by(t, "votes").withColumn("precision", r6("precision"))


@query(TALLY + "SELECT count(*) FILTER (WHERE line % 3 <> 0 AND votes = 5) AS unanimous_wrong, count(*) FILTER (WHERE line % 3 <> 0) AS wrong, round(count(*) FILTER (WHERE line % 3 <> 0 AND votes = 5) / nullif(count(*) FILTER (WHERE line % 3 <> 0), 0), 6) AS share FROM tally")
def systematic_errors(spark, sf_dir):
    t = votes.tally(votes_of(spark, sf_dir)).select("votes", (F.col("line") % 3 == 0).alias("correct"))
    return review.systematic(t, 5).withColumn("share", r6("share"))


@query("""SELECT user_id, ['tossup', 'narrow', 'clear', 'decisive'][min(event_id % 4)::int + 1] AS gap FROM events GROUP BY 1""")
def weakest_gaps(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.get(F.array(*map(F.lit, review.GAPS)), (F.col("event_id") % 4).cast("int")).alias("gap"))
    return e.groupBy("user_id").agg(review.weakest_gap(F.col("gap")).alias("gap"))


@query("""WITH e AS (SELECT o_orderpriority AS lang, o_custkey % 40 AS cause, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS w FROM orders), t AS (SELECT lang, count(*) AS t FROM e GROUP BY 1), n AS (SELECT lang, cause, count(*) AS n, sum(w) AS weighted FROM e GROUP BY 1, 2)
SELECT t.lang AS lang, 'c' || c AS cause, coalesce(n, 0) AS n, round(coalesce(n, 0) / t, 6) AS share, coalesce(n, 0) >= 5 OR (coalesce(n, 0) > 0 AND coalesce(n, 0) >= 0.2 * t) AS triggered, coalesce(weighted, 0)::bigint AS weighted FROM t CROSS JOIN range(45) r(c) LEFT JOIN n ON n.lang = t.lang AND n.cause = c""")
def cause_triggers(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("lang"), F.concat(F.lit("c"), F.col("o_custkey") % 40).alias("cause"), F.when(F.col("o_orderstatus") == "F", "false_match").otherwise("missed").alias("kind"))
    causes = spark.range(45).select(F.concat(F.lit("c"), "id").alias("cause"))
    return review.cause_triggers(e, "lang", causes).withColumn("share", r6("share"))


@query(PAIRS + "SELECT decision, (score % 4)::int AS agreeing, correct, count(*) AS n FROM pairs GROUP BY 1, 2, 3")
def agreement_table(spark, sf_dir):
    return review.counted(pairs_of(spark, sf_dir).withColumn("agreeing", (F.col("score") % 4).cast("int")), ["decision", "agreeing", "correct"])


@query("SELECT count(DISTINCT p_type) AS types, count(DISTINCT (p_type, p_brand)) AS usages, count(*) AS rows FROM part")
def taxonomy_size(spark, sf_dir):
    return review.taxonomy_size(table(spark, sf_dir, "part").withColumnsRenamed({"p_type": "type", "p_brand": "usage"}))


@query("""WITH l AS (SELECT p_type AS label FROM part UNION SELECT p_brand FROM part UNION SELECT p_name FROM part)
SELECT label FROM l WHERE trim(label) <> ''""")
def taxonomy_labels(spark, sf_dir):
    return enrich.labels(table(spark, sf_dir, "part").withColumnsRenamed({"p_type": "type", "p_brand": "usage", "p_name": "subtype"}))

"""Importance resampling towards a target distribution, in DataFrame operations only.

Hashed n-grams are counted in buckets over the whole corpus and over the target's texts; the logarithm of the buckets'
odds is a gain, and a document's weight is the mean gain of its features. Documents are drawn without replacement by
weight plus Gumbel noise that the identifier fixes: the highest scores are drawn. Ranks come from one sort by ranges: each
range's rows are numbered where they lie, and the sizes of the ranges before it are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolith.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that separate words, once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
SEED = 2024
#: Documents of fewer words are not drawn; of those that are left, so many in a hundred are.
LEAST_WORDS, PERCENT = 20, 10


def words(text: Column) -> Column:
    """Words of a whole text with A-Z lower-cased; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), lambda w: w != "")


def ngrams(tokens: Column, most: int) -> Column:
    """All runs of 1 to most consecutive words, joined by one space, repeats kept."""

    def runs(w: Column, n: int) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))

    # the words are computed once, not once for every start
    return tokens if most == 1 else F.transform(F.array(tokens), lambda w: F.concat(w, *[runs(w, n) for n in range(2, most + 1)]))[0]


def bucket(feature: Column, buckets: int) -> Column:
    return F.crc32(feature.cast("binary")) % buckets


def gains(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: at most `buckets` rows, one for each bucket that occurs on either side.

    Features of both tables' texts are counted before the shuffle, so that a frequent word is one row a task.
    """
    side = lambda df, of_target: df.select(F.explode(ngrams(words(F.col("text")), most)).alias("feature")).select(bucket(F.col("feature"), buckets).alias("bucket"), F.lit(of_target).alias("of_target"))
    counts = side(docs, False).unionByName(side(target, True)).groupBy("bucket").agg(F.count_if(~F.col("of_target")).alias("s"), F.count_if(F.col("of_target")).alias("t"))
    counts = common.kept(counts, "bucket_counts")
    total = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).cast("double").alias("all_t"))
    odds = (F.col("t") + 1.0) * (F.col("all_s") + float(buckets)) / ((F.col("s") + 1.0) * (F.col("all_t") + float(buckets)))
    return counts.crossJoin(F.broadcast(total)).select("bucket", F.floor(1000.0 * F.log(odds)).alias("gain"))  # total is one row


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a digest of seed and identifier; a null identifier counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighted(docs: DataFrame, gain: DataFrame, most: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """row, doc_id, n_words, n_features, weight, score for every row; gain has at most `buckets` rows and is broadcast."""
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("words"))
    each = read.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.explode_outer(ngrams(F.col("words"), most)).alias("feature"))
    found = each.select("row", "doc_id", "n_words", bucket(F.col("feature"), buckets).alias("bucket")).join(F.broadcast(gain), "bucket", "left")
    # a text's features lie together: they are summed before anything is shuffled
    total = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    # whole numbers only: pmod() makes the division go down
    weight = F.expr("(total - pmod(total, greatest(n_features, 1L))) div greatest(n_features, 1L)")
    return total.withColumn("weight", weight).select("row", "doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))


def ranked(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """scored with rank: 1, 2, 3 and so on over the drawn rows by falling score, then doc_id; null for the others.

    The rows are dealt by ranges of (may be drawn, score, doc_id, row), so that equal scores don't meet in one task, and
    written with their place in the range. Only the ranges' sizes, a row each, are added up.
    """
    drawable = F.col("n_words") >= least_words
    keys = [F.desc("drawable"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    ranges = scored.withColumn("drawable", drawable).repartitionByRange(*keys).sortWithinPartitions(*keys)
    number = F.monotonically_increasing_id()
    placed = common.kept(ranges.select("doc_id", "n_features", "weight", "score", "drawable", F.shiftright(number, 33).alias("range"), number.bitwiseAND((1 << 33) - 1).alias("at")), "ranges")
    sizes = placed.groupBy("range").agg(F.count_if("drawable").alias("n"))  # a row for each task of the sort
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("range", before.alias("before"), F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100).alias("drawn"))
    rank = F.col("before") + F.col("at") + 1
    return placed.join(common.checked(offsets), "range").select(
        "doc_id", "n_features", "weight", "score", F.when(F.col("drawable") & (rank <= F.col("drawn")), rank).alias("rank")
    )


def resampled(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row per row of docs, drawn or not.

    Null and empty texts have no features, weight 0 and are not drawn; very long texts are exploded whole. Repeated rows are
    rows of their own: each is weighed and may be drawn; of equal scores the smaller doc_id goes first, a null one last (it
    is hashed as an empty identifier). Empty docs give no rows; an empty target gives gains from the corpus alone. Other
    columns of either table are ignored.
    """
    own, other = common.no_clash(docs, "doc_id", "text"), common.no_clash(target, "text")
    return ranked(weighted(own, gains(own, other, most, buckets), most, buckets, seed), least_words, percent)


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resampled(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


#: CRC-32 in SQL: a table of 256 remainders, then a fold over the bytes of x. The expressions go into WITH RECURSIVE.
CRC_TABLE = """remainder_(n, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM remainder_ WHERE k < 8),
crc_ AS (SELECT list(c ORDER BY n) AS tab FROM remainder_ WHERE k = 8)"""


def crc_sql(x: str) -> str:
    """CRC-32 of the SQL expression x (text), where crc_ is one of the tables joined."""
    octets = f"list_transform(range(strlen({x})), lambda i: ('0x' || substr(hex({x}), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLE = f"""WITH RECURSIVE {CRC_TABLE},
low AS (SELECT doc_id, 0 AS side, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS x FROM documents UNION ALL SELECT NULL, 1, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') FROM benchmark),
w AS (SELECT doc_id, side, list_filter(string_split_regex(x, '{SEPARATORS}'), lambda y: y <> '') AS words FROM low),
f AS (SELECT doc_id, side, unnest(words) AS feature FROM w),
b AS (SELECT feature, {crc_sql("feature")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT feature FROM f) CROSS JOIN crc_),
c AS (SELECT bucket, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM f JOIN b USING (feature) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM c) + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM c) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM c),
m AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN b USING (feature) JOIN g USING (bucket) WHERE side = 0 GROUP BY 1),
d AS (SELECT w.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('{SEED}:' || w.doc_id), 1, 8))::BIGINT AS h FROM w LEFT JOIN m ON m.doc_id = w.doc_id WHERE side = 0),
e AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM e WHERE n_features >= {LEAST_WORDS})
SELECT e.*, CASE WHEN rank <= {PERCENT} * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM e LEFT JOIN r USING (doc_id)"""

"""TF-IDF similarity join between texts and a small library of labels, on n-grams of characters and words."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxolith.sources import tables


#: Scores are compared to nine digits; bounds leave so much room.
ROOM = 1e-8


@F.pandas_udf(T.StringType())
def unaccented(text: pd.Series) -> pd.Series:
    """Compatibility forms taken apart, marks dropped; plain ASCII passes as it is."""

    def one(t):
        return t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))

    return text.map(one)


def words_of(folded: Column) -> Column:
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def char_grams(folded: Column, low: int = 3, high: int = 5) -> Column:
    """n-grams inside words, each word padded with one blank on both sides; a shorter padded word is one gram."""
    padded = F.transform(words_of(folded), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(w, n):
        return F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.when(F.lit(n == low), F.array(w)).otherwise(F.array().cast("array<string>")))

    return F.flatten(F.transform(padded, lambda w: F.concat(*[grams(w, n) for n in range(low, high + 1)])))


def word_grams(folded: Column, most: int = 2) -> Column:
    """Runs of 1 to most words of two characters or more."""
    words = F.filter(words_of(folded), lambda w: F.length(w) >= 2)

    def runs(w: Column, n: int) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))

    return words if most == 1 else F.transform(F.array(words), lambda w: F.concat(w, *[runs(w, n) for n in range(2, most + 1)]))[0]


def grams(folded: Column, most_words: int = 2) -> Column:
    """Grams of both kinds, told apart by a first letter."""
    return F.concat(F.transform(char_grams(folded), lambda g: F.concat(F.lit("c"), g)), F.transform(word_grams(folded, most_words), lambda g: F.concat(F.lit("w"), g)))


def fitted(corpus: DataFrame, most_words: int = 2) -> DataFrame:
    """gram, idf = ln((1 + n) / (1 + df)) + 1 over the corpus' folded texts (id, text)."""
    df = corpus.select(F.explode(F.array_distinct(grams(F.col("text"), most_words))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    n = corpus.agg(F.count("*").alias("n"))  # one row
    return df.crossJoin(F.broadcast(n)).select("gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def vectors(texts: DataFrame, idf: DataFrame, most_words: int = 2) -> DataFrame:
    """id, gram, w: (1 + ln tf) * idf, the grams of each kind scaled to half a unit, so that products sum to the mean of both cosines."""
    tf = texts.select("id", F.explode(grams(F.col("text"), most_words)).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("tf"))
    raw = tf.join(idf, "gram").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(2 * F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id", F.substring("gram", 1, 1))))
    return raw.select("id", "gram", (F.col("w") / norm).alias("w"))


def top1(lines: DataFrame, library: DataFrame, corpus: DataFrame, most_words: int = 2) -> DataFrame:
    """line, row, score: the best library row of each line by the mean of the cosines of characters and words; of equals (to nine digits) the first row.

    Equal texts are one query. A gram can add at most its weight times the largest weight it has in the library. Each text
    first scores one promising row; what it then leaves out are its most frequent grams whose bounds together stay below
    that score: a row that has none of the others can't win. Rows with one of them are scored in full. Lines without a gram
    of the library have no row.
    """
    folded = lambda df: df.select("id", F.lower(unaccented(F.col("text"))).alias("text"))
    ours = tables.written(folded(lines), "folded_lines")
    idf = tables.written(fitted(folded(corpus), most_words), "idf")
    rows = tables.written(vectors(folded(library), idf, most_words).withColumnsRenamed({"id": "row", "w": "wb"}), "rows")
    texts = ours.groupBy("text").agg(F.min("id").alias("id"))
    known = rows.groupBy("gram").agg(F.max("wb").alias("top"), F.count("*").alias("df"))
    asked = vectors(texts, idf, most_words).withColumnRenamed("id", "text_id").join(known, "gram").select("text_id", "gram", "w", "df", (F.col("w") * F.col("top")).alias("bound"))
    asked = tables.written(asked, "asked")
    of_text = Window.partitionBy("text_id")
    rarest = asked.withColumn("k", F.row_number().over(of_text.orderBy("df", F.desc("bound"), "gram"))).where("k <= 2")
    product = F.sum(F.col("w") * F.col("wb"))
    tried = rarest.join(rows, "gram").groupBy("text_id", "row").agg(product.alias("part")).groupBy("text_id").agg(F.max_by("row", F.struct("part", -F.col("row"))).alias("row"))
    reached = tried.join(asked, "text_id").join(rows, ["row", "gram"]).groupBy("text_id").agg(product.alias("reached"))
    rest = F.sum("bound").over(of_text.orderBy(F.desc("df"), "bound", "gram").rowsBetween(Window.unboundedPreceding, 0))
    split = tables.written(asked.join(reached, "text_id").withColumn("needed", rest >= F.col("reached") - ROOM), "split")
    spare = split.where("NOT needed").groupBy("text_id").agg(F.sum("bound").alias("spare"))
    found = split.where("needed").join(rows, "gram").groupBy("text_id", "row").agg(product.alias("part"), F.first("reached").alias("reached")).join(spare, "text_id", "left")
    found = found.where(F.col("part") + F.coalesce("spare", F.lit(0.0)) >= F.col("reached") - ROOM)
    more = found.select("text_id", "row").join(split.where("NOT needed").select("text_id", "gram", "w"), "text_id").join(rows, ["row", "gram"]).groupBy("text_id", "row").agg(product.alias("more"))
    scored = found.join(more, ["text_id", "row"], "left").select("text_id", "row", (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("score"))
    best = scored.groupBy("text_id").agg(F.max_by(F.struct("row", "score"), F.struct(F.round("score", 9), -F.col("row"))).alias("best"))
    named = texts.withColumnRenamed("id", "text_id").join(best, "text_id").select("text", "best")
    return ours.join(named, "text").select(F.col("id").alias("line"), "best.row", "best.score")


def phrase_matches(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """id, term, starts of phrases in texts as whole words; a match inside a longer term's match does not count.

    terms is a dictionary: it is exploded to word n-grams on its own side and met by the texts' n-grams of the same
    lengths in an equality join, so no pair of text and term is compared that does not match.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    t = terms.select("term", words(F.col("term")).alias("tw")).where(F.size("tw") > 0).select("term", F.size("tw").alias("len"), F.array_join("tw", " ").alias("gram"))
    lengths = [r.len for r in t.select("len").distinct().collect()]  # a handful
    if not lengths:
        return texts.select("id").limit(0).selectExpr("id", "'' as term", "0 as at", "0 as len")
    w = texts.select("id", words(F.col("text")).alias("w"))

    def starts(n):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.struct(i.alias("at"), F.array_join(F.slice(F.col("w"), i, F.lit(n)), " ").alias("gram")))

    grams = F.flatten(F.array(*map(starts, lengths)))
    found = w.where(F.size("w") > 0).select("id", F.inline(grams)).join(F.broadcast(t) if t.count() <= 100_000 else t, "gram").select("id", "term", "at", "len")
    s = Window.partitionBy("id").orderBy("at", F.desc("len"))
    # an interval lies inside a longer one if the furthest end so far reaches its own
    furthest = F.max(F.col("at") + F.col("len")).over(s.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("_f", furthest).where(F.col("_f").isNull() | (F.col("_f") < F.col("at") + F.col("len"))).drop("_f").distinct()

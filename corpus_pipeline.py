"""A pipeline over the documents table: good documents, lines once, one of each near-duplicate group, no benchmark items, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolith.llm import common, decontaminate, jaccard, line_dedup, pieces, quality


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier (10): documents it rejects go; null and empty texts are scored as texts without characters."""
    model = quality.fit(docs.select("doc_id", "text"), common.table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def single_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (6): of each group of lines one stays, where it occurs first; a document keeps its row, a null text stays null."""
    after = line_dedup.line_dedup(docs)
    return after.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else after


def single_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (1), five words and 0.8: the document with the smallest identifier of each group stays.

    Documents without words, with a null text or without an identifier link with nothing and stay.
    """
    joined = jaccard.jaccard_join(docs, n=5, num=80, den=100)
    gone = common.kept(joined.where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct(), "near_duplicates")
    return common.without(docs, "doc_id", gone)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (9): documents that hold an item go; null and empty texts and rows without an identifier stay."""
    return decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding and decoding (2): the ids of each text, their number, and digests of ids and decoded text."""
    return pieces.encoded(docs, with_ids=True)


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", single_lines),
    ("ngram_jaccard_join", single_documents),
    ("benchmark_decontamination", without_benchmark),
    ("sentencepiece", tokens),
]

#: Stages use learned models, similarity and a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.kept(stage(spark, docs, sf_dir), f"after_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

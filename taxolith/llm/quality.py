"""Quality classifier: a sparse ensemble of rules, compiled into Spark column expressions.

Statistics of the text are columns. A small random forest over them gives paths; each path is a rule, a conjunction of
comparisons; a logistic regression with an L1 penalty weighs the rules and sets most weights to 0; what is left is one
column expression, so that scoring is a projection over any number of rows.

Training reads a bounded sample: at most SAMPLE labelled rows, those with the smallest hashes of their identifiers.
Scoring covers all rows and whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolith.llm import common

#: Labelled rows that training reads at most.
SAMPLE = 20_000
#: A score from here on predicts 1.
THRESHOLD = 0.3
TREES, DEPTH, PENALTY = 12, 3, 0.0005


def statistics(text: Column) -> dict[str, Column]:
    """Shares and means over a whole text; all are 0 for a null or empty one."""
    body = F.coalesce(text, F.lit(""))
    n = F.length(body)
    words = F.split(F.trim(body), r"\s+")
    lines = F.split(body, "\n")
    part = lambda count, of: F.coalesce(F.try_divide(count.cast("double"), of.cast("double")), F.lit(0.0))
    without = lambda pattern: n - F.length(F.regexp_replace(body, pattern, ""))
    single = lambda c: n - F.length(F.replace(body, F.lit(c), F.lit("")))
    return {
        "log_chars": F.log1p(n.cast("double")),
        "word_length": part(n, F.size(words)),
        "upper": part(without(r"\p{Lu}+"), n),
        "symbols": part(without(r"[^\p{L}\p{N}\s.,;:'\"()-]+"), n),
        "digits": part(without(r"[0-9]+"), n),
        "exclaims": part(single("!"), n),
        "bars": part(single("|"), n),
        "stops": part(single("."), n),
        "commas": part(single(","), n),
        "line_length": part(n, F.size(lines)),
        "distinct_words": part(F.size(F.array_distinct(words)), F.size(words)),
        "distinct_lines": part(F.size(F.array_distinct(lines)), F.size(lines)),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is at most, bound) with its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        held = F.lit(True)
        for name, at_most, bound in self.terms:
            held = held & (F.col(name) <= bound if at_most else F.col(name) > bound)
        return held


def paths(forest, names: list[str]) -> list[Rule]:
    """Every path from a root to any other node, once each."""
    found: dict[tuple, Rule] = {}

    def walk(node, terms):
        if terms:
            found[tuple(sorted(terms))] = Rule(tuple(sorted(terms)))
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            name, bound = names[split.featureIndex()], split.threshold()
            walk(node.leftChild(), (*terms, (name, True, bound)))
            walk(node.rightChild(), (*terms, (name, False, bound)))

    for tree in forest.trees:
        walk(tree._call_java("rootNode"), ())
    return list(found.values())


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    intercept: float

    def score(self) -> Column:
        """Over columns named as the statistics: the probability of label 1."""
        total = F.lit(float(self.intercept))
        for rule in self.rules:
            total = total + F.when(rule.column(), F.lit(float(rule.weight))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def held_out(doc_id: Column, mod: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, remainder: int, size: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label) of at most size labelled rows outside the held-out fold, one a doc_id."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0.0, 1.0) & ~held_out(F.col("doc_id"), mod, remainder))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).join(F.broadcast(chosen), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 5, remainder: int = 0, size: int = SAMPLE) -> RuleModel:
    """Learn from labelled rows outside the held-out fold. Without any row of either label, the share is the score."""
    sample = labelled_sample(docs, labels, label, mod, remainder, size)
    stats = statistics(F.col("text"))
    table = common.kept(sample.select("doc_id", "label", *[c.alias(n) for n, c in stats.items()]), "quality_sample")
    n, ones = table.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        return RuleModel((), 0.0 if not n else (4.0 if ones else -4.0))
    # bounded by size: one partition in a fixed order makes training repeatable
    rows = table.repartition(1).sortWithinPartitions("doc_id", *stats)
    data = VectorAssembler(inputCols=list(stats), outputCol="features").transform(rows).select("label", "features", *stats).cache()
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, maxBins=64, featureSubsetStrategy="0.5").fit(data)
    rules = paths(forest, list(stats))
    marked = data.select("label", *[r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    ready = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(marked).select("label", "features").cache()
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=100).fit(ready)
    ready.unpersist()
    data.unpersist()
    weights = lasso.coefficients.toArray()
    return RuleModel(tuple(Rule(r.terms, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-9), float(lasso.intercept))


def scored(docs: DataFrame, model: RuleModel, mod: int = 5, remainder: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. Null and empty texts are scored from statistics that are all 0."""
    stats = statistics(F.col("text"))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(n) for n, c in stats.items()])
    return narrow.select("doc_id", held_out(F.col("doc_id"), mod, remainder).alias("held_out"), model.score().alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: RuleModel) -> DataFrame:
    """The rows of docs, all their columns, that the model does not reject; no join, no shuffle."""
    stats = statistics(F.col("text"))
    # inline() keeps the filter from being pushed below the statistics, which would compute each of them once per rule
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.inline(F.array(F.struct(*[c.alias(n) for n, c in stats.items()]))))
    return rows.where(model.score() >= THRESHOLD).select("_row.*")


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, fit(docs, common.table(spark, sf_dir, "labels")))

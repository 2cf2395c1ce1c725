"""Connected components by repeated contraction, in DataFrame operations only."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolith.llm import common


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges(a long, b long); root is one node of the component, the same for all.

    Each round gives every node the neighbour, or itself, that comes first in an order drawn for the round (ids xor a
    number; ids should look random), follows that pointer once more, and contracts the edges. Nodes shrink by a constant
    factor a round, whatever the shape: hubs and chains are no worse. Rounds are written to the shared folder; minima
    are taken before a shuffle, so that a hub is one row a task. Null ends are dropped, an end without an edge to another
    node is its own root.
    """
    spark = edges.sparkSession
    folder = common.new_folder(spark, "components")
    at = lambda name, r: f"{folder}/{name}{r}"
    edges = common.kept(edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", at("edges", 0))
    labels = common.kept(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "labels", at("labels", 0))
    edges = edges.where("a <> b")
    draw, r = random.Random(11), 0
    while not edges.isEmpty():
        mask = F.lit(draw.getrandbits(63))
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        first = both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(mask)).alias("m")).select(F.col("a").alias("node"), F.least("m", F.col("a").bitwiseXOR(mask)).bitwiseXOR(mask).alias("next"))
        first = common.kept(first, "next", at("next", r))
        jump = first.alias("x").join(first.alias("y"), F.col("x.next") == F.col("y.node")).select(F.col("x.node").alias("node"), F.col("y.next").alias("next"))
        jump = common.kept(jump, "jump", at("jump", r))
        contracted = edges.join(jump.withColumnsRenamed({"node": "a", "next": "na"}), "a").join(jump.withColumnsRenamed({"node": "b", "next": "nb"}), "b")
        contracted = contracted.where("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct()
        edges = common.kept(contracted, "edges", at("edges", r + 1))
        labels = labels.join(jump.withColumnsRenamed({"node": "root", "next": "new"}), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
        labels = common.kept(labels, "labels", at("labels", r + 1))
        for old in ("edges", "labels", "next", "jump"):
            common.removed(spark, at(old, r))
        r += 1
    return labels

"""Connected components of a graph that is given as edges, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextkit.llm._common import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b); label is the least node that it reaches.

    Each round, a node and its present label take the least label among the
    node's neighbours, then labels are followed one step.  That halves the
    height of the label trees, so rounds grow with the logarithm of the size.
    Every round's labels are written to the shared checkpoint folder.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = settle(both.where("a <> b").distinct())
    label = settle(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    while True:
        met = both.join(label, both.b == label.node).groupBy("a").agg(F.min("label").alias("met"))
        seen = label.join(met, label.node == met.a).select("node", "label", "met")
        offers = seen.select("node", F.least("label", "met").alias("label")).unionByName(seen.select(F.col("label").alias("node"), F.least("label", "met").alias("label")))
        lower = offers.groupBy("node").agg(F.min("label").alias("label"))
        ahead = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = lower.join(ahead, "label").select("node", F.col("next").alias("label"))
        new = settle(after.join(label.withColumnRenamed("label", "was"), "node").select("node", "label", (F.col("label") != F.col("was")).alias("moved")))
        label = new.select("node", "label")
        if new.where("moved").isEmpty():
            return label

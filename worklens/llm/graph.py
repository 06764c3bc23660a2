"""Connected components of an undirected graph, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.common import stage


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, label): the smallest node reachable from each node that has an edge (columns a, b: long).

    Each round takes the least label among the neighbours and then the label of that label, so a star
    ends in two rounds and a path in a number of rounds logarithmic in its length. Rounds are staged."""
    links = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), tag)
    labels = stage(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), tag)
    while True:
        near = links.join(labels, links.b == labels.node).groupBy("a").agg(F.min("label").alias("other"))
        step = labels.join(near, labels.node == near.a, "left").select("node", F.col("label").alias("was"), F.least("label", "other").alias("label"))
        goal = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = step.join(goal, "label", "left").select("node", "was", F.least("label", F.coalesce("further", "label")).alias("label"))
        step = stage(step, tag)
        if step.filter("was <> label").isEmpty():
            return step.select("node", "label")
        labels = step.select("node", "label")

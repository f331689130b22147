"""Connected components by distributed label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import materialise


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label (the smallest node of its component) of every node in ``edges`` (a, b).

    Every round takes the smallest label among a node and its neighbours, then
    the label of that label; rounds end when none changes, after about the
    logarithm of the longest path.  Each is written to the shared folder.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("top"), F.col("label").alias("above"))
        labels = materialise(step.join(up, F.col("label") == F.col("top"), "left").select("node", "old", F.least("label", "above").alias("label")))
        if labels.filter(F.col("old") != F.col("label")).isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
    raise RuntimeError("components did not settle")


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, label) after further ``edges`` (a, b): the components of components.

    However many edges lead from one component to another, they count once.
    """
    of = lambda k: labels.select(F.col("node").alias(k), F.col("label").alias(f"label_{k}"))
    told = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    top = components(materialise(told.filter("a != b").distinct()))
    every = labels.unionByName(top.select("node", F.col("node").alias("label"))).distinct()
    up = top.select(F.col("node").alias("label"), F.col("label").alias("above"))
    return materialise(every.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label")))

"""Connected components of a graph in tables: smallest label, with a jump to the label's own label in each round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import staged


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) for each node of edges (a, b).

    Each round is written to the shared folder, so that the plan stays short and lost executors cost no
    earlier round; every round takes labels from neighbours and then from the label's own label.
    """
    both = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("heard"))
        told = labels.join(heard, labels.node == heard.a, "left").select("node", F.col("label").alias("before"), F.least("label", F.coalesce("heard", "label")).alias("label"))
        up = told.select(F.col("node").alias("parent"), F.col("label").alias("above"))
        jumped = staged(told.join(up, told.label == up.parent, "left").select("node", "before", F.least("label", F.coalesce("above", "label")).alias("label")), "labels")
        changed = jumped.filter("label <> before").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels


def joined_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, label) after further edges (a, b): components of the graph of labels, which is far smaller than that of nodes."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    known = staged(labels.union(nodes.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))), "labels")
    a, b = (known.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab")
    above = edges.join(a, "a").join(b, "b").filter("label_a <> label_b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct()
    lifted = components(above).select(F.col("node").alias("label"), F.col("label").alias("lifted"))
    return staged(known.join(lifted, "label", "left").select("node", F.coalesce("lifted", "label").alias("label")), "labels")

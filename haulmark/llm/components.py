"""Connected components of an undirected graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulmark.llm.common import keep


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node of ``edges`` (a, b).

    Each round every node takes the smallest label among its neighbours and then the label of that label, so a
    chain shrinks by half at least. Labels are sums of minima, combined before they are shuffled, and each round is
    written to the shared folder, which cuts the lineage.
    """
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    # A node's smaller neighbours hang together through it: keep one link to the least of them, and theirs to that.
    down = down.withColumn("least", F.min("b").over(Window.partitionBy("a")))
    stars = down.select("a", F.col("least").alias("b")).union(down.select(F.col("b").alias("a"), F.col("least").alias("b")))
    stars = stars.where("a <> b").distinct()
    both = keep(stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))), "graph")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
    labels = labels.select("node", F.least("node", "near").alias("component"))
    labels = keep(labels.withColumn("moved", F.lit(True)), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        met = labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("component")
        )
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = met.join(jump, "component", "left").select(
            "node",
            F.least("component", "further").alias("component"),
            (F.least("component", "further") < F.col("old")).alias("moved"),
        )
        labels = keep(new, "labels")
        if not labels.where("moved").limit(1).count():
            return labels.select("node", "component")

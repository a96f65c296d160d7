"""Connected components of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm.base import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` of every linked node; the label is the component's smallest node.

    Each round takes the smallest label among a node's neighbours, then the
    label of that label, so chains shorten by half; all steps are joins and
    partial aggregates over written tables.
    """
    edges = cut(links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(F.col(b), F.col(a)))
                .filter("u != v").distinct(), "edges")
    labels = cut(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("l")).select("node", F.least("node", "l").alias("label")), "labels")
    while True:
        near = (edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near")))
        mixed = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("step"))
        up = labels.select(F.col("node").alias("step"), F.col("label").alias("top"))
        moved = cut(mixed.join(up, "step", "left").select("node", "old", F.least("step", F.coalesce("top", "step")).alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.filter("old != label").isEmpty():
            return labels

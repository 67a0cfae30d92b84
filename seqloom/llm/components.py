"""Connected components by smallest label, with pointer jumping, on tables in the shared folder."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, label`` for every node of ``links(a, b)``: the smallest node that it reaches.

    Each round a node takes the smallest label among its neighbours (aggregated before the shuffle), then the label
    of its label; long chains halve. No group is gathered anywhere.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(both.where("a <> b").distinct(), "cc-edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "cc-labels")
    for _ in range(max_rounds):
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = materialize(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "cc-step")
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styloweave.llm.storage import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label): each node of `edges` (a, b) and the smallest node of its component.

    Every round takes the least label of the neighbours and then the label of that label, so chains
    shorten by a factor; only the number of changed labels comes to the driver.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                  .where("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]) \
            .select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("next"))
        moved = stored(lower.join(jump, lower["label"] == jump["at"], "left")
                       .select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        changed = moved.where("old <> label").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels

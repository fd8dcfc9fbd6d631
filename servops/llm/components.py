"""Connected components by least labels and pointer jumping, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def connected_components(links: DataFrame, a: str = "x", b: str = "y") -> DataFrame:
    """(node, component) for every node of a link; the component is its least node.

    Each round a node takes the least label among itself and its neighbours (a grouped minimum, summed
    before the shuffle, so a node with many links costs one row a task), then the label of that
    label. Every round's labels are written to the shared checkpoint folder. A null end links nothing.
    """
    both = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("s"), F.col(b).alias("d"))
    both = cut_lineage(both.unionByName(both.select(F.col("d").alias("s"), F.col("s").alias("d"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("s").alias("node")).agg(F.min("d").alias("least"))
                         .select("node", F.least("node", "least").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "d"), "d") \
            .groupBy(F.col("s").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("new"))
        target = labels.select(F.col("node").alias("new"), F.col("component").alias("jump"))
        done = cut_lineage(step.join(target, "new").select("node", F.least("new", "jump").alias("component"),
                                                           (F.least("new", "jump") != F.col("component")).alias("changed")))
        changed = not done.where("changed").isEmpty()
        labels = done.select("node", "component")
        if not changed:
            return labels

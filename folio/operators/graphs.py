"""Connected components, each round written, so that lost executors cost one round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.session import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of the edges (a, b) the least node that it is connected with.

    Every round a node takes the least label among its neighbours' labels, then its label's own label; labels only fall,
    and jumping over labels halves the way to the least one, so rounds grow with the logarithm of a component's width.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "graph-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "graph-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("seen")), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        lower = labels.join(near, "node").select("node", F.least("root", "seen").alias("root"), F.col("root").alias("was"))
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("over"))
        moved = written(lower.join(jump, "root", "left").select("node", F.least("root", F.coalesce("over", "root")).alias("root"), "was"), "graph-labels")
        labels = moved.select("node", "root")
        if moved.where("root <> was").isEmpty():
            return labels

"""Connected components by joins: labels never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the undirected ``edges``; root is the least node.

    Each round a node takes the least label among its neighbours, then the label of its
    label (pointer jumping), so chains shrink by halves. The loop ends when no label
    changes; each round is one checkpoint, which keeps plans short and survives lost
    executors. Only whether a label has changed comes to the driver: labels grow with the input, so none
    are broadcast, which would pass them through the driver, and a round has few jobs and exchanges.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    pairs = pairs.filter("u <> v")
    both = cut(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    size = both.count()  # of directed edges, and so a bound of the nodes
    labels = cut(
        both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")), size
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("v"), "root").hint("merge"), "v")
            .select(F.col("u").alias("node"), "root", F.lit(None).cast("long").alias("old"))
            .unionByName(labels.select("node", "root", F.col("root").alias("old")))
            .groupBy("node")
            .agg(F.min("root").alias("root"), F.min("old").alias("old"))
        )
        # Both uses of ``near`` share the exchange of its aggregate.
        jump = near.select(F.col("node").alias("__at"), F.col("root").alias("__next"))
        after = near.join(jump.hint("merge"), F.col("root") == F.col("__at"), "left").select(
            "node", F.least("root", F.coalesce("__next", "root")).alias("root"), "old"
        )
        labels = cut(after, size)
        if not labels.filter("root <> old").head(1):
            return labels.drop("old")
        labels = labels.drop("old")

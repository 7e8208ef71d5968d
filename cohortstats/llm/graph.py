"""Connected components by minimum labels and pointer jumping, all in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that the links (a, b) connect with it; for every node of a link.

    Every round takes the least label of the neighbours, then the label of the node that the label
    names, so the rounds grow with the logarithm of the longest path. Tables of each round are
    checkpointed: both sides of each join are read from there, so that adaptive execution can
    split the key of a node with very many neighbours.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    nodes = both.select("a").distinct()
    both = checkpoint(both.union(nodes.select("a", F.col("a").alias("b"))))
    now, total = checkpoint(nodes.select(F.col("a").alias("node"), F.col("a").alias("label"))), None
    while True:
        near = checkpoint(both.join(now, F.col("a") == F.col("node")).groupBy("b").agg(F.min("label").alias("label")).select(F.col("b").alias("node"), "label"))
        of = near.select(F.col("node").alias("__of"), F.col("label").alias("__label"))
        now = checkpoint(near.join(of, F.col("label") == F.col("__of")).select("node", F.col("__label").alias("label")))
        # labels only fall, so an unchanged sum is an unchanged table
        new = now.agg(F.sum(F.col("label").cast("decimal(38,0)")).alias("s")).first()["s"]
        if new == total:
            return now
        total = new

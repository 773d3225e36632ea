"""Connected components of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut


def components(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """(node, root): the smallest node that each node of the pairs reaches.

    Each round takes the smallest label among a node's neighbours, for the node and for the node's own label, and then the label of
    that label; rounds grow with the logarithm of a component's width.
    """
    way = lambda x, y: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"))
    both = cut(pairs.select(F.explode(F.array(way(first, second), way(second, first))).alias("e")).select("e.*").distinct())
    labels = cut(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("root")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("m"))
        near = cut(labels.join(seen, "node").select("node", F.col("root").alias("was"), "m"))
        lifted = near.groupBy(F.col("was").alias("node")).agg(F.min("m").alias("h"))
        via = near.join(lifted, "node", "left").select("node", "was", F.least("was", "m", "h").alias("via"))
        new = cut(via.join(labels.select(F.col("node").alias("via"), F.col("root").alias("far")), "via").select("node", "was", F.least("via", "far").alias("root")))
        labels = new.select("node", "root")
        if new.where("was <> root").isEmpty():
            return labels

"""Connected components of a link table, as DataFrames: min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.store import discard, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable, for every node of the undirected links.

    Each round takes the smallest label among the neighbours (a partial aggregation, so a node with very many
    links costs one row a task) and then the label of that label. A round writes its small table to the shared
    folder; only a count comes to the driver. Rounds grow with the logarithm of a component's diameter, in practice.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = written(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label"), F.lit(True).alias("moved")), "labels")
    while labels.where("moved").limit(1).count():
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("least"))
        hop = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("was"), F.least("label", "least").alias("label"))
        root = labels.select(F.col("node").alias("root"), F.col("label").alias("of_root"))
        before, labels = labels, written(hop.join(root, hop["label"] == root["root"], "left").select("node", F.least("label", "of_root").alias("label"), (F.least("label", "of_root") < F.col("was")).alias("moved")), "labels")
        discard(before)
    discard(both)
    return labels.select("node", "label")

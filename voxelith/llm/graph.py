"""Connected components as DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import release, remove, scratch, stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for all nodes of the undirected edges (a, b); root is the component's least node.

    Each round lowers a node's label to the least among its neighbours' and then to that label's
    own label, so paths shrink by more than half; labels live in the shared folder.
    """
    spark = edges.sparkSession
    path = scratch(spark, "components")
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{path}/edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.col("node").alias("old"), F.least("node", "least").alias("root")), f"{path}/0")
    for i in range(1, rounds + 1):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").select(F.col("a").alias("node"), F.lit(None).cast("long").alias("old"), "root")
        lower = labels.select("node", F.col("root").alias("old"), "root").union(near).groupBy("node").agg(F.max("old").alias("old"), F.min("root").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = stored(lower.join(up, "root").select("node", "old", F.least("root", "above").alias("root")), f"{path}/{i}")
        changed = new.where("old <> root").limit(1).count()
        remove(spark, f"{path}/{i - 1}")
        release(spark)
        labels = new
        if not changed:
            return labels.select("node", "root")
    raise RuntimeError(f"components are not complete after {rounds} rounds")

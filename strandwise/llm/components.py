"""Connected components of an edge table, without bringing any of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._native import saved


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); root is the smallest node reachable.

    Each round every node takes the smallest label among its neighbours' and
    then its label's label, so labels spread along paths at doubling speed.
    Rounds are checkpointed; only the number of changed labels is brought back.
    """
    pairs = edges.select("a", "b").where("a <> b")
    both = saved(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"), F.lit(True).alias("changed")))
    while labels.where("changed").limit(1).count():
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        hooked = saved(labels.select("node", F.col("root").alias("was")).join(near, "node").select("node", "was", F.least("was", "m").alias("root")))
        above = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        labels = saved(hooked.join(above, "root", "left").select("node", F.least("root", F.coalesce("top", "root")).alias("new"), "was").select("node", F.col("new").alias("root"), (F.col("new") < F.col("was")).alias("changed")))
    return labels.select("node", "root")

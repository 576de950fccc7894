"""Connected components of an undirected graph as a loop of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root being the smallest node it reaches.

    Each round takes the smallest root among a node's neighbours and then its root's root, which shortens long chains
    by half; rounds end when nothing changes. Every round is written to the shared folder. Nodes with the same root
    may be a large part of all, so that join goes through attach()."""
    links = stored(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "links")
    roots = stored(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "roots")
    while True:
        near = links.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = stored(roots.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was")), "lower")
        above = lower.select(F.col("node").alias("root"), F.col("root").alias("top"))
        sizes = lower.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
        jumped = stored(
            attach(lower, sizes.join(above, "root"), "root", "members", lower.count()).select("node", F.col("top").alias("root"), (F.col("top") != F.col("was")).alias("moved")), "roots"
        )
        roots = jumped.select("node", "root")
        if not jumped.filter("moved").limit(1).count():
            return roots

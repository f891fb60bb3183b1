"""Connected components, for identities that are known by several keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.sources.workspace import Workspace


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """links (a, b) -> (node, component): the least node that each one reaches; nodes without links (b null) stand alone.

    Every round points each node to the least root among its own and its neighbours' (two joins on nodes,
    minima combined before they are shuffled), then roots to the least that any of theirs saw; the rounds
    follow the logarithm of the longest path.
    """
    both = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = work.keep(both.select("a", "b").unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).where("node IS NOT NULL").distinct()
    root = work.keep(nodes.withColumn("root", F.col("node")))
    while True:
        # the least root next to any node of a tree becomes that tree's root
        seen = both.join(root.select(F.col("node").alias("b"), F.col("root").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        offered = root.join(seen, "node").where("near < root").groupBy(F.col("root").alias("old")).agg(F.min("near").alias("new"))
        offered = work.keep(offered)
        if not offered.limit(1).count():
            return root.select("node", F.col("root").alias("component"))
        # offers point to smaller roots, so following them ends; two steps are followed at once
        further = offered.select(F.col("old").alias("new"), F.col("new").alias("next"))
        jumps = offered.join(further, "new", "left").select("old", F.coalesce("next", "new").alias("new"))
        root = work.keep(root.join(jumps, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")))

"""Connected components by hooking and pointer jumping, one small written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b): root is the smallest node of its component.

    A round takes each node to the smallest root among its neighbours, moves whole trees along, and halves
    their depth; trees of any shape join in logarithmically many rounds. Only a count reaches the driver.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    now = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        near = both.join(now, both.b == now.node).groupBy("a").agg(F.min("root").alias("near")).select(F.col("a").alias("node"), "near")
        hooked = now.join(near, "node").select("node", "root", F.least("root", "near").alias("new"))
        trees = hooked.groupBy(F.col("root").alias("old")).agg(F.min("new").alias("tree"))
        moved = hooked.join(trees, hooked.root == trees.old).select("node", F.least("new", "tree").alias("new"), "root")
        up = moved.select(F.col("node").alias("parent"), F.col("new").alias("top"))
        after = staged(moved.join(up, moved.new == up.parent, "left").select("node", F.least("new", F.coalesce("top", "new")).alias("root"), (F.least("new", F.coalesce("top", "new")) != F.col("root")).alias("changed")), "roots")
        now = after.drop("changed")
        if after.where("changed").isEmpty():
            return now

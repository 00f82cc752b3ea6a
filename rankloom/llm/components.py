"""Connected components by graph contraction, all in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import common


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every end of the ``edges`` (columns ``a``, ``b``);
    nodes of one component have one root, some node of it.

    Each round hooks every node to its smallest neighbour, follows that link
    once more, and maps the edges to what is left. At least half of the nodes
    that still have edges go per round; a star goes in one.
    """
    edges = common.materialize(edges.where("a != b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    labels = ends.select("node", F.col("node").alias("root"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p"))
        hook = common.materialize(hook, "hook")
        up = hook.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        hook = common.materialize(hook.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p")), "hook")
        to = hook.select(F.col("a").alias("root"), "p")
        labels = common.materialize(labels.join(to, "root", "left").select(
            "node", F.coalesce("p", "root").alias("root")), "labels")
        left = hook.select("a", F.col("p").alias("pa"))
        right = hook.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        edges = common.materialize(edges.join(left, "a").join(right, "b").where("pa != pb").select(
            F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    return labels

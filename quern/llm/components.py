"""Connected components of links, without bringing any of them to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (a, b); root is the same for all nodes of a component.

    Contraction: every node moves to the smallest of itself and its neighbours, links
    between what nodes have become remain, until there are none. Nodes are digests, so the
    order is random and each round leaves a constant fraction; the number of rounds is
    logarithmic in the largest component. Every round is written to the shared folder. A
    star around one node is combined before its shuffle (min).
    """
    edges = written(links.select("a", "b").where("a <> b"), "links")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root"))
        low = written(low, "roots")
        if roots is None:
            roots = low
        else:
            step = low.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = written(roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        left = low.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = low.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(left, "a").join(right, "b").where("ra <> rb")
        edges = written(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots

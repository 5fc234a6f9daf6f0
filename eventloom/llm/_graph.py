"""Connected components by contraction, entirely in DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stash


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of edges (a, b): comp is the smallest node reachable.

    Each round points every node at its smallest neighbour, follows the pointers to their roots (the
    number of hops doubles each time) and replaces edges by edges between roots; the smallest node of a
    component always remains. Rounds are few as a star or a chain vanishes in one. Each round's table is
    written to the shared folder. Joins are on stashed tables, so that AQE can split a hot centre.
    """
    edges = stash(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        up = stash(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("up")), "cc-up")
        while True:
            hop = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
            jumped = stash(up.join(hop, "up").select("node", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")), "cc-hop")
            moved = not jumped.where("moved").isEmpty()
            up = jumped.select("node", "up")
            if not moved:
                break
        rounds.append(up)
        to_a, to_b = up.select(F.col("node").alias("a"), F.col("up").alias("ra")), up.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        edges = edges.join(to_a, "a").join(to_b, "b").where("ra <> rb")
        edges = stash(edges.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))

    def follow(first: DataFrame, then: DataFrame) -> DataFrame:
        last = then.select(F.col("node").alias("up"), F.col("up").alias("next"))
        return first.join(last, "up", "left").select("node", F.coalesce("next", "up").alias("up"))

    return stash(reduce(follow, rounds).select("node", F.col("up").alias("comp")), "cc-labels")

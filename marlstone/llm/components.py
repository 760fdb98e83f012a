"""Connected components of a large edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common


def components(edges: DataFrame, label: str = "components", rounds: int = 60) -> DataFrame:
    """(a, b) pairs of bigint -> (node, root): the smallest node of each node's component.

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest node near it; paths
    shorten by a constant factor a round. Edges are reduced to one row a pair before each shuffle. It is done when every
    node is a root or hangs on one: none has two smaller neighbours, or a smaller and a larger one. Raises if the rounds run out.
    """

    def deal(e: DataFrame) -> DataFrame:
        return e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now = common.written(deal(edges), label)
    for _ in range(rounds):
        total = 2 * now.count()
        # large star: each node's larger neighbours go to the smallest node in its neighbourhood
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.written(both.groupBy("a").agg(
            F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"), F.count_if(F.col("b") < F.col("a")).alias("smaller")), label)
        if least.filter("smaller > 1 or (smaller = 1 and n > 1)").isEmpty():
            common.removed(least)
            roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        large = common.lookup(both, least, ["a"], "n", total).filter("b > a")
        large = common.written(deal(large.select(F.col("b").alias("a"), F.col("m").alias("b"))), label)
        # small star: each node and its smaller neighbours go to the smallest of them
        lowest = common.written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), label)
        joined = common.lookup(large, lowest, ["a"], "n", total)
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            lowest.select("a", F.col("m").alias("b")))
        after = common.written(deal(small), label)
        for old in (now, least, large, lowest):
            common.removed(old)
        now = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")

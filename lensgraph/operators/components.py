"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014).

Each step turns edges into stars around smaller nodes; a few rounds leave one star per component. Steps are joins and
grouped minima, so no component is ever in one task; a hub's join partition can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensgraph.shared import Rounds, written

MOST_ROUNDS = 60


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """edges: a > b. Each node's smaller neighbours and itself get the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that an edge names; component is the least node of the connected set.

    Nodes may be of any type that has an order. Nulls are left out; an edge from a node to itself names the node. No edges give no rows.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    given = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    now, seen, rounds = given.filter("a > b"), None, Rounds(edges.sparkSession, "stars")
    for _ in range(MOST_ROUNDS):
        now = rounds.written(_small(_large(now)).filter("a > b").distinct())
        digest = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if digest == seen:
            break
        seen = digest
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    nodes = given.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))

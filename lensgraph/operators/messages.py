"""Message passing in supersteps: nodes with a state send along their edges, and what a node is sent is combined on the way.

Edges are bucketed by source once, and the state by node each round, in equal numbers: sending joins bucket to bucket and
only messages, combined in each task first, are shuffled. A round is one job: what the next round needs to know of all
nodes (totals, and how many are active) is observed while the state is written. A node is computed while it is active or
is sent something; the run ends when no node is active, or after the rounds asked for.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lensgraph.operators import pull
from lensgraph.shared import delete, new_folder, partitions, written


class _Buckets:
    """Tables of one run, bucketed alike, in the shared folder."""

    def __init__(self, df: DataFrame):
        self.spark, self.n, self.uri, self.names = df.sparkSession, partitions(df.sparkSession), new_folder(df.sparkSession, "messages"), []

    def written(self, df: DataFrame, by: str) -> DataFrame:
        name = f"messages_{uuid.uuid4().hex}"
        df.repartition(self.n, by).write.bucketBy(self.n, by).sortBy(by).option("path", f"{self.uri}/{name}").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def drop(self, keep: int) -> None:
        """Drops all but the last `keep` tables after the first."""
        while len(self.names) > 1 + keep:
            name = self.names.pop(1)
            self.spark.sql(f"DROP TABLE {name}")
            delete(self.spark, f"{self.uri}/{name}")

    def end(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE {name}")
        delete(self.spark, self.uri)


def run(
    nodes: DataFrame,
    edges: DataFrame,
    start: dict[str, Column],
    send: Column,
    combine: Callable[[Column], Column],
    receive: Callable[[dict], dict[str, Column]],
    active: Column,
    rounds: int,
    totals: dict[str, Column] | None = None,
    first: Column | None = None,
) -> DataFrame:
    """id and the state columns of every node after the last round.

    nodes: id and columns that `start` refers to. edges: src, dst and columns that `send` refers to.
    send: the message of an active node along an edge, from state and edge columns; null sends nothing.
    combine: aggregate of the messages of a node, such as F.sum or F.min.
    receive: from the totals of the state before, the new state columns of a node that is computed, from the old ones and
    `message` (null where nothing came). active: from old columns, new ones (`new_` before their names) and `message`.
    first: which nodes are active at first (all). totals: aggregates over the state.
    """
    names, totals = list(start), {"_active": F.count(F.when(F.col("active"), 1)), "_nodes": F.count("*")} | (totals or {})
    held = _Buckets(nodes)
    links = held.written(edges.filter("src is not null and dst is not null"), "src")
    state = nodes.dropDuplicates(["id"]).select("id", *[c.alias(k) for k, c in start.items()])
    state, seen = _observed(held, state.withColumn("active", F.lit(True) if first is None else F.coalesce(first, F.lit(False))), totals)
    for _ in range(rounds):
        if not seen["_active"]:
            break
        sent = state.filter("active").join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("to"), send.alias("message")).filter("message is not null")
        got = sent.groupBy("to").agg(combine(F.col("message")).alias("message"))
        both = state.join(got, F.col("id") == F.col("to"), "left").drop("to")
        computed = F.col("active") | F.col("message").isNotNull()
        new = both.select("*", *[F.when(computed, c).otherwise(F.col(k)).alias(f"new_{k}") for k, c in receive(seen).items()])
        on = F.coalesce(computed & active, F.lit(False))
        state, seen = _observed(held, new.select("id", *[F.col(f"new_{k}").alias(k) for k in names], on.alias("active")), totals)
        held.drop(1)
    out = written(state.drop("active"), "state")
    held.end()
    return out


def _observed(held: _Buckets, state: DataFrame, totals: dict[str, Column]) -> tuple[DataFrame, dict]:
    seen = Observation()
    return held.written(state.observe(seen, *[c.alias(k) for k, c in totals.items()]), "id"), seen.get


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(id, rank) after `rounds` steps from 1/n; what nodes without out-edges hold is spread over all."""
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    known = nodes.select("id").join(out, F.col("id") == F.col("src"), "left").select("id", "out")
    n = max(1, nodes.select("id").distinct().count())

    def receive(seen: dict) -> dict[str, Column]:
        lost = F.lit((seen["lost"] or 0.0) / n)
        return {"rank": F.lit((1 - damping) / n) + damping * (F.coalesce("message", F.lit(0.0)) + lost), "out": F.col("out")}

    start = {"rank": F.lit(1.0 / n), "out": F.col("out")}
    return run(known, edges, start, F.col("rank") / F.col("out"), F.sum, receive, F.lit(True), rounds, {"lost": F.sum(F.when(F.col("out").isNull(), F.col("rank")))}).select("id", "rank")


def centrality(nodes: DataFrame, edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(id, value) after `rounds` steps of the weighted adjacency from all ones, of length one (L2 norm); edges: src, dst, weight."""
    return pull.centrality(nodes, edges, rounds)


def least_labels(nodes: DataFrame, edges: DataFrame, rounds: int = 1 << 20) -> DataFrame:
    """(id, label): the least id that reaches the node (itself included), along the edges."""
    return pull.least_labels(nodes, edges, rounds)


def distances(nodes: DataFrame, edges: DataFrame, sources: Column, rounds: int = 1 << 20) -> DataFrame:
    """(id, distance): least sum of `weight` (not negative) over paths from any node where `sources` holds; null if there is none."""
    nearer = F.least("distance", "message")  # least() passes over nulls
    start = {"distance": F.when(sources, F.lit(0.0))}
    moved = F.col("message").isNotNull() & (F.col("distance").isNull() | (F.col("new_distance") < F.col("distance")))
    return run(nodes, edges, start, F.col("distance") + F.col("weight"), F.min, lambda seen: {"distance": nearer}, moved, rounds, first=sources)

"""Least action over time: paths whose edges follow one another in time, and teams of least action.

A state is (source, node, arrival, action). Of the states of one source and node only those stay that no other beats in both
arrival and action (a Pareto front): a later arrival is worth keeping only for a smaller action.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lensgraph.operators.graph import least_action
from lensgraph.shared import Rounds, written


def _front(states: DataFrame) -> DataFrame:
    """States that none of the same source and node beats; of equal ones, one."""
    order = Window.partitionBy("source", "id").orderBy("arrival", "action").rowsBetween(Window.unboundedPreceding, -1)
    best = F.min("action").over(order)
    return states.groupBy("source", "id", "arrival").agg(F.min("action").alias("action"), F.min_by("new", "action").alias("new")).withColumn("_best", best).filter("_best is null or action < _best").drop("_best")


def timed_action(edges: DataFrame, sources: DataFrame, rounds: int) -> DataFrame:
    """(source, id, arrival, action): the Pareto front of each node over paths of at most `rounds` edges.

    edges: src, dst, time, weight (not negative); an edge may follow one of its own time or earlier. A source has arrival
    null, before all times, and action 0. Edges with a null are left out.
    """
    links = written(edges.dropna(subset=["src", "dst", "time", "weight"]).groupBy("src", "dst", "time").agg(F.min("weight").alias("weight")), "timed")
    kind = links.schema["time"].dataType
    first = sources.select(F.col("id").alias("source"), "id").distinct()
    state = first.select("source", "id", F.lit(None).cast(kind).alias("arrival"), F.lit(0.0).alias("action"), F.lit(1).alias("new"))
    held = Rounds(edges.sparkSession, "timed")
    now = held.written(state)
    for _ in range(rounds):
        fresh = now.filter("new = 1")
        step = fresh.join(links, (F.col("id") == F.col("src")) & (F.col("arrival").isNull() | (F.col("arrival") <= F.col("time"))))
        step = step.select("source", F.col("dst").alias("id"), F.col("time").alias("arrival"), (F.col("action") + F.col("weight")).alias("action"), F.lit(1).alias("new"))
        kept = _merged(now, step)
        now = held.written(kept)
        if not now.filter("new = 1").limit(1).count():
            break
    return now.drop("new")


def _merged(now: DataFrame, step: DataFrame) -> DataFrame:
    """The front of both; a state is new only if no old one equals it."""
    old = now.withColumn("new", F.lit(0))
    both = old.unionByName(step)
    known = both.groupBy("source", "id", "arrival", "action").agg(F.min("new").alias("new"))
    return _front(known)


def paired_actions(edges: DataFrame, teams: DataFrame, most: int) -> DataFrame:
    """(source, id, action): least action of paths of at most `most` edges, of the pairs of members of each team alone.

    A path is met in the middle: a first half, rounded up, from one member, and a last half from the other, against the
    edges. Both are listed per member and joined within a team, so that what else a member reaches is listed for half the
    edges only.
    """
    members = written(teams.select("team", "id").dropna().distinct(), "members")
    links = written(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")), "links")
    turned = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    halves = []
    for way, k, end in ((links, most - most // 2, "source"), (turned, most // 2, "id")):
        reached = least_action(way, members.select("id"), k).select(F.col("source").alias(end), F.col("id").alias("middle"), F.col("action").alias(f"{end}_action"))
        halves.append(members.withColumnRenamed("id", end).join(reached, end))
    met = halves[0].join(halves[1], ["team", "middle"]).filter("source <> id")
    return met.groupBy("source", "id").agg(F.min(F.col("source_action") + F.col("id_action")).alias("action"))


def team_action(actions: DataFrame, teams: DataFrame) -> DataFrame:
    """(team, pairs, action, least): sum of the least actions of all ordered pairs of a team's members.

    actions: (source, id, action), the pairs that are connected. teams: (team, id). action is null if a pair is missing;
    `least` marks the team of least action, the first of equals.
    """
    members = teams.select("team", "id").dropna().distinct()
    a, b = members.toDF("team", "source"), members
    pairs = a.join(b, "team").filter("source <> id")
    best = actions.groupBy("source", "id").agg(F.min("action").alias("action"))
    sums = pairs.join(best, ["source", "id"], "left").groupBy("team").agg(F.count("*").alias("pairs"), F.count("action").alias("met"), F.sum("action").alias("sum"))
    out = written(sums.select("team", "pairs", F.when(F.col("pairs") == F.col("met"), F.col("sum")).alias("action")), "teams")
    first = out.filter("action is not null").agg(F.min(F.struct("action", "team")).alias("first"))  # one row
    return out.crossJoin(first).select("team", "pairs", "action", F.coalesce(F.col("team") == F.col("first.team"), F.lit(False)).alias("least"))

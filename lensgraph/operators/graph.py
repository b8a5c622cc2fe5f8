"""Property-graph analytics on edge tables (src, dst[, weight, rel_type]).

Iterations write their state to the shared folder every round, so that plans stay short and lost executors cost one
round. Hubs are met with map-side combined sums; joins on a hub's key can be split by adaptive execution.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensgraph.operators import pull
from lensgraph.operators.csr import numbered
from lensgraph.operators.cycles import cycles  # noqa: F401
from lensgraph.shared import Rounds, written


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair of neighbours in both orders, once; no loops."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.filter("src <> dst").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) of every node, 0 for isolated ones."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    sums = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return nodes.select("id").join(sums, "id", "left").na.fill(0, ["out_degree", "in_degree"])


def power_iteration(edges: DataFrame, rounds: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """(id, value): leading eigenvector of the symmetric weights, of length one; stops once no more than `tolerance` moves."""
    return pull.power_iteration(edges.select("src", "dst", "weight"), rounds, tolerance)


def random_projection(edges: DataFrame, dim: int = 16, weights: tuple[float, ...] = (0.0, 1.0, 1.0, 1.0)) -> DataFrame:
    """(id, vector): weighted sum over rounds of neighbour means of seeded vectors of -1, 0 and 1, each round of length one."""
    from lensgraph.functions.vectors import l2_normalize

    both = written(undirected(edges), "both")
    chance = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(6))
    now = both.select(F.col("src").alias("id")).distinct().select("id", *[F.when(chance(k) == 0, 1.0).when(chance(k) == 1, -1.0).otherwise(0.0).alias(f"v{k}") for k in range(dim)])
    steps, sums = Rounds(edges.sparkSession, "projection"), Rounds(edges.sparkSession, "sum")
    names = [f"v{k}" for k in range(dim)]
    total = now.select("id", *[(F.col(c) * weights[0]).alias(c) for c in names])
    for w in weights[1:]:
        mean = both.join(now, both.dst == now.id).groupBy("src").agg(*[F.avg(c).alias(c) for c in names])
        unit = mean.select(F.col("src").alias("id"), l2_normalize(F.array(*names)).alias("u"))
        now = steps.written(unit.select("id", *[F.get("u", F.lit(k)).alias(c) for k, c in enumerate(names)]))
        step = now.select("id", *[(F.col(c) * w).alias(f"{c}_") for c in names])
        total = sums.written(total.join(step, "id").select("id", *[(F.col(c) + F.col(f"{c}_")).alias(c) for c in names]))
    return total.select("id", F.array(*names).alias("vector"))


def hops(edges: DataFrame, sources: DataFrame, most: int, directed: bool = True) -> DataFrame:
    """(source, id, hops): least number of edges from each source, up to `most`; a source is 0 from itself."""
    links = written(edges.select("src", "dst").distinct() if directed else undirected(edges), "links")
    front = written(sources.select(F.col("id").alias("source"), "id").distinct().withColumn("hops", F.lit(0)), "hops")
    seen = front
    for k in range(1, most + 1):
        step = front.join(links, front.id == links.src).select("source", F.col("dst").alias("id")).distinct()
        front = written(step.join(seen, ["source", "id"], "left_anti").withColumn("hops", F.lit(k)), "hops")
        seen = seen.unionByName(front)
        if not front.limit(1).count():
            break
    return seen


def shortest_paths(edges: DataFrame, sources: DataFrame, most: int, directed: bool = True) -> DataFrame:
    """(source, id, hops, nodes): the nodes of a shortest path of at most `most` edges, the least list of equally short ones.

    Only a level's nodes are extended: a least path begins with a least path to the node before its end.
    """
    links = written(edges.select("src", "dst").distinct() if directed else undirected(edges), "links")
    front = written(sources.select(F.col("id").alias("source"), "id").distinct().withColumns({"hops": F.lit(0), "nodes": F.array("id")}), "paths")
    seen = front
    for k in range(1, most + 1):
        step = front.join(links, front.id == links.src).select("source", F.col("dst").alias("id"), F.concat("nodes", F.array("dst")).alias("nodes"))
        fresh = step.join(seen.select("source", "id"), ["source", "id"], "left_anti")
        front = written(fresh.groupBy("source", "id").agg(F.min("nodes").alias("nodes")).select("source", "id", F.lit(k).alias("hops"), "nodes"), "paths")
        seen = seen.unionByName(front)
        if not front.limit(1).count():
            break
    return seen


def context(edges: DataFrame, sources: DataFrame, depth: int, budget: int, directed: bool = False) -> DataFrame:
    """(source, id, hops): at most `budget` nodes within `depth` edges of each source, the nearest first, then the least id."""
    order = Window.partitionBy("source").orderBy("hops", "id")
    return hops(edges, sources, depth, directed).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= budget).drop("place")


def linked(edges: DataFrame, sources: DataFrame, most: int, links: DataFrame) -> DataFrame:
    """(source, id, found): nodes on undirected paths of 1 to `most` edges from each source, with what `links` (src, dst) join to them."""
    near = hops(edges, sources, most, directed=False).filter("hops > 0").select("source", "id")
    return near.join(links.select(F.col("src").alias("id"), F.col("dst").alias("found")).distinct(), "id").select("source", "id", "found")


def least_action(edges: DataFrame, sources: DataFrame, rounds: int) -> DataFrame:
    """(source, id, action): least sum of `weight` (not negative) over paths of at most `rounds` edges."""
    links = written(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")), "links")
    now = sources.select(F.col("id").alias("source"), "id").distinct().withColumn("action", F.lit(0.0))
    held = Rounds(edges.sparkSession, "action")
    for _ in range(rounds):
        step = now.join(links, now.id == links.src).select("source", F.col("dst").alias("id"), (F.col("action") + F.col("weight")).alias("action"))
        now = held.written(now.unionByName(step).groupBy("source", "id").agg(F.min("action").alias("action")))
    return now


def action_weight(w: Column, potential: Column) -> Column:
    """Lagrangian of an edge: half its weight squared, less the potential."""
    return 0.5 * w * w - potential


def paths(edges: DataFrame, starts: DataFrame, least: int, most: int) -> DataFrame:
    """(start, end, length, nodes) of every path of `least` to `most` edges from the starts; no edge twice."""
    links = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col("edge_id").alias("_e"))
    now = starts.select(F.col("id").alias("start"), F.col("id").alias("end"), F.array("id").alias("nodes"), F.array().cast("array<long>").alias("used"))
    found = []
    for k in range(1, most + 1):
        now = now.join(links, (now.end == links._s) & ~F.array_contains("used", links._e)).select("start", F.col("_d").alias("end"), F.concat("nodes", F.array("_d")).alias("nodes"), F.concat("used", F.array("_e")).alias("used"))
        if k >= least:
            found.append(now.select("start", "end", F.lit(k).alias("length"), "nodes"))
    return reduce(DataFrame.unionByName, found)


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), a < b < c, of the undirected graph."""
    half = undirected(edges).filter("src < dst")
    x, y, z = half.alias("x"), half.alias("y"), half.alias("z")
    two = x.join(y, F.col("x.dst") == F.col("y.src")).select(F.col("x.src").alias("a"), F.col("x.dst").alias("b"), F.col("y.dst").alias("c"))
    return two.join(z, (F.col("a") == F.col("z.src")) & (F.col("c") == F.col("z.dst"))).select("a", "b", "c")


def shape(edges: DataFrame) -> DataFrame:
    """One row: nodes, links, density 2m/n(n-1), triangles, clustering 3t/paths of two."""
    both = written(undirected(edges), "both")
    degree = both.groupBy("src").agg(F.count("*").alias("d"))
    a = degree.agg(F.count("*").alias("nodes"), (F.sum("d") / 2).cast("long").alias("links"), F.sum(F.expr("d * (d - 1) div 2")).alias("twos"))
    t = triangles(both.filter("src < dst")).agg(F.count("*").alias("triangles"))
    return a.crossJoin(t).select("nodes", "links", F.try_divide(2 * F.col("links"), F.col("nodes") * (F.col("nodes") - 1)).alias("density"), "triangles", F.try_divide(3 * F.col("triangles"), F.col("twos")).alias("clustering"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, label): each node takes its neighbours' commonest label, the least of equals; all at once, `rounds` times."""
    return pull.label_propagation(edges, rounds)


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, Q of a partition (id, label) of the undirected graph; a null label is a group without inner links."""
    pairs = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).filter("src is not null and src <> dst")
    pairs = written(pairs.distinct(), "pairs")
    m2 = 2 * pairs.count()
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("la")), labels.select(F.col("id").alias("dst"), F.col("label").alias("lb"))
    links = pairs.join(a, "src").join(b, "dst").groupBy("la", "lb").agg(F.count("*").alias("n"))
    inside = F.when(F.col("la") == F.col("lb"), F.col("n")).otherwise(0)
    ends = F.explode(F.array(*[F.struct(F.col(c).alias("label"), inside.alias("inside"), F.col("n").alias("ends")) for c in ("la", "lb")]))
    inner = links.select(ends.alias("e")).select("e.*").groupBy("label").agg(F.sum("inside").alias("inside"), F.sum("ends").alias("ends"))
    return inner.agg(F.sum(F.try_divide("inside", F.lit(m2)) - F.try_divide("ends", F.lit(m2)) ** 2).alias("modularity"))


def coloring_order(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, degree, priority): for coloring, of more neighbours first, then of a newer `at`, then of more `downloads`.

    facts: (id, at, downloads), at as a number that grows with time; missing facts come last.
    """
    degree = undirected(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    last = lambda c: F.coalesce(-F.col(c).cast("double"), F.lit(float("inf")))
    return degree.join(facts.select("id", "at", "downloads"), "id", "left").select("id", "degree", F.struct((-F.col("degree")).alias("degree"), last("at").alias("at"), last("downloads").alias("downloads")).alias("priority"))


def coloring(edges: DataFrame, priority: DataFrame) -> DataFrame:
    """(id, color): greedy coloring in order of (priority, id), color from 1; equals one pass in that order.

    Nodes are numbered in that order and cut into twice as many ranges as the session has cores. In a round each task goes
    through its range, over mapped adjacency and the colors of the round before, and colors every node whose earlier
    neighbours have one. Dependencies only point to earlier ranges, so there are at most as many rounds as ranges, however
    long the chains in the graph are. priority: (id, priority), the lower first, a number or what `coloring_order` gives; edges to other nodes do not count.
    """
    order = priority.select("id", "priority").dropna().withColumn("key", F.struct("priority", "id"))
    return pull.greedy_colors(edges, numbered(order, "key"))


def composed(edges: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(src, dst, rel_type): two edges in a row whose types a rule (first, second, result) names."""
    found = []
    for first, second, result in rules:
        x, y = edges.filter(F.col("rel_type") == first).alias("x"), edges.filter(F.col("rel_type") == second).alias("y")
        found.append(x.join(y, F.col("x.dst") == F.col("y.src")).select(F.col("x.src"), F.col("y.dst"), F.lit(result).alias("rel_type")))
    return reduce(DataFrame.unionByName, found).distinct()


def entropy(values: DataFrame, column: str) -> DataFrame:
    """One row: -sum p log p of the shares of a non-negative column."""
    p = F.col(column) / F.lit(values.agg(F.sum(column)).first()[0] or 1)
    return values.select(p.alias("p")).filter("p > 0").agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy"))

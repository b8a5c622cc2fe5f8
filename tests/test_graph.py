import collections
import itertools
import math
import random

import pytest

from lensgraph.operators import csr, graph, messages
from lensgraph.operators.components import connected_components


@pytest.fixture(scope="module")
def edges():
    rng = random.Random(3)
    return sorted({(a, b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(70)) if a != b})


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def neighbours(edges):
    out = collections.defaultdict(set)
    for a, b in edges:
        out[a].add(b)
        out[b].add(a)
    return out


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 10), (20, 20), (7, 3), (None, 4)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(connected_components(frame(spark, edges), "src", "dst").collect())
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 10: 10, 11: 10, 12: 10, 20: 20} | {100 + i: 100 for i in range(41)}
    assert connected_components(frame(spark, []), "src", "dst").count() == 0


def test_coloring_is_greedy(spark, edges):
    near = neighbours(edges)
    order = sorted(near, key=lambda n: (-len(near[n]), n))
    want = {}
    for n in order:
        used = {want[m] for m in near[n] if m in want}
        want[n] = next(c for c in itertools.count(1) if c not in used)
    priority = spark.createDataFrame([(n, -len(near[n])) for n in near], "id long, priority long")
    assert dict(graph.coloring(frame(spark, edges), priority).collect()) == want


def test_betweenness(spark, edges):
    out = collections.defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    ids = sorted({x for e in edges for x in e})
    want = collections.Counter()
    for s in ids:
        dist, sigma, order, queue = {s: 0}, collections.Counter({s: 1}), [], [s]
        while queue:
            v = queue.pop(0)
            order.append(v)
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        delta = collections.Counter()
        for w in reversed(order):
            for v in order:
                if w in out[v] and dist[w] == dist[v] + 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                want[w] += delta[w]
    got = {r.id: r.centrality for r in csr.betweenness(frame(spark, edges), spark.createDataFrame([(i,) for i in ids], "id long")).collect()}
    assert all(abs(got.get(i, 0) - want[i]) < 1e-9 for i in ids)


def test_shape_goldens(spark):
    # three nodes in a row and a triangle
    got = graph.shape(frame(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])).first()
    assert (got.nodes, got.links, got.triangles) == (4, 4, 1)
    assert got.density == pytest.approx(2 * 4 / 12)
    assert got.clustering == pytest.approx(3 / 5)


def test_paths_use_no_edge_twice(spark):
    e = spark.createDataFrame([(1, 2, 0), (2, 1, 1), (1, 3, 2)], "src long, dst long, edge_id long")
    got = {tuple(r.nodes) for r in graph.paths(e, spark.createDataFrame([(1,)], "id long"), 1, 4).collect()}
    assert got == {(1, 2), (1, 3), (1, 2, 1), (1, 2, 1, 3)}


def test_action_of_unit_weights_is_half_a_hop(spark):
    from pyspark.sql import functions as F

    e = frame(spark, [(1, 2), (2, 3)]).withColumn("weight", graph.action_weight(F.lit(1.0), F.lit(0.0)))
    got = {r.id: r.action for r in graph.least_action(e, spark.createDataFrame([(1,)], "id long"), 3).collect()}
    assert got == {1: 0.0, 2: 0.5, 3: 1.0}


def test_projection_does_not_depend_on_order(spark, edges):
    a = graph.random_projection(frame(spark, edges), dim=4).orderBy("id").collect()
    b = graph.random_projection(frame(spark, edges[::-1]).repartition(3), dim=4).orderBy("id").collect()
    assert [r.id for r in a] == [r.id for r in b]
    assert all(abs(x - y) < 1e-9 for r, s in zip(a, b) for x, y in zip(r.vector, s.vector))


def test_pagerank_sums_to_one(spark, edges):
    nodes = spark.createDataFrame([(i,) for i in range(35)], "id long")
    got = messages.pagerank(nodes, frame(spark, edges), 8).collect()
    assert len(got) == 35 and sum(r["rank"] for r in got) == pytest.approx(1.0)


def test_coloring_in_the_order_of_three_facts(spark, edges):
    near = neighbours(edges)
    facts = {n: (n * 7 % 5, n * 3 % 4) for n in near if n % 6}
    fact = lambda n: tuple(-x for x in facts[n]) if n in facts else (math.inf, math.inf)
    want = {}
    for n in sorted(near, key=lambda n: (-len(near[n]), *fact(n), n)):
        used = {want[m] for m in near[n] if m in want}
        want[n] = next(c for c in itertools.count(1) if c not in used)
    order = graph.coloring_order(frame(spark, edges), spark.createDataFrame([(n, *f) for n, f in facts.items()], "id long, at long, downloads long"))
    assert {r.id: r.degree for r in order.collect()} == {n: len(x) for n, x in near.items()}
    assert dict(graph.coloring(frame(spark, edges), order).collect()) == want

"""Paths in time, teams, scaffolded attention, distances, relations and roles against plain versions."""

import collections
import random

import numpy as np
import pytest

from lensgraph.operators import attention, distances, relations, temporal


@pytest.fixture(scope="module")
def links():
    rng = random.Random(6)
    return [(rng.randrange(12), rng.randrange(12), rng.randrange(8), float(rng.randrange(1, 9))) for _ in range(60)]


def test_timed_action(spark, links):
    edges = spark.createDataFrame([*links, (0, 1, None, 1.0), (None, 1, 1, 1.0)], "src long, dst long, time int, weight double")
    states = {(0, -1, 0.0)} | {(5, -1, 0.0)}
    found = {s: {(s, -1, 0.0)} for s in (0, 5)}
    for s in found:
        front = set(found[s])
        for _ in range(4):
            front = {(d, t, w + x) for v, at, w in front for a, d, t, x in links if a == v and t >= at}
            found[s] |= front
    want = set()
    for s, reached in found.items():
        for v, t, w in reached:
            if not any(u == v and (at, x) != (t, w) and at <= t and x <= w for u, at, x in reached):
                want.add((s, v, t, w))
    got = temporal.timed_action(edges, spark.createDataFrame([(0,), (5,)], "id long"), 4).collect()
    assert {(r.source, r.id, -1 if r.arrival is None else r.arrival, r.action) for r in got} == want and len(got) == len(want) and states
    assert temporal.timed_action(edges.limit(0), spark.createDataFrame([(0,)], "id long"), 3).count() == 1


def test_team_action(spark):
    actions = spark.createDataFrame([(1, 2, 1.0), (2, 1, 2.0), (1, 2, 0.5), (3, 4, 9.0), (4, 3, 1.0), (5, 6, 0.1)], "source long, id long, action double")
    teams = spark.createDataFrame([(10, 1), (10, 2), (10, 2), (11, 3), (11, 4), (12, 5), (12, 6), (13, None)], "team long, id long")
    got = {r.team: (r.pairs, r.action, r.least) for r in temporal.team_action(actions, teams).collect()}
    assert got == {10: (2, 2.5, True), 11: (2, 10.0, False), 12: (2, None, False)}


def test_scaffolded_is_the_dense_product(spark):
    rng = np.random.default_rng(3)
    q, k, v = rng.normal(size=(3, 30, 4))
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 30, (80, 2))}
    nodes = spark.createDataFrame([(i, q[i].tolist(), k[i].tolist(), v[i, :3].tolist()) for i in range(30)] + [(99, None, [1.0] * 4, [1.0] * 3)], "id long, q array<double>, k array<double>, v array<double>")
    edges = spark.createDataFrame([*pairs, *list(pairs)[:9], (99, 1), (1, 99)], "src long, dst long")
    s = np.full((30, 30), 0.05)
    for a, b in pairs:
        s[a, b] = 1
    want = ((q @ k.T) * s + 0.3 * s) @ v[:, :3]
    got = {r.id: r.output for r in attention.scaffolded(nodes, edges, 0.05, 0.3).collect()}
    assert got.keys() == set(range(30)) and np.allclose([got[i] for i in range(30)], want)
    assert attention.scaffolded(nodes.limit(0), edges, 0.05, 0.3).count() == 0


def test_average_path(spark, links):
    edges, nodes = spark.createDataFrame([(a, b) for a, b, _, _ in links[:25]], "src long, dst long"), spark.range(14)
    out = collections.defaultdict(set)
    for a, b, _, _ in links[:25]:
        out[a].add(b)
    hops = []
    for s in range(14):
        far, queue = {s: 0}, [s]
        for x in queue:
            for y in out[x]:
                if y not in far:
                    far[y] = far[x] + 1
                    queue.append(y)
        hops += [d for d in far.values() if d]
    row = distances.average_path(edges, nodes).first()
    assert (row.pairs, row.average, row.diameter) == (len(hops), pytest.approx(sum(hops) / len(hops)), max(hops))
    told = distances.average_path_estimate(edges, nodes).first()
    assert told.pairs == pytest.approx(len(hops), rel=0.05) and told.average == pytest.approx(row.average, rel=0.05) and told.rounds >= max(hops)
    none = distances.average_path(edges.limit(0), nodes).first()
    assert none.pairs == 0 and none.average is None and distances.average_path_estimate(edges.limit(0), nodes).first().average is None


def test_relations(spark):
    rows = [(1, '@Transactional @a.b.Timed("x@Secured") class A'), (2, "@Value int x; @Value int y; @Other"), (3, None), (4, "none"), (5, "@PreAuthorize@Secured")]
    got = {tuple(r) for r in relations.relations(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == {(1, "MANAGED_BY", "Lifecycle", 1), (1, "OBSERVED_BY", "Diagnostics", 1), (1, "PROTECTED_BY", "Security", 1), (2, "CONFIGURED_BY", "Configuration", 2), (5, "PROTECTED_BY", "Security", 2)}


def test_cluster_roles(spark):
    members = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c"), (6, "d")], "id long, cluster string")
    degrees = spark.createDataFrame([(1, 10), (2, 7), (3, 8), (4, 8), (5, 20)], "id long, degree long")
    middle = spark.createDataFrame([(1, 0.9), (3, 0.51), (5, 0.6)], "id long, normalized double")
    got = {r.cluster: r.role for r in relations.cluster_roles(members, degrees, middle).collect()}
    assert got == {"a": "Controller", "b": "Security", "c": "Controller", "d": None}

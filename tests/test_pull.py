"""Rounds over mapped graphs against plain versions, with bounded pieces."""

import collections
import itertools
import random

import numpy as np
import pytest

from lensgraph.operators import graph, messages, pull


@pytest.fixture(scope="module")
def links():
    rng = random.Random(4)
    return sorted({(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(400))})


@pytest.fixture(params=[3, 1 << 20])
def few(request, monkeypatch):
    monkeypatch.setattr(pull, "EDGES", request.param)


def test_colored_in_few_rounds(few):
    """More colors than a word has bits, ranges in turn; a range whose earlier ranges are done is done at once."""
    rng, n = np.random.default_rng(2), 200
    near = [set() for _ in range(n)]
    for a, b in [*itertools.combinations(range(80), 2), *rng.integers(0, n, (500, 2)).tolist()]:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = np.zeros(n, np.int32)
    for v in range(n):
        used = {want[w] for w in near[v] if w < v}
        want[v] = next(c for c in itertools.count(1) if c not in used)
    starts = np.cumsum([0, *map(len, near)])
    targets = np.array([w for x in near for w in sorted(x)], np.int32)
    before = np.zeros(n, np.int32)
    for low in range(0, n, 50):
        own = before[low : low + 50].copy()
        pull.colored(starts, targets, before, own, low)
        before[low : low + 50] = own
    assert want.max() > 64 and (before == want).all()
    last = np.zeros(50, np.int32)
    pull.colored(starts, targets, np.zeros(n, np.int32), last, 150)  # nothing is known of the earlier ranges
    assert all(last[v - 150] in (0, want[v]) for v in range(150, n))


def test_coloring_rounds_do_not_follow_partitions(spark, links, monkeypatch):
    """With many shuffle partitions there were as many ranges, and rounds."""
    monkeypatch.setattr(pull, "partitions", lambda spark: 50)
    rounds, ran = [], pull.Pull.round
    monkeypatch.setattr(pull.Pull, "round", lambda self, *a, **k: rounds.append(1) or ran(self, *a, **k))
    e = spark.createDataFrame(links, "src long, dst long")
    near = collections.defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for n in sorted(near, key=lambda n: (-len(near[n]), n)):
        used = {want[m] for m in near[n] if m in want}
        want[n] = next(c for c in itertools.count(1) if c not in used)
    priority = spark.createDataFrame([(n, -len(x)) for n, x in near.items()], "id long, priority long")
    assert dict(graph.coloring(e, priority).collect()) == want and len(rounds) <= 2 * spark.sparkContext.defaultParallelism


def test_sketches_by_stripes(spark, monkeypatch):
    """The same whatever the stripe, near the exact pairs, and rounds as the longest way tells; edges to other ids do not count."""
    from lensgraph.operators import distances

    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(700)] + [(7, 7), (5, 900), (900, 6), (None, 3)]
    e, n = spark.createDataFrame(edges, "src long, dst long"), spark.range(305)
    exact = distances.average_path(e.filter("src < 900 and dst < 900"), n).first()
    got = distances.average_path_estimate(e, n).first()
    assert got.pairs == pytest.approx(exact.pairs, rel=0.05) and got.average == pytest.approx(exact.average, rel=0.03)
    assert got.rounds <= exact.diameter + 1
    monkeypatch.setattr(distances, "SKETCH_BYTES", 1)
    monkeypatch.setattr(pull, "EDGES", 50)
    again = distances.average_path_estimate(e, n).first()
    assert again.rounds == got.rounds and again.pairs == pytest.approx(got.pairs) and again.average == pytest.approx(got.average)


def test_rounds_in_bounded_pieces(spark, few, links):
    """Labels, votes and values are the same however few edges a task holds at once."""
    e = spark.createDataFrame([(a, b, 1.0 + a % 3) for a, b in links if a % 7], "src long, dst long, weight double")
    n, pairs = spark.range(63), [(a, b) for a, b in links if a % 7]
    least = list(range(63))
    for _ in range(63):
        for a, b in pairs:
            least[b] = min(least[b], least[a])
    assert dict(messages.least_labels(n, e).collect()) == dict(enumerate(least))
    near = collections.defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    label = {x: x for x in near}
    for _ in range(3):
        votes = {x: collections.Counter(label[y] for y in near[x]) for x in near}
        label = {x: min(v, key=lambda y: (-v[y], y)) for x, v in votes.items()}
    assert dict(graph.label_propagation(e, 3).collect()) == label
    m, value = np.zeros((63, 63)), np.ones(63)
    for a, b in pairs:
        m[b, a] += 1.0 + a % 3
    for _ in range(2):
        value = m @ value
    got = dict(messages.centrality(n, e, 2).collect())
    assert np.allclose([got[x] for x in range(63)], value / np.linalg.norm(value))
    want = np.abs(np.linalg.eigh(m + m.T)[1][:, -1])
    assert all(abs(v - want[x]) < 1e-3 for x, v in graph.power_iteration(e, 200, 1e-7).collect())


def test_modularity_with_a_null_label(spark):
    """As in SQL, a null label is a group with nothing inside; its links were lost before."""
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 4)], "src long, dst long")
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id long, label string")
    assert graph.modularity(e, labels).first()[0] == pytest.approx(2 / 6 - (3 / 6) ** 2 - (2 / 6) ** 2 - (1 / 6) ** 2)

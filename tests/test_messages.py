"""Message passing, strong components and Louvain against plain versions."""

import collections
import heapq
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lensgraph.operators import communities, graph, messages, strong


@pytest.fixture(scope="module")
def links():
    rng = random.Random(11)
    return sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(75)})


@pytest.fixture(scope="module")
def frames(spark, links):
    nodes = spark.range(45).withColumn("state", F.lit("x"))
    edges = spark.createDataFrame([(a, b, float(1 + (a * b) % 5)) for a, b in links], "src long, dst long, weight double")
    return nodes, edges


def reach(links, n):
    out = collections.defaultdict(set)
    for a, b in links:
        out[a].add(b)
    found = {}
    for s in range(n):
        seen, stack = set(), [s]
        while stack:
            for w in out[stack.pop()]:
                if w not in seen:
                    seen.add(w)
                    stack.append(w)
        found[s] = seen
    return found


def test_least_labels(frames, links):
    to = reach(links, 45)
    want = {v: min([v] + [s for s in range(45) if v in to[s]]) for v in range(45)}
    assert {r.id: r.label for r in messages.least_labels(*frames).collect()} == want


def test_distances(frames, links):
    out = collections.defaultdict(list)
    for a, b in links:
        out[a].append((b, 1 + (a * b) % 5))
    want, heap = {}, [(0, 3), (0, 7)]
    while heap:
        d, v = heapq.heappop(heap)
        if v not in want:
            want[v] = d
            for w, x in out[v]:
                heapq.heappush(heap, (d + x, w))
    got = {r.id: r.distance for r in messages.distances(*frames, F.col("id").isin(3, 7)).collect()}
    assert got == {v: want.get(v) for v in range(45)}


def test_pagerank_and_centrality(frames, links):
    n, rank, value = 45, np.full(45, 1 / 45), np.ones(45)
    out = np.bincount([a for a, _ in links], minlength=n)
    for _ in range(5):
        lost = rank[out == 0].sum()
        new, raised = np.zeros(n), np.zeros(n)
        for a, b in links:
            new[b] += rank[a] / out[a]
            raised[b] += value[a] * (1 + (a * b) % 5)
        rank, value = 0.15 / n + 0.85 * (new + lost / n), raised
    got = {r.id: r["rank"] for r in messages.pagerank(frames[0], frames[1], 5).collect()}
    assert np.allclose([got[v] for v in range(n)], rank)
    got = {r.id: r.value for r in messages.centrality(*frames, 5).collect()}
    assert np.allclose([got[v] for v in range(n)], value / np.linalg.norm(value))


def test_edges_are_not_shuffled_again(spark, frames):
    held = messages._Buckets(frames[0])
    links, state = held.written(frames[1], "src"), held.written(frames[0], "id")
    held_size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = state.join(links, F.col("id") == F.col("src"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held_size)
        held.end()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_tables_are_dropped(spark, frames):
    messages.least_labels(*frames)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("messages_")]


def test_no_rows(spark, frames):
    nodes, edges = frames
    assert messages.least_labels(nodes.limit(0), edges.limit(0)).count() == 0
    assert {r.label for r in messages.least_labels(nodes, edges.limit(0)).collect()} == set(range(45))
    assert strong.strong_components(nodes.limit(0), edges.limit(0)).count() == 0
    assert communities.louvain(edges.limit(0)).count() == 0


def test_strong_components(spark, frames, links):
    more = [(100 + k, 100 + (k + 1) % 9) for k in range(9)] + [(200 + k, 201 + k) for k in range(8)] + [(108, 200), (300, 300), (45, None)]
    edges = spark.createDataFrame([*links, *more], "src long, dst long")
    every = [p for p in [*links, *more] if p[1] is not None]
    to = reach(every, 301)
    ids = {*range(45), *(x for p in every for x in p)}
    want = {v: (min([v] + [w for w in to[v] if v in to[w]]), v in to[v]) for v in ids}
    got = {r.id: (r.component, r.cyclic) for r in strong.strong_components(frames[0], edges).collect()}
    assert got == want and sum(c for _, c in want.values()) > 10


def plain_louvain(pairs):
    w = collections.Counter()
    for a, b, x in pairs:
        w[a, b] += x
        w[b, a] += x
    members = {v: v for e in w for v in e}

    def quality(w):
        m = sum(w.values())
        ends = collections.Counter()
        for (a, _), x in w.items():
            ends[a] += x
        return sum(w.get((c, c), 0) / m - (x / m) ** 2 for c, x in ends.items())

    q = quality(w)
    while True:
        m, k = sum(w.values()), collections.Counter()
        for (a, _), x in w.items():
            k[a] += x
        at, still = {v: v for v in k}, 0
        for number in range(communities.ROUNDS):
            tot = collections.Counter()
            for v, c in at.items():
                tot[c] += k[v]
            new = dict(at)
            for v in k:
                near = collections.Counter({at[v]: 0.0})
                for (a, b), x in w.items():
                    if a == v and b != v:
                        near[at[b]] += x
                gain = {c: round(x - k[v] * (tot[c] - (k[v] if c == at[v] else 0)) / m, 9) for c, x in near.items()}
                best = min(gain, key=lambda c: (-gain[c], c))
                if gain[best] > gain[at[v]] and zlib.crc32(f"{v}:{number}".encode()) % 2 == 0:
                    new[v] = best
            still = still + 1 if new == at else 0
            at = new
            if still == 2:
                break
        joined = collections.Counter()
        for (a, b), x in w.items():
            joined[at[a], at[b]] += x
        if quality(joined) - q < communities.GAIN:
            return members, q
        q, w = quality(joined), joined
        members = {v: at[c] for v, c in members.items()}


def test_louvain(spark):
    rng = random.Random(4)
    pairs = [(a, b, 1.0 + (a + b) % 3) for a in range(40) for b in range(a, 40) if rng.random() < (0.5 if a // 10 == b // 10 else 0.04)]
    edges = spark.createDataFrame(pairs, "src long, dst long, weight double")
    want, q = plain_louvain(pairs)
    got = {r.id: r.community for r in communities.louvain(edges).collect()}
    assert got == want
    labels = graph.label_propagation(edges, 4)
    m = {frozenset(p[:2]) for p in pairs if p[0] != p[1]}
    assert len(m) and q > 0.4
    ours = graph.modularity(edges, spark.createDataFrame(list(got.items()), "id long, label long")).first()[0]
    assert ours >= graph.modularity(edges, labels).first()[0] - 1e-9

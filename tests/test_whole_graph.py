"""Graph queries over all edges of the smallest tables, against brute force."""

import collections
import itertools

import duckdb
import numpy as np
import pytest

from lensgraph.operators import csr, graph
from lensgraph.plans import registry
from lensgraph.sources.tables import LINKS_SQL


@pytest.fixture(scope="module")
def links(sf):
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{sf}/lineitem.parquet'")
    return con.execute(f"WITH {LINKS_SQL.strip()} SELECT src, dst, rel_type, weight::DOUBLE FROM edges").fetchall()


@pytest.fixture(scope="module")
def near(links):
    out = collections.defaultdict(set)
    for a, b, *_ in links:
        out[a].add(b)
        out[b].add(a)
    return out


@pytest.fixture(scope="module")
def parts(near):
    out = {}
    for n in sorted(near):
        stack = [] if n in out else [n]
        while stack:
            v = stack.pop()
            if v not in out:
                out[v] = n
                stack.extend(near[v])
    return out


def test_components(spark, sf, parts):
    assert dict(registry.queries()["graph_components"](spark, sf).collect()) == parts


def test_cycle_rank(spark, sf, near, parts):
    nodes, n_links, components = len(near), sum(map(len, near.values())) // 2, len(set(parts.values()))
    assert tuple(registry.queries()["graph_cycle_rank"](spark, sf).first()) == (nodes, n_links, components, n_links - nodes + components)


def test_communities(spark, sf, near):
    label = {n: n for n in near}
    for _ in range(4):
        votes = {n: collections.Counter(label[m] for m in near[n]) for n in near}
        label = {n: min(v, key=lambda x: (-v[x], x)) for n, v in votes.items()}
    assert dict(registry.queries()["graph_communities"](spark, sf).collect()) == label


def test_composition(spark, sf, links):
    out = collections.defaultdict(set)
    for a, b, kind, _ in links:
        if kind == "IMPORTS":
            out[a].add(b)
    want = {(a, c, "INFLUENCES") for a, b, kind, _ in links if kind == "CALLS" for c in out[b]}
    got = registry.queries()["graph_composition"](spark, sf).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_coloring(spark, sf, near):
    want = {}
    for n in sorted(near, key=lambda n: (-len(near[n]), n)):
        used = {want[m] for m in near[n] if m in want}
        want[n] = next(c for c in itertools.count(1) if c not in used)
    assert dict(registry.queries()["graph_coloring"](spark, sf).collect()) == want
    most = max(want.values())
    assert tuple(registry.queries()["graph_exclusions"](spark, sf).first()) == (most, True, most - 1)


def calls_of(links):
    out = collections.defaultdict(set)
    for a, b, kind, _ in links:
        if kind == "CALLS":
            out[a].add(b)
    return out


def test_betweenness_follows_long_paths(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(24)], "src long, dst long")
    ids = spark.createDataFrame([(i,) for i in range(25)], "id long")
    got = {r.id: r.centrality for r in csr.betweenness(e, ids, ids.filter("id = 0")).collect()}
    assert got == {i: 24 - i if i else 0 for i in range(25)}


def test_betweenness_from_all_nodes(spark, sf, links):
    out, ids = calls_of(links), sorted(r.p_partkey for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect())
    want = collections.Counter()
    for s in ids:
        dist, sigma, queue = {s: 0}, collections.Counter({s: 1}), [s]
        for v in queue:
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        delta = collections.Counter()
        for v in reversed(queue):
            delta[v] = sum(sigma[v] / sigma[w] * (1 + delta[w]) for w in out[v] if dist[w] == dist[v] + 1)
            if v != s:
                want[v] += delta[v]
    got = {r.id: r.centrality for r in registry.queries()["graph_betweenness"](spark, sf).collect()}
    assert sorted(got) == ids and all(abs(got[i] - want[i]) < 1e-3 for i in ids)


@pytest.mark.parametrize("size", [1, 256 << 20])
def test_betweenness_by_batches(spark, monkeypatch, size):
    """A ring of four with a chord, a node apart, a repeated edge, a loop and a null; one source a batch, or all."""
    monkeypatch.setattr(csr, "BATCH_BYTES", size)
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1), (2, 4), (2, 4), (3, 3), (None, 3)], "src long, dst long")
    n = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    got = {r.id: (r.centrality, r.normalized) for r in csr.betweenness(e, n).collect()}
    assert got == {1: (3.0, 3 / 12), 2: (3.0, 3 / 12), 3: (0.0, 0.0), 4: (3.0, 3 / 12), 5: (0.0, 0.0)}
    assert csr.betweenness(e.limit(0), n.limit(0)).count() == 0 and {r.centrality for r in csr.betweenness(e.limit(0), n).collect()} == {0.0}


def plain_dependencies(out, source):
    dist, sigma, queue = {source: 0}, collections.Counter({source: 1}), [source]
    for v in queue:
        for w in out[v]:
            if w not in dist:
                dist[w] = dist[v] + 1
                queue.append(w)
            if dist[w] == dist[v] + 1:
                sigma[w] += sigma[v]
    delta = collections.Counter()
    for v in reversed(queue):
        delta[v] = sum(sigma[v] / sigma[w] * (1 + delta[w]) for w in out[v] if dist[w] == dist[v] + 1)
    del delta[source]
    return delta


def test_betweenness_searches_a_part_as_small_as_it_is(spark, monkeypatch):
    """Copies that do not meet: a batch's arrays are as long as what it reaches, and its width does not shrink with the copies. Hubs have their own way."""
    monkeypatch.setattr(csr, "HUB", 5)
    rng, links = np.random.default_rng(3), set()
    for copy in range(4):
        links |= {(int(a) + 40 * copy, int(b) + 40 * copy) for a, b in rng.integers(0, 40, (110, 2)) if a != b} | {(40 * copy + k, 40 * copy) for k in range(1, 9)}
    out, want = collections.defaultdict(set), collections.Counter()
    for a, b in links:
        out[a].add(b)
    for s in range(160):
        want.update(plain_dependencies(out, s))
    monkeypatch.setattr(csr, "BATCH_BYTES", 36 * 40 * csr.SOURCES)
    e = spark.createDataFrame(sorted(links), "src long, dst long")
    got = {r.id: r.centrality for r in csr.betweenness(e, spark.range(160)).collect()}
    assert set(got) == set(range(160)) and all(abs(got[i] - want[i]) < 1e-9 for i in got)
    at = np.array(sorted(links))
    starts, targets = np.searchsorted(at[:, 0], np.arange(161)), at[:, 1].astype(np.int32)
    for s in (0, 45, 159):
        assert set(csr.reached(starts, targets, np.array([s]))) <= set(range(s // 40 * 40, s // 40 * 40 + 40))
    one = csr.dependencies(starts, targets, *csr.turned(starts, targets), np.array([0, 45, 159]))
    assert np.allclose(one, [sum(plain_dependencies(out, s)[i] for s in (0, 45, 159)) for i in range(160)])


def test_eigenvector_has_converged(spark, sf, links):
    at = {n: i for i, n in enumerate(sorted({x for a, b, kind, _ in links if kind == "CALLS" for x in (a, b)}))}
    m = np.zeros((len(at), len(at)))
    for a, b, kind, w in links:
        if kind == "CALLS":
            m[at[a], at[b]] += w
            m[at[b], at[a]] += w
    want = np.abs(np.linalg.eigh(m)[1][:, -1])
    got = dict(registry.queries()["graph_eigenvector"](spark, sf).collect())
    assert set(got) == set(at) and np.linalg.norm(np.array([got[n] for n in at]) - want) < 1e-3


def test_cycles_to_five(spark, sf, links):
    out, want = calls_of(links), set()

    def walk(path):
        for w in out[path[-1]]:
            if w == path[0] and len(path) > 1:
                want.add((len(path), ">".join(map(str, path))))
            elif w > path[0] and w not in path and len(path) < 5:
                walk([*path, w])

    for s in list(out):
        walk([s])
    got = registry.queries()["graph_cycles"](spark, sf).collect()
    assert len(got) == len(want) and {(r.length, r.path) for r in got} == want and max(r.length for r in got) == 5

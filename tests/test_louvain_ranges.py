"""A round of Louvain by ranges of nodes: no link is shuffled, and ranges do not change what moves."""

import random

from pyspark.sql import functions as F

from lensgraph.operators import communities, csr


def test_ranges_do_not_matter(spark, monkeypatch):
    rng = random.Random(3)
    pairs = {(min(a, b), max(a, b)): float(rng.randrange(1, 5)) for a, b in ((rng.randrange(40) * 10, rng.randrange(40) * 10) for _ in range(120))}
    both = [(a, b, w) for (a, b), w in pairs.items()] + [(b, a, w) for (a, b), w in pairs.items() if a != b]
    links = spark.createDataFrame(both, "a long, b long, w double")
    found = []
    for size in (1 << 19, 60):
        monkeypatch.setattr(communities, "RANGE", size)
        level = communities._Level(links, sum(w for *_, w in both))
        moved = level.moved(0)
        found.append((level.ranges, moved, sorted(level.communities(1).collect()), sorted(level.contracted(1).collect())))
    assert found[0][0] == 1 and found[1][0] > 1 and found[0][1] > 0 and found[0][1:] == found[1][1:]
    at = dict((r.id, r.community) for r in found[0][2])
    want = {}
    for a, b, w in both:
        want[at[a], at[b]] = want.get((at[a], at[b]), 0) + w
    assert {(r.ca, r.cb): r.w for r in found[0][3]} == want


def test_ids_are_numbered_once(spark, monkeypatch):
    """Three levels at least, in ranges of few links: ids are numbered once, later levels number themselves; all ranges agree with one."""
    calls, numbered = [], csr.numbered
    monkeypatch.setattr(csr, "numbered", lambda *a, **k: calls.append(1) or numbered(*a, **k))
    rng = random.Random(9)
    links = {(min(a, b), max(a, b)) for a, b in ((rng.randrange(160) * 7 - 300, rng.randrange(160) * 7 - 300) for _ in range(420))} | {(-300, -300)}
    edges = spark.createDataFrame([(a, b, float((a + b) % 3 + 1)) for a, b in sorted(links)] + [(5000, 5001, None), (5002, 5003, -1.0), (None, 1, 1.0)], "src long, dst long, weight double")
    found = []
    for size in (1 << 19, 40):
        monkeypatch.setattr(communities, "RANGE", size)
        calls.clear()
        found.append(sorted(map(tuple, communities.louvain(edges).collect())))
        assert len(calls) == 1
    ids = {x for pair in links for x in pair}
    assert found[0] == found[1] and [i for i, _ in found[0]] == sorted(ids) and {c for _, c in found[0]} <= ids and len({c for _, c in found[0]}) < 40

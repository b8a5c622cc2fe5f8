"""Cycles over mapped rows, against a walk from every node."""

import numpy as np
import pytest

from lensgraph.operators import cycles, graph


def plain_cycles(links, most):
    out, found = {}, set()
    for a, b in links:
        out.setdefault(a, set()).add(b)

    def walk(path):
        for w in out.get(path[-1], ()):
            if w == path[0] and len(path) > 1:
                found.add((len(path), *path))
            if w > path[0] and w not in path and len(path) < most:
                walk([*path, w])

    for a in out:
        walk([a])
    return found


@pytest.mark.parametrize(("steps", "most"), [(1 << 19, 5), (7, 5), (7, 6), (7, 2)])
def test_cycles_in_small_pieces(spark, monkeypatch, steps, most):
    """Loops, repeated edges, nulls, both directions of a hub, ids with gaps; pieces smaller than one node's edges."""
    monkeypatch.setattr(cycles, "STEPS", steps)
    rng = np.random.default_rng(most)
    links = [(int(a) * 3, int(b) * 3) for a, b in rng.integers(0, 22, (60, 2))] + [(9, 3 * k) for k in range(0, 22, 2)] + [(3 * k, 9) for k in range(0, 22, 3)]
    df = spark.createDataFrame([*links, *links[:9], (None, 3), (3, None)], "src long, dst long")
    got = [(r.length, *r.nodes) for r in graph.cycles(df, most).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_cycles([x for x in links if x[0] != x[1]], most)


def test_cycles_of_text_ids_and_of_no_edges(spark):
    df = spark.createDataFrame([("b", "a"), ("a", "c"), ("c", "b"), ("c", "a")], "src string, dst string")
    assert {(r.length, *r.nodes) for r in graph.cycles(df, 5).collect()} == {(2, "a", "c"), (3, "a", "c", "b")}
    assert graph.cycles(df.limit(0), 5).count() == 0


def test_cycles_shuffle_no_path(spark):
    """The paths of a graph without cycles, 20 ** 3 of three edges, stay in their task: none reaches a shuffle."""
    layers = [(100 * k + a, 100 * k + 100 + b) for k in range(3) for a in range(20) for b in range(20)]
    ends = [(a, 1000) for a in range(300, 320)] + [(1000, 1001)]
    df = spark.createDataFrame([*layers, *ends], "src long, dst long")
    plan = graph.cycles(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Join") <= 2 and graph.cycles(df, 5).count() == 0

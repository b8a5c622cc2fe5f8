"""Folds over a user's events against plain loops; no row holds all events of a user."""

import collections

import pytest

from lensgraph.operators import reports
from lensgraph.plans import registry


@pytest.fixture(scope="module")
def events(spark, sf):
    out = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "event_id", "event_type").collect():
        out[r.user_id].append((r.ts, r.event_id, r.event_type))
    return {u: sorted(x) for u, x in out.items()}


def test_confidence_fold(spark, sf, events):
    df = registry.queries()["confidence_fold"](spark, sf)
    got = dict(df.collect())
    assert sorted(got) == sorted(events)
    for u, x in events.items():
        p = 0.5
        for _, _, kind in x:
            p = (p + (kind != "error")) / 3
        assert abs(got[u] - p) < 2e-6
    assert "collect_list" not in df._jdf.queryExecution().toString()


def test_pattern_library(spark):
    rows = [("a", i, i % 3 == 1, f"c{i}") for i in range(30)] + [("b", 1, False, "x")] + [("c", 1, True, "y"), ("c", 2, False, None)]
    df = reports.pattern_library(spark.createDataFrame(rows, "k string, at long, ok boolean, c string"), "k", "at", "ok", "c")
    got = {r.k: r for r in df.collect()}
    p = 0.6
    for i in range(2, 30):
        p = (p + (i % 3 == 1)) / 3
    assert sorted(got) == ["a", "c"]
    assert (got["a"].uses, got["a"].successes, got["a"].examples) == (29, 10, [f"c{i}" for i in range(20, 30)])
    assert abs(got["a"].confidence - p) < 1e-12
    assert (got["c"].uses, got["c"].successes, got["c"].examples) == (2, 1, ["y", None]) and abs(got["c"].confidence - 0.2) < 1e-12
    assert "Window" in df._jdf.queryExecution().toString()

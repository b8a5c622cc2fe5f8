"""Places and quantiles by stretches of an order."""

import numpy as np
from pyspark.sql import functions as F

from lensgraph.operators import graph, ranks, reports


def test_placed_hot_group_and_nulls(spark):
    rng = np.random.default_rng(5)
    rows = [(None if k == 3 else int(k), int(v), i) for i, (k, v) in enumerate(zip(rng.choice(4, 3000, p=[0.9, 0.05, 0.04, 0.01]), rng.integers(0, 50, 3000)))]
    df = spark.createDataFrame(rows, "k int, v int, id int")
    got = {r.id: r.at for r in ranks.placed(df, ["k"], ["v", "id"], "at").collect()}
    want, seen = {}, {}
    for k, v, i in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = seen.get(k, 0)
        seen[k] = want[i] + 1
    assert got == want
    # sums of a weight, no keys
    got = {r.id: r.at for r in ranks.placed(df, [], ["v", "id"], "at", "v").collect()}
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    assert got == {i: s for (_, _, i), s in zip(order, np.cumsum([0, *[v for _, v, _ in order]]).tolist())}
    assert ranks.placed(df.limit(0), ["k"], ["v"], "at").count() == 0


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=1001), rng.integers(0, 4, 1001).astype(float)
    rows = [(float(x), None if i % 3 == 0 else float(y), None, i) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d int")
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {(r.column, r.share): r.value for r in ranks.quantiles(df, ["a", "b", "c", "d"], shares).collect()}
    values = {"a": a, "b": b[np.arange(1001) % 3 != 0], "d": np.arange(1001)}
    assert set(got) == {(c, s) for c in values for s in shares}
    assert all(np.isclose(got[c, s], np.quantile(values[c], s)) for c, s in got)


def test_profile_of_columns_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (None, None)], "a double, b double")
    got = {r.column: r for r in reports.profile(df, ["a", "b"]).collect()}
    assert (got["a"].n, got["a"].missing, got["a"].median, got["a"].outliers) == (2, 1, 1.5, 0)
    assert (got["b"].n, got["b"].missing, got["b"].median, got["b"].mean) == (0, 3, None, None)


def test_cycles_of_each_length(spark):
    rng = np.random.default_rng(7)
    links = {(int(a), int(b)) for a, b in rng.integers(0, 12, (50, 2))}
    df = spark.createDataFrame(sorted(links), "src long, dst long")
    for most in (2, 3, 4, 6):
        want = []

        def walk(path, most=most, want=want):
            for s, d in links:
                if s == path[-1] and d == path[0] and len(path) > 1:
                    want.append(tuple(path))
                elif s == path[-1] and d > path[0] and d not in path and len(path) < most:
                    walk([*path, d])

        for node in range(12):
            walk([node])
        got = graph.cycles(df, most).select("length", F.col("nodes")).collect()
        assert sorted(tuple(r.nodes) for r in got) == sorted(want)
        assert all(r.length == len(r.nodes) for r in got)

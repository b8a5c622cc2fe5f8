"""Exact search over blocks and the vector index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lensgraph.operators import search, vector_index
from lensgraph.operators.vector_index import VectorIndex


def brute(rows, queries, k, least=-2.0):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = x @ x[list(ids).index(q)]
        near = sorted(((-v, i) for v, i in zip(s, ids) if i != q and v > least))
        out[q] = [int(i) for _, i in (near if k is None else near[:k])]
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(40, 16))
    return [(i, (middles[i % 40] + 0.5 * rng.normal(size=16)).tolist()) for i in range(3000)]


def lists(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.row_id))
    return {q: [i for _, i in sorted(v)] for q, v in out.items()}


@pytest.mark.parametrize("block", [7, 4096])
def test_search_is_exact(spark, clustered, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "HELD", 100)
    few = clustered[:300] + [(1000 + i, clustered[i][1]) for i in range(5)]  # ties
    df = spark.createDataFrame(few, "vec_id long, embedding array<double>").repartition(5)
    queries = df.filter("vec_id % 10 = 0")
    asked = [i for i, _ in few if i % 10 == 0]
    assert lists(search.search(df, queries, 6)) == brute(few, asked, 6)
    some = {}
    for r in search.search(df, queries, None, 0.5).collect():
        some.setdefault(r.query_id, set()).add(r.row_id)
    assert some == {q: set(v) for q, v in brute(few, asked, None, 0.5).items() if v}


def test_index_recall(spark, clustered, tmp_path):
    df = spark.createDataFrame(clustered, "vec_id long, embedding array<double>")
    index = VectorIndex.build(df, str(tmp_path / "index"))
    asked = [i for i, _ in clustered if i % 20 == 0]
    want, got = brute(clustered, asked, 10), lists(VectorIndex.open(spark, str(tmp_path / "index")).search(df.filter("vec_id % 20 = 0"), 10))
    recall = np.mean([len(set(want[q]) & set(got[q])) / 10 for q in asked])
    assert recall >= 0.9 and index.probes < index.n_lists / 2, (recall, index.probes, index.n_lists)
    assert index.rows.count() == len(clustered)
    assert lists(index.search(df.filter("vec_id % 20 = 0"), 10, probes=index.n_lists)) == want


def test_index_of_the_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    queries = rows.filter("vec_id % 10 = 0")
    got, want = lists(VectorIndex.build(rows).search(queries, 10)), lists(search.search(rows, queries, 10))
    assert np.mean([len(set(want[q]) & set(got.get(q, []))) / 10 for q in want]) >= 0.9


def test_hot_list_is_cut(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 50)
    rows = [(i, [1.0, i / 1000.0]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = VectorIndex.build(df, lists=1)
    assert index.rows.groupBy("block").count().agg(F.max("count")).first()[0] == 50
    assert lists(index.search(df, 5)) == brute(rows, range(400), 5)


def test_rows_that_do_not_count(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (None, [1.0, 0.0]), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0]), (7, [None, 1.0]), (8, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert lists(VectorIndex.build(df).search(df, 3)) == {1: [2, 8], 2: [1, 8], 8: [2, 1]}
    assert VectorIndex.build(df.limit(0)).search(df, 3).count() == 0

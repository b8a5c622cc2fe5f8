import numpy as np
import pytest
from pyspark.sql import functions as F

from lensgraph.functions import scores, vectors
from lensgraph.operators import calibrate, search


@pytest.fixture(scope="module")
def rows(spark):
    x = np.random.default_rng(0).normal(size=(300, 8)).astype(np.float32)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def test_nulls_and_zeros(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), (None, [1.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[:2] == [None, None] and got[2] == pytest.approx(1.0)
    assert df.select(vectors.mrl_truncate(F.col("b"), 1)).first()[0] == [0.0]


def test_truncation_of_whole_width_changes_nothing(rows):
    x, df = rows
    assert df.select(vectors.mrl_truncate(F.col("embedding"), 8)).first()[0] == pytest.approx(x[0].tolist())


def test_search_is_exact(rows, monkeypatch):
    x, df = rows
    monkeypatch.setattr(search, "BLOCK", 7)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    got = search.search(df, df.filter("vec_id % 10 = 0"), 5).collect()
    assert len(got) == 150
    for q in range(0, 300, 10):
        s = u @ u[q]
        s[q] = -9
        want = sorted(range(300), key=lambda i: (-s[i], i))[:5]
        assert [r.row_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


def test_spectrum_and_whitening(rows):
    x, df = rows
    c = x.astype(float) - x.astype(float).mean(0)
    s = np.linalg.svd(c, compute_uv=False)
    p = s / s.sum()
    got = calibrate.spectrum(df).first()
    assert got.effective_dimension == pytest.approx(np.exp(-(p * np.log(p)).sum()))
    assert got.isotropy == pytest.approx(s[-1] / s[0])
    mean, w = calibrate.whitening(df)
    out = np.array([r.vector for r in calibrate.transformed(df, w, mean).collect()])
    assert np.allclose(np.cov(out.T), np.eye(8), atol=1e-8)


def test_low_rank_is_two_products(rows):
    x, df = rows
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(8, 2)), rng.normal(size=(8, 2))
    got = df.select(vectors.low_rank_apply(F.col("embedding"), a.tolist(), b.tolist())).first()[0]
    assert np.allclose(got, x[0] + a @ (b.T @ x[0].astype(float)))


def test_goldens(spark):
    assert scores.majority_correct(5, 0.7) == pytest.approx(0.837, abs=5e-4)
    df = spark.createDataFrame([(0.94, 0.08)], "c double, s double")
    r = df.select(scores.divergence(F.col("c"), F.col("s")).alias("g"), scores.divergence_band(F.lit(0.86)).alias("b"), scores.interpretation(F.lit(0.69999)).alias("i")).first()
    assert (round(r.g, 2), r.b, r.i) == (0.86, "HIGH", "MEDIUM")
    assert df.select(scores.bayes_update(F.lit(0.5), F.lit(True)).alias("p")).first().p == pytest.approx(0.5)

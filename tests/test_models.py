import pytest

from lensgraph.operators import models, reports
from lensgraph.settings import Settings


def test_settings_bounds(monkeypatch):
    for good in (128, 4096):
        assert Settings(dimension=good).dimension == good
    for bad in (64, 8192):
        with pytest.raises(ValueError):
            Settings(dimension=bad)
    monkeypatch.setenv("LENSGRAPH_DIMENSION", "512")
    monkeypatch.setenv("LENSGRAPH_MODEL_ID", "mine")
    assert (Settings.from_env().dimension, Settings.from_env().model_id, Settings.from_env(dimension=256).dimension) == (512, "mine", 256)


def test_encode_keeps_nulls_and_order(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "i long, text string").coalesce(1)
    got = {r.i: r.embedding for r in models.encode(df, models.HashingEncoder(16), "text", ["i"], batch=1).collect()}
    assert got[2] is None and set(got[3]) == {0.0} and len(got[1]) == 16


def test_scores_and_rerank(spark):
    df = spark.createDataFrame([("capital of france", "paris is the capital of france"), ("capital of france", "bread"), (None, "x")], "q string, d string")
    got = {r.d: (r.score, r.interpretation) for r in models.score(df, models.OverlapScorer(), "q", "d").collect()}
    assert got["paris is the capital of france"][1] == "HIGH" and got["bread"][1] == "LOW" and got["x"][0] is None
    s = models.score(df, models.OverlapScorer(), "q", "d", symmetric=True).filter("d = 'bread'").first()
    assert 0 <= s.score <= 1
    q = spark.createDataFrame([(1, "a b")], "query_id long, query string")
    docs = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "a b c", "z", "b a"])], "query_id long, doc_id long, document string")
    assert [r.doc_id for r in models.rerank(q, docs, models.OverlapScorer(), 2).orderBy("rank").collect()] == [1, 3]


def test_request_faults(spark):
    f = lambda *t: spark.createDataFrame(list(enumerate(t)), "idx long, text string")
    e = models.HashingEncoder(256)
    assert models.request(f("", " "), e, None, 128).first().status == 400
    assert models.request(f("a"), e, "other", 128).first().status == 422
    assert models.request(f("a"), e, "semantic", 64).first().status == 422
    assert models.request(f(*"abcdefghijklmnopqrstu"), e, None, 128).first().status == 422
    got = models.request(f("a", "", "b"), e, "semantic", 128).collect()
    assert [(r.status, r.idx, len(r.embedding)) for r in got] == [(200, 0, 128), (200, 1, 128), (200, 2, 128)]


def test_t_test():
    assert reports.t_test_p(2.0, 10) == pytest.approx(0.07339, abs=1e-4)
    assert reports.t_test_p(0.0, 5) == pytest.approx(1.0)

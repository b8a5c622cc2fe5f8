"""Lens fitting, sampling and silhouettes against numpy and plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lensgraph.operators import calibrate, lens_fit, samples


def plain_loss(lens, a, b, t, covariance, weights, limit):
    u, v = a @ lens.T, b @ lens.T
    c = (u * v).sum(1) / np.linalg.norm(u, axis=1) / np.linalg.norm(v, axis=1)
    s = np.linalg.svd(lens, compute_uv=False)
    gap = lens @ covariance @ lens.T - np.eye(len(lens))
    parts = ((t - c) ** 2).mean(), np.log(np.exp(-2 * (2 - 2 * c)).mean()), s.sum(), (gap**2).sum(), max(0, s[0] / s[-1] - limit) ** 2
    return parts[0] + sum(w * x for w, x in zip(weights, parts[1:]))


@pytest.fixture(scope="module")
def fit(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 5)) @ np.diag([3, 1, 1, 0.5, 0.2])
    pairs = [(x[i].tolist(), x[j].tolist(), float((i + j) % 3 == 0)) for i in range(0, 60, 3) for j in range(60) if i != j]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id long, embedding array<double>")
    df = spark.createDataFrame([*pairs, (None, x[0].tolist(), 1.0), (x[0].tolist(), x[1].tolist(), None)], "va array<double>, vb array<double>, target double").repartition(3)
    made = lens_fit.LensFit(df, rows, limit=2.0)
    return made, [np.array(c) for c in zip(*pairs)], np.cov(x.T)


def test_loss_and_gradient(fit):
    made, (a, b, t), covariance = fit
    assert np.allclose(made.covariance, covariance)
    rng = np.random.default_rng(1)
    lens = np.eye(5) + 0.3 * rng.normal(size=(5, 5))
    values, slope = made.loss(lens)
    args = (a, b, t, covariance, made.weights, made.limit)
    assert values["condition"] > 0 and values["total"] == pytest.approx(plain_loss(lens, *args), rel=1e-9)
    for i in range(5):
        for j in range(5):
            step = np.zeros((5, 5))
            step[i, j] = 1e-6
            assert slope[i, j] == pytest.approx((plain_loss(lens + step, *args) - plain_loss(lens - step, *args)) / 2e-6, rel=1e-4, abs=1e-5)


def test_loss_falls_every_step(fit):
    made = fit[0].fit(4)
    totals = [h["total"] for h in made.history]
    assert len(totals) == 5 and all(x > y for x, y in zip(totals, totals[1:]))
    least, most, condition = lens_fit.bounds(made.lens)
    rng = np.random.default_rng(2)
    for _ in range(200):
        v = rng.normal(size=5)
        assert least - 1e-9 <= np.linalg.norm(made.lens @ v) / np.linalg.norm(v) <= most + 1e-9
    assert condition == pytest.approx(np.linalg.cond(made.lens))


def test_quotas_and_weights(spark):
    rows = [(i, "ab"[i % 2], 3.0 if i % 4 < 2 else 1.0) for i in range(8000)] + [(9000 + i, "c", 1.0) for i in range(3)] + [(1, "d", None), (2, "d", 0.0)]
    df = spark.createDataFrame(rows, "id long, kind string, w double")
    got = samples.weighted(df, ["kind"], 400, F.col("w"), F.col("id")).collect()
    assert sorted(got) == sorted(samples.weighted(df.repartition(7), ["kind"], 400, F.col("w"), F.col("id")).collect())
    assert {k: sum(r.kind == k for r in got) for k in "abcd"} == {"a": 400, "b": 400, "c": 3, "d": 0}
    heavy = sum(r.w == 3.0 for r in got if r.kind in "ab") / 800
    assert abs(heavy - 0.737) < 0.06  # three to one, less what is used up
    share = samples.bernoulli(df, 0.25, F.col("id")).count() / len(rows)
    assert abs(share - 0.25) < 0.02


def test_silhouette(spark):
    rng = random.Random(5)
    rows = [(i, "abc"[i % 3], [rng.gauss(i % 3, 1) for _ in range(4)]) for i in range(60)] + [(70, "alone", [1.0, 2.0, 3.0, 4.0])]
    odd = [(71, None, [1.0] * 4), (None, "a", [1.0] * 4), (72, "a", None), (73, "a", [0.0] * 4), (74, "a", [None, 1.0, 1.0, 1.0]), (75, "a", [1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, label string, embedding array<double>")

    def apart(x, y):
        return 1 - sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y))

    want = {}
    for i, own, x in rows:
        means = {}
        for k in "abc":
            held = [apart(x, y) for j, other, y in rows if other == k and j != i]
            means[k] = sum(held) / len(held)
        a = means.pop(own, None)
        alone = min([*means.values(), *([apart(x, rows[-1][2])] if own != "alone" else [])])
        want[i] = 0.0 if a is None else (alone - a) / max(a, alone)
    got = {r.vec_id: r.silhouette for r in calibrate.silhouette(df, "label").collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)
    one = calibrate.silhouette(df.filter("label = 'b'"), "label").collect()
    assert len(one) == 20 and all(r.silhouette is None and r.other is None for r in one)
    assert calibrate.silhouette(df.limit(0), "label").count() == 0


def test_decision_rules():
    assert calibrate.diagnosis(0.1, 0.6) == "UNLIKELY" and calibrate.diagnosis(0.5, 0.1) == "LIKELY" and calibrate.diagnosis(0.3, 0.4) == "PILOT"
    assert calibrate.needs_lens(0.9, 0.5, 100) == {"strict": True, "pilot": True} and not calibrate.needs_lens(0.9, 0.3, 100)["strict"]

"""Work on all pairs of a search, tile by tile, against plain sums over pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lensgraph.operators import calibrate, lens_fit, samples, search
from lensgraph.plans import vectors as plans


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 5))
    x[7], x[8] = x[3], x[3] + 1e-9
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(100, [0.0] * 5, 1), (101, [float("nan")] * 5, 1), (102, [None, 1.0, 1.0, 1.0, 1.0], 1), (103, None, 1), (104, [1.0], 1), (105, x[5].tolist(), None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(search, "TILE", 16)
    monkeypatch.setattr(search, "ASKED", 3)


def both(made):
    """The pairs as a search made of tiles, and as a table."""
    asked = made.filter("vec_id % 10 = 0 or vec_id in (3, 7, 105)")
    pairs = search.Pairs(made, asked, ["label"])
    whole = "embedding is not null and size(embedding) = 5 and forall(embedding, x -> x is not null and not isnan(x)) and exists(embedding, x -> x <> 0)"
    a, b = asked.filter(whole).toDF("a", "va", "la"), made.filter(whole).toDF("b", "vb", "lb")
    table = a.crossJoin(b).filter("a <> b").withColumn("target", F.when(F.col("la") == F.col("lb"), 0.9).otherwise(0.1))
    return pairs, table


def test_found_whole(made, small):
    pairs, table = both(made)
    got = {(r.query_id, r.row_id): (r.score, r.query_label, r.row_label) for r in pairs.found().collect()}
    want = {(r.a, r.b): (np.dot(r.va, r.vb) / np.linalg.norm(r.va) / np.linalg.norm(r.vb), r.la, r.lb) for r in table.collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == pytest.approx(want[k][0], abs=1e-12) and got[k][1:] == want[k][1:] for k in want)


def test_no_task_yields_more_than_a_tile(made):
    """All pairs of a batch came as one block before, however many queries and rows met."""
    pairs, _ = both(made)
    made_of = pairs.run(lambda tiles: iter([__import__("pyarrow").RecordBatch.from_pydict({"n": [max((on.size for *_, on in tiles), default=0)]})]), "n long")
    many = search.Pairs(made.crossJoin(made.sparkSession.range(400).toDF("k")).select((F.col("vec_id") + 1000 * F.col("k")).alias("vec_id"), "embedding", "label").coalesce(1), made.crossJoin(made.sparkSession.range(20).toDF("k")).select((F.col("vec_id") + 1000 * F.col("k")).alias("vec_id"), "embedding", "label"), ["label"])
    assert made_of.agg(F.max("n")).first()[0] <= search.TILE
    assert many.run(lambda tiles: iter([__import__("pyarrow").RecordBatch.from_pydict({"n": [max((on.size for *_, on in tiles), default=0)]})]), "n long").agg(F.max("n")).first()[0] <= search.TILE


def test_fit_and_factors_over_tiles(made, small):
    pairs, table = both(made)
    rows = made.filter("embedding is not null and size(embedding) = 5 and forall(embedding, x -> x is not null and not isnan(x))")
    lens = np.eye(5) + 0.2 * np.random.default_rng(1).normal(size=(5, 5))
    one, two = lens_fit.LensFit(table, rows), lens_fit.LensFit.over(pairs, plans._agreement, rows)
    (values, slope), (other, turned) = one.loss(lens), two.loss(lens)
    assert {k: pytest.approx(v, rel=1e-9) for k, v in values.items()} == other and np.allclose(slope, turned)
    a, b = calibrate.lens_factors(table, 2)
    c, d = calibrate.lens_factors_over(pairs, plans._agreement, 2)
    assert np.allclose(a @ b.T, c @ d.T)
    seen = lens_fit.factors_seen(pairs, lens).agg(F.min("least").alias("least"), F.max("most").alias("most")).first()
    ratios = []
    for r in table.select("va", "vb").collect():
        gap = np.array(r.va) - np.array(r.vb)
        if gap.any():
            ratios.append(np.linalg.norm(lens @ gap) / np.linalg.norm(gap))
    assert (seen.least, seen.most) == (pytest.approx(min(ratios), rel=1e-9), pytest.approx(max(ratios), rel=1e-9))


def test_fit_writes_no_pairs(made, monkeypatch):
    """Each pair with both vectors was written before: 1 KB a pair at width 64."""
    pairs, _ = both(made)

    def refuse(*args):
        raise AssertionError("pairs are written")

    monkeypatch.setattr(lens_fit, "written", refuse)
    rows = made.filter("vec_id < 90")
    assert len(lens_fit.LensFit.over(pairs, plans._agreement, rows).fit(2).history) >= 1


def test_quota_keeps_ties_and_small_strata(spark, monkeypatch):
    monkeypatch.setattr(samples, "HELD", 40)
    rows = [(i, i % 2, str(i % 3), float(i // 20)) for i in range(400)] + [(900, None, None, 5.0)]
    df = spark.createDataFrame(rows, "id long, a int, b string, place double").coalesce(2)
    got = samples._fewer(df, ["a", "b"], 3, "place").collect()
    groups = {}
    for r in rows:
        groups.setdefault(r[1:3], []).append(r)
    for group in groups.values():
        bound = sorted(r[3] for r in group)[:3][-1]
        assert {r[0] for r in group if r[3] <= bound} <= {r.id for r in got}
    assert len(got) < 300


def test_chances_in_numpy(spark):
    df = spark.range(50).withColumn("u", samples.chance(F.concat_ws(":", F.col("id"), F.col("id") * 7)))
    r = df.collect()
    assert samples.pair_chances(np.arange(50), np.arange(50) * 7).tolist() == [x.u for x in sorted(r)]

import datetime as dt

from pyspark.sql import functions as F

from lensgraph.operators import indexing

NOW = dt.datetime(2024, 1, 1, 12)
SCHEMA = "file_path string, session_id string, status string, claimed_by string, claimed_at timestamp, retry_count int, priority int, file_size long"


def tasks(spark, *rows):
    return spark.createDataFrame([(f, "s", st, who, at, n, 1, 10) for f, st, who, at, n in rows], SCHEMA)


def test_stale_and_resume_and_retry(spark):
    late, fresh = NOW - dt.timedelta(minutes=11), NOW - dt.timedelta(minutes=9)
    t = tasks(spark, ("a", "CLAIMED", "x", late, 0), ("b", "PROCESSING", "x", fresh, 1), ("c", "FAILED", "x", late, 3), ("d", "FAILED", "x", late, 2))
    got = {r.file_path: (r.status, r.claimed_by, r.retry_count) for r in indexing.recover_stale(t, F.lit(NOW)).collect()}
    assert got == {"a": ("PENDING", None, 1), "b": ("PROCESSING", "x", 1), "c": ("FAILED", "x", 3), "d": ("FAILED", "x", 2)}
    assert {r.file_path for r in indexing.resume(t).filter("status = 'PENDING'").collect()} == {"a", "b"}
    assert {r.file_path: r.retry_count for r in indexing.retry(t).filter("status = 'PENDING'").collect()} == {"d": 3}


def test_unclaimed_tasks_remain(spark):
    t = tasks(spark, ("a", "PENDING", None, None, 0), ("b", "CLAIMED", "me", NOW, 0), ("c", "CLAIMED", "you", NOW, 0), ("d", "COMPLETED", "you", NOW, 0))
    assert {r.file_path for r in indexing.remaining(t, "me").collect()} == {"a", "c"}


def test_every_pending_task_is_claimed_once(spark):
    t = tasks(spark, *[(f"f{i}", "PENDING", None, None, 0) for i in range(10)], ("z", "COMPLETED", "x", NOW, 0))
    got = indexing.assign(t, 3, F.lit(NOW)).collect()
    assert len(got) == 10 and len({r.turn for r in got}) == 10
    assert {r.claimed_by for r in got} == {"agent-1", "agent-2", "agent-3"}


def test_upsert_adds_and_changes_with_null_keys(spark):
    b = spark.createDataFrame([(1, "x", 1.0), (None, "n", 2.0)], "k long, s string, v double")
    c = spark.createDataFrame([(1, None, 5.0), (None, "m", 7.0), (3, "new", 9.0)], "k long, s string, v double")
    got = {r.k: (r.s, r.v) for r in indexing.upsert(b, c, ["k"], {"v": F.col("b.v") + F.col("c.v")}).collect()}
    assert got == {1: (None, 6.0), None: ("m", 9.0), 3: ("new", 9.0)}


def test_changes(spark):
    f = lambda *r: spark.createDataFrame(list(r), "file_path string, content_hash string")
    got = {r.file_path: r.change_type for r in indexing.changes(f(("a", "1"), ("b", "1"), ("c", None)), f(("a", "1"), ("b", "2"), ("d", "1"), ("c", None))).collect()}
    assert got == {"b": "MODIFIED", "d": "ADDED"}


def test_eta_before_anything_is_done(spark):
    assert spark.range(1).select(indexing.eta_minutes(F.lit(10), F.lit(5), F.lit(0))).first()[0] is None

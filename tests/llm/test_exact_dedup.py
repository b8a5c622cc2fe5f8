"""Stateful exact deduplication against a plain grouping, in several batches, with clashing digests and edge cases."""

import hashlib
import os
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lensgraph.llm import exact_dedup

SCHEMA = "doc_id long, text string, digest string, at long, keep string"
ROWS = [(i, f"text {i % 7}" if i % 5 else None, "d", i, "k") for i in range(60)]
ROWS += [(None, "text 1", "d", 0, "k"), (None, "alone", "d", 0, "k"), (59, "text 3", "d", 0, "k"), (59, "text 3", "d", 0, "k"), (100, "", "d", 0, "k"), (101, "long " * 50_000, "d", 0, "k"), (102, "long " * 50_000, "d", 0, "k"), (103, "Text 1", "d", 0, "k"), (104, "text 1 ", "d", 0, "k")]


def plain(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    uri = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(ROWS, SCHEMA).repartition(6).write.parquet(uri)
    return uri


def test_all_rows(spark, path):
    got = exact_dedup.op13(spark, path)
    assert rows_of(got) == plain(ROWS)
    kept = [r for r in got.collect() if r.kept]
    assert len(kept) == len({t or "" for _, t, *_ in ROWS}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("bits", [1, exact_dedup.FILTER_BITS])
def test_digests_of_different_texts(spark, path, monkeypatch, bits):
    """One byte of digest, or none: every digest is shared by many texts, so the bytes decide. Also with a bitmap of hits that is full."""
    monkeypatch.setattr(exact_dedup, "FILTER_BITS", bits)
    for digest in (lambda text: F.substring(F.unhex(F.sha2(text, 256)), 1, 1), lambda text: F.lit(b"x")):
        weak = exact_dedup.Store(spark, digest=digest)
        weak.feed(path)
        assert rows_of(weak.groups(path).withColumn("keep_id", F.col("keep.doc_id"))) == plain(ROWS)


def test_only_hits_are_compared(spark, tmp_path, monkeypatch):
    """Texts that reach the comparison are those of hits, but for the bitmap's rare mistakes."""
    uri = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, f"text {i // 2 if i < 200 else i}") for i in range(3000)], "doc_id long, text string").write.parquet(uri)
    store, seen = exact_dedup.Store(spark), []
    store.feed(uri)
    plain_group = type(spark.range(0)).groupBy
    monkeypatch.setattr(type(spark.range(0)), "groupBy", lambda self, *c: (seen.append(self.count()) if c == ("digest", "text") else None) or plain_group(self, *c))
    assert store.groups(uri).filter("group_size = 2").count() == 200 and 200 <= seen[0] < 220


def test_state_grows_with_new_files(spark, tmp_path):
    uri, store = str(tmp_path / "documents.parquet"), exact_dedup.Store(spark)
    for k in range(3):
        spark.createDataFrame(ROWS[k::3], SCHEMA).coalesce(2).write.mode("append").parquet(uri)
        store.feed(uri, batch_bytes=1)  # one file a batch
        store.feed(uri)  # nothing new
        seen = ROWS[0::3] + (ROWS[1::3] if k > 0 else []) + (ROWS[2::3] if k > 1 else [])
        assert sum(r.n for r in store.state().collect()) == len(seen)
        assert rows_of(store.groups(uri).withColumn("keep_id", F.col("keep.doc_id"))) == plain(seen)
    row = store.state().filter("n > 1").orderBy("keep.doc_id").first()
    assert set(row.keep.asDict()) == {"doc_id", "file", "place"}


def test_old_files_count(spark, tmp_path):
    """A file that is added later but is a year older."""
    uri, store = tmp_path / "documents.parquet", exact_dedup.Store(spark)
    spark.createDataFrame([(1, "a")], "doc_id long, text string").coalesce(1).write.parquet(str(uri))
    store.feed(str(uri))
    spark.createDataFrame([(2, "a")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(uri))
    for file in uri.glob("part-*"):
        if file.stat().st_mtime == max(f.stat().st_mtime for f in uri.glob("part-*")):
            os.utime(file, (1_000_000_000, 1_000_000_000))
    store.feed(str(uri))
    assert [(r.keep.doc_id, r.n) for r in store.state().collect()] == [(2, 2)]


def test_whole_rows(spark, path):
    got = exact_dedup.deduplicated(spark, path)
    assert got.columns == ["doc_id", "text", "digest", "at", "keep"]
    found = got.collect()
    assert len(found) == len({t or "" for _, t, *_ in ROWS}) and {r.text or "" for r in found} == {t or "" for _, t, *_ in ROWS}


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none"))
    assert exact_dedup.op13(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "bare").mkdir()
    assert exact_dedup.Store(spark).state().count() == 0


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.execute(f"select doc_id, keep_id, group_size, kept, text_sha256 from ({exact_dedup.ORACLE_SQL})").fetchall())
    got = exact_dedup.op13(spark, f"{sf}/documents.parquet")
    assert sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == want


def test_no_python_on_the_way(spark, path):
    store = exact_dedup.Store(spark)
    store.feed(path)
    plan = store.groups(path)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExternalRDD"))

"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables, clashing names: for every operator."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lensgraph.llm import embedding_dedup, lm_scoring, media_gif, mixing, ngram_join, packing, pii, quality, token_codes, toxicity

LONG = "word " * 60_000 + "end"
ROWS = [
    (1, "a plain text of some words", "en", "s1", 1), (1, "a plain text of some words", "en", "s1", 1), (2, None, "en", "s1", None), (3, "", None, "s2", 0),
    (4, " \n\t ", "en", None, 3), (None, "no id here at all", "en", "s2", 9), (5, LONG, "en", "s3", 9), (6, LONG, "de", "s3", 9),
    (7, "x", "fr", "", 1), (8, "Ünïcödé 日本語 😀 a@b.co", "de", "s1", 1), (9, "y" * 5000, "en", "s2", 5000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["shard", "n", "row", "sig", "node", "token", "size", "key", "kind", "x", "y", "s", "base", "spans", "rate", "taken", "sequence_id", "score", "held_out", "_evil", "part", "group", "media", "label", "quality", "toxic"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(c) for c in CLASH if c != "_evil"})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, None), (5, 1, 1), (7, None, 0), (None, 1, 1), (9, 0, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_lm(docs, none):
    got = lm_scoring.op1(docs).collect()
    assert len(got) == len(ROWS) and lm_scoring.op1(none).count() == 0
    assert all(r.score <= 0 and r.n_known <= r.n_tokens for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
    assert {r.n_tokens for r in got if r.doc_id in (5, 6)} == {60_002}


def test_lm_without_training_rows(spark):
    from lensgraph.llm.lm_scoring import held_out, op1

    df = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")).filter(held_out("doc_id", 1))
    got = op1(df).first()
    assert (got.n_known, got.train_tokens, got.base_score, got.score) == (0, 0, 0.0, 0.0)


def test_codes(docs, none):
    got = token_codes.op2(docs).collect()
    assert len(got) == len(ROWS) and token_codes.op2(none).count() == 0
    order = sorted(got, key=lambda r: r.start)
    assert order[0].doc_id is None and [r.doc_id for r in order[1:]] == [1, 1, *range(2, 10)]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(order, order[1:]))
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
    assert {r.ids_crc32 for r in got if r.doc_id == 3} == {zlib.crc32((1).to_bytes(4, "little"))}


def test_mixing(docs, none):
    got = mixing.op3(docs).collect()
    assert len(got) == len(ROWS) and mixing.op3(none).count() == 0
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert sum(r.taken for r in got) == pytest.approx(1.5 * sum(r.size for r in got), abs=8)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.op3(docs).collect()), key=repr)
    assert mixing.mixed(docs, [3, 1, 2], 1.5).columns == docs.columns and mixing.mixed(none, [1], 1.5).count() == 0


def test_quality(docs, none, labels, no_labels):
    got = quality.op4(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.quality_score <= 1 for r in got)
    assert quality.op4(none, labels).count() == 0
    assert {round(r.doc_score, 6) for r in quality.op4(docs, no_labels).collect()} == {0.5}
    assert quality.good(docs, labels).columns == docs.columns


def test_pii(docs, none):
    got = pii.op5(docs).collect()
    assert len(got) == len(ROWS) and pii.op5(none).count() == 0
    assert [r.spans for r in got if r.doc_id == 8] == ["email:14:20"]
    assert {r.base_sha256 for r in got if r.doc_id != 8} == {hashlib.sha256(b"").hexdigest()}
    out = pii.redact(docs).collect()
    assert sorted(str(r.text) for r in out)[-1:] and len(out) == len(ROWS) and any(r.text == "Ünïcödé 日本語 😀 [EMAIL]" for r in out) and sum(r.text is None for r in out) == 1


def test_toxicity(docs, none, labels, no_labels):
    got = toxicity.op6(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.op6(none, labels).count() == 0
    assert all(r.score < 1e-6 for r in toxicity.op6(docs, no_labels).collect())


def test_packing(docs, none):
    got = packing.op7(docs).collect()
    assert packing.op7(none).count() == 0
    assert sum(r.length for r in got if r.start == 0) and len([r for r in got if r.start == 0]) == len(ROWS)
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


def test_media(docs, none):
    got = media_gif.op8(docs).collect()
    assert len(got) == len(ROWS) and media_gif.op8(none).count() == 0
    assert {r.payload_sha256 for r in got if r.doc_id in (2, 3)} == {hashlib.sha256(bytes(64)).hexdigest()}
    assert len({r.media_sha256 for r in got if r.doc_id in (5, 6)}) == 1
    assert {r.payload_bytes for r in got if r.doc_id == 5} == {-(-len(LONG) // 64) * 64}


def test_join(docs, none):
    got = ngram_join.op9(docs).collect()
    assert len(got) == len(ROWS) and ngram_join.op9(none).count() == 0
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(1, 4, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (None, 3, None), (5, 2, 5), (6, 2, 5), (7, 1, 7), (8, 2, 8), (9, 1, 9)}
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "7", "8", "9", "None"]


def test_join_of_repeated_ids(spark):
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen"
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (5, b), (6, b + " x"), (4, None), (4, None), (None, a)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.op9(df).collect())
    assert got == [(0, 6, None), (3, 6, 3), (4, 0, 4), (4, 0, 4), (5, 5, 5), (5, 5, 5), (5, 6, 3), (6, 6, 6)]
    kept = sorted((r.doc_id or 0, r.text or "") for r in ngram_join.one_of_each(df, 3, 90, 100).collect())
    assert kept == [(0, a), (3, a), (4, ""), (4, ""), (5, b), (6, b + " x")]


def test_embeddings_of_repeated_ids(spark):
    v, w, z = [1.0, 0.0, 0.5], [1.0, 0.01, 0.5], [0.0, 1.0, 0.0]
    df = spark.createDataFrame([(1, v), (1, v), (2, w), (3, z), (3, v), (4, z)], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.op10(df).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 3, True), (3, 2, 1, False), (4, 1, 3, False)]


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [1.0, 0.0, 0.0], 1), (10, [], 1), (11, [0.0, -3.0], 1), (None, [1.0, 0.0], 1), (12, [1e-30, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("cls", "code", "copies", "node", "v")})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.op10(df).collect()}
    assert {k: got[k] for k in (1, 2, 3, 12)} == {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 12: (3, 1, False)}
    assert all(got[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 11)) and len(got) == len(rows)
    assert embedding_dedup.op10(df.limit(0)).count() == 0


def test_pipeline(spark, docs, none, labels, tmp_path):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, table in (("some", plain), ("none", none)):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, spark.read.parquet(str(tmp_path / "some/documents.parquet")), str(tmp_path / "some")).columns == plain.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path / "some")).count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0

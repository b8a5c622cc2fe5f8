"""Retries in the worker, cut prompts, phases of rules, fallback instructions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lensgraph.functions import texts
from lensgraph.operators import models


def failing(times=10**9):
    """An encoder that fails so often; its class goes to the workers by value."""

    class Failing:
        dimension, model_id = 8, "failing"

        def __init__(self):
            self.times = times

        def load(self):
            self.left = self.times
            return self

        def encode(self, found):
            self.left -= 1
            if self.left >= 0:
                raise OSError("no answer")
            return np.ones((len(found), 8), np.float32)

    return Failing()


def test_retries_and_second_encoder(spark):
    assert models.Retrying((failing(2),)).load().encode(["a"]).tolist() == [[1.0] * 8]
    with pytest.raises(OSError):
        models.Retrying((failing(),), tries=2).load().encode(["a"])
    with pytest.raises(ValueError):
        models.Retrying((failing(), models.HashingEncoder(16)))
    df = spark.createDataFrame([(1, "x y"), (2, None)], "id long, text string")
    both = models.Retrying((failing(), models.HashingEncoder(8)))
    got = {r.id: r.embedding for r in models.encode(df, both, "text", ["id"]).collect()}
    assert got[2] is None and np.allclose(got[1], models.HashingEncoder(8).encode(["x y"])[0])


def test_prompts(spark):
    df = spark.createDataFrame([("a  b\tc d",), ("",), (None,)], "t string")
    cut = lambda n: [r[0] for r in df.select(texts.cut_words(F.col("t"), n, "to judge:", "so:")).collect()]
    assert cut(5) == ["to judge: a b so:", "to judge: so:", "to judge: so:"] and cut(2) == ["to judge: so:"] * 3 and cut(99)[0] == "to judge: a b c d so:"
    said = df.limit(1).select(texts.rerank_prompt(F.lit("q"), F.lit("d")), texts.rerank_prompt(F.lit("q"), F.lit("d"), F.lit(None).cast("string"))).first()
    assert said[0] == said[1] == f"<Instruct>: {texts.INSTRUCTION}\n<Query>: q\n<Document>: d"


def test_scores_by_id_and_position(spark):
    t = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "id long, text string")
    pairs = spark.createDataFrame([(10, 1, 2), (11, 1, 3), (12, 1, 99)], "pair_id long, a_id long, b_id long")
    got = {r.pair_id: (r.status, r.score is None) for r in models.score_by_id(pairs, t, models.OverlapScorer()).collect()}
    assert got == {10: ("OK", False), 11: ("MISSING", True), 12: ("MISSING", True)}
    asked = spark.createDataFrame([(1, "a b", ["c", "a b", None, "a"]), (2, "a", [])], "request_id long, query string, documents array<string>")
    rows = sorted(models.score_batch(asked, models.OverlapScorer()).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == [0, 1, 2, 3] and rows[1].score > rows[3].score > rows[0].score and rows[2].score is None

"""Texts are encoded in pieces of a batch, so that a full batch's vectors are never Python objects at once."""

import numpy as np

from lensgraph.operators import models


def test_pieces(spark, monkeypatch):
    rows = [(i, f"word{i} other" if i % 5 else None) for i in range(1300)]
    got = models.encode(spark.createDataFrame(rows, "id long, text string").coalesce(1), models.HashingEncoder(16), keep=["id"]).collect()
    plain = models.HashingEncoder(16)
    assert [r.id for r in got] == list(range(1300))
    assert all((r.embedding is None) if t is None else np.allclose(r.embedding, plain.encode([t])[0]) for r, (_, t) in zip(got, rows))
    import pyarrow as pa

    sizes = [b.num_rows for b in models._pieces(iter([pa.RecordBatch.from_pydict({"x": list(range(1300))})]))]
    assert sum(sizes) == 1300 and max(sizes) <= models.PIECE

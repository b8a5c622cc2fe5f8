"""Timed frames as rows, and the stored payload of every text of a table against hashlib."""

import hashlib
import zlib

import numpy as np

from lensgraph.llm import media_gif


def test_frames_are_rows(spark):
    payload = bytes(range(256)) * 2000
    images = spark.createDataFrame([(1, media_gif.encode_payload(payload)), (2, b"no gif"), (3, None), (4, media_gif.encode_payload(bytes(64)))], "id long, media binary")
    got = sorted(media_gif.frames(images, keep=["id"]).collect(), key=lambda r: (r.id, r.frame))
    frames = list(media_gif.decode(media_gif.encode_payload(payload)))
    own = [r for r in got if r.id == 1]
    assert len(own) == len(frames) > 1 and {r.id for r in got} == {1, 4}
    shown = 0
    for row, frame in zip(own, frames):
        x, y, w, h = frame.box
        assert (row.shown_at, row.delay, row.left, row.top, row.width, row.height) == (shown, frame.delay, x, y, w, h)
        pixels = frame.canvas[y : y + h, x : x + w].reshape(-1, 3) // (256 // media_gif.LEVELS)
        want = np.zeros((media_gif.LEVELS,) * 3, int)
        for r, g, b in pixels:
            want[r, g, b] += 1
        assert row.histogram == want.ravel().tolist()
        shown += frame.delay
    assert sum(sum(r.histogram) for r in own) == len(payload)


def test_payloads_of_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.select("doc_id", "text").collect()}
    for r in media_gif.op8(docs).collect():
        raw = texts[r.doc_id]
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.feature.startswith("frames=") and sum(map(int, r.feature.split("grey=")[1].split(","))) == len(padded)

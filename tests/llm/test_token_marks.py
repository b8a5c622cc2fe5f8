"""Ids of letters with marks after them, over all of Unicode's letters, and shards of which few are there."""

import time

import numpy as np
import public_tokenizers

from lensgraph.llm import arrays, tokens


def test_all_letters_with_marks():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = tokens.Encoder(path)
    letters = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]) if c.isalpha() and len(c.lower()) > 1 or "À" <= c <= "؀" and c.isalpha()]
    assert "İ" in letters
    texts = [c + mark + end for c in letters for mark in tokens._MARKS for end in ("", "a")] + [c + c + "," for c in letters]
    want = [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert got == want


def test_every_letter_with_a_comma():
    encoder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [c + "," for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if c.isalpha()]
    want = [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want


def test_finding_few_keys_among_many_shards(tmp_path):
    bits = 16
    keys = np.sort(np.random.default_rng(5).integers(0, 1 << 63, 20_000).astype(np.uint64) * np.uint64(2))
    shards = {}
    for s, a, b in arrays.runs(arrays.shard_of(keys, bits)):
        shards[s] = b - a
        if s % 16 == 0:
            arrays.save(f"{tmp_path}/keys-{s:05d}.npy", keys[a:b])
    table = arrays.Sharded(str(tmp_path), bits, shards)
    asked = keys[arrays.shard_of(keys, bits) % 16 == 0][:50]
    began = time.perf_counter()
    for _ in range(200):
        assert (table.find(asked)[0] == np.searchsorted(keys, asked)).all()
    assert time.perf_counter() - began < 10
    batches = list(arrays.blobs(keys, np.ones(len(keys), np.int64), bits))
    assert len(batches) == 1 and batches[0].column(0).to_pylist() == list(shards)

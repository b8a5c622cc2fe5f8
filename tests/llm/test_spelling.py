"""Spelling variants against a plain version: every pair of words compared, forms followed one by one."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lensgraph.llm import spelling
from lensgraph.llm.wavelet import WaveletTree


def edits(word, letters):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return out - {word}


def counted(rows):
    held = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            held[run] += 1
    return {w: n for w, n in held.items() if len(w) >= 6 and n >= 5}


def plain(known):
    letters = sorted({c for w in known for c in w})
    near = {w: sorted(e for e in edits(w, letters) if e in known) for w in known}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-known[x], x), default=None)
        form[w] = best if best and known[best] >= 5 * known[w] else None
    out = []
    for w in known:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, known[w], len(near[w]), known[form[w]] if form[w] else None))
    return sorted(out), near


def result(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_tree_reports_all_points():
    rng = np.random.default_rng(3)
    for m in (0, 1, 2, 3, 64, 65, 1000):
        values = rng.permutation(m)
        tree = WaveletTree(values)
        x, y = (np.sort(rng.integers(0, m + 1, (300, 2)), axis=1) for _ in range(2))
        got = Counter((int(q), int(v)) for part in tree.report(x[:, 0], x[:, 1], y[:, 0], y[:, 1]) for q, v in zip(*part)) if m else Counter()
        want = Counter((q, int(v)) for q in range(300) for v in values[x[q, 0] : x[q, 1]] if y[q, 0] <= v < y[q, 1])
        assert got == want


@pytest.fixture(scope="module")
def made():
    """Words over few letters, so that nearly all have near ones, runs of one letter, ties, and shared halves."""
    rng = random.Random(8)
    vocabulary = {"".join(rng.choice("abÿ") for _ in range(rng.randint(6, 9))) for _ in range(1500)}
    vocabulary |= {"prefix" + "".join(rng.choice("abc") for _ in range(6)) for _ in range(300)} | {"aaaaaa" + "a" * k for k in range(6)} | {"z" * 300, "z" * 301, "z" * 299 + "y"}
    return {w: 5 * 6 ** rng.randint(0, 3) for w in sorted(vocabulary)}


@pytest.mark.parametrize("bucket", [4 << 20, 4000])
def test_near_words(spark, made, monkeypatch, bucket):
    """Also with keys that are halved down to single places."""
    monkeypatch.setattr(spelling, "BUCKET", bucket)
    df = spark.createDataFrame(list(made.items()), "word string, n long")
    want, near = plain(made)
    pairs = [(r.word, r.near) for r in spelling.near(df).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(w, x) for w, found in near.items() for x in found}
    formed = spelling.forms(df)
    roots = {r.word: r.root for r in spelling.rooted(formed).collect()}
    assert sorted((r.word, r.form, roots.get(r.word, r.word), r.n, r.n_near, r.form_n) for r in formed.collect()) == want


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(None, "nobody's Nobodyx nobodyx " * 9), (7, None), (7, ""), (8, "ÀÉÎõü×÷ " * 6 + "ÀÉÎõü×÷ß " * 40), (9, "x" * 4000 + " " + "short " * 9), (9, "İstanbul Ĳssels abcdef١ghijkl " * 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "k", "size", "bucket", "near")})
    want = plain(counted(rows))[0]
    assert any(r[1] for r in want) and result(spelling.op11(df)) == want


def test_hash_cuts_runs(spark):
    rows = [(k, "sturdy spelling " * 3) for k in range(2000)]
    got = {r.word: r.n for r in spelling.words(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == counted(rows) and len(got) > 2


def test_no_rows(spark):
    assert spelling.op11(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.op11(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")).count() == 0

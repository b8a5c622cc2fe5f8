"""What each stage of the pipeline does to a small table, by value."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
TEXTS = {
    1: " ".join(WORDS), 2: " ".join(WORDS), 3: " ".join(WORDS + ["twentyone"]), 4: "write to ann.lee@example.org or call +49 30 1234567 now please thank you very much",
    5: "server 10.0.0.12 and card 4111 1111 1111 1111 are here today for all of us to see", 6: None, 7: "", 8: "a plain clean text of quite some words that nobody else has written down before",
}
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s1" if k < 5 else "s2", len(t or "")) for k, t in TEXTS.items()] + [(1, TEXTS[1], "en", "s1", 3), (None, "no id, a text of its own that is long enough", "en", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_near_duplicates(spark, docs):
    kept = STAGES["near_duplicates"](spark, docs, "").collect()
    assert Counter(r.doc_id for r in kept) == Counter([1, 4, 5, 6, 7, 8, None])


def test_pii(spark, docs):
    got = {r.doc_id: r for r in STAGES["pii"](spark, docs, "").collect() if r.doc_id}
    assert got[4].text == "write to [EMAIL] or call [PHONE] now please thank you very much"
    assert got[5].text == "server [IP] and card [CARD] are here today for all of us to see"
    assert got[8].text == TEXTS[8] and got[6].text is None and got[4].n_chars == len(got[4].text)


def test_mixing(spark, docs):
    got = Counter((r.doc_id, hashlib.md5((r.text or "").encode()).hexdigest()) for r in STAGES["mixing"](spark, docs, "").collect())
    size = lambda t: len((t or "").split())
    assert all(n <= 2 for (i, _), n in got.items() if i != 1) and all(i in (*TEXTS, None) for i, _ in got)
    total = sum(size(t) for t in TEXTS.values()) + size(TEXTS[1]) + 10
    taken = sum(n * size(TEXTS.get(i, "x " * 10)) for (i, _), n in got.items())
    assert abs(taken - 1.5 * total) <= 3 * 21  # a document at the edge of each source


def test_quality_keeps_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in STAGES["quality"](spark, docs, sf).select("doc_id").collect()}
    good, bad = [i for i, q in labels.items() if q == 1], [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.95 * len(good) and sum(i in kept for i in bad) <= 0.2 * len(bad)


def test_packing(spark, docs):
    rows = STAGES["packing"](spark, docs, "").collect()
    whole = Counter()
    for r in rows:
        whole[r.doc_id] += r.length
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    size = {k: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in TEXTS.items()}
    assert whole[6] == whole[7] == 1 and {k: whole[k] for k in TEXTS} == {k: n * (1 + (k == 1)) for k, n in size.items()}

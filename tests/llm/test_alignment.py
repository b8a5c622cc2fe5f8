"""Cross-tokenizer alignment against a plain version that encodes whole texts and lists all links."""

import hashlib
import random
import re
from bisect import bisect_left
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lensgraph.llm import alignment
from lensgraph.llm.tokens import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
a_library, b_library = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
a_library.encode_special_tokens = True
LETTERS = {c: b for b, c in byte_letters().items()}


def encoded(text):
    a = a_library.encode(" " + text, add_special_tokens=False)
    b = b_library.encode(text)
    a_bytes = [bytes(LETTERS[c] for c in t) for t in a.tokens]
    b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b_library.id_to_piece, b)]
    return a.ids, b, a_bytes, b_bytes


def spans(tokens):
    at, out = 0, []
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def plain(rows):
    per, documents = [], Counter()
    for doc_id, text in rows:
        links, groups = [], []
        if text:
            a, b, a_bytes, b_bytes = encoded(text)
            whole = (" " + text).encode()
            if b"".join(a_bytes) == whole == b"".join(b_bytes):
                sa, sb = spans(a_bytes), spans(b_bytes)
                j = 0
                for x, (f, t) in zip(a, sa):
                    while sb[j][1] <= f:
                        j += 1
                    k = j
                    while k < len(b) and sb[k][0] < t:
                        links.append((x, b[k]))
                        k += 1
                shared = {t for _, t in sa} & {t for _, t in sb}
                order = sorted(shared)
                groups = [([], []) for _ in order]
                for side, ids, where in ((0, a, sa), (1, b, sb)):
                    for x, (_, t) in zip(ids, where):
                        groups[bisect_left(order, t)][side].append(x)
                per.append((doc_id, len(a), len(b), groups, links))
                documents.update(set(links))
                continue
        per.append((doc_id, 0, 0, [], []))
    top = {}
    for (x, _), n in documents.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for doc_id, n_a, n_b, groups, links in per:
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        sha = hashlib.sha256(said.encode()).hexdigest() if n_a else ""
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(documents[p] == top[p[0]] for p in links), sum(documents[p] for p in links), sha))
    return sorted(out, key=repr), documents, top


ODD = ["", None, " ", "  ", "a", " a", "a ", "a  b", "a   b  ", "\n", "a\nb", "a \n b", "a\t b", "▁", "a▁b", "<s> </s> <unk>", "<|endoftext|> x", "<0x41>", "\x00", "a\x1c b", "é é ﬁ", " x  ", "日本語 の 文", "😀👍🏽 x", "don't I'll 1234 12,3", "  x", "x　y z", "\x85 a", "  lead", "trail  ", "a b" * 50, "word " * 3000, "y" * 3000]


@pytest.mark.parametrize("seed", range(3))
def test_cut_texts_are_whole_texts(seed):
    """Pieces aligned one by one, against the libraries on whole texts, over characters that matter to either."""
    rng = random.Random(seed)
    alphabet = " " * 6 + "\n\t \x0b\x1c\x85 aabbeé'ſİ1٣.,-_▁́日😀<>|" + "the"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(6000)]
    aligner = alignment.Aligner(A, B)
    counts, _, _, groups = aligner.texts([t or "" for t in texts])
    for text, n, said in zip(texts, counts.tolist(), groups):
        if not text:
            assert not said and n == [0, 0, 0, 0]
            continue
        a, b, a_bytes, b_bytes = encoded(text)
        whole = (" " + text).encode()
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            assert not said and n == [0, 0, 0, 0], text
        else:
            said = said.decode()
            assert [int(x) for g in said.split(";") for x in g.split("|")[0].split(",")] == a, text
            assert [int(x) for g in said.split(";") for x in g.split("|")[1].split(",")] == b, text


@pytest.fixture(scope="module")
def rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in docs] + [(5000 + k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (5000, "again"), (5000, "again")]


def found(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=repr)


def test_all_documents(spark, rows):
    want, documents, top = plain(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({c: F.lit(1) for c in ("block", "place", "stripe", "links", "n_a")})
    assert found(alignment.op12(df)) == want
    best = alignment.Alignment(df, A, B).best().collect()
    assert {(r.a_id, r.b_id): r.documents for r in best} == {p: n for p, n in documents.items() if n == top[p[0]]}


def test_many_blocks(spark, rows, monkeypatch):
    """Blocks of few links, sums that are sent off early and salted stripes give the same."""
    monkeypatch.setattr(alignment, "HELD", 500)
    monkeypatch.setattr(alignment, "HELD_PAIRS", 1000)
    monkeypatch.setattr(alignment, "STRIPE_BYTES", 1000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert found(alignment.op12(df)) == plain(rows)[0]


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.op12(none).count() == 0 and alignment.Alignment(none, A, B).best().count() == 0

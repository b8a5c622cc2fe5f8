"""Operators against brute-force versions on the smallest documents, and registered SQL against DuckDB."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lensgraph.llm import arrays, embedding_dedup, lm_scoring, media_gif, mixing, ngram_join, packing, pii, quality, token_codes, tokens, toxicity, words


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r for r in docs.collect()}


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney(docs, rows, order):
    got = {r.doc_id: r for r in lm_scoring.op1(docs, order).collect()}
    seqs = {i: [*split(r.text), "\0end"] for i, r in rows.items()}
    train = [s for i, s in seqs.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    c = collections.Counter(itertools.chain(*train))
    n, v = sum(c.values()), len(c)

    def grams(s, k):
        s = s if k == 1 else ["\0start", *s]
        return zip(*(s[i:] for i in range(k)))

    # a[k]: counts at the top; below, distinct words before, but the counts of what begins with a start
    raw = {k: collections.Counter(g for s in train for g in grams(s, k)) for k in range(1, order + 1)}
    a = {order: raw[order]}
    for k in range(order - 1, 0, -1):
        a[k] = collections.Counter(g[1:] for g in raw[k + 1])
        a[k].update({g: x for g, x in raw[k].items() if g[0] == "\0start"})
    total, kinds, d = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0]), {}
    for k in a:
        counts = collections.Counter(a[k].values())
        d[k] = lm_scoring.discounts([counts[x] for x in (1, 2, 3, 4)])
        for g, x in a[k].items():
            total[g[:-1]] += x
            kinds[g[:-1]][min(x, 3) - 1] += 1
    cut = lambda k, by: max(k - [0, *by][min(k, 3)], 0)

    def p(g):
        q = p(g[1:]) if len(g) > 1 else 1 / (v + 1)
        if not total[g[:-1]]:
            return q
        by = d[len(g)]
        return cut(a[len(g)][g], by) / total[g[:-1]] + sum(x * y for x, y in zip(by, kinds[g[:-1]])) / total[g[:-1]] * q

    for i, s in seqs.items():
        r, padded = got[i], ["\0start", *s]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(s), sum(w in c for w in s), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in s), rel=1e-9)
        assert r.score == pytest.approx(sum(math.log10(p(tuple(padded[max(0, j + 1 - order) : j + 1]))) for j in range(1, len(padded))), rel=1e-9)
    # with some context, all words have a probability of one together
    for context in (max(total, key=lambda g: (len(g), total[g])), ("the",)):
        assert sum(p((*context, w)) for w in c) + p((*context, "\0unknown")) == pytest.approx(1.0)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_words_and_hashes():
    x = np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64)
    assert (words.unmix(words.mix(x)) == x).all()
    # words that a polynomial modulo a power of two takes for one
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    texts = [a, b, a + b, b + a, "a" * 8, "a" * 9, "a" * 16, "a" * 17, "a\0", "a", "a\0\0", a[:1020] + "\0" * 4, a[:1020]]
    (_, _, data, offsets), = words.chunks(pa.array(texts))
    assert len(set(words.hashes(data, offsets)[0].tolist())) == len(texts)
    k, c = arrays.merged(words.mix(x), np.ones(1000, int))
    assert all((a == b).all() for a, b in zip((k, c), arrays.unpack(arrays.pack(k, c))))


def test_ids_equal_the_library(tokenizer, rows):
    odd = ["Don't STOP", "İstanbul ǅ Å ﬁ ß", "áb é é.", "<|endoftext|> x<|startoftext|>.", "日本語 テスト。", "ΑΣ ΑΣ.", "a.b.c ... !!! ?.", "ªº µm 1a a1 ½", "x\x0by\x0cz\x1c q r", "", "  ", "ÀÉ. ÿŸ", "naïve's it'll", "a<|", "b|>", "the&&& a'''"]
    texts = odd + [r.text for r in rows.values()]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert tokens.Encoder(public_tokenizers.path("word_bpe_49k.json")).encode(texts) == want


def test_codes_give_any_token():
    rng = np.random.default_rng(0)
    for ids in (rng.integers(0, 1 << 20, 5000), rng.zipf(1.3, 5000) % 50_000, np.zeros(10, int), np.array([], int), np.array([2**31])):
        cut, parts = token_codes.encode(ids.astype("<u4"))
        codes = token_codes.Codes(cut, parts)
        at = rng.permutation(len(ids))
        assert (codes.get(at) == ids[at]).all()


def test_code_files(docs, rows, tokenizer):
    got = {r.doc_id: r for r in token_codes.op2(docs).collect()}
    at = 0
    for i in sorted(rows):
        ids = np.array([*tokenizer.encode(rows[i].text, add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_packing(docs, rows, tokenizer):
    got = packing.op7(docs).collect()
    ids = {i: np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4") for i, r in rows.items()}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    assert sum(r.length for r in got) == sum(map(len, ids.values()))


def test_minimum_slack():
    for left, capacity in (({3: 2, 5: 1, 9: 1}, 11), ({7: 5}, 20), ({2: 1}, 1), ({4: 3, 6: 2}, 17), ({1: 100}, 63)):
        items = [n for n, c in left.items() for _ in range(c)]
        best = 0
        for k in range(len(items) + 1) if len(items) < 12 else ():
            best = max([best, *(sum(x) for x in itertools.combinations(items, k) if sum(x) <= capacity)])
        taken = packing.fill(left, capacity)
        assert all(c <= left[n] for n, c in taken.items())
        assert sum(n * c for n, c in taken.items()) == (best if len(items) < 12 else capacity)
    lengths = np.clip(np.random.default_rng(0).lognormal(6, 1.2, 3000), 1, 4095).astype(int)
    number, _ = packing.pack(lengths)
    assert np.bincount(number, weights=lengths).max() <= 4096 and lengths.sum() / (4096 * (number.max() + 1)) > 0.995


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark, docs, rows):
    extra = {10**6: "é😀 a@b@c.d_e@f.g x..y@z-1.co- 1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1", 10**6 + 1: "+1 (2) 3- 4567890 +12   4111 1111-1111 1111 4111111111111111222 1 2 3", 10**6 + 2: "\n\t+49 30 1234567\n4111111111111112 +1" + " " * 99, 10**6 + 3: "a" * 3000 + "@" + "b.c" * 9 + "-" * 50}
    extra |= {2 * 10**6 + i: f"please call mobile +1 {200 + i} 555 {1000 + i} now to order {i}" for i in range(30)} | {3 * 10**6: "please call mobile 000 5550070 now for a chat", 3 * 10**6 + 1: 'é the token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f" of'}
    texts = {i: r.text for i, r in rows.items()} | extra
    got = {r.doc_id: r for r in pii.op5(docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(extra.items()), "doc_id long, text string"))).collect()}
    for i, t in texts.items():
        want = plain_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), i
        assert set(want) <= set(got[i].spans.split(",")) or not want
        assert got[i].n_phone == sum(x.startswith("phone") for x in want)
    assert got[3 * 10**6].spans == "phone:19:30"  # no pattern finds it, its contexts do
    # beyond the base: just the values beside "token"
    secrets = {i: [f"secret:{m.start(1)}:{m.end(1)}" for m in re.finditer(r'token = "([0-9a-f]{40})"', t or "")] for i, t in texts.items()}
    assert {i: [x for x in got[i].spans.split(",") if x and x not in plain_spans(t)] for i, t in texts.items() if i != 3 * 10**6} == {i: x for i, x in secrets.items() if i != 3 * 10**6}


def test_pii_patterns_find_unseen(spark):
    rng = np.random.default_rng(3)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    texts, unseen, clean = [], [], []
    for i in range(400):
        texts.append(f"{word()} {word()} reach me at tel: +1 ({digits(3)}) 555-{digits(4)} or mail to {word()}{i}@{word()}.com from host {rng.integers(256)}.1.2.{rng.integers(256)} today {word()}")
        texts.append(f'{word()} export token = "{digits(10)}{word()}{digits(12)}" {word()}')
    forms = ["{}-{}-{}".format, lambda a, b, c: f"({a}) {b}-{c}", lambda a, b, c: f"{a}{b}{c}", lambda a, b, c: f"{a} *** {c}"]
    for i in range(60):
        kind = i % 3
        if kind == 0:
            x = forms[i // 3 % 4](digits(3), digits(3), digits(4))
            unseen.append(("phone", x, f"{word()} reach me at tel: {x} or mail {word()}"))
        elif kind == 1:
            x = f"{word()}{i} [at] {word()} [dot] com"
            unseen.append(("email", x, f"{word()} or mail to {x} from {word()}"))
        else:
            x = f"{digits(9)}{word()}{digits(9)}"
            unseen.append(("secret", x, f'{word()} {word()} export "{x}" {word()}' if i % 2 else f'{word()} export token = "{x}" {word()}'))
        clean.append(f"order {digits(9)} of {word()} at {word()} part {word()}{digits(14)} on {digits(2)}-{digits(2)}-{digits(4)}")
    rows = [(i, t) for i, t in enumerate([*texts, *clean])] + [(10_000 + i, t) for i, (_, _, t) in enumerate(unseen)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: set(r.spans.split(",")) for r in pii.op5(df).collect()}
    hit = {kind: [f"{kind}:{t.index(x)}:{t.index(x) + len(x)}" in got[10_000 + i] for i, (k, x, t) in enumerate(unseen) if k == kind] for kind in ("phone", "email", "secret")}
    assert all(sum(h) >= 0.45 * len(h) for h in hit.values()) and all(hit["phone"]) and all(hit["email"])
    assert all(got[len(texts) + i] == {""} for i in range(len(clean)))  # nothing in the clean ones
    back = {r.kind: r for r in pii.held_back(df, 0.3).collect()}
    assert set(back) == {"phone", "email", "ip", "secret"}
    assert all(r.found >= 0.95 * r.hidden and not r.mistaken for r in back.values())


def test_pii_many_matches_in_a_text(spark):
    n = 3000
    t = " ".join(f"a{i}@b.cc" + (" x" if i % 7 else " é +1 555 123 4567") for i in range(n))
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    assert pii.op5(df).first().base_sha256 == hashlib.sha256(",".join(plain_spans(t)).encode()).hexdigest()
    want = re.sub(r"\+1 555 123 4567", "[PHONE]", re.sub(r"a[0-9]+@b[.]cc", "[EMAIL]", t))
    assert pii.redact(df).first().text == want
    # spans that touch are one
    both = spark.createDataFrame([(1, "x 1.2.3.4.5.6.7.8@b.cc y" + "é" * 2000)], "doc_id long, text string")
    assert pii.redact(both).first().text == "x [EMAIL] y" + "é" * 2000


@pytest.mark.parametrize("n,num,hot", [(3, 90, 256), (5, 80, 2)])
def test_join(spark, sf, n, num, hot, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    near = docs.limit(40).select((F.col("doc_id") + 1000).alias("doc_id"), F.regexp_replace("text", "^[^ ]+ ", "changed ").alias("text"))
    docs = docs.select("doc_id", "text").unionByName(near).unionByName(near.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    sets = {}
    for r in docs.collect():
        w = split(r.text)
        sets[r.doc_id] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    head = {i: i for i in sets}
    for _ in range(len(sets)):
        before = dict(head)
        for a, b in links:
            head[a] = head[b] = min(head[a], head[b])
        if before == head:
            break
    joined = ngram_join.Joined(docs, n, num, 100)
    got = {r.doc_id: r for r in joined.documents().collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), head[i]) for i in sets}
    # all pairs of class representatives
    rep = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    want = {(rep[a], rep[b]) if rep[a] < rep[b] else (rep[b], rep[a]) for a, b in links if rep[a] != rep[b]}
    assert {(r.a, r.b) for r in joined.similar_pairs().collect()} == want


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 16))
    near = np.repeat(x[:20], 30, 0) + rng.normal(size=(600, 16)) * rng.uniform(0, 0.45, (600, 1))
    x = np.concatenate([x, near, x[:50]]).astype(np.float32)
    got = {r.vec_id: r for r in embedding_dedup.op10(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert sum(r.n_links for r in got.values()) >= 0.97 * near.sum()
    assert all(got[i].n_links <= near[i].sum() for i in got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    head = np.arange(len(x))
    while True:
        low = np.array([min(head[i], *head[near[i]]) if near[i].any() else head[i] for i in range(len(x))])
        if (low == head).all():
            break
        head = low
    assert sum(got[i].component_id == head[i] for i in got) >= 0.97 * len(got)
    assert all(got[i].component_id >= head[i] for i in got)


def test_embeddings_in_many_blocks(spark, monkeypatch):
    # exact links whatever the blocks: one table that all meet in, cut into many blocks
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    monkeypatch.setattr(embedding_dedup, "STRIPE", 7)
    monkeypatch.setattr(embedding_dedup, "plan", lambda n, t: (2, 24))
    rng = np.random.default_rng(1)
    x = (np.repeat(rng.normal(size=(6, 8)), 60, 0) + 0.25 * rng.normal(size=(360, 8))).astype(np.float32)
    got = {r.vec_id: r for r in embedding_dedup.op10(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    assert [got[i].n_links for i in range(360)] == (near.sum(1) - 1).tolist()


def test_mixing_matches_sql(docs, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    found = con.execute(mixing.ORACLE_SQL)
    columns = [d[0] for d in found.description]
    assert sorted(found.fetchall()) == sorted(tuple(r[c] for c in columns) for r in mixing.op3(docs).collect())


def test_gif():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5, 300, 5000, 70_000):
        for data in (rng.integers(0, 256, n, dtype=np.uint8).tobytes(), (b"ab" * n)[:n], bytes(n), bytes(rng.integers(97, 103, n, dtype=np.uint8))):
            assert media_gif.lzw_decode(media_gif.lzw_encode(data), 8, n).tobytes() == data
    payload = rng.integers(0, 256, 64 * 9000, dtype=np.uint8).tobytes()
    frames = list(media_gif.decode(media_gif.encode_payload(payload)))
    assert [f.box[3] for f in frames] == [4096, 4096, 808] and b"".join(f.canvas[: f.box[3], :, 0].tobytes() for f in frames) == payload
    assert list(media_gif.decode(b"no gif")) == [] and len(list(media_gif.decode(media_gif.encode_payload(payload)[:-40_000]))) == 2


def block(data, size):
    return bytes([size]) + media_gif._blocks(media_gif.lzw_encode(data, size))


def test_gif_disposal_transparency_and_palettes():
    head = b"GIF89a" + bytes([2, 0, 2, 0, 0x80, 0, 0]) + bytes([255, 0, 0, 0, 0, 255])

    def frame(x, y, w, h, pixels, disposal=0, clear=None, palette=b"", flags=0):
        control = b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), 5, 0, clear or 0, 0])
        return control + b"\x2c" + bytes([x, 0, y, 0, w, 0, h, 0, flags | (0x80 if palette else 0)]) + palette + block(pixels, 2)

    data = head + frame(0, 0, 2, 2, bytes(4)) + frame(0, 0, 2, 1, bytes([1, 0]), disposal=2, clear=0) + frame(1, 1, 1, 1, bytes([0]), disposal=3, palette=bytes([0, 9, 0, 1, 1, 1])) + frame(0, 0, 1, 1, bytes([1])) + b"\x3b"
    red, blue, none, green = [255, 0, 0], [0, 0, 255], [0, 0, 0], [0, 9, 0]
    shown = [f.canvas.tolist() for f in media_gif.decode(data)]
    assert shown == [[[red, red], [red, red]], [[blue, red], [red, red]], [[none, none], [red, green]], [[blue, none], [red, red]]]
    rows = bytes(range(4)) * 1
    lines = head[:6] + bytes([1, 0, 4, 0, 0x81, 0, 0]) + bytes(range(12)) + frame(0, 0, 1, 4, bytes([0, 2, 1, 3]), flags=0x40) + b"\x3b"
    assert [p[0][0] for p in next(media_gif.decode(lines)).canvas.tolist()] == [0, 3, 6, 9] and rows


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.op6(docs, labels).join(labels, "doc_id").select("held_out", "toxic", "predicted").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.toxic == r.predicted for r in held) / len(held) > 0.9
    assert sum(r.predicted for r in got if not r.toxic) / sum(not r.toxic for r in got) < 0.03


def test_misspellings():
    rng = np.random.default_rng(0)
    clean = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    texts = [" ".join(rng.choice(clean, 30)) for _ in range(400)]
    labels = np.arange(400) % 4 == 0
    texts = [t + (" worthless thing" if y else " other thing") for t, y in zip(texts, labels)]
    model = toxicity.fit(texts, labels.astype(int))
    score = lambda t: float(np.log(model.chance(toxicity._bags([t]))[0] / (1 - model.chance(toxicity._bags([t]))[0])))
    assert score("abcdef worthless bcdefg") > 0 > score("abcdef other bcdefg")
    assert all(score(f"abcdef {w} bcdefg") > score("abcdef other bcdefg") for w in ("worhtless", "worthlesss", "worthles", "WORTH1ESS"))


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.op4(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    assert sum(r.quality == r.predicted for r in got) / len(got) > 0.95


def posterior(rows):
    """Plain version of the hierarchy: (host, path, p) -> rate of each row's site without the row."""
    n, by_path, by_host = len(rows), collections.defaultdict(list), collections.defaultdict(list)
    for h, q, p in rows:
        by_path[h, q].append(p)
        by_host[h].append(p)
    m = np.mean([p for _, _, p in rows])
    w = sum(((np.array(x) - np.mean(x)) ** 2).sum() for x in by_path.values()) / (n - len(by_path))
    inner = sum(len(x) ** 2 / len(by_host[h]) for (h, _), x in by_path.items())
    t = (sum(len(x) * (np.mean(x) - np.mean(by_host[h])) ** 2 for (h, _), x in by_path.items()) - w * (len(by_path) - len(by_host))) / (n - inner)
    t = max(t, 0.0)
    u = sum(len(x) * (np.mean(x) - m) ** 2 for x in by_host.values()) - t * (inner - sum(len(x) ** 2 for x in by_path.values()) / n) - w * (len(by_host) - 1)
    u = max(0.0, u / (n - sum(len(x) ** 2 for x in by_host.values()) / n))
    out = []
    for h, q, p in rows:
        host, path = by_host[h], by_path[h, q]
        rate = m
        if len(host) > 1:
            own = sum(len(x) ** 2 for (k, _), x in by_path.items() if k == h) / len(host) ** 2
            rate = m + ((sum(host) - p) / (len(host) - 1) - m) * u / (u + w / (len(host) - 1) + t * own)
        if len(path) > 1:
            rate += ((sum(path) - p) / (len(path) - 1) - rate) * t / (t + w / (len(path) - 1))
        out.append(rate)
    return out, m


def test_quality_posterior(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("doc_id") % 7)).withColumn("lang", F.when(F.col("doc_id") % 11 > 8, F.lit("one" + "x")).otherwise("lang"))
    got = quality.op4(docs, labels).join(docs.select("doc_id", "source", "lang"), "doc_id").orderBy("doc_id").collect()
    rates, mean = posterior([(r.source, r.lang, r.doc_score) for r in got])
    logit = lambda p: math.log(p / (1 - p))
    for r, rate in zip(got, rates, strict=True):
        assert r.site_rate == pytest.approx(rate, rel=1e-6)
        assert r.quality_score == pytest.approx(1 / (1 + math.exp(-logit(r.doc_score) - logit(rate) + logit(mean))), rel=1e-6)


def test_small_sites_shrink(spark):
    # paths of a host are alike and hosts differ: two odd documents leave their path near its host's rate
    rng = np.random.default_rng(0)
    sites = [(h, f"{h}{k}", 60, mid + 0.3 * rng.normal()) for h, mid in (("f", 2), ("g", 0), ("h", -2)) for k in range(12)] + [("f", "odd", 2, -2)]
    rows = [(h, q, float(e)) for h, q, n, mid in sites for e in mid + rng.normal(size=n)]
    scored = spark.createDataFrame(rows, "_host string, _path string, _evidence double")
    sums, prior = quality.site_sums(scored)
    rated = scored.join(sums, [scored._host == sums._h, scored._path == sums._p]).withColumn("rate", quality.site_rate(prior))
    own = F.avg(1 / (1 + F.exp(-F.col("_evidence"))))
    got = {r._path: r for r in rated.groupBy("_path", "_host").agg(F.avg("rate").alias("rate"), own.alias("own")).collect()}
    mean = {h: np.mean([r.own for r in got.values() if r._host == h and r._path != "odd"]) for h in "fgh"}
    assert mean["f"] > 0.8 and got["odd"].own < 0.3 and got["odd"].rate > 0.7
    assert all(abs(r.rate - r.own) < 0.05 for k, r in got.items() if k != "odd")

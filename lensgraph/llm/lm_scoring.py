"""LM scoring: an interpolated modified Kneser-Ney n-gram model of any order from 2 on, counted in Spark.

Every level takes one job that counts. The first counts words by their 64-bit hash; shards by leading hash bits are
written as sorted arrays, whose positions number the words. Level k counts pairs of the number of a (k-1)-gram and of
the word that follows; a key is a bijection of both numbers, so that the stored hashes never collide, and positions
number the k-grams. Then, from the top down, the tasks of a level's shards sum per (k-1)-gram what the model needs of
it as a context and as a continuation. Workers map the arrays and look up whole batches.

    p(w | u v) = max(a(uvw) - D(a(uvw)), 0) / a(uv.) + g(uv) * p(w | v)
    p(w)       = max(a(w) - D(a(w)), 0) / a(.) + g * 1 / (V + 1)

a is the count at the top level, and below it the number of distinct words before the n-gram; the start of a text is a
context of its own with nothing before it, so n-grams that begin with it keep their counts. A word whose context was
never seen, or that has fewer words before it, is scored by the next lower level. D has three values a level, from its
counts of counts (Chen and Goodman 1999). A word that training lacks gets the share of one of V + 1 words.

Edge cases: a null or empty text is just its end token; a null doc_id is never held out by the query's rule; rows are
scored one by one, so repeated rows repeat their score; with no training rows every word is unknown and its
probability is 1 (log 0) under one unknown word. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensgraph.llm import arrays, words
from lensgraph.shared import new_folder

#: Stands for the end of a text among the word hashes.
END = np.uint64(0x5BD1E9955BD1E995)
#: Words of an n-gram, the scored one included.
ORDER = 3
#: Numbers of words, and of longer n-grams, whose sums one task gathers into one file of each kind: a word is in many shards.
WORD_PART, PART = 1 << 17, 1 << 20
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Odd factors that spread keys.
SPREAD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Of an n-gram as context: the counts after it, and how many words follow it once, twice, more often; then the distinct words before it.
KINDS = ("total", "one", "two", "more", "before")


@dataclass
class Model:
    """Where the arrays lie, and the few numbers that hold for all of the corpus. Level k is at place k - 1 of a list."""

    uri: str
    levels: list[arrays.Sharded]
    tokens: int
    discounts: list[list[float]]
    continuations: int
    word_kinds: list[int]

    @property
    def known(self) -> int:
        return self.levels[0].size


def discounts(n: list[int]) -> list[float]:
    """D for counts 1, 2 and from 3 on, from the numbers n of keys with count 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    out = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(out)]


def _discounted(counts: np.ndarray, by: list[float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *by])[np.minimum(counts, 3)], 0)


def _sequences(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows from, to, the word hashes of those texts with END after each, and where each text begins in them."""
    for row, end, data, offsets in words.chunks(texts):
        hashed, begins = words.hashes(data, offsets)
        counts = np.diff(begins)
        begins = np.concatenate([[0], np.cumsum(counts + 1)])
        out = np.full(begins[-1], END, np.uint64)
        out[np.arange(len(hashed)) + np.repeat(np.arange(len(counts)), counts)] = hashed
        yield row, end, out, begins


def _before(numbers: np.ndarray, begins: np.ndarray, first: int) -> np.ndarray:
    """The number before each token's; `first` where a text begins."""
    out = np.empty(len(numbers), np.int64)
    out[1:] = numbers[:-1]
    out[begins[:-1]] = first
    return out


def _width(levels: list[arrays.Sharded], level: int) -> int:
    """Bits that name any pair of a context of this level (or the start) and a word."""
    width = ((levels[level - 2].size + 1) * (levels[0].size + 1)).bit_length()
    if width > 64:
        raise ValueError(f"n-grams of {level} words need keys of {width} bits, more than 64")
    return max(width, levels[0].bits + 8)


def _keys(levels: list[arrays.Sharded], level: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Leading bits of 64 that name each pair, spread evenly."""
    width = _width(levels, level)
    half, mask = np.uint64((width + 1) // 2), np.uint64((1 << width) - 1)
    x = context.astype(np.uint64) * np.uint64(levels[0].size + 1) + word.astype(np.uint64)
    for by in SPREAD:
        x = ((x ^ (x >> half)) * np.uint64(by)) & mask
    return (x ^ (x >> half)) << np.uint64(64 - width)


def _parts(levels: list[arrays.Sharded], level: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the context and of the last word."""
    width = _width(levels, level)
    half, mask = np.uint64((width + 1) // 2), np.uint64((1 << width) - 1)
    x = keys >> np.uint64(64 - width)
    for by in SPREAD[::-1]:
        x = ((x ^ (x >> half)) * np.uint64(pow(by, -1, 1 << 64))) & mask
    x, radix = x ^ (x >> half), np.uint64(levels[0].size + 1)
    return (x // radix).astype(np.int64), (x % radix).astype(np.int64)


def _find(table: arrays.Sharded, keys: np.ndarray, *columns: str) -> list[np.ndarray]:
    distinct, where = np.unique(keys, return_inverse=True)
    return [x[where] for x in table.find(distinct, *columns)]


def _numbered(levels: list[arrays.Sharded], seq: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The tokens' word numbers (-1: unknown), and for each level from 2 to one above the last the number of each token's context (-1: none)."""
    token = _find(levels[0], seq)[0]
    contexts = [_before(token, begins, levels[0].size)]
    for level, table in enumerate(levels[1:], 2):
        grams = np.full(len(seq), -1, np.int64)
        both = np.flatnonzero((contexts[-1] >= 0) & (token >= 0))
        grams[both] = table.find(_keys(levels, level, contexts[-1][both], token[both]))[0]
        contexts.append(_before(grams, begins, -1))
    return token, contexts


def _count(df: DataFrame, levels: list[arrays.Sharded], bits: int) -> DataFrame:
    """Keys of the level above `levels`, by shard."""

    def run(batches):
        held = arrays.Held(bits)
        for batch in batches:
            for _, _, seq, begins in _sequences(batch.column(0)):
                if levels:
                    token, contexts = _numbered(levels, seq, begins)
                    at = contexts[-1] >= 0
                    seq = _keys(levels, len(levels) + 1, contexts[-1][at], token[at])
                yield from held.add(seq)
        yield from held.flush()

    return df.select("text").mapInArrow(run, "shard int, blob binary")


def _write(df: DataFrame, uri: str, bits: int, width: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        keys, counts = arrays.joined(table)
        arrays.save(f"{uri}/keys-{shard:05d}.npy", arrays.narrowed(keys, bits, width))
        arrays.save(f"{uri}/counts-{shard:05d}.npy", arrays.least(counts))
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": [len(keys)], "total": [int(counts.sum())]})

    return df.groupBy("shard").applyInArrow(run, "shard int, n long, total long")


def _last(levels: list[arrays.Sharded], level: int, numbers: np.ndarray) -> np.ndarray:
    """Numbers of the n-grams of `level`, which must be sorted, without their first word (or start)."""
    context, word = _parts(levels, level, levels[level - 1].keys_at(numbers))
    return word if level == 2 else _shorter(levels, level, context, word)


def _shorter(levels: list[arrays.Sharded], level: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Numbers, a level lower, of n-grams given by context and last word, without the first word."""
    if level == 2:
        return word
    distinct, where = np.unique(context, return_inverse=True)
    return _find(levels[level - 2], _keys(levels, level - 1, _last(levels, level - 1, distinct)[where], word))[0]


def _from_start(levels: list[arrays.Sharded], level: int, context: np.ndarray) -> np.ndarray:
    """Whether n-grams with these contexts begin with the start of a text."""
    if level == 2:
        return context == levels[0].size
    distinct, where = np.unique(context, return_inverse=True)
    return _from_start(levels, level - 1, _parts(levels, level - 1, levels[level - 2].keys_at(distinct))[0])[where]


def _part(level: int) -> int:
    return WORD_PART if level == 1 else PART


class Sums:
    """The sums of a level's n-grams, in files by ranges of numbers."""

    def __init__(self, uri: str, level: int):
        self.folder, self.part = arrays.Folder(f"{uri}/sums-{level}"), _part(level)

    def get(self, ids: np.ndarray, *kinds: str) -> list[np.ndarray]:
        """Values of sorted numbers."""
        out = [np.zeros(len(ids), np.int64) for _ in kinds]
        part = ids // self.part
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for value, kind in zip(out, kinds, strict=True):
                value[a:b] = self.folder.get(f"{kind}-{int(part[a]):05d}")[ids[a:b] - part[a] * self.part]
        return out


def _shard_sums(spark: SparkSession, levels: list[arrays.Sharded], level: int, top: bool, uri: str) -> DataFrame:
    """Of each shard of a level, the counts of its counts, and sums for the n-grams a level lower by ranges of their numbers."""
    table, below = levels[level - 1], levels[level - 2].size
    n_shards, n_parts = len(table.base) - 1, below // _part(level - 1) + 1

    def run(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                if shard == 0 or shard in table.shards:
                    yield from one(shard)

    def one(shard: int):
        counts = np.zeros(0, np.int64)
        if n := table.shards.get(shard, 0):
            counts = table.column("counts", shard).astype(np.int64)
        numbers = table.base[shard] + np.arange(n)
        context, word = _parts(levels, level, table.keys_at(numbers))
        if not top and n:
            kept = _from_start(levels, level, context)
            counts = np.where(kept, counts, Sums(uri, level).get(numbers, "before")[0])
        kinds = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([kinds], pa.list_(pa.int64())), pa.array([None], pa.binary())], names=["part", "kinds", "blob"])
        order = np.argsort(context)
        context, counts = context[order], counts[order]
        first = np.flatnonzero(np.diff(context, prepend=-1))
        after = [np.add.reduceat(x.astype(np.int64), first) if n else counts for x in (counts, counts == 1, counts == 2, counts > 2)]
        context = context[first].astype(np.uint64)
        ends, before = arrays.merged(_shorter(levels, level, *_parts(levels, level, table.keys_at(numbers))).astype(np.uint64), np.ones(n, np.int64))
        limits = np.arange(n_parts + 1, dtype=np.uint64) * np.uint64(_part(level - 1))
        a, b = np.searchsorted(context, limits), np.searchsorted(ends, limits)
        for p in range(n_parts):
            # every part has a row of the first shard, so that its files are there whatever it holds
            if shard and a[p] == a[p + 1] and b[p] == b[p + 1]:
                continue
            x, y = slice(a[p], a[p + 1]), slice(b[p], b[p + 1])
            pieces = [arrays.pack(context[x] - limits[p], after[0][x]), arrays.pack(ends[y] - limits[p], before[y])]
            for values in after[1:]:
                narrow = arrays.least(values[x])
                pieces.append(bytes([narrow.itemsize]) + narrow.tobytes())
            blob = b"".join(len(piece).to_bytes(4, "little") + piece for piece in pieces)
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([None], pa.list_(pa.int64())), pa.array([blob], pa.binary())], names=["part", "kinds", "blob"])

    return spark.range(0, n_shards, 1, max(1, len(table.shards))).mapInArrow(run, "part int, kinds array<long>, blob binary")


def _write_sums(df: DataFrame, uri: str, level: int, size: int) -> DataFrame:
    """Per range of numbers, dense arrays of the sums; counts of continuation counts, and at part -1 the counts of counts of the level above."""

    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        if part < 0:
            return out(part, 0, 0, np.array(table["kinds"].to_pylist()).sum(0).tolist())
        n = min(_part(level), size + 1 - part * _part(level))
        sums = {kind: np.zeros(n, np.int64) for kind in KINDS}
        for blob in table["blob"]:
            blob, at, pieces = blob.as_py(), 0, []
            while at < len(blob):
                n_bytes = int.from_bytes(blob[at : at + 4], "little")
                pieces.append(blob[at + 4 : at + 4 + n_bytes])
                at += 4 + n_bytes
            (context, total), (ends, before) = arrays.unpack(pieces[0]), arrays.unpack(pieces[1])
            sums["total"][context.astype(np.int64)] += total
            sums["before"][ends.astype(np.int64)] += before
            for kind, piece in zip(KINDS[1:4], pieces[2:], strict=True):
                sums[kind][context.astype(np.int64)] += np.frombuffer(piece, f"<u{piece[0]}", offset=1).astype(np.int64)
        for kind, value in sums.items():
            arrays.save(f"{uri}/sums-{level}/{kind}-{part:05d}.npy", arrays.least(value))
        return out(part, int(sums["before"].sum()), int((sums["before"] > 2).sum()), [int((sums["before"] == k).sum()) for k in (1, 2, 3, 4)])

    def out(part: int, continuations: int, more: int, kinds: list[int]) -> pa.Table:
        return pa.table({"part": pa.array([part], pa.int32()), "continuations": [continuations], "more": [more], "kinds": pa.array([kinds], pa.list_(pa.int64()))})

    return df.groupBy("part").applyInArrow(run, "part int, continuations long, more long, kinds array<long>")


def _added(rows: list) -> list[int]:
    return [sum(r.kinds[k] for r in rows) for k in range(4)]


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each query made here go when it ends, rather than when the driver happens to collect garbage."""
    held = spark.conf.get(FREED)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, held)


def train(corpus: DataFrame, order: int = ORDER) -> Model:
    """Counts all texts of `corpus` (column text); the model's arrays are in the shared folder."""
    if order < 2:
        raise ValueError("the order is at least 2")
    with _shuffles_freed(corpus.sparkSession):
        return _trained(corpus.sparkSession, corpus.select("text"), order)


def _trained(spark: SparkSession, corpus: DataFrame, order: int) -> Model:
    bits, uri = arrays.shard_bits(corpus), new_folder(spark, "lm")
    levels, tokens = [], 0
    for level in range(1, order + 1):
        width = 64 if level == 1 else _width(levels, level)
        rows = _write(_count(corpus, levels, bits), f"{uri}/grams-{level}", bits, width).collect()  # one small row a shard
        levels.append(arrays.Sharded(f"{uri}/grams-{level}", bits, {r.shard: r.n for r in rows}, width))
        tokens = tokens or sum(r.total for r in rows)
    by = []
    for level in range(order, 1, -1):
        sums = _shard_sums(spark, levels, level, level == order, uri)
        rows = _write_sums(sums, uri, level - 1, levels[level - 2].size).collect()  # one small row a part
        by.insert(0, discounts(_added([r for r in rows if r.part < 0])))
        ends = [r for r in rows if r.part >= 0]
    low = _added(ends)
    return Model(uri, levels, tokens, [discounts(low), *by], sum(r.continuations for r in ends), [low[0], low[1], sum(r.more for r in ends)])


class Scorer:
    """Scores batches of texts against a model's mapped arrays."""

    def __init__(self, model: Model):
        self.m = m = model
        self.sums = [Sums(m.uri, level) for level in range(1, len(m.levels))]
        self.rest = sum(d * k for d, k in zip(m.discounts[0], m.word_kinds, strict=True)) / m.continuations if m.continuations else 1.0

    def texts(self, seq: np.ndarray, begins: np.ndarray) -> dict[str, np.ndarray]:
        m = self.m
        token, count = _find(m.levels[0], seq, "counts")
        known = token >= 0
        base = np.log10((count + 0.5) / (m.tokens + 0.5 * (m.known + 1)))
        p = np.full(len(seq), self.rest / (m.known + 1))
        if m.continuations:
            distinct, where = np.unique(token[known], return_inverse=True)
            p[known] += _discounted(self.sums[0].get(distinct, "before")[0][where], m.discounts[0]) / m.continuations
        context = _before(token, begins, m.known if m.tokens else -1)
        for level, table in enumerate(m.levels[1:], 2):
            p, context = self.raised(level, table, token, context, p, begins)
        add = lambda x: np.add.reduceat(x, begins[:-1]) if len(begins) > 1 else x[:0]  # noqa: E731  no text is without its end
        return {"n_tokens": np.diff(begins), "n_known": add(known.astype(np.int64)), "base_score": add(base), "score": add(np.log10(p))}

    def raised(self, level: int, table: arrays.Sharded, token: np.ndarray, context: np.ndarray, p: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of this level from those a level lower, and the contexts of the next level."""
        d = self.m.discounts[level - 1]
        follows = np.flatnonzero(context >= 0)
        distinct, where = np.unique(context[follows], return_inverse=True)
        total, one, two, more = self.sums[level - 2].get(distinct, *KINDS[:4])
        seen = total > 0
        share = np.ones(len(distinct))
        share[seen] = (d[0] * one[seen] + d[1] * two[seen] + d[2] * more[seen]) / total[seen]
        p = p.copy()
        p[follows] *= share[where]
        all_of = np.ones(len(token), np.int64)
        all_of[follows] = np.maximum(total, 1)[where]
        both = np.flatnonzero((context >= 0) & (token >= 0))
        at, count = table.find(_keys(self.m.levels, level, context[both], token[both]), "counts")
        grams = np.full(len(token), -1, np.int64)
        grams[both] = at
        if level < len(self.m.levels):
            first = np.zeros(len(token), bool)
            first[(begins[:-1] + level - 2)[level - 2 < np.diff(begins)]] = True
            held = np.flatnonzero((at >= 0) & ~first[both])
            distinct, where = np.unique(at[held], return_inverse=True)
            count[held] = self.sums[level - 1].get(distinct, "before")[0][where]
        p[both] += _discounted(count, d) / all_of[both]
        return p, _before(grams, begins, -1)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep`, then n_tokens, n_known, base_score, score and perplexity of each row's text."""
    kept = docs.select(*keep).schema
    tail = "n_tokens long, n_known long, base_score double, score double, perplexity double"
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), tail])

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(len(keep))
            for row, end, seq, begins in _sequences(texts):
                out = scorer.texts(seq, begins)
                cols = [batch.column(k).slice(row, end - row) for k in range(len(keep))]
                cols += [pa.array(out["n_tokens"], pa.int64()), pa.array(out["n_known"], pa.int64()), pa.array(out["base_score"]), pa.array(out["score"]), pa.array(10 ** (-out["score"] / out["n_tokens"]))]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "n_tokens", "n_known", "base_score", "score", "perplexity"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, fields)


def held_out(column: str, fold: int) -> F.Column:
    """crc32 of the id as text, modulo 5, is `fold`; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == fold, F.lit(False))


def op1(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Held-out scores of all documents under a model of the others."""
    docs = docs.select("doc_id", "text").withColumn("held_out", held_out("doc_id", 1))
    model = train(docs.filter(~F.col("held_out")), order)
    out = score(docs, model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")

"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word's bag holds its character 3- to 6-grams, with a mark at either end, hashed to BUCKETS rows of an embedding. A
window of WINDOW words is the mean of its bags' rows, and so is a whole text of all its n-grams; a softmax over two classes
reads such a mean. A text's probability is a logistic function of its best window's score and of its own mean bag's, whose
weights are learned with the labels (learned pooling): a few words may decide, and so may the text as a whole. Training
goes in rounds: under the present model each labelled text gives its most toxic window (at first, as an initialisation, the
words that toxic texts hold far more often), toxic texts also misspelt copies of theirs, and embedding, softmax and bias are
trained on all windows gathered so far. So misspellings that no text held share n-gram rows with what was seen.

As the softmax is linear, each bucket is one number once trained, and whole batches of texts are scored by running sums.

The labelled rows used are at most SAMPLE of each class, chosen by a hash of the id; scoring covers every text whole.

Edge cases: null and empty texts, and those without letters or digits, have the score of the bias alone; with no
labelled rows, or one class only, every score is the share of label 1 (0 with none); rows are scored one by one; a null
label is left out; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensgraph.llm import tokens, words

BUCKETS, WIDTH, GRAMS, WINDOW = 1 << 18, 12, (3, 4, 5, 6), 1
SAMPLE, ROUNDS, EPOCHS, BATCH, RATE, SEED = 3000, 4, 6, 256, 0.5, 7
#: Likelihood ratio of a word with label 1 from which it begins a first window, if its share of the toxic texts is also
#: OFTEN times that of the others: in many texts a common word passes any ratio by a slight excess.
LIKELY, OFTEN = 30.0, 2.0
#: How often at most a toxic window counts in an epoch.
REPEATS = 100
_PRIME = np.uint64(0x100000001B3)
_FOLD = np.full(256, 0x20, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256), 0x40]:
    _FOLD[_b] = _b
_FOLD[65:91] = np.arange(97, 123)


@dataclass
class Model:
    """weights and bias score a bag; slope, whole and shift pool a text: its best window, its own mean bag, a constant."""

    weights: np.ndarray
    bias: float
    slope: float
    whole: float
    shift: float

    def chance(self, bags: Bags) -> np.ndarray:
        """Per text the probability of label 1."""
        high, _, mean = bags.pooled(self.weights, self.bias)
        return 1 / (1 + np.exp(-np.clip(self.slope * high + self.whole * mean + self.shift, -30, 30)))


class Bags:
    """The bags of many texts: for each n-gram its bucket and its word; for each word its text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        texts = len(offsets) - 1
        padded = np.full(len(data) + texts + 1, 0x20, np.uint8)
        padded[np.arange(len(data)) + np.repeat(np.arange(texts), np.diff(offsets)) + 1] = _FOLD[data]
        gap = padded == 0x20
        self.padded = padded
        self.start = np.flatnonzero(~gap[1:] & gap[:-1]) + 1
        self.end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        self.begins = np.searchsorted(self.start, offsets + np.arange(texts + 1))
        self.gaps = np.zeros(len(padded) + 1, np.int32)
        np.cumsum(gap, out=self.gaps[1:])

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where valid n-grams begin, and their buckets. Only the first and the last byte of one may be a gap."""
        m = len(self.padded) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.gaps[n - 1 : n - 1 + m] == self.gaps[1 : 1 + m])
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h ^ self.padded[at + k].astype(np.uint64)) * _PRIME
        return at, ((h ^ (h >> np.uint64(29))) & np.uint64(BUCKETS - 1)).astype(np.int64)

    def sums(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per word the sum of its buckets' weights, and the size of its bag."""
        total, count = np.zeros(len(self.start)), np.zeros(len(self.start))
        if not len(self.start):
            return total, count
        for n in GRAMS:
            at, bucket = self.grams(n)
            word = np.searchsorted(self.start, at + 1, "right") - 1 if len(at) < 1000 else (np.cumsum(np.bincount(self.start, minlength=len(self.padded) + 1))[at + 1] - 1)
            total += np.bincount(word, weights=weights[bucket], minlength=len(total))
            count += np.bincount(word, minlength=len(count))
        return total, count

    def best(self, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
        """Per text the highest window score, and the word where that window begins (-1: no words)."""
        return self.pooled(weights, bias)[:2]

    def pooled(self, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text the highest window score, the word where that window begins (-1: no words), and the score of the text's own mean bag."""
        total, count = self.sums(weights)
        owner = np.repeat(np.arange(len(self.begins) - 1), np.diff(self.begins))
        whole = [np.bincount(owner, weights=x, minlength=len(self.begins) - 1) for x in (total, count)]
        mean = whole[0] / np.maximum(whole[1], 1) + bias
        for _ in range(WINDOW - 1):  # a window ends at its text's end
            follow = np.concatenate([owner[1:] == owner[:-1], [False]])
            total, count = total + np.where(follow, np.roll(total, -1), 0), count + np.where(follow, np.roll(count, -1), 0)
        score = total / np.maximum(count, 1) + bias
        out, where = np.full(len(self.begins) - 1, bias), np.full(len(self.begins) - 1, -1)
        has = np.flatnonzero(np.diff(self.begins))
        if len(has):
            out[has] = np.maximum.reduceat(score, self.begins[has])
            first = np.flatnonzero(score == out[owner])[::-1]
            where[owner[first]] = first
        return out, where, mean

    def word(self, i: int) -> bytes:
        return self.padded[self.start[i] : self.end[i]].tobytes()

    def window(self, word: int) -> str:
        text = int(np.searchsorted(self.begins, word, "right")) - 1
        last = min(word + WINDOW, int(self.begins[text + 1])) - 1
        return self.padded[self.start[word] : self.end[last]].tobytes().decode("utf-8", "replace")


def _bags(texts: list[str]) -> Bags:
    data, offsets = words.buffers(pa.array(texts, pa.string()))
    return Bags(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def misspelt(text: str, rng: np.random.Generator) -> str:
    """One edit of a word: a letter doubled, dropped, swapped with the next or replaced."""
    if len(text) < 3:
        return text
    i, kind = int(rng.integers(len(text) - 1)), int(rng.integers(5))
    if kind == 0:
        return text[:i] + text[i] + text[i:]
    if kind == 1:
        return text[:i] + text[i + 1 :]
    if kind == 2:
        return text[:i] + text[i + 1] + text[i] + text[i + 2 :]
    if kind == 3:
        looks = str.maketrans("oieastlbg", "013457169")
        return text[:i] + text[i:].translate(looks) if rng.integers(2) else text[:i] + text[i].translate(looks) + text[i + 1 :]
    return text[:i] + chr(97 + int(rng.integers(26))) + text[i + 1 :]


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """A model from labelled texts."""
    rng = np.random.default_rng(SEED)
    share = float(labels.mean()) if len(labels) else 0.0
    if len(np.unique(labels)) < 2:
        return Model(np.zeros(BUCKETS), 0.0, 0.0, 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    # the first toxic windows begin at words that toxic texts hold far more often
    held: dict[bytes, list[int]] = {}
    for a, b in tokens.blocks(texts):  # a block at a time: the bags of all texts would not fit the driver
        bags = _bags(texts[a:b])
        for t in range(b - a):
            for w in {bags.word(i) for i in range(bags.begins[t], bags.begins[t + 1])}:
                held.setdefault(w, [0, 0])[labels[a + t]] += 1
    n1, n0 = int(labels.sum()), int((1 - labels).sum())

    def likely(n: list[int]) -> bool:
        share = n1 / (n1 + n0)
        ratio = n[1] * np.log(n[1] / (share * sum(n))) + (n[0] * np.log(n[0] / ((1 - share) * sum(n))) if n[0] else 0)
        return n[1] / n1 > OFTEN * n[0] / n0 and 2 * ratio >= LIKELY

    marked = {w for w, n in held.items() if n[1] > 1 and likely(n)}
    del held
    pool: dict[str, int] = {}
    toxic_texts = [t for t, y in zip(texts, labels, strict=True) if y]
    for a, b in tokens.blocks(toxic_texts):
        bags = _bags(toxic_texts[a:b])
        for i in range(len(bags.start)):
            if bags.word(i) in marked:
                text = bags.window(i)
                pool[text] = pool.get(text, 0) + 1
    weights, bias = np.zeros(BUCKETS), 0.0
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    soft, soft_bias = rng.normal(0, 0.1, (WIDTH, 2)), np.zeros(2)
    grown = [np.full(BUCKETS, 1e-3), np.full(soft.shape, 1e-3), np.full(2, 1e-3)]
    for turn in range(ROUNDS):
        for a, b in tokens.blocks(texts):
            bags = _bags(texts[a:b])
            _, where = bags.best(weights, bias)
            for t in np.flatnonzero((where >= 0) & ((labels[a:b] == 0) | (turn > 0))):
                text = bags.window(int(where[t]))
                pool[text] = pool.get(text, 0) + (1 if labels[a + t] else -1)
                if not labels[a + t]:  # and a word by chance
                    text = bags.window(int(rng.integers(bags.begins[t], bags.begins[t + 1])))
                    pool[text] = pool.get(text, 0) - 1
        toxic = [x for x, n in pool.items() if n > 0 for _ in range(min(n, REPEATS))]
        clean = [x for x, n in pool.items() if n < 0]
        rows = toxic + [misspelt(x, rng) for x in toxic] + [misspelt(misspelt(x, rng), rng) for x in toxic[::2]] + clean + [misspelt(x, rng) for x in clean]
        n_toxic = 2 * len(toxic) + len(toxic[::2])
        goal = np.arange(len(rows)) < n_toxic
        weight = np.where(goal, 0.5 / max(1, n_toxic), 0.5 / max(1, len(rows) - n_toxic)) * len(rows)
        own = _bags(rows)
        row_of = np.repeat(np.arange(len(rows)), np.diff(own.begins))
        grams = [own.grams(n) for n in GRAMS]
        bucket = np.concatenate([b for _, b in grams])
        row = np.concatenate([row_of[np.searchsorted(own.start, at + 1, "right") - 1] for at, _ in grams])
        order = np.argsort(row, kind="stable")
        bucket, row = bucket[order], row[order]
        cuts = np.searchsorted(row, np.arange(len(rows) + 1))
        for _ in range(EPOCHS):
            for batch in np.array_split(rng.permutation(np.flatnonzero(np.diff(cuts))), max(1, len(rows) // BATCH)):
                size = np.diff(cuts)[batch]
                of = np.repeat(np.arange(len(batch)), size)
                picks = bucket[cuts[batch][of] + np.arange(len(of)) - (np.cumsum(size) - size)[of]]
                mean = np.add.reduceat(table[picks], np.cumsum(size) - size) / size[:, None]
                logit = mean @ soft + soft_bias
                p = np.exp(logit - logit.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(batch)), goal[batch].astype(int)] -= 1
                p *= weight[batch][:, None] / len(batch)
                g_soft, g_bias, g_mean = mean.T @ p, p.sum(0), p @ soft.T / size[:, None]
                uniq, back = np.unique(picks, return_inverse=True)
                g_table = np.stack([np.bincount(back, weights=g_mean[of, k], minlength=len(uniq)) for k in range(WIDTH)], 1)
                grown[0][uniq] += (g_table**2).mean(1)
                table[uniq] -= RATE * g_table / np.sqrt(grown[0][uniq])[:, None]
                grown[1] += g_soft**2
                soft -= RATE * 0.2 * g_soft / np.sqrt(grown[1])
                grown[2] += g_bias**2
                soft_bias -= RATE * 0.2 * g_bias / np.sqrt(grown[2])
        weights, bias = table @ (soft[:, 1] - soft[:, 0]), float(soft_bias[1] - soft_bias[0])
    found = [_bags(texts[a:b]).pooled(weights, bias) for a, b in tokens.blocks(texts)]
    x = np.stack([np.concatenate([f[0] for f in found]), np.concatenate([f[2] for f in found]), np.ones(len(texts))], 1)
    pool_by, prior = np.array([1.0, 0.0, 0.0]), np.array([0.1, 0.1, 0.0])
    for _ in range(50):  # Newton's steps of a logistic fit, held back by a prior on the slopes
        p = 1 / (1 + np.exp(-np.clip(x @ pool_by, -30, 30)))
        d = p * (1 - p) + 1e-6
        grad = x.T @ (p - labels) + prior * (pool_by - np.array([1.0, 0.0, 0.0]))
        hess = (x * d[:, None]).T @ x + np.diag(prior + 1e-6)
        pool_by -= np.clip(np.linalg.solve(hess, grad), -1, 1) * np.array([0.5, 0.5, 1])
    return Model(weights, bias, *map(float, pool_by))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Fits on at most SAMPLE labelled rows of each class (about; by a hash of doc_id)."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    bound = F.lit(0.0)
    for k, n in counts.items():
        bound = F.when(F.col("label") == k, min(1.0, SAMPLE / n)).otherwise(bound)
    chosen = rows.filter(chance < bound)  # about 2 * SAMPLE ids
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").collect()
    got.sort(key=lambda r: (r.doc_id, r.text or ""))
    return fit([r.text or "" for r in got], np.array([r.label for r in got], np.int64))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns `keep` and the score of each row's text."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]

    def run(batches):
        for batch in batches:
            for row, end, data, offsets in words.chunks(batch.column(len(keep))):
                p = model.chance(Bags(data, offsets))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(row, end - row) for k in range(len(keep))), pa.array(p)], names=[*keep, "score"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, ", ".join([*kept, "score double"]))


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All documents under a model of the labels outside the held-out fold."""
    from lensgraph.llm.lm_scoring import held_out

    model = train(docs, labels.filter(~held_out("doc_id", 0)))
    out = score(docs.select("doc_id", "text").withColumn("held_out", held_out("doc_id", 0)), model, ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

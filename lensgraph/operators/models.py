"""Encoders (text to vector) and scorers (two texts to a number) as Spark operators.

A model is a small object with `load()`; each Python worker loads it once and keeps it. The defaults need no download:
a hashing encoder and a word-overlap scorer. Any class with the same methods can take their place.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lensgraph.functions.scores import interpretation
from lensgraph.functions.texts import LENSES, cache_key, instruct, rerank_prompt, short_hash

_loaded: dict[tuple, object] = {}


class HashingEncoder:
    """Signed word hashes summed into `dimension` components, of length one if asked.

    digest: "blake2b", or "md5", whose first eight hexadecimal digits give the component and whose ninth gives the sign
    (8 and above: +1), so that SQL elsewhere finds the same vector.
    """

    def __init__(self, dimension: int = 256, normalize: bool = True, digest: str = "blake2b"):
        self.dimension, self.normalize, self.digest = dimension, normalize, digest
        self.model_id = f"hashing-encoder-{dimension}"

    def load(self) -> HashingEncoder:
        return self

    def _place(self, word: str) -> tuple[int, int]:
        if self.digest == "md5":
            h = hashlib.md5(word.encode()).hexdigest()
            return int(h[:8], 16) % self.dimension, 1 if h[8] > "7" else -1
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return h % self.dimension, 1 if h >> 63 else -1

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                place, sign = self._place(w)
                out[i, place] += sign
        if self.normalize:
            size = np.linalg.norm(out, axis=1, keepdims=True)
            out /= np.where(size > 0, size, 1)
        return out


class OverlapScorer:
    """P(yes) of a logit from the share of the query's words in the document, after truncation to `max_words`."""

    def __init__(self, max_words: int = 8192):
        self.max_words, self.model_id = max_words, "overlap-scorer"

    def load(self) -> OverlapScorer:
        return self

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for q, d in pairs:
            a, b = set(q.lower().split()[: self.max_words]), set(d.lower().split()[: self.max_words])
            share = len(a & b) / len(a) if a else 0.0
            out.append(1 / (1 + math.exp(4 - 8 * share)))
        return out


class Retrying:
    """An encoder that tries each of its encoders in turn, `tries` times each, until one answers; all must have one width.

    What the last one raises goes on. Retries stay in the worker, so a failing call costs no task.
    """

    def __init__(self, encoders: tuple, tries: int = 3):
        if len({e.dimension for e in encoders}) != 1:
            raise ValueError("the encoders' widths differ")
        self.encoders, self.tries, self.dimension = tuple(encoders), tries, encoders[0].dimension
        self.model_id = "+".join(e.model_id for e in encoders)
        self.key = (Retrying, tries, *(_key(e) for e in encoders))

    def load(self) -> Retrying:
        self.live = [e.load() for e in self.encoders]
        return self

    def encode(self, texts: list[str]) -> np.ndarray:
        fault: Exception | None = None
        for encoder in self.live:
            for _ in range(self.tries):
                try:
                    return encoder.encode(texts)
                except Exception as e:  # noqa: BLE001  whatever a client raises; kept and raised if all fail
                    fault = e
        raise fault


def _key(model) -> tuple:
    """What tells models apart: their own `key`, or type and parameters."""
    return getattr(model, "key", None) or (type(model), tuple(sorted(vars(model).items())))


def _worker(model):
    """The model of this worker, loaded at first use."""
    key = _key(model)
    if key not in _loaded:
        _loaded[key] = model.load()
    return _loaded[key]


def lens_table(spark: SparkSession, instructions: dict[str, str]) -> DataFrame:
    """(lens, instruction, lens_hash) of the given lenses, one small row each."""
    rows = [(k, instructions[k]) for k in LENSES if k in instructions]
    return spark.createDataFrame(rows, "lens string, instruction string").withColumn("lens_hash", short_hash(F.col("instruction")))


#: Texts whose vectors a task holds as Python objects at once.
PIECE = 512


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, PIECE):
            yield b.slice(at, PIECE)


def encode(rows: DataFrame, encoder, text: str = "text", keep: list[str] | None = None, batch: int = 8) -> DataFrame:
    """Columns `keep` and embedding of each row's text; null texts have a null embedding, blank ones are encoded."""
    keep = keep or []
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema] if keep else []

    def run(batches: Iterator[pa.RecordBatch]):
        model = _worker(encoder)
        for b in _pieces(batches):
            texts = b.column(len(keep)).to_pylist()
            known = [t for t in texts if t is not None]
            found = [v for i in range(0, len(known), batch) for v in model.encode(known[i : i + batch]).tolist()]
            got = iter(found)
            vectors = [next(got) if t is not None else None for t in texts]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), pa.array(vectors, pa.list_(pa.float32()))], names=[*keep, "embedding"])

    return rows.select(*keep, F.col(text).alias("_text")).mapInArrow(run, ", ".join([*kept, "embedding array<float>"]))


def encode_lenses(rows: DataFrame, encoder, lenses: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per text and lens: (key, lens, lens_hash, embedding). The lens table is three rows at most, hence broadcast."""
    both = rows.select(key, F.col(text).alias("_t")).crossJoin(F.broadcast(lenses.limit(len(LENSES))))
    return encode(both.withColumn("_p", instruct(F.col("_t"), F.col("instruction"))), encoder, "_p", [key, "lens", "lens_hash"])


def cached(rows: DataFrame, cache: DataFrame, encoder, lens: Column, dim: int, fresh_after: Column, text: str = "text") -> DataFrame:
    """(cache_key, embedding, hit): rows found in `cache` (cache_key, embedding, cached_at), and the others encoded once a text."""
    asked = rows.select(cache_key(F.col(text), lens, dim).alias("cache_key"), F.col(text).alias("_t")).groupBy("cache_key").agg(F.first("_t").alias("_t"))
    valid = cache.filter(F.col("cached_at") >= fresh_after).select("cache_key", "embedding")
    hits = asked.join(valid, "cache_key").select("cache_key", "embedding", F.lit(True).alias("hit"))
    misses = asked.join(valid, "cache_key", "left_anti")
    return hits.unionByName(encode(misses, encoder, "_t", ["cache_key"]).withColumn("hit", F.lit(False)))


def score(pairs: DataFrame, scorer, a: str, b: str, instruction: Column | None = None, symmetric: bool = False) -> DataFrame:
    """Adds score (mean of both directions if symmetric; null if a text is null) and interpretation of the raw score."""
    kept = pairs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    left = rerank_prompt(F.col(a), F.lit(""), instruction) if instruction is not None else F.col(a)

    def run(batches: Iterator[pa.RecordBatch]):
        model = _worker(scorer)
        for x in _pieces(batches):
            one, two = x.column(len(kept)).to_pylist(), x.column(len(kept) + 1).to_pylist()
            at = [i for i in range(len(one)) if one[i] is not None and two[i] is not None]
            s = model.score([(one[i], two[i]) for i in at])
            if symmetric:
                s = [(p + q) / 2 for p, q in zip(s, model.score([(two[i], one[i]) for i in at]), strict=True)]
            out: list[float | None] = [None] * len(one)
            for i, v in zip(at, s, strict=True):
                out[i] = v
            yield pa.RecordBatch.from_arrays([*(x.column(k) for k in range(len(kept))), pa.array(out, pa.float64())], names=[*kept, "score"])

    got = pairs.select(*kept, left.alias("_a"), F.col(b).alias("_b")).mapInArrow(run, f"{fields}, score double")
    return got.withColumn("interpretation", interpretation(F.col("score")))


def score_by_id(pairs: DataFrame, texts: DataFrame, scorer, symmetric: bool = False) -> DataFrame:
    """(pair_id, score, interpretation, status) of pairs (pair_id, a_id, b_id) over texts (id, text).

    A pair whose text is missing or null has a null score and status MISSING, else OK; every pair has its row.
    """
    a, b = texts.select(F.col("id").alias("a_id"), F.col("text").alias("a")), texts.select(F.col("id").alias("b_id"), F.col("text").alias("b"))
    both = pairs.select("pair_id", "a_id", "b_id").join(a, "a_id", "left").join(b, "b_id", "left").select("pair_id", "a", "b")
    out = score(both, scorer, "a", "b", symmetric=symmetric)
    return out.select("pair_id", "score", "interpretation", F.when(F.col("score").isNull(), "MISSING").otherwise("OK").alias("status"))


def score_batch(requests: DataFrame, scorer) -> DataFrame:
    """(request_id, position, score, interpretation): one row for each document of (request_id, query, documents), position
    from 0 being its place in the array, so that answers can be put in the order asked."""
    rows = requests.select("request_id", "query", F.posexplode("documents").alias("position", "document"))
    return score(rows, scorer, "query", "document").select("request_id", "position", "score", "interpretation")


def rerank(queries: DataFrame, documents: DataFrame, scorer, k: int = 10) -> DataFrame:
    """For (query_id, query) and (query_id, doc_id, document): the k best documents of each query, ties by doc_id."""
    from pyspark.sql import Window

    s = score(documents.join(queries, "query_id").select("query_id", "doc_id", "query", "document"), scorer, "query", "document")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return s.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "doc_id", "score", "interpretation", "rank")


def request(texts: DataFrame, encoder, lens: str | None, dimension: int, most: int = 20) -> DataFrame:
    """An embedding request (idx, text): rows with status 200 in order of idx; or one row of status 422 for a bad lens,
    dimension or number of texts, or 400 if all texts are blank."""
    from lensgraph.functions.vectors import mrl_truncate
    from lensgraph.settings import LEAST_DIMENSION, MOST_DIMENSION

    n, blank = texts.agg(F.count("*"), F.sum(F.coalesce(F.trim("text") == "", F.lit(True)).cast("long"))).first()
    fault = 422 if (lens and lens not in LENSES) or not LEAST_DIMENSION <= dimension <= MOST_DIMENSION or not 1 <= n <= most else 400 if blank == n else 200
    if fault != 200:
        return texts.sparkSession.createDataFrame([(fault, None, None)], "status int, idx long, embedding array<double>")
    out = encode(texts, encoder, "text", ["idx"])
    return out.select(F.lit(200).alias("status"), F.col("idx").cast("long"), mrl_truncate(F.col("embedding"), dimension).alias("embedding")).orderBy("idx")


def model_info(spark: SparkSession, model, lenses: DataFrame) -> DataFrame:
    """One row: model id, lens hashes and the time."""
    h = lenses.agg(F.map_from_entries(F.collect_list(F.struct("lens", "lens_hash"))).alias("lens_hashes"))
    return h.select(F.lit(model.model_id).alias("model_id"), "lens_hashes", F.current_timestamp().alias("at"))


def lens_current(stored: DataFrame, lenses: DataFrame) -> DataFrame:
    """Adds `current`: the stored lens hash is that of the lens today; false for an unknown lens."""
    now = lenses.select("lens", F.col("lens_hash").alias("_now"))
    return stored.join(F.broadcast(now.limit(len(LENSES))), "lens", "left").withColumn("current", F.coalesce(F.col("lens_hash") == F.col("_now"), F.lit(False))).drop("_now")

"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

A logistic model of character and repetition features gives each document's own probability p of being good. Of these,
counts, sums and sums of squares by path (a part of a host) give three variances, by the method of moments for nested
groups: w within paths, t between the paths of one host, u between hosts. With m_p, m_h and m the means of a path, a
host and all, and n_p, n_h the documents,

    rate(host) = m          + (m_h - m)          * u / (u + w / n_h + t * sum over its paths of (n_p / n_h)^2)
    rate(path) = rate(host) + (m_p - rate(host)) * t / (t + w / n_p)

so that a path with few documents takes its host's rate, and a host with few the global one. A document's site rate is
that of its path with the document itself left out of m_p, m_h, n_p and n_h. Its posterior odds are its own odds times
the ratio of the odds of its site rate to those of m.

The logistic model is fitted on at most SAMPLE labelled rows (about; by a hash of the id); rates and scores cover all
rows. Group sums are map-side combined, so a host with a third of all rows is a few partial sums.

Edge cases: null and empty texts have all features 0 and are scored like any text; null hosts and paths are groups of
their own; with no labelled rows, or one class only, each document's own probability is the share of good labels (0.5
with none); rows are scored one by one; an empty table gives no rows; other columns are kept if asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lensgraph.llm import words
from lensgraph.shared import written

SAMPLE, RIDGE, KEEP = 20_000, 1.0, 0.5
#: Bytes whose shares are features by themselves; others count by class.
_MARKS = np.frombuffer(b".,;:!?'\"()[]{}<>|#$%&*@/\\=+-_~^`", np.uint8)
_CLASSES = [(97, 123), (65, 91), (48, 58), (128, 256), (32, 33), (10, 11)]
_SAME = np.arange(256, dtype=np.uint8)
_IN_LINE = _SAME != 10
N_FEATURES = len(_MARKS) + len(_CLASSES) + 5


@dataclass
class Model:
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    bias: float


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row a text: byte shares, word length, shares of distinct words, of the commonest word, and of distinct lines."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    counts = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    share = counts / np.maximum(size, 1)[:, None]
    hashed, begins = words.hashes(data, offsets)
    held = np.diff(begins)
    word_owner = np.repeat(np.arange(n), held)
    out = [np.log1p(100 * share[:, _MARKS]), *(np.log1p(100 * share[:, a:b].sum(1))[:, None] for a, b in _CLASSES)]

    def spread(values: np.ndarray, of: np.ndarray, total: np.ndarray) -> list[np.ndarray]:
        order = np.lexsort((values, of))
        v, o = values[order], of[order]
        first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])])) if len(v) else np.zeros(0, np.int64)
        run = np.diff(np.append(first, len(v)))
        most = np.zeros(n)
        np.maximum.at(most, o[first], run)
        return [(np.bincount(o[first], minlength=n) / np.maximum(total, 1))[:, None], (most / np.maximum(total, 1))[:, None]]

    out += [np.log1p(size / np.maximum(held, 1))[:, None], *spread(hashed, word_owner, held)]
    line, line_begins = words.hashes(data, offsets, _IN_LINE, _SAME)
    lines = np.diff(line_begins)
    out += spread(line, np.repeat(np.arange(n), lines), lines)
    return np.concatenate(out, axis=1)


def _logit(p):
    return np.log(p) - np.log1p(-p)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Ridge logistic regression by Newton's steps."""
    share = (y.sum() + 1e-6) / (len(y) + 2e-6) if len(y) else 0.5
    if len(np.unique(y)) < 2:
        return Model(np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.ones(N_FEATURES), float(_logit(np.clip(share, 1e-6, 1 - 1e-6))))
    centre, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z = np.hstack([np.clip((x - centre) / scale, -8, 8), np.ones((len(x), 1))])
    w, ridge = np.zeros(z.shape[1]), np.append(np.full(z.shape[1] - 1, RIDGE), 1e-6)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return Model(w[:-1], centre, scale, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fits on the features of about SAMPLE labelled rows at most."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    chance = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000)) / 1_000_000
    chosen = rows.filter(chance < min(1.0, SAMPLE / max(1, rows.count())))  # about SAMPLE ids

    def run(batches):
        for batch in batches:
            for row, end, data, offsets in words.chunks(batch.column(0)):
                x = features(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(1).slice(row, end - row), batch.column(2).slice(row, end - row)], names=["x", "label", "doc_id"])

    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label", "doc_id").mapInArrow(run, "x array<double>, label int, doc_id long").collect()
    got.sort(key=lambda r: (r.doc_id, r.x))
    return fit(np.array([r.x for r in got]).reshape(-1, N_FEATURES), np.array([r.label for r in got], float))


def evidence(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns `keep` and _evidence, each document's own log odds of being good."""
    fields = T.StructType([*docs.select(*keep).schema.fields, T.StructField("_evidence", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for row, end, data, offsets in words.chunks(batch.column(len(keep))):
                z = np.clip((features(data, offsets) - model.centre) / model.scale, -8, 8) @ model.weights + model.bias
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(row, end - row) for k in range(len(keep))), pa.array(np.clip(z, -20, 20))], names=[*keep, "_evidence"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, fields)


@dataclass
class Prior:
    """Mean of all documents' probabilities, and the variances within paths, between paths of a host, between hosts."""

    mean: float
    within: float
    paths: float
    hosts: float


def site_sums(scored: DataFrame) -> tuple[DataFrame, Prior]:
    """Per (_h, _p): np, sp (documents and sum of probabilities of the path), nh, sh (of the host), ch (see module); and the prior.

    scored: rows with _host, _path and _evidence.
    """
    own = 1 / (1 + F.exp(-F.col("_evidence")))
    paths = written(scored.groupBy(F.col("_host").alias("_h"), F.col("_path").alias("_p")).agg(F.count("*").alias("np"), F.sum(own).alias("sp"), F.sum(own * own).alias("qp")), "paths")
    hosts = paths.groupBy(F.col("_h").alias("_k")).agg(F.sum("np").alias("nh"), F.sum("sp").alias("sh"), F.sum(F.col("np") * F.col("np")).alias("nn"))
    sites = written(paths.join(hosts, F.col("_h").eqNullSafe(F.col("_k"))).drop("_k"), "sites")
    n, nh, mp, mh = F.col("np").cast("double"), F.col("nh").cast("double"), F.col("sp") / F.col("np"), F.col("sh") / F.col("nh")
    total = sites.agg(F.sum(n).alias("n"), F.sum("sp").alias("s")).first()
    mean = (total.s or 0.0) / (total.n or 1.0)
    r = sites.agg(
        F.count("*").alias("p"), F.sum(n / nh).alias("h_docs"), F.sum(F.col("qp") - F.col("sp") * mp).alias("ssw"), F.sum(n * (mp - mh) ** 2).alias("ssp"),
        F.sum(n * (mh - mean) ** 2).alias("ssh"), F.sum(n * n / nh).alias("inner"), F.sum(n * n).alias("pp"), F.sum(n * nh).alias("hh"),
    ).first()
    if not total.n:
        return sites, Prior(0.5, 0.0, 0.0, 0.0)
    n, hosts_n = total.n, round(r.h_docs)  # sum of np / nh over paths counts each host once
    within = max(r.ssw, 0.0) / (n - r.p) if n > r.p else mean * (1 - mean)
    between = max(0.0, (r.ssp - within * (r.p - hosts_n)) / (n - r.inner)) if n - r.inner > 1e-9 * n else 0.0
    spread = n - r.hh / n
    outer = max(0.0, (r.ssh - between * (r.inner - r.pp / n) - within * (hosts_n - 1)) / spread) if spread > 1e-9 * n else 0.0
    return sites, Prior(float(np.clip(mean, 1e-6, 1 - 1e-6)), within, between, outer)


def site_rate(prior: Prior) -> Column:
    """Rate of the site of a row with _evidence and the sums of site_sums(), the row itself left out."""
    own = 1 / (1 + F.exp(-F.col("_evidence")))
    n, nh = F.col("np") - 1, F.col("nh") - 1
    mean, w, t, u = (F.lit(float(x)) for x in (prior.mean, prior.within, prior.paths, prior.hosts))
    noise = w / nh + t * F.col("nn") / (F.col("nh") * F.col("nh"))
    host = F.when((nh > 0) & (u > 0), mean + ((F.col("sh") - own) / nh - mean) * u / (u + noise)).otherwise(mean)
    path = F.when((n > 0) & (t > 0), host + ((F.col("sp") - own) / n - host) * t / (t + w / n)).otherwise(host)
    return F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), path))


def classified(docs: DataFrame, labels: DataFrame, host: Column, path: Column, keep: list[str]) -> DataFrame:
    """_keep (a struct of `keep`), doc_score (own probability), site_rate and quality_score (posterior).

    Evidence is computed for the rates and again for the rows, so that texts kept are neither written nor shuffled.
    """
    rows = docs.select(F.struct(*keep).alias("_keep"), host.alias("_host"), path.alias("_path"), "text")
    model = train(docs, labels)
    sites, prior = site_sums(evidence(rows, model, ["_host", "_path"]))
    scored = evidence(rows, model, ["_keep", "_host", "_path"])
    out = scored.join(sites, F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_p"))).withColumn("_rate", site_rate(prior))
    odds = F.col("_evidence") + F.log(F.col("_rate") / (1 - F.col("_rate"))) - float(_logit(prior.mean))
    return out.select("_keep", (1 / (1 + F.exp(-F.col("_evidence")))).alias("doc_score"), F.col("_rate").alias("site_rate"), (1 / (1 + F.exp(-odds))).alias("quality_score"))


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All documents: host is the source, path the language within it."""
    out = classified(docs, labels, F.col("source"), F.col("lang"), ["doc_id"])
    return out.select("_keep.doc_id", "doc_score", "site_rate", "quality_score", (F.col("quality_score") >= KEEP).cast("int").alias("predicted"))


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not rejected."""
    out = classified(docs, labels, F.col("source"), F.col("lang"), docs.columns)
    return out.filter(F.col("quality_score") >= KEEP).select(*[F.col("_keep").getField(c).alias(c) for c in docs.columns])

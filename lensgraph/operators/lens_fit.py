"""Fitting a full lens: T is moved down the gradient of its loss, which Spark sums over all pairs, one job a step.

The loss is alignment + weights x (uniformity, nuclear norm, whitening, condition), of cosines between T a and T b:

- alignment: mean (target - cosine)^2; uniformity: log mean exp(-2 (2 - 2 cosine)), of unit vectors;
- nuclear norm: sum of T's singular values; condition: max(0, s_max / s_min - limit)^2;
- whitening: |T C T' - I|^2 (Frobenius), C the covariance of the vectors, summed once.

Tasks return sums of width x width numbers, whose size does not grow with the rows; what hangs on T and C alone is solved on
the driver. A step that does not lower the loss is halved, so the loss falls with every step or the fit ends.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensgraph.operators.calibrate import moments, total_loss
from lensgraph.operators.search import Pairs, Side
from lensgraph.shared import written

#: Weights of uniformity, nuclear norm, whitening and condition (fixed values), and the condition number free of charge.
WEIGHTS, LIMIT = (0.05, 0.01, 0.1, 1.0), 100.0


def pair_sums(a: np.ndarray, b: np.ndarray, target: np.ndarray, lens: np.ndarray) -> tuple[int, float, float, np.ndarray, np.ndarray]:
    """n, sum (target - c)^2, sum e = exp(-2 (2 - 2 c)), and the gradients of both sums in T; pairs with a zero vector count not."""
    u, v = a @ lens.T, b @ lens.T
    nu, nv = np.sqrt((u * u).sum(1)), np.sqrt((v * v).sum(1))
    on = (nu > 0) & (nv > 0)
    a, b, target, nu, nv = a[on], b[on], target[on], nu[on], nv[on]
    u, v = u[on] / nu[:, None], v[on] / nv[:, None]
    c = (u * v).sum(1)
    e = np.exp(-2 * (2 - 2 * c))
    out = []
    for slope in (2 * (c - target), 4 * e):
        gu = slope[:, None] * (v - c[:, None] * u) / nu[:, None]
        gv = slope[:, None] * (u - c[:, None] * v) / nv[:, None]
        out.append(gu.T @ a + gv.T @ b)
    return len(c), float(((target - c) ** 2).sum()), float(e.sum()), *out


def tile_sums(a: np.ndarray, b: np.ndarray, target: np.ndarray, on: np.ndarray, lens: np.ndarray) -> tuple[int, float, float, np.ndarray, np.ndarray]:
    """The same sums over the pairs of every row of a with every row of b where `on` holds, by matrix products."""
    u, v = a @ lens.T, b @ lens.T
    nu, nv = np.sqrt((u * u).sum(1)), np.sqrt((v * v).sum(1))
    on = on & (nu > 0)[:, None] & (nv > 0)[None, :]
    nu, nv = np.where(nu > 0, nu, 1.0), np.where(nv > 0, nv, 1.0)
    u, v = u / nu[:, None], v / nv[:, None]
    c = u @ v.T
    e = np.where(on, np.exp(-2 * (2 - 2 * c)), 0.0)
    gap = np.where(on, c - target, 0.0)
    out = []
    for slope in (2 * gap, 4 * e):
        turn = slope * c
        gu = (slope @ v - turn.sum(1)[:, None] * u) / nu[:, None]
        gv = (slope.T @ u - turn.sum(0)[:, None] * v) / nv[:, None]
        out.append(gu.T @ a + gv.T @ b)
    return int(on.sum()), float((gap * gap).sum()), float(e.sum()), *out


def lens_terms(lens: np.ndarray, covariance: np.ndarray, limit: float = LIMIT) -> tuple[dict[str, float], dict[str, np.ndarray]]:
    """Nuclear norm, whitening and condition of T, and their gradients."""
    left, s, right = np.linalg.svd(lens)
    gap = lens @ covariance @ lens.T - np.eye(len(lens))
    over = max(0.0, s[0] / s[-1] - limit)
    slope = (np.outer(left[:, 0], right[0]) * s[-1] - s[0] * np.outer(left[:, -1], right[-1])) / s[-1] ** 2
    values = {"low_rank": float(s.sum()), "whiten": float((gap * gap).sum()), "condition": over**2}
    return values, {"low_rank": left @ right, "whiten": 4 * gap @ lens @ covariance, "condition": 2 * over * slope}


def bounds(lens: np.ndarray) -> tuple[float, float, float]:
    """Least and largest factor by which T changes a distance, and their ratio."""
    s = np.linalg.svd(lens, compute_uv=False)
    return float(s[-1]), float(s[0]), float(s[0] / s[-1]) if s[-1] else float("inf")


def factors_seen(pairs: Pairs, lens: np.ndarray) -> DataFrame:
    """(least, most) of each task: the factors by which T changes the distances of its pairs; equal vectors have none.

    Squared distances of a tile come from products; only what these leave open (pairs nearly equal, for which they cancel,
    and those within 1e-6 of the extremes so far) is measured again by differences.
    """

    def task(tiles):
        least, most = np.inf, -np.inf
        for asked, own, apart in tiles:
            squares = [_squares(asked.vectors, own.vectors), _squares(asked.vectors @ lens.T, own.vectors @ lens.T)]
            near = [s < 1e-6 * whole for s, whole in squares]
            with np.errstate(invalid="ignore", divide="ignore"):
                factor = np.sqrt(squares[1][0] / squares[0][0])
            sure = factor[apart & ~near[0] & ~near[1]]
            low, high = min(least, sure.min(initial=np.inf)), max(most, sure.max(initial=-np.inf))
            q, r = np.nonzero(apart & (near[0] | near[1] | (factor <= low * (1 + 1e-6)) | (factor >= high * (1 - 1e-6))))
            for at in range(0, len(q), 4096):
                x = asked.vectors[q[at : at + 4096]] - own.vectors[r[at : at + 4096]]
                before, after = np.sqrt((x * x).sum(1)), np.sqrt(((x @ lens.T) ** 2).sum(1))
                exact = after[before > 0] / before[before > 0]
                least, most = min(least, exact.min(initial=np.inf)), max(most, exact.max(initial=-np.inf))
        if most >= 0:
            yield pa.RecordBatch.from_arrays([pa.array([float(least)]), pa.array([float(most)])], names=["least", "most"])

    return pairs.run(task, "least double, most double")


def _squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all pairs by products, and the sums of squared lengths that they are made of."""
    whole = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    return whole - 2 * (a @ b.T), whole


class LensFit:
    """A fit over pairs (va, vb, target) and vectors of a column of `rows`; `over` fits all pairs of a search."""

    def __init__(self, pairs: DataFrame, rows: DataFrame, column: str = "embedding", weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT):
        self._about(rows, column, weights, limit)
        whole = [F.col(c).isNotNull() & (F.size(c) == self.dim) & F.forall(c, lambda x: x.isNotNull()) for c in ("va", "vb")]
        self.pairs = written(pairs.filter(whole[0] & whole[1] & F.col("target").isNotNull()).select(F.col("va").cast("array<double>"), F.col("vb").cast("array<double>"), F.col("target").cast("double")), "pairs")

    @classmethod
    def over(cls, pairs: Pairs, target: Callable[[Side, Side], np.ndarray], rows: DataFrame, column: str = "embedding", weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT) -> LensFit:
        """A fit over all pairs of a search, tile by tile, with none of them written. target: the scores of a tile."""
        made = cls.__new__(cls)
        made._about(rows, column, weights, limit)
        made.pairs, made.target = pairs, target
        return made

    def _about(self, rows: DataFrame, column: str, weights: tuple[float, ...], limit: float) -> None:
        self.weights, self.limit = weights, limit
        n, _, scatter = moments(rows, column)
        self.dim, self.covariance = len(scatter), scatter / max(1, n - 1)
        self.lens, self.history = np.eye(self.dim), []

    def _sums(self, lens: np.ndarray) -> DataFrame:
        """(n, sums, grads) of each task."""
        d, fields = self.dim, "n long, sums array<double>, grads array<double>"

        def row(parts):
            n, sums, grads = 0, np.zeros(2), np.zeros((2, d, d))
            for m, x, y, gx, gy in parts:
                n, sums = n + m, sums + (x, y)
                grads += (gx, gy)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.tolist()]), pa.array([grads.ravel().tolist()])], names=["n", "sums", "grads"])

        if isinstance(self.pairs, Pairs):
            target = self.target
            return self.pairs.run(lambda tiles: row(tile_sums(q.vectors, r.vectors, target(q, r), on, lens) for q, r, on in tiles), fields)

        def read(batches):
            for batch in batches:
                a, b = (batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, d) for k in (0, 1))
                yield pair_sums(a, b, batch.column(2).to_numpy(zero_copy_only=False), lens)

        return self.pairs.mapInArrow(lambda batches: row(read(batches)), fields)

    def loss(self, lens: np.ndarray) -> tuple[dict[str, float], np.ndarray]:
        """All terms with their `total`, and the gradient of the total: one pass over the pairs."""
        d = self.dim
        n, sums, grads = 0, np.zeros(2), np.zeros((2, d, d))
        for r in self._sums(lens).toLocalIterator():  # one row a task
            n, sums, grads = n + r.n, sums + r.sums, grads + np.array(r.grads).reshape(2, d, d)
        values, slopes = lens_terms(lens, self.covariance, self.limit)
        values |= {"alignment": sums[0] / n if n else 0.0, "uniformity": float(np.log(sums[1] / n)) if n else 0.0}
        slopes |= {"alignment": grads[0] / n if n else grads[0], "uniformity": grads[1] / sums[1] if n else grads[1]}
        uniform, rank, whiten, condition = self.weights
        values["total"] = total_loss(values["alignment"], values["uniformity"], values["whiten"], values["low_rank"], (uniform, rank, whiten)) + condition * values["condition"]
        return values, slopes["alignment"] + uniform * slopes["uniformity"] + rank * slopes["low_rank"] + whiten * slopes["whiten"] + condition * slopes["condition"]

    def fit(self, steps: int = 5, rate: float = 0.1, least: float = 1e-6) -> LensFit:
        """Adds a line of terms to `history` for the start and each step; ends early once the rate is below `least`."""
        now, slope = self.loss(self.lens)
        self.history.append(now)
        while len(self.history) <= steps and rate >= least:
            lens = self.lens - rate * slope
            new, new_slope = self.loss(lens)
            if new["total"] < now["total"]:
                self.lens, now, slope, rate = lens, new, new_slope, rate * 1.5
                self.history.append(now)
            else:
                rate /= 2
        return self


def exported(pairs: DataFrame, index: DataFrame, a: str, b: str, id_column: str = "vec_id") -> DataFrame:
    """Training rows (i, j, cosine, reranker) of pairs (a, b, cosine, score): i and j are matrix indexes of the ids."""
    i, j = index.select(F.col(id_column).alias(a), F.col("idx").alias("i")), index.select(F.col(id_column).alias(b), F.col("idx").alias("j"))
    return pairs.join(i, a).join(j, b).select("i", "j", "cosine", F.col("score").alias("reranker"))

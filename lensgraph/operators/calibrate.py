"""Calibration of a low-rank correction to an embedding space.

Matrices of the width of a vector (d x d, d x r) are summed in Spark, entry by entry and map-side combined, and solved
on the driver; their size does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensgraph import mapped
from lensgraph.operators.search import Pairs, Side, unit
from lensgraph.shared import new_folder, partitions, written


def moments(rows: DataFrame, column: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and centred scatter matrix of the vectors of a column; rows with nulls or another width are left out.

    Each batch gives its number, sum and products about its own mean; those are combined on the driver in pairs, as the
    textbook formula for two groups does, so that nothing cancels.
    """
    rows = rows.filter(F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull()))
    first = rows.select(F.size(column).alias("d")).first()
    d = first.d if first else 0

    def run(batches):
        n, mean, scatter = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            m, mu = len(x), x.mean(0)
            step = mu - mean
            scatter += (x - mu).T @ (x - mu) + np.outer(step, step) * (n * m / (n + m))
            mean, n = mean + step * (m / (n + m)), n + m
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()]), pa.array([scatter.ravel().tolist()])], names=["n", "mean", "scatter"])

    kept = rows.filter(F.size(column) == d).select(F.col(column).cast("array<double>"))
    n, mean, scatter = 0, np.zeros(d), np.zeros((d, d))
    for r in kept.mapInArrow(run, "n long, mean array<double>, scatter array<double>").toLocalIterator():
        mu = np.array(r.mean)
        step = mu - mean
        scatter += np.array(r.scatter).reshape(d, d) + np.outer(step, step) * (n * r.n / (n + r.n))
        mean, n = mean + step * (r.n / (n + r.n)), n + r.n
    return n, mean, scatter


def singular_values(rows: DataFrame, column: str = "embedding") -> np.ndarray:
    """Of the centred matrix of all vectors, largest first."""
    _, _, scatter = moments(rows, column)
    return np.sqrt(np.maximum(np.linalg.eigvalsh(scatter)[::-1], 0)) if len(scatter) else np.zeros(0)


def spectrum(rows: DataFrame, column: str = "embedding", share: float = 0.9) -> DataFrame:
    """One row: effective dimension exp(-sum p log p), isotropy, condition number, least rank with `share` of the energy."""
    s = singular_values(rows, column)
    total = s.sum()
    p = s[s > 0] / total if total else s
    energy = np.cumsum(s * s)
    rank = int(np.searchsorted(energy, share * energy[-1] * (1 - 1e-12)) + 1) if total else 0
    values = (float(np.exp(-(p * np.log(p)).sum())) if total else 0.0, float(s[-1] / s[0]) if total else 0.0, float(s[0] / s[-1]) if total and s[-1] else None, rank)
    return rows.sparkSession.createDataFrame([values], "effective_dimension double, isotropy double, condition double, rank int")


def whitening(rows: DataFrame, column: str = "embedding", floor: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the inverse square root of the covariance."""
    n, mean, scatter = moments(rows, column)
    values, vectors = np.linalg.eigh(scatter / max(1, n - 1))
    return mean, vectors @ np.diag(1 / np.sqrt(np.maximum(values, floor))) @ vectors.T


def transformed(rows: DataFrame, matrix: np.ndarray, mean: np.ndarray | None = None, column: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """(id, vector): matrix (v - mean) of every row, by one product a batch."""
    mean = np.zeros(matrix.shape[1]) if mean is None else mean

    def run(batches):
        for batch in batches:
            x = (batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(mean)) - mean) @ matrix.T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=[id_column, "vector"])

    kept = rows.filter(F.size(column) == len(mean)).select(F.col(id_column).cast("long"), F.col(column).cast("array<double>"))
    return kept.mapInArrow(run, f"{id_column} long, vector array<double>")


def lens_factors(pairs: DataFrame, rank: int, column_a: str = "va", column_b: str = "vb", target: str = "target") -> tuple[np.ndarray, np.ndarray]:
    """A, B (d x rank) whose product best corrects scores: leading part of sum (target - a.b) (a b^T + b a^T) / 2.

    The sum is one d x d matrix, of symmetric sign-weighted products; its leading eigenpairs give A = U s and B = U.
    """
    first = pairs.select(F.size(column_a).alias("d")).first()
    d = first.d if first else 0

    def run(batches):
        total, n = np.zeros((d, d)), 0
        for batch in batches:
            a, b = (batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, d) for k in (0, 1))
            gap = batch.column(2).to_numpy(zero_copy_only=False) - (a * b).sum(1)
            total += (a * gap[:, None]).T @ b
            n += len(a)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.ravel().tolist()])], names=["n", "m"])

    rows = pairs.select(F.col(column_a).cast("array<double>"), F.col(column_b).cast("array<double>"), F.col(target).cast("double"))
    total, n = np.zeros((d, d)), 0
    for r in rows.mapInArrow(run, "n long, m array<double>").toLocalIterator():
        total += np.array(r.m).reshape(d, d)
        n += r.n
    return _leading(total, n, rank)


def lens_factors_over(pairs: Pairs, target: Callable[[Side, Side], np.ndarray], rank: int) -> tuple[np.ndarray, np.ndarray]:
    """The same factors from all pairs of a search, tile by tile: no pair is written. target: the scores of a tile."""
    d = pairs.dim

    def task(tiles):
        total, n = np.zeros((d, d)), 0
        for asked, own, apart in tiles:
            gap = np.where(apart, target(asked, own) - asked.vectors @ own.vectors.T, 0.0)
            total += asked.vectors.T @ (gap @ own.vectors)
            n += int(apart.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.ravel().tolist()])], names=["n", "m"])

    total, n = np.zeros((d, d)), 0
    for r in pairs.run(task, "n long, m array<double>").toLocalIterator():  # one row a task
        total += np.array(r.m).reshape(d, d)
        n += r.n
    return _leading(total, n, rank)


def _leading(total: np.ndarray, n: int, rank: int) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh((total + total.T) / max(1, 2 * n))
    top = np.argsort(-np.abs(values))[:rank]
    return vectors[:, top] * values[top], vectors[:, top]


def lens_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """I + A B^T."""
    return np.eye(len(a)) + a @ b.T


def matrix_index(ids: DataFrame, column: str = "vec_id") -> DataFrame:
    """(id, idx): 0..n-1 in order of id, by range partitions; no task numbers all rows."""
    parts = written(ids.select(column).distinct().repartitionByRange(partitions(ids.sparkSession), column).withColumn("part", F.spark_partition_id()), "index")
    before = parts.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    idx = F.row_number().over(Window.partitionBy("part").orderBy(column)) - 1 + F.col("before")
    return parts.join(F.broadcast(before), "part").select(column, idx.alias("idx"))  # one row a partition


def pair_losses(pairs: DataFrame, cosine: Column, target: Column, temperature: float = 0.07) -> DataFrame:
    """One row: alignment mean (target - cos)^2, uniformity log mean exp(-2 (2 - 2 cos)), contrastive log-loss at a temperature."""
    p = pairs.select(cosine.alias("c"), target.alias("t"))
    return p.agg(
        F.avg((F.col("t") - F.col("c")) ** 2).alias("alignment"),
        F.log(F.avg(F.exp(-2 * (2 - 2 * F.col("c"))))).alias("uniformity"),
        F.avg(F.log1p(F.exp(-F.col("c") / temperature)) * F.col("t") + F.log1p(F.exp(F.col("c") / temperature)) * (1 - F.col("t"))).alias("contrastive"),
    )


def total_loss(alignment: float, uniformity: float, whiten: float, low_rank: float, weights: tuple[float, float, float] = (0.05, 0.01, 0.1)) -> float:
    """Alignment plus the weighted other terms."""
    return alignment + weights[0] * uniformity + weights[1] * low_rank + weights[2] * whiten


def incremental_loss(pairs: DataFrame, cells: DataFrame, weights: tuple[float, float] = (0.5, 0.1)) -> DataFrame:
    """One row: critical, memory, anchor and their weighted sum `total`.

    pairs: (class, target, cosine); squared errors are averaged over the critical classes and over the stable ones, and
    invalidated pairs count in neither. cells: (old, new) of the lens matrix; anchor sums their squared differences. A
    class without pairs, or a matrix without cells, counts 0.
    """
    error = (F.col("target") - F.col("cosine")) ** 2
    over = lambda *names: F.coalesce(F.avg(F.when(F.col("class").isin(*names), error)), F.lit(0.0))
    one = pairs.agg(over("CRITICAL_NEW", "CRITICAL_MODIFIED").alias("critical"), over("STABLE").alias("memory"))
    anchor = cells.agg(F.coalesce(F.sum((F.col("new") - F.col("old")) ** 2), F.lit(0.0)).alias("anchor"))  # one row each
    return one.crossJoin(anchor).withColumn("total", F.col("critical") + weights[0] * F.col("memory") + weights[1] * F.col("anchor"))


def needs_lens(average_cosine: float, average_divergence: float, effective_dimension: float) -> dict[str, bool]:
    """Both published rules: one needs all of .85, .4 and 200; the other asks for a pilot from .2 and .5 on."""
    return {"strict": average_cosine > 0.85 and average_divergence > 0.4 and effective_dimension < 200, "pilot": average_divergence > 0.2 and average_cosine > 0.5}


def diagnosis(divergence: float, isotropy: float) -> str:
    """What the diagnostic rule says (fixed values): unlikely below .2 and above .5, likely above .4 and below .3, else a pilot."""
    if divergence < 0.2 and isotropy > 0.5:
        return "UNLIKELY"
    return "LIKELY" if divergence > 0.4 and isotropy < 0.3 else "PILOT"


def silhouette(rows: DataFrame, label: str, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, label, own, other, silhouette) by cosine distance, all clusters compared and no pairs made.

    The mean distance of a row to a cluster is 1 less its product with the cluster's sum of unit vectors over the number of
    rows; its own row is taken out of both. A row alone in its cluster has silhouette 0 and a null `own`; with one cluster
    `other` and the silhouette are null. Rows without a label or an id, and vectors that are null, zero, hold nulls or
    have another width than the first, are left out. Each task sums its rows by cluster first; the sums are written in blocks
    of 1024 clusters, which tasks map.
    """
    spark = rows.sparkSession
    kept = rows.filter(F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull()) & F.exists(column, lambda x: x != 0) & F.col(label).isNotNull() & F.col(id_column).isNotNull())
    first = kept.select(F.size(column).alias("d")).first()
    d, uri = first.d if first else 1, new_folder(spark, "clusters")
    kept = kept.filter(F.size(column) == d).select(F.col(id_column).alias("id"), F.col(label).alias("label"), F.col(column).cast("array<double>").alias("v"))
    kind = {f.name: f.dataType.simpleString() for f in kept.schema}

    def add(batches):
        held: dict = {}
        for batch in batches:
            names = batch.column(1).dictionary_encode()
            sums, counts = np.zeros((len(names.dictionary), d)), np.bincount(names.indices, minlength=len(names.dictionary))
            np.add.at(sums, names.indices.to_numpy(), unit(batch.column(2), d))
            for name, s, n in zip(names.dictionary.to_pylist(), sums, counts.tolist(), strict=True):
                old = held.get(name, (0.0, 0))
                held[name] = (old[0] + s, old[1] + n)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), _arrow(kind["label"])), pa.array([x[0].tolist() for x in held.values()], pa.list_(pa.float64())), pa.array([x[1] for x in held.values()], pa.int64())], names=["label", "s", "n"])

    def join(table: pa.Table) -> pa.Table:
        total = table["s"].combine_chunks().flatten().to_numpy().reshape(-1, d).sum(0)
        return pa.table({"label": table["label"].slice(0, 1), "s": [total.tolist()], "n": [sum(table["n"].to_pylist())]})

    fields = f"label {kind['label']}, s array<double>, n long"
    sums = written(kept.mapInArrow(add, fields).groupBy("label").applyInArrow(join, fields), "sums")
    blocks = max(1, -(-sums.count() // 1024))

    def write(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        mapped.put(f"{uri}/sums-{block}", 0, table["s"].combine_chunks().flatten().to_numpy().reshape(-1, d))
        mapped.put(f"{uri}/counts-{block}", 0, table["n"].to_numpy())
        return pa.table({"block": pa.array([block] * table.num_rows, pa.int32()), "place": pa.array(range(table.num_rows), pa.int32()), "label": table["label"]})

    dealt = sums.withColumn("block", F.pmod(F.xxhash64("label"), F.lit(blocks)).cast("int"))
    places = written(dealt.groupBy("block").applyInArrow(write, f"block int, place int, label {kind['label']}"), "places")
    sizes = {r.block: r.n for r in places.groupBy("block").agg(F.count("*").alias("n")).collect()}  # one row a block of clusters

    def measure(batches):
        held = {b: (mapped.get(f"{uri}/sums-{b}", "<f8", n * d).reshape(n, d), mapped.get(f"{uri}/counts-{b}", "<i8", n)) for b, n in sizes.items()}
        for batch in batches:
            x, block, place = unit(batch.column(2), d), batch.column(3).to_numpy(), batch.column(4).to_numpy()
            own, other = np.full(len(x), np.nan), np.full(len(x), np.inf)
            for b, (s, n) in held.items():
                product, mine = x @ s.T, np.flatnonzero(block == b)
                at = place[mine]
                with np.errstate(invalid="ignore", divide="ignore"):
                    own[mine] = 1 - (product[mine, at] - 1) / (n[at] - 1)
                own[mine[n[at] == 1]] = np.nan
                apart = 1 - product / n
                apart[mine, at] = np.inf
                other = np.minimum(other, apart.min(1))
            with np.errstate(invalid="ignore", divide="ignore"):
                value = np.where(np.isnan(own), 0.0, (other - own) / np.maximum(own, other))
            lone = np.isinf(other)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, mask=np.isnan(own)), pa.array(other, mask=lone), pa.array(value, mask=lone)], names=[id_column, label, "own", "other", "silhouette"])

    out = kept.join(places, "label").select("id", "label", "v", "block", "place")
    return out.mapInArrow(measure, f"`{id_column}` {kind['id']}, `{label}` {kind['label']}, own double, other double, silhouette double")


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[kind]


def weighted_sample(pairs: DataFrame, target: int, same: Column, a: str = "a", b: str = "b") -> DataFrame:
    """Keeps a pair with probability weight * 2 target / pairs, by a hash: weight 0.3 within a type, else 0.7."""
    total = pairs.count()
    chance = F.pmod(F.xxhash64(a, b), F.lit(1_000_000)) / 1_000_000
    return pairs.filter(chance < F.when(same, 0.3).otherwise(0.7) * (2.0 * target / max(1, total)))


def stratified_sample(rows: DataFrame, stratum: str, per_mille: int, key: str) -> DataFrame:
    """The rows whose hash, within their stratum, falls below a share of 1000: each stratum keeps about that share."""
    return rows.filter(F.pmod(F.xxhash64(key, stratum), F.lit(1000)) < per_mille)

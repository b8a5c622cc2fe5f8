"""A vector index: coarse centroids, inverted lists over every row, several lists probed, exact scores.

Centroids are fitted by spherical k-means on a bounded sample (SAMPLE rows, those of least hash) on the driver, which also
finds how many lists a query must probe for RECALL of its neighbours inside the sample. Every row is then put in the list
of its nearest centroid; lists are stored in order, in blocks of bounded size, with the vectors as given. A query meets
only the blocks of the lists it probes: blocks of queries and blocks of rows are grouped and multiplied, and cosines are
exact. A long list is many blocks, a list that many queries probe meets them in many blocks too, so no group is unbounded.

The index is a folder and can be opened again. Edge cases: rows without a vector or an id, of another width, or of length
zero are not in it; an index of no rows finds nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensgraph import mapped
from lensgraph.operators.search import FOUND, Best, ranked, unit, usable
from lensgraph.shared import new_folder, partitions

SAMPLE, STEPS, RECALL, MOST_LISTS = 20_000, 12, 0.97, 4096
#: Rows, and queries, of one group.
BLOCK = 4096


def centroids(x: np.ndarray, lists: int, steps: int = STEPS) -> np.ndarray:
    """Spherical k-means from evenly spread rows; an emptied list starts again from the row worst served."""
    c = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(steps):
        s = x @ c.T
        near = s.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        empty = np.flatnonzero(np.bincount(near, minlength=lists) == 0)
        sums[empty] = x[np.argsort(s.max(1), kind="stable")[: len(empty)]]
        c = sums / np.maximum(np.sqrt((sums * sums).sum(1, keepdims=True)), 1e-300)
    return c


def probes_for(x: np.ndarray, c: np.ndarray, recall: float, k: int = 10) -> int:
    """Lists to probe for that share of the k nearest of every 50th row among these rows."""
    q = x[::50]
    s = q @ x.T
    s[np.arange(len(q)), np.arange(0, len(x), 50)] = -np.inf
    near = np.argsort(-s, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(q @ c.T), axis=1, kind="stable"), axis=1)  # of each list, by query
    needed = np.take_along_axis(place, (x @ c.T).argmax(1)[near], axis=1)
    return int(np.quantile(needed, recall, method="higher")) + 1 if needed.size else 1


class VectorIndex:
    """An index in a folder; see build() and open()."""

    def __init__(self, spark: SparkSession, uri: str, dim: int, lists: int, probes: int):
        self.spark, self.uri, self.dim, self.n_lists, self.probes = spark, uri, dim, lists, probes
        self.rows = spark.read.schema("list int, block long, id long, vector array<double>").parquet(f"{uri}/lists") if dim else None

    @staticmethod
    def build(rows: DataFrame, uri: str | None = None, lists: int | None = None, recall: float = RECALL, id_column: str = "vec_id", vector: str = "embedding") -> VectorIndex:
        spark, uri = rows.sparkSession, uri or new_folder(rows.sparkSession, "vector-index")
        first = rows.filter(F.col(id_column).isNotNull() & (F.size(vector) > 0)).select(F.size(vector).alias("d")).first()
        kept = usable(rows, first.d if first else 1, id_column, vector)
        kept = kept.filter(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0))
        sample = kept.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()  # a bounded sample
        if not sample:
            spark.createDataFrame([(0, 0, 0)], "dim int, lists int, probes int").write.parquet(f"{uri}/about")
            return VectorIndex(spark, uri, 0, 0, 0)
        dim, n = first.d, kept.count()
        x = unit(pa.array([r.vector for r in sample], pa.list_(pa.float64())), dim)
        lists = lists or max(1, min(MOST_LISTS, len(x) // 20, int(n**0.5)))
        c = centroids(x, lists)
        mapped.put(f"{uri}/centroids", 0, c)

        def assign(batches):
            for batch in batches:
                near = (unit(batch.column(1), dim) @ c.T).argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), *batch.columns], names=["list", "id", "vector"])

        def number(batches):
            """Blocks of BLOCK rows, none of two lists."""
            from pyspark import TaskContext

            block, held, last = TaskContext.get().partitionId() << 32, 0, None
            for batch in batches:
                out = []
                for own in batch.column(0).to_pylist():
                    if own != last or held == BLOCK:
                        block, held, last = block + 1, 0, own
                    held += 1
                    out.append(block)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64()), *batch.columns[1:]], names=["list", "block", "id", "vector"])

        dealt = kept.mapInArrow(assign, "list int, id long, vector array<double>")
        dealt = dealt.repartitionByRange(partitions(spark), "list", F.xxhash64("id")).sortWithinPartitions("list")
        dealt.mapInArrow(number, "list int, block long, id long, vector array<double>").write.parquet(f"{uri}/lists")
        probes = probes_for(x, c, recall)
        spark.createDataFrame([(dim, lists, probes)], "dim int, lists int, probes int").write.parquet(f"{uri}/about")
        return VectorIndex(spark, uri, dim, lists, probes)

    @staticmethod
    def open(spark: SparkSession, uri: str) -> VectorIndex:
        about = spark.read.parquet(f"{uri}/about").first()
        return VectorIndex(spark, uri, about.dim, about.lists, about.probes)

    def search(self, queries: DataFrame, k: int, least: float = -2.0, probes: int | None = None, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """(query_id, row_id, score, rank): the k other rows of highest cosine above `least` in the lists probed."""
        if not self.dim:
            return self.spark.createDataFrame([], f"{FOUND}, rank int")
        uri, dim, lists, probes = self.uri, self.dim, self.n_lists, min(probes or self.probes, self.n_lists)

        def probe(batches):
            c = mapped.get(f"{uri}/centroids", "<f8", lists * dim).reshape(lists, dim)
            for batch in batches:
                near = np.argsort(-(unit(batch.column(1), dim) @ c.T), axis=1, kind="stable")[:, :probes]
                which = np.repeat(np.arange(batch.num_rows), probes)
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int32()), *(col.take(pa.array(which)) for col in batch.columns)], names=["list", "query_id", "query"])

        asked = usable(queries, dim, id_column, vector).mapInArrow(probe, "list int, query_id long, query array<double>")
        parts = asked.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
        blocks = self.rows.select("list", F.col("block").alias("meets")).distinct()
        left = asked.join(parts, "list").join(blocks, "list").select("meets", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("own"), "query_id", "query")
        right = self.rows.join(parts, "list").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "vector")

        def score(a: pa.Table, b: pa.Table) -> pa.Table:
            best = Best(k)
            if a.num_rows and b.num_rows:
                x, y = (unit(t[c].combine_chunks(), dim) for t, c in ((a, "query"), (b, "vector")))
                best.add(x @ y.T, a["query_id"].to_numpy(), b["id"].to_numpy(), least)
            return pa.Table.from_batches([best.batch()])

        return ranked(left.groupBy("meets", "own").cogroup(right.groupBy("block", "part")).applyInArrow(score, FOUND), k)

"""Similarity search: a stated set of queries against all rows.

Queries are written to the shared folder in blocks of bounded size; each task maps them and multiplies every block with its
batches of rows, keeping what is among the k best of a query in that task. Windows then choose among those. Rows are never
joined with each other, no query passes the driver, and the rows are read once.

`Pairs` is the same for work on every pair: a task goes through tiles of bounded size, which hold the vectors and numbers of
both sides, so that sums over all pairs are matrix products and no pair is written or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensgraph import mapped
from lensgraph.functions.vectors import cosine
from lensgraph.shared import new_folder, partitions, written

BLOCK = 4096
#: Pairs that a task has in hand at once, of so many queries at most: its memory does not grow with queries or rows.
TILE, ASKED = 1 << 16, 512
#: Candidates of all queries that a task holds before it keeps the best k of each.
HELD = 2_000_000
FOUND = "query_id long, row_id long, score double"


def top_k(rows: DataFrame, vector: Column, query: list[float], k: int, least: float | None = None, id_column: str = "vec_id") -> DataFrame:
    """(id, score) of the k rows most similar to one vector, ties by id."""
    scored = rows.select(id_column, cosine(vector, F.array(*[F.lit(float(x)) for x in query])).alias("score")).dropna()
    if least is not None:
        scored = scored.filter(F.col("score") > least)
    return scored.orderBy(F.desc("score"), id_column).limit(k)


def unit(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of length one; not a number for a zero vector or one with nulls."""
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(df: DataFrame, dim: int | None, id_column: str, vector: str, carried: Iterable[str] = ()) -> DataFrame:
    """id, vector and carried columns (as doubles) of the rows that have the first two, of that width."""
    kept = df.filter(F.col(vector).isNotNull() & F.col(id_column).isNotNull() & (F.size(vector) > 0 if dim is None else F.size(vector) == dim))
    return kept.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), *[F.col(c).cast("double").alias(c) for c in carried])


class Best:
    """The k best rows of each query so far, ties by id; all rows if k is None."""

    def __init__(self, k: int | None):
        self.k, self.parts, self.n = k, [], 0

    def add(self, scores: np.ndarray, query: np.ndarray, row: np.ndarray, least: float) -> None:
        """scores: queries x rows."""
        scores = np.where((query[:, None] != row[None, :]) & (scores > least), scores, -np.inf)
        if self.k is not None and scores.shape[1] > self.k:  # ties at the k-th place all stay for now
            scores[scores < np.partition(scores, -self.k, axis=1)[:, -self.k][:, None]] = -np.inf
        q, r = np.nonzero(np.isfinite(scores))
        self.parts.append((query[q], row[r], scores[q, r]))
        self.n += len(q)
        if self.k is not None and self.n > HELD:
            self.parts = [self.found()]
            self.n = len(self.parts[0][0])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, r, s = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        if self.k is None:
            return q, r, s
        order = np.lexsort((r, -s, q))
        q, r, s = q[order], r[order], s[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        return q[place < self.k], r[place < self.k], s[place < self.k]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in self.found()], names=["query_id", "row_id", "score"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


@dataclass
class Side:
    """Queries or rows of a tile: ids, vectors as given and of length one, and carried numbers by name (not a number for null)."""

    ids: np.ndarray
    vectors: np.ndarray
    units: np.ndarray
    carried: dict[str, np.ndarray]

    def part(self, which) -> Side:
        return Side(self.ids[which], self.vectors[which], self.units[which], {k: v[which] for k, v in self.carried.items()})

    def whole(self) -> Side:
        """Those with a direction: vectors of zero, nulls or infinities are in no pair."""
        return self.part(np.isfinite(self.units).all(1))


class Pairs:
    """Every pair of a query and another row: queries in blocks in the shared folder, rows by batches of tasks.

    `carried` columns hold numbers of both sides, read as doubles (whole numbers up to 2^53). Pickles without its tables.
    """

    def __init__(self, rows: DataFrame, queries: DataFrame, carried: Iterable[str] = (), id_column: str = "vec_id", vector: str = "embedding"):
        spark = rows.sparkSession
        self.carried, self.uri, self.sizes = list(carried), new_folder(spark, "query-blocks"), {}
        asked = written(usable(queries, None, id_column, vector, self.carried), "queries")
        first = asked.select(F.size("vector").alias("d")).first()
        self.dim = first.d if first else 0
        if first:
            self.sizes = _blocks(asked.filter(F.size("vector") == self.dim), self.uri, self.dim, self.carried)
        tasks = 2 * max(partitions(spark), spark.sparkContext.defaultParallelism)  # a file may come as one task, and a row is work with every query
        self.rows = usable(rows, self.dim, id_column, vector, self.carried).repartition(tasks, "id")

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "rows"}

    def blocks(self) -> list[Side]:
        d, out = self.dim, []
        for b, n in self.sizes.items():
            x, u = (mapped.get(f"{self.uri}/{what}-{b}", "<f8", n * d).reshape(n, d) for what in ("vectors", "units"))
            out.append(Side(mapped.get(f"{self.uri}/ids-{b}", "<i8", n), x, u, {c: mapped.get(f"{self.uri}/carried{k}-{b}", "<f8", n) for k, c in enumerate(self.carried)}))
        return out

    def side(self, batch: pa.RecordBatch) -> Side:
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, self.dim)
        return Side(batch.column(0).to_numpy(), x, unit(batch.column(1), self.dim), {c: batch.column(2 + k).to_numpy(zero_copy_only=False) for k, c in enumerate(self.carried)})

    def tiles(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Side, Side, np.ndarray]]:
        """Queries, rows, and which pairs of them (queries x rows) have different ids."""
        blocks = [b.part(slice(at, at + ASKED)).whole() for b in self.blocks() for at in range(0, len(b.ids), ASKED)]
        for batch in batches:
            rows = self.side(batch).whole()
            for block in blocks:
                step = max(1, TILE // max(1, len(block.ids)))
                for at in range(0, len(rows.ids), step):
                    own = rows.part(slice(at, at + step))
                    yield block, own, block.ids[:, None] != own.ids[None, :]

    def run(self, task: Callable[[Iterator[tuple[Side, Side, np.ndarray]]], Iterator[pa.RecordBatch]], fields: str) -> DataFrame:
        """What `task` makes of the tiles of each task."""

        def each(batches):
            yield from task(self.tiles(batches))

        return self.rows.mapInArrow(each, fields)

    def found(self, least: float = -2.0, keep: Callable[[], Callable[[Side, Side, np.ndarray, np.ndarray], np.ndarray]] | None = None) -> DataFrame:
        """(query_id, row_id, score, and both sides' carried columns as query_<name>, row_<name>) of every pair of cosine above `least`.

        keep: makes, once a task, what tells of a tile's scores and pairs so far which pairs a later step may need.
        """

        def task(tiles):
            chosen = keep() if keep else None
            for asked, own, apart in tiles:
                scores = asked.units @ own.units.T
                on = apart & (scores > least)
                q, r = np.nonzero(chosen(asked, own, scores, on) if chosen else on)
                if len(q):
                    sides = [pa.array(side.carried[c][at], from_pandas=True) for side, at in ((asked, q), (own, r)) for c in self.carried]
                    yield pa.RecordBatch.from_arrays([pa.array(asked.ids[q]), pa.array(own.ids[r]), pa.array(scores[q, r]), *sides], names=names)

        names = ["query_id", "row_id", "score", *[f"{side}_{c}" for side in ("query", "row") for c in self.carried]]
        return self.run(task, ", ".join([FOUND, *[f"`{n}` double" for n in names[3:]]]))


def _blocks(queries: DataFrame, uri: str, dim: int, carried: list[str]) -> dict[int, int]:
    """Writes blocks of queries; returns the rows of each."""
    count = max(1, -(-queries.count() // BLOCK))

    def write(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        table = table.sort_by("id")
        vectors = table["vector"].combine_chunks()
        mapped.put(f"{uri}/ids-{block}", 0, table["id"].to_numpy())
        mapped.put(f"{uri}/vectors-{block}", 0, vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
        mapped.put(f"{uri}/units-{block}", 0, unit(vectors, dim))
        for k, c in enumerate(carried):
            mapped.put(f"{uri}/carried{k}-{block}", 0, table[c].to_numpy())
        return pa.table({"block": pa.array([block], pa.int32()), "n": [table.num_rows]})

    dealt = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))
    return {r.block: r.n for r in dealt.groupBy("block").applyInArrow(write, "block int, n long").collect()}  # one small row a block


def search(rows: DataFrame, queries: DataFrame, k: int | None, least: float = -2.0, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, row_id, score, and rank unless k is None): for each query the k other rows of highest cosine above `least` (all, if k is None)."""
    pairs = Pairs(rows, queries, (), id_column, vector)
    if k is None:
        return pairs.found(least)

    def task(tiles):
        best = Best(k)
        for asked, own, _ in tiles:
            best.add(asked.units @ own.units.T, asked.ids, own.ids, least)
        yield best.batch()

    return ranked(pairs.run(task, FOUND), k)

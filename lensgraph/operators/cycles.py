"""Simple directed cycles of a bounded length, found over mapped compressed rows (csr): no path is ever shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensgraph.operators.csr import Csr, expanded
from lensgraph.shared import partitions

#: Edges along which a task lengthens its paths at once (a path's or a start's own at least), and cycles it looks at together.
STEPS = 1 << 19


def cycles(edges: DataFrame, most: int) -> DataFrame:
    """(length, nodes) of the simple directed cycles of 2 to `most` edges, each once, from its least node.

    A cycle of k edges is met in the middle: a path from its least node of the first half, rounded up, and one back to it of
    the rest. A task takes a range of least nodes. Only cycles, as numbers of nodes, are joined with the ids.
    """
    spark = edges.sparkSession
    links = edges.select("src", "dst")
    graph = Csr(links)
    back = Csr(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")), numbers=graph.numbers)
    tasks = 4 * max(partitions(spark), spark.sparkContext.defaultParallelism)

    def run(batches):
        out, into = [tuple(map(np.asarray, g.arrays())) for g in (graph, back)]
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for low, high in _blocks(out, into, int(numbers[0]), int(numbers[-1]) + 1):
                for path in _from_least(out, into, low, high, most):
                    flat, width = pa.array(path.ravel(), pa.int64()), path.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(path) + 1) * width, pa.int32()), flat)], names=["path"])

    found = spark.range(0, graph.n, 1, tasks).mapInArrow(run, "path array<long>")
    nodes = found.select("path", F.posexplode("path").alias("place", "number")).join(graph.numbers, "number")
    ids = F.array_sort(F.collect_list(F.struct("place", "id")))
    return nodes.groupBy("path").agg(ids.alias("ids")).select(F.size("path").alias("length"), F.col("ids.id").alias("nodes"))


def _blocks(out: tuple, into: tuple, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Ranges of starts from low to high with about STEPS paths of two edges ahead and back, or of one start."""
    paths = np.ones(high - low, np.int64)
    for starts, targets in (out, into):
        to = targets[starts[low] : starts[high]]
        sums = np.concatenate([[0], np.cumsum(starts[to + 1] - starts[to])])
        paths += np.diff(sums[starts[low : high + 1] - starts[low]])
    ends, a = np.cumsum(paths), 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEPS, "right")))
        yield low + a, low + b
        a = b


def _longer(rows: tuple, paths: np.ndarray) -> Iterator[np.ndarray]:
    """Paths with one more node, above the first and on no path twice; the last node is followed along `rows`, a piece of paths at a time."""
    starts, targets = rows
    ends, a = np.cumsum(starts[paths[:, -1] + 1] - starts[paths[:, -1]]), 0
    while a < len(paths):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEPS, "right")))
        which, to = expanded(starts, targets, paths[a:b, -1])
        keep = np.flatnonzero(to > paths[a:b, 0][which])
        which, to = which[keep], to[keep]
        longer = np.column_stack([paths[a:b][which], to])
        yield longer[(longer[:, 1:-1] != to[:, None]).all(1)]
        a = b


def _from_least(out: tuple, into: tuple, low: int, high: int, most: int) -> Iterator[np.ndarray]:
    """The cycles whose least node is in a range, as rows of nodes, an array a length and piece."""
    begin = np.arange(low, high, dtype=np.int64)[:, None]
    backs, held = {}, begin
    for j in range(1, most // 2 + 1):
        held = np.concatenate([held[:0, :0].reshape(0, j + 1), *_longer(into, held)])
        keys = held[:, 0] * (len(out[0]) - 1) + held[:, -1]
        order = np.argsort(keys, kind="stable")
        backs[j] = keys[order], held[order]

    def walk(paths: np.ndarray, i: int) -> Iterator[np.ndarray]:
        for longer in _longer(out, paths):
            for j in (i - 1, i):
                if 1 <= j and i + j <= most:
                    yield from _met(longer, *backs[j], len(out[0]) - 1)
            if i < (most + 1) // 2:
                yield from walk(longer, i + 1)

    return walk(begin, 1)


def _met(paths: np.ndarray, keys: np.ndarray, backs: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Cycles of a path ahead and a path back (from the start, its nodes as they are come upon) that end at the same node and share no other."""
    own = paths[:, 0] * n + paths[:, -1]
    first = np.searchsorted(keys, own, "left")
    count = np.searchsorted(keys, own, "right") - first
    paths, first, count = paths[count > 0], first[count > 0], count[count > 0]
    ends, a = np.cumsum(count), 0
    while a < len(paths):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEPS, "right")))
        which = np.repeat(np.arange(a, b), count[a:b])
        place = np.arange(len(which)) - np.repeat(np.cumsum(count[a:b]) - count[a:b], count[a:b]) + first[which]
        ahead, rest = paths[which], backs[place, 1:-1][:, ::-1]
        apart = (ahead[:, :, None] != rest[:, None, :]).all((1, 2))
        if apart.any():
            yield np.concatenate([ahead[apart], rest[apart]], 1)
        a = b

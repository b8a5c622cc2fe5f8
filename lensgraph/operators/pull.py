"""Rounds over a mapped graph: every node pulls what its neighbours hold.

The compressed rows of a graph (csr) are written once. A node's state is a place in an array of the shared folder; in a
round each task takes a range of nodes, reads the arrays of the round before and writes its stretch of the new ones. So a
round shuffles nothing but one row of totals a range, and a task's memory is the stretch and a bounded piece of edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensgraph import mapped
from lensgraph.operators.csr import Csr, numbered
from lensgraph.shared import new_folder, partitions

#: Edges that a task holds at once (a node's own edges at least).
EDGES = 1 << 20


def pieces(starts: np.ndarray, low: int, high: int, most: int = 0) -> Iterator[tuple[int, int]]:
    """Ranges of nodes from low to high of at most `most` (EDGES) edges each, or of one node."""
    while low < high:
        end = min(high, max(low + 1, int(np.searchsorted(starts[: high + 1], starts[low] + (most or EDGES), "right")) - 1))
        yield low, end
        low = end


def reduced(ufunc: np.ufunc, values: np.ndarray, counts: np.ndarray, empty) -> np.ndarray:
    """`ufunc` over consecutive stretches of `values` of these lengths; `empty` for stretches of none."""
    out, has = np.full((len(counts), *values.shape[1:]), empty, values.dtype), counts > 0
    if has.any():
        out[has] = ufunc.reduceat(values, (np.cumsum(counts) - counts)[has], axis=0)
    return out


class Pull:
    """The state arrays of one run over the nodes of `graph`."""

    def __init__(self, graph: Csr, ranges: int | None = None):
        self.graph, self.spark = graph, graph.numbers.sparkSession
        self.uri, self.now = new_folder(self.spark, "pull"), -1
        count = max(1, min(graph.n, ranges or max(partitions(self.spark), self.spark.sparkContext.defaultParallelism)))
        self.cuts = [graph.n * k // count for k in range(count + 1)]

    def over(self, step: Callable, size: int) -> list[float]:
        """Sums over all ranges of the `size` numbers that step(low, high) returns."""
        cuts = self.cuts

        def run(batches):
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in map(float, step(cuts[k], cuts[k + 1]))], names=[f"t{i}" for i in range(size)])

        tasks = self.spark.range(0, len(cuts) - 1, 1, len(cuts) - 1)
        sums = tasks.mapInArrow(run, ", ".join(f"t{i} double" for i in range(size))).agg(*[F.sum(f"t{i}") for i in range(size)])
        return [v or 0.0 for v in sums.first()]

    def round(self, kind: str, step: Callable, size: int = 1) -> list[float]:
        """Writes the next array, of type `kind`; step(starts, targets, before, low, high) gives a stretch of it and `size` totals."""
        graph, uri, now = self.graph, self.uri, self.now

        def task(low: int, high: int):
            starts, targets = graph.arrays()
            before = mapped.get(f"{uri}/{now}", kind, graph.n) if now >= 0 else None
            values, totals = step(starts, targets, before, low, high)
            mapped.put(f"{uri}/{now + 1}", low, np.ascontiguousarray(values, kind))
            return totals

        totals = self.over(task, size) if graph.n else [0.0] * size
        self.now += 1
        if self.now > 1:
            mapped.drop(f"{uri}/{self.now - 2}")
        return totals

    def table(self, kind: str, name: str, sql: str) -> DataFrame:
        """(id, name): the last array with the ids of the nodes."""
        uri, now, n = self.uri, self.now, self.graph.n

        def told(batches):
            values = mapped.get(f"{uri}/{now}", kind, n)
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values[batch.column(1).to_numpy()])], names=["id", name])

        ids = self.graph.numbers.schema["id"].dataType.simpleString()
        return self.graph.numbers.select("id", "number").mapInArrow(told, f"id {ids}, {name} {sql}")


def put_column(rows: DataFrame, uri: str, kind: str) -> None:
    """Writes the array of (number, value), where the numbers are 0, 1, 2, ... each once."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                mapped.put(uri, batch.column(0)[0].as_py(), batch.column(1).to_numpy().astype(kind))
        yield pa.RecordBatch.from_pydict({"n": pa.array([], pa.int64())})

    parts = partitions(rows.sparkSession)
    rows.select("number", "value").repartitionByRange(parts, "number").sortWithinPartitions("number").mapInArrow(run, "n long").count()


def least_labels(nodes: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """See messages.least_labels; a label is the number of a node, in the order of ids."""
    graph = Csr(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), numbers=numbered(nodes))
    run = Pull(graph)

    def step(starts, targets, before, low, high):
        if before is None:
            return np.arange(low, high), [high - low]
        out = np.array(before[low:high])
        for a, b in pieces(starts, low, high):
            least = reduced(np.minimum, before[targets[starts[a] : starts[b]]], np.diff(starts[a : b + 1]), np.iinfo(np.int32).max)
            np.minimum(out[a - low : b - low], least, out=out[a - low : b - low])
        return out, [(out < before[low:high]).sum()]

    moved = run.round("<i4", step)[0]
    while moved and rounds:
        moved, rounds = run.round("<i4", step)[0], rounds - 1
    label = run.table("<i4", "label", "int").withColumnRenamed("label", "number")
    return label.join(graph.numbers.withColumnRenamed("id", "label"), "number").select("id", "label")


def _raised(starts, targets, weights, values, low, high) -> np.ndarray:
    """Weighted sums of the neighbours' values of a range of nodes."""
    out = np.zeros(high - low)
    for a, b in pieces(starts, low, high):
        cut = slice(starts[a], starts[b])
        out[a - low : b - low] = reduced(np.add, weights[cut] * values[targets[cut]], np.diff(starts[a : b + 1]), 0.0)
    return out


def centrality(nodes: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """See messages.centrality."""
    into = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").cast("double").alias("weight"))
    graph = Csr(into, weight="weight", numbers=numbered(nodes), loops=True)
    run, size = Pull(graph), 0.0
    for k in range(rounds + 1):

        def step(starts, targets, before, low, high, norm=size):
            if before is None:
                return np.ones(high - low), [high - low]
            out = _raised(starts, targets, graph.weights(), before, low, high) / norm if norm else np.full(high - low, np.nan)
            return out, [(out * out).sum()]

        size = run.round("<f8", step)[0] ** 0.5
    size = size or 1.0
    return run.table("<f8", "value", "double").select("id", F.nullif(F.col("value"), F.lit(float("nan"))).alias("value")).withColumn("value", F.col("value") / F.lit(size))


def power_iteration(edges: DataFrame, rounds: int, tolerance: float) -> DataFrame:
    """See graph.power_iteration."""
    graph = Csr(edges.withColumn("weight", F.col("weight").cast("double")), weight="weight", loops=True, both=True)
    run, sizes, root = Pull(graph), [1.0], max(1, graph.n) ** 0.5
    run.round("<f8", lambda starts, targets, before, low, high: (np.full(high - low, 1 / root), [0.0]))
    for _ in range(rounds if graph.n else 0):
        last = sizes[-1]

        def step(starts, targets, before, low, high, last=last):
            out = _raised(starts, targets, graph.weights(), before, low, high) / last
            return out, [(out * out).sum()]

        sizes.append(run.round("<f8", step)[0] ** 0.5)
        if not sizes[-1]:
            break
        uri, now, n, size = run.uri, run.now, graph.n, sizes[-1]

        def moved(low, high, uri=uri, now=now, n=n, size=size, last=last):
            new, old = (mapped.get(f"{uri}/{k}", "<f8", n)[low:high] for k in (now, now - 1))
            return [((new / size - old / last) ** 2).sum()]

        if run.over(moved, 1)[0] ** 0.5 < tolerance:
            break
    return run.table("<f8", "value", "double").withColumn("value", F.try_divide("value", F.lit(sizes[-1])))


def label_propagation(edges: DataFrame, rounds: int) -> DataFrame:
    """See graph.label_propagation."""
    graph = Csr(edges, both=True)
    run = Pull(graph)

    def step(starts, targets, before, low, high):
        if before is None:
            return np.arange(low, high), [0]
        out = np.array(before[low:high])
        for a, b in pieces(starts, low, high):
            key = (np.repeat(np.arange(b - a, dtype=np.int64), np.diff(starts[a : b + 1])) << 32) | before[targets[starts[a] : starts[b]]]
            key.sort()
            first = np.flatnonzero(np.diff(key, prepend=-1))
            votes, row, label = np.diff(np.append(first, len(key))), key[first] >> 32, key[first] & 0xFFFFFFFF
            best = (votes << 32) | (0xFFFFFFFF - label)  # the most votes, then the least label
            at = np.flatnonzero(np.diff(row, prepend=-1))
            if len(at):
                out[a - low + row[at]] = 0xFFFFFFFF - (np.maximum.reduceat(best, at) & 0xFFFFFFFF)
        return out, [0]

    for _ in range(rounds + 1):
        run.round("<i4", step)
    label = run.table("<i4", "label", "int").withColumnRenamed("label", "number")
    return label.join(graph.numbers.withColumnRenamed("id", "label"), "number").select("id", "label")


def greedy_colors(edges: DataFrame, order: DataFrame) -> DataFrame:
    """(id, color): see graph.coloring. order: (id, number), the place of each node."""
    graph = Csr(edges, numbers=order, both=True, distinct=False)
    run = Pull(graph, 2 * order.sparkSession.sparkContext.defaultParallelism)

    def step(starts, targets, before, low, high):
        own = np.zeros(high - low, np.int32) if before is None else np.array(before[low:high])
        if before is None:
            before = np.zeros(graph.n, np.int32)
        colored(starts, targets, before, own, low)
        return own, [(own == 0).sum()]

    while graph.n and run.round("<i4", step)[0]:
        pass
    return run.table("<i4", "color", "int")


def _some(starts: np.ndarray, nodes: np.ndarray) -> Iterator[np.ndarray]:
    """Stretches of `nodes` with at most EDGES edges each, or of one node."""
    ends, at = np.cumsum(starts[nodes + 1] - starts[nodes]), 0
    while at < len(nodes):
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + EDGES, "right")))
        yield nodes[at:end]
        at = end


def colored(starts: np.ndarray, targets: np.ndarray, before: np.ndarray, own: np.ndarray, low: int) -> None:
    """Colors in `own`, the range from `low` on, every node whose earlier neighbours have a color, in `before` or by now.

    Each edge of an open node is looked at twice: nodes are colored as soon as none of their earlier neighbours waits.
    """
    from lensgraph.operators.csr import expanded

    size, blocked, ends = len(own), np.zeros(len(own), bool), []
    todo = np.flatnonzero(own == 0)
    for some in _some(starts, todo + low):
        which, to = expanded(starts, targets, some)
        node = some[which]
        early = to < node
        node, to = node[early], to[early]
        outer = to < low
        blocked[node[outer][before[to[outer]] == 0] - low] = True
        node, to = node[~outer] - low, to[~outer] - low
        open_ = own[to] == 0
        ends.append((to[open_].astype(np.int32), node[open_].astype(np.int32)))
    first = np.concatenate([e[0] for e in ends]) if ends else np.zeros(0, np.int32)
    later = np.concatenate([e[1] for e in ends]) if ends else np.zeros(0, np.int32)
    del ends
    wait = np.bincount(later, minlength=size)
    turn = np.argsort(first, kind="stable")
    later, bound = later[turn], np.searchsorted(first[turn], np.arange(size + 1))
    front = todo[(wait[todo] == 0) & ~blocked[todo]]
    while len(front):
        for some in _some(starts, front + low):
            which, to = expanded(starts, targets, some)
            early = to < some[which]
            which, to = which[early], to[early]
            near = np.where(to < low, before[to], own[np.maximum(to - low, 0)])
            own[some - low] = _least_free(which, near, len(some))
        _, after = expanded(bound, later, front)
        np.subtract.at(wait, after, 1)
        front = np.unique(after[(wait[after] == 0) & ~blocked[after]]).astype(np.int64)


def _least_free(which: np.ndarray, colors: np.ndarray, size: int) -> np.ndarray:
    """For each of `size` nodes the least color, from 1, that no row (which, color) names; `which` ascends. 64 colors at a time."""
    out, base = np.zeros(size, np.int32), 0
    while not out.all():
        fits = (colors > base) & (colors <= base + 64)
        bits = np.uint64(1) << (colors[fits] - 1 - base).astype(np.uint64)
        free = ~reduced(np.bitwise_or, bits, np.bincount(which[fits], minlength=size), 0)
        found = (out == 0) & (free != 0)
        lowest = free & (~free + np.uint64(1))
        out[found] = base + 1 + np.bitwise_count(lowest[found] - np.uint64(1)).astype(np.int32)
        base += 64
    return out

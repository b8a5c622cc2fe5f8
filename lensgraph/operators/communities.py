"""Louvain communities: local moves by modularity gain, then contraction, level by level until the gain stops.

All nodes whose turn it is move at once, each to the neighbouring community that gains most (the least of equals); turns go
by a hash of node and round, so that two nodes do not swap places for ever. A round keeps its partition only as part of a
level, and a level stands only if modularity grew by it.

A level's links are arrays in the shared folder, a range of nodes apiece, and each round's communities one array beside them: a
task maps both and moves the nodes of its ranges, so that a round shuffles nothing. A task holds a few numbers a node and the
links of a range. Ids are numbered once: a level's communities are numbered in their order by every task for itself, and the
links between them are summed within ranges, shuffled once by ranges and summed again.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensgraph import mapped
from lensgraph.operators import csr, pull
from lensgraph.shared import Scratch, delete, new_folder, partitions

ROUNDS, GAIN = 12, 1e-6
#: Links of a range of nodes, about.
RANGE = 1 << 19


class _Level:
    """Moves of one level. links: a, b, w in both orders, loops once with all their weight, repeated ones to be added.

    Nodes are numbered in the order of their ids: those of links, or the `n` of the sorted array `uri`/ids that is there already.
    """

    def __init__(self, links: DataFrame, total: float, uri: str | None = None, n: int = 0):
        self.spark, self.total = links.sparkSession, total
        if uri is None:
            uri, numbers = new_folder(self.spark, "louvain"), csr.numbered(links.select(F.col("a").alias("id")))
            pull.put_column(numbers.select("number", F.col("id").alias("value")), f"{uri}/ids", "<i8")
            n = numbers.count()
        if n >= 1 << 31:
            raise ValueError("more nodes than 31 bits name")
        self.uri, self.n = uri, n

        def store(batches):
            """Links of one range, in order and each once; the degrees and loops of its nodes."""
            batches = [b for b in batches if b.num_rows]
            if not batches:
                return
            ids = mapped.get(f"{uri}/ids", "<i8", n)
            s, d = (np.concatenate([np.searchsorted(ids, b.column(k).to_numpy()) for b in batches]) for k in (0, 1))
            s, d, w = _summed(s, d, np.concatenate([b.column(2).to_numpy() for b in batches]))
            low, high = int(s[0]), int(s[-1]) + 1  # every node has links, and all of them here
            degrees, inner = np.bincount(s - low, w, high - low), s == d
            loops = np.bincount(s[inner] - low, w[inner], high - low)
            mapped.put(f"{uri}/degrees", low, degrees.astype("<f8"))
            mapped.put(f"{uri}/loops", low, loops.astype("<f8"))
            for name, values in (("owners", s.astype("<i4")), ("targets", d.astype("<i4")), ("weights", w.astype("<f8"))):
                mapped.put(f"{uri}/{name}-{low}", 0, values[~inner])
            share = float((loops / total - (degrees / total) ** 2).sum())
            yield pa.RecordBatch.from_pydict({"low": [low], "high": [high], "links": [int((~inner).sum())], "quality": [share]})

        count = max(1, -(-max(links.count(), n) // RANGE))
        ranges = links.select("a", "b", F.col("w").cast("double")).repartitionByRange(count, "a")
        found = sorted(ranges.mapInArrow(store, "low long, high long, links long, quality double").collect())  # one row a range
        self.parts = [(r.low, r.high, r.links) for r in found]
        self.ranges, self.tasks = len(found), min(len(found), 2 * self.spark.sparkContext.defaultParallelism)
        #: Modularity with each node for itself.
        self.quality = sum(r.quality for r in found)

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "spark"}

    def at(self, number: int) -> np.ndarray:
        """The communities of all nodes after so many rounds."""
        return mapped.get(f"{self.uri}/at-{number}", "<i4", self.n) if number else np.arange(self.n, dtype=np.int32)

    def links(self, k: int) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
        """Of range k: first node and the one after the last, and owner, target and weight of its links (loops apart)."""
        low, high, size = self.parts[k]
        return low, high, *(np.asarray(mapped.get(f"{self.uri}/{name}-{low}", kind, size)) for name, kind in (("owners", "<i4"), ("targets", "<i4"), ("weights", "<f8")))

    def over(self, task, fields: str) -> DataFrame:
        """What `task` makes of the ranges that come to it."""

        def run(batches):
            for columns in task(k for batch in batches for k in batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

        names = [f.split()[0] for f in fields.split(", ")]
        return self.spark.range(0, self.ranges, 1, self.tasks).mapInArrow(run, fields)

    def moved(self, number: int) -> int:
        """Writes the communities after a round, and tells how many nodes moved."""

        def task(ranges):
            at = np.asarray(self.at(number))
            degree, ids = (np.asarray(mapped.get(f"{self.uri}/{name}", kind, self.n)) for name, kind in (("degrees", "<f8"), ("ids", "<i8")))
            size = np.bincount(at, degree, self.n)
            for k in ranges:
                low, high, owner, to, w = self.links(k)
                own, now = np.arange(low, high), at[low:high].copy()
                node, c, near = _summed(np.append(owner, own), np.append(at[to], now), np.append(w, np.zeros(len(own))))
                here = c == at[node]
                gain = np.round(near - degree[node] * (size[c] - np.where(here, degree[node], 0.0)) / self.total, 9)
                first = np.flatnonzero(np.diff(node, prepend=-1))
                most = np.maximum.reduceat(gain, first)
                best = np.flatnonzero(gain == np.repeat(most, np.diff(first, append=len(node))))
                best = best[np.flatnonzero(np.diff(node[best], prepend=-1))]  # the least of equals; one of each a node, as `here`
                better = np.flatnonzero(most > gain[here])
                turn = np.array([zlib.crc32(b"%d:%d" % (i, number)) % 2 == 0 for i in ids[low + better].tolist()], bool)
                now[better[turn]] = c[best[better[turn]]]
                mapped.put(f"{self.uri}/at-{number + 1}", low, now.astype("<i4"))
                yield [[int(turn.sum())]]

        return self.over(task, "moved long").agg(F.sum("moved")).first()[0]

    def run(self) -> int:
        """Rounds made, until neither half moves."""
        still = 0
        for number in range(ROUNDS):
            still = 0 if self.moved(number) else still + 1
            if number > 1:
                mapped.drop(f"{self.uri}/at-{number - 1}")
            if still == 2:
                break
        return number + 1

    def communities(self, number: int) -> DataFrame:
        """(id, community)."""

        def task(ranges):
            at, ids = self.at(number), mapped.get(f"{self.uri}/ids", "<i8", self.n)
            for k in ranges:
                low, high, _ = self.parts[k]
                yield ids[low:high], ids[at[low:high]]

        return self.over(task, "id long, community long")

    def pieces(self, number: int) -> DataFrame:
        """(a, b, w): links between communities, in both orders, loops once, summed within ranges."""

        def task(ranges):
            at, ids, loops = self.at(number), mapped.get(f"{self.uri}/ids", "<i8", self.n), mapped.get(f"{self.uri}/loops", "<f8", self.n)
            for k in ranges:
                low, high, owner, to, w = self.links(k)
                own = np.flatnonzero(loops[low:high]) + low
                ca, cb, sums = _summed(at[np.append(owner, own)], at[np.append(to, own)], np.append(w, loops[own]))
                yield ids[ca], ids[cb], sums

        return self.over(task, "a long, b long, w double")

    def contracted(self, number: int) -> DataFrame:
        """(ca, cb, w): links between communities, in both orders, loops once."""
        return self.pieces(number).groupBy(F.col("a").alias("ca"), F.col("b").alias("cb")).agg(F.sum("w").alias("w"))

    def above(self, number: int) -> _Level:
        """The level whose nodes are the communities after so many rounds; `uri`/above holds each node's number there."""
        uri = new_folder(self.spark, "louvain")

        def task(ranges):
            at, ids = np.asarray(self.at(number)), mapped.get(f"{self.uri}/ids", "<i8", self.n)
            used = np.zeros(self.n, bool)
            used[at] = True
            place = np.cumsum(used, dtype=np.int32) - 1
            for k in ranges:
                low, high, _ = self.parts[k]
                mapped.put(f"{self.uri}/above", low, place[at[low:high]].astype("<i4"))
                if len(own := np.flatnonzero(used[low:high]) + low):
                    mapped.put(f"{uri}/ids", int(place[own[0]]), ids[own].astype("<i8"))
                yield [[len(own)]]

        n = self.over(task, "n long").agg(F.sum("n")).first()[0]
        held = Scratch(self.spark, "contracted")
        level = _Level(held.written(self.pieces(number)), self.total, uri, n)
        held.drop()
        return level

    def forget(self) -> None:
        """Deletes the links, which nothing reads any more."""
        for low, *_ in self.parts:
            for name in ("owners", "targets", "weights"):
                mapped.drop(f"{self.uri}/{name}-{low}")


def _summed(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of numbers below 2^31 in order, with the sums of their weights."""
    if not len(a):
        return a, b, w
    key = a.astype(np.int64) << 31 | b
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    key = key[first]
    return key >> 31, key & ((1 << 31) - 1), np.add.reduceat(w[order], first)


def louvain(edges: DataFrame, gain: float = GAIN) -> DataFrame:
    """(id, community) of every node of the undirected graph of edges (src, dst, weight); a community is named by a number of its nodes.

    Ids are whole numbers. Weights of one pair are summed, in either order; loops count twice, as usual.
    """
    pairs = edges.dropna(subset=["src", "dst"]).groupBy(F.least("src", "dst").cast("long").alias("a"), F.greatest("src", "dst").cast("long").alias("b")).agg(F.sum(F.coalesce("weight", F.lit(0)).cast("double")).alias("w")).filter("w > 0")
    ends = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", (2 * F.col("w")).alias("w")))).otherwise(F.array(F.struct("a", "b", "w"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    held = Scratch(edges.sparkSession, "links")
    links = held.written(pairs.select(F.explode(ends).alias("e")).select("e.*"))
    total = links.agg(F.sum("w")).first()[0] or 0.0
    if not total:
        return links.select(F.col("a").alias("id"), F.col("a").alias("community"))
    first = level = _Level(links, total)
    held.drop()
    below = []
    while True:
        new = level.above(level.run())
        if new.quality - level.quality < gain:
            delete(edges.sparkSession, new.uri)
            break
        level.forget()
        below.append((f"{level.uri}/above", level.n))
        level = new
    n, ids, names, size = first.n, f"{first.uri}/ids", f"{level.uri}/ids", level.n
    cuts = [n * k // partitions(edges.sparkSession) for k in range(partitions(edges.sparkSession) + 1)]

    def told(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                at = np.arange(cuts[k], cuts[k + 1])
                for uri, nodes in below:
                    at = mapped.get(uri, "<i4", nodes)[at]
                yield pa.RecordBatch.from_arrays([pa.array(mapped.get(ids, "<i8", n)[cuts[k] : cuts[k + 1]]), pa.array(mapped.get(names, "<i8", size)[at])], names=["id", "community"])

    return edges.sparkSession.range(0, len(cuts) - 1, 1, len(cuts) - 1).mapInArrow(told, "id long, community long")

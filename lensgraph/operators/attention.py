"""Scaffolded attention without a row per pair: A o S + lambda S over values, S being 1 on edges and epsilon elsewhere.

With raw attention A = q.k, everything that is not an edge is epsilon times a term that factors: the sum over all nodes of
k v' (width x width) and of v. So a node's output is its edges' part, weighted 1 - epsilon, plus that term: edges and
nodes are read once each, and no n x n matrix exists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensgraph.shared import written


def scaffolded(nodes: DataFrame, edges: DataFrame, epsilon: float, weight: float) -> DataFrame:
    """(id, output): sum over j of (q_i.k_j + weight) S_ij v_j of every node; S_ii is epsilon unless (i, i) is an edge.

    nodes: id, q, k, v (arrays of one width each for q and k, and for v); edges: src, dst, repeats counting once. Rows with
    a null array or another width than the first are left out.
    """
    kept = nodes.select("id", *[F.col(c).cast("array<double>").alias(c) for c in "qkv"]).dropna()
    first = kept.select(F.size("k").alias("d"), F.size("v").alias("w")).first()
    d, w = (first.d, first.w) if first else (1, 1)
    kept = written(kept.filter((F.size("q") == d) & (F.size("k") == d) & (F.size("v") == w)), "nodes")
    flat = lambda c, n: c.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)

    def total(batches):
        moment, ones = np.zeros((d, w)), np.zeros(w)
        for batch in batches:
            k, v = flat(batch.column(0), d), flat(batch.column(1), w)
            moment, ones = moment + k.T @ v, ones + v.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([moment.ravel().tolist()]), pa.array([ones.tolist()])], names=["moment", "ones"])

    moment, ones = np.zeros((d, w)), np.zeros(w)
    for r in kept.select("k", "v").mapInArrow(total, "moment array<double>, ones array<double>").toLocalIterator():  # one row a task
        moment, ones = moment + np.array(r.moment).reshape(d, w), ones + np.array(r.ones)

    def along(batches):
        for batch in batches:
            q, k, v = flat(batch.column(1), d), flat(batch.column(2), d), flat(batch.column(3), w)
            out = ((1 - epsilon) * ((q * k).sum(1) + weight))[:, None] * v
            # edges of a node in a batch are added up before they are shuffled
            ids, where = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            sums = np.zeros((len(ids), w))
            np.add.at(sums, where, out)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, w)), pa.array(np.tile(np.arange(w), len(ids)), pa.int32()), pa.array(sums.ravel())], names=["id", "place", "value"])

    def rest(batches):
        for batch in batches:
            out = epsilon * (flat(batch.column(1), d) @ moment + weight * ones)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), w)), pa.array(np.tile(np.arange(w), len(out)), pa.int32()), pa.array(out.ravel())], names=["id", "place", "value"])

    links = edges.select("src", "dst").dropna().distinct()
    queries, keys = kept.select(F.col("id").alias("src"), "q"), kept.select(F.col("id").alias("dst"), "k", "v")
    met = links.join(queries, "src").join(keys, "dst").select(F.col("src").alias("id"), "q", "k", "v")
    fields = "id long, place int, value double"
    parts = met.mapInArrow(along, fields).unionByName(kept.select("id", "q").mapInArrow(rest, fields))
    sums = parts.groupBy("id", "place").agg(F.sum("value").alias("value"))
    return sums.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("output"))

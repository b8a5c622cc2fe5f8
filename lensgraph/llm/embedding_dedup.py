"""Embedding near-duplicates: random-hyperplane signs in several tables, exact cosines, connected components.

Equal vectors are one class first. In each table a class has a code, the signs of its products with that table's
hyperplanes; a row for the shuffle holds the code and the vector's components as they were given. Classes with one code
are compared by exact double-precision cosine, in blocks: a code with many classes is cut into blocks of about BLOCK
classes, and every pair of its blocks is one group, so that no task holds a whole code and none is capped. A pair is
counted in the first table where it meets; the codes of the tables before are computed again from the vectors. A group
returns, per class, the vectors it links with and an edge to the least class it hangs together with, never the pairs.

The number of signs follows the number of classes (about BUCKET classes a code), and the number of tables follows the
signs, so that a pair at the threshold meets with probability RECALL in at least one table.

Edge cases: a null or zero vector, and one with null or non-finite components, links with nothing; vectors of unlike
lengths are never compared; rows equal in id and components are one vector, rows of one id with unlike components are
vectors of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensgraph.operators.components import connected_components
from lensgraph.shared import written

BLOCK, BUCKET, RECALL, SEED = 2048, 512, 0.995, 20240607
#: Rows compared at once with a whole group.
STRIPE = 256


def plan(classes: int, threshold: float) -> tuple[int, int]:
    """Signs in a code, and tables."""
    signs = max(4, min(24, math.ceil(math.log2(max(1, classes) / BUCKET))))
    meet = (1 - math.acos(threshold) / math.pi) ** signs
    return signs, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - meet)))


def classes_of(rows: DataFrame) -> DataFrame:
    """(cls, part, embedding, copies): distinct usable vectors with their number of ids; the least vec_id and a hash of
    the components name a class."""
    v = F.col("embedding")
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    held = rows.filter(usable & F.col("vec_id").isNotNull()).groupBy("embedding").agg(F.min("vec_id").alias("cls"), F.count_distinct("vec_id").alias("copies"))
    return held.select("cls", F.xxhash64("embedding").alias("part"), "embedding", "copies")


def unit(x: np.ndarray) -> np.ndarray:
    """Rows as doubles of length one."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def codes(x: np.ndarray, signs: int, tables: int) -> np.ndarray:
    """Codes of unit vectors in the first tables; a table's planes depend on its number and the length alone."""
    dim = x.shape[1]
    planes = np.concatenate([np.random.default_rng([SEED, dim, t]).standard_normal((dim, signs)) for t in range(tables)], axis=1)
    bits = (x @ planes > 0).reshape(len(x), tables, signs)
    return (bits.astype(np.int64) << np.arange(signs)).sum(2)


def coded(classes: DataFrame, signs: int, tables: int) -> DataFrame:
    """One row per class and table: table, dim, code, cls, part, copies, vector (the components' bytes)."""
    width = "<f4" if classes.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"

    def run(batches):
        for batch in batches:
            ids, parts, copies = (batch.column(k).to_numpy() for k in (0, 1, 2))
            lists = batch.column(3)
            sizes = np.diff(np.asarray(lists.offsets))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(width)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                x = np.ascontiguousarray(flat[starts[at][:, None] + np.arange(dim)])
                code = codes(unit(x), signs, tables)
                ends = np.arange(len(at) + 1, dtype=np.int32) * np.int32(dim * x.itemsize)
                vectors = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(x)])
                for t in range(tables):
                    cols = [pa.array(np.full(len(at), t, np.int32)), pa.array(np.full(len(at), dim, np.int32)), pa.array(code[:, t]), pa.array(ids[at]), pa.array(parts[at]), pa.array(copies[at]), vectors]
                    yield pa.RecordBatch.from_arrays(cols, names=["table", "dim", "code", "cls", "part", "copies", "vector"])

    return classes.select("cls", "part", "copies", "embedding").mapInArrow(run, "table int, dim int, code long, cls long, part long, copies long, vector binary")


def blocked(codes: DataFrame) -> DataFrame:
    """Deals each code's classes into blocks, and each block into the groups of its pairs of blocks."""
    key = ["table", "dim", "code"]
    sizes = codes.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    rows = codes.join(sizes, key).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cls", "part", "table"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(*key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "part", "copies", "vector")


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each node's connected set, for pairs (a, b) of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compared(groups: DataFrame, signs: int, threshold: float) -> DataFrame:
    """Per group and class with a link: the class, links (vectors of other classes), the least class it hangs together with."""

    def run(table: pa.Table) -> pa.Table:
        t, i, j = (table[c][0].as_py() for c in ("table", "i", "j"))
        dim = table["dim"][0].as_py()
        order = np.lexsort((table["part"].to_numpy(), table["cls"].to_numpy()))
        cls, part, copies, own = (table[c].to_numpy()[order] for c in ("cls", "part", "copies", "own"))
        raw = b"".join(table["vector"].to_pylist())
        x = unit(np.frombuffer(raw, f"<f{len(raw) // (len(order) * dim)}").reshape(-1, dim)[order])
        earlier = codes(x, signs, t) if t else np.zeros((len(x), 0), np.int64)
        links, label = np.zeros(len(x), np.int64), np.arange(len(x))
        for s in range(0, len(x), STRIPE):
            a, b = np.nonzero(x[s : s + STRIPE] @ x[s:].T >= threshold)
            a, b = a + s, b + s
            keep = a < b
            if i != j:
                keep &= own[a] != own[b]
            a, b = a[keep], b[keep]
            for k in range(t):  # met in an earlier table
                fresh = earlier[a, k] != earlier[b, k]
                a, b = a[fresh], b[fresh]
            links += np.bincount(a, copies[b], len(x)).astype(np.int64) + np.bincount(b, copies[a], len(x)).astype(np.int64)
            label = _components(len(x), np.concatenate([a, np.arange(len(x))]), np.concatenate([b, label]))
        hit = links > 0
        to = label[hit]
        return pa.table({"cls": cls[hit], "part": part[hit], "links": links[hit], "to_cls": cls[to], "to_part": part[to]})

    return groups.groupBy("table", "dim", "code", "i", "j").applyInArrow(run, "cls long, part long, links long, to_cls long, to_part long")


def near_duplicates(rows: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding)."""
    rows = rows.select(F.col("vec_id").cast("long"), "embedding")
    classes = written(classes_of(rows), "classes")
    signs, tables = plan(classes.count(), threshold)
    found = written(compared(blocked(written(coded(classes, signs, tables), "codes")), signs, threshold), "found")
    links = found.groupBy("cls", "part").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.struct("cls", "part").alias("a"), F.struct(F.col("to_cls").alias("cls"), F.col("to_part").alias("part")).alias("b")).distinct())
    parts = parts.select("node.cls", "node.part", F.col("component.cls").alias("component"))
    known = classes.join(links, ["cls", "part"], "left").join(parts, ["cls", "part"], "left")
    known = known.select(F.col("embedding").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "cls").alias("component"))
    out = rows.join(known, F.col("embedding") == F.col("v"), "left")
    own = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))


def op10(rows: DataFrame) -> DataFrame:
    """All vectors, a cosine of 0.9."""
    return near_duplicates(rows, 0.9)

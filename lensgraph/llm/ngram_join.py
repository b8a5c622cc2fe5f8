"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. The document frequency of every word shingle is counted exactly, by hash, in shards; shingles of two documents or
   more are kept as sorted arrays that workers map.
2. A document's set is ordered by (frequency, hash). Two sets can only reach the threshold if they share a shingle
   within their prefixes; shingles of one document are not sent at all, they only move the others' positions.
3. Equal sets are one class, known by two 64-bit sums over its members and its size; a class is a node. Nodes that share
   a prefix shingle are candidates if their sizes and the positions of that shingle still allow the threshold.
4. Candidate pairs are made distinct. Counts of a set's shingles by hash range (64 bytes) bound an intersection: only
   pairs that this suffix filter leaves get their whole sets, and are verified once.

similar_pairs() joins all nodes of a prefix shingle with one another. components() needs only who hangs together: it
first verifies each node against one pivot of each of its shingles (the set with the fewest rarer shingles), and then
joins only nodes that are still in different components; every link is inside a component afterwards. The set of a node
in many pairs is copied, once for every HOT of them, so that no task takes all pairs of one node.

Edge cases: null and empty texts, and texts of white space, have no shingles and link with nothing; a text shorter than
a shingle has its whole sequence as one; rows that share a doc_id are documents of their own, so one with another text
keeps its own component; a null doc_id links with nothing and has a null component; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensgraph.llm import arrays, words
from lensgraph.operators.components import connected_components
from lensgraph.shared import new_folder, written

#: Hash ranges whose counts bound an intersection before it is computed.
SUFFIX_RANGES = 64
#: Pairs of one node that go to one copy of its set.
HOT = 256
SETS = "doc_id long, hash long, n_shingles long, class binary, tokens array<long>, places array<long>, bound binary, shingles binary"


def frequencies(docs: DataFrame, n: int) -> arrays.Sharded:
    """Shingles of two documents or more, with the number of documents."""
    spark = docs.sparkSession
    bits, uri = arrays.shard_bits(docs), new_folder(spark, "shingles")

    def count(batches):
        held = arrays.Held(bits)
        for batch in batches:
            for _, _, data, offsets in words.chunks(batch.column(0)):
                yield from held.add(words.shingles(*words.hashes(data, offsets), n)[0])
        yield from held.flush()

    def write(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        keys, counts = arrays.joined(table)
        keys, counts = keys[counts > 1], counts[counts > 1]
        arrays.save(f"{uri}/keys-{shard:05d}.npy", keys)
        arrays.save(f"{uri}/counts-{shard:05d}.npy", arrays.least(counts))
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": [len(keys)]})

    rows = docs.select("text").mapInArrow(count, "shard int, blob binary").groupBy("shard").applyInArrow(write, "shard int, n long")
    return arrays.Sharded(uri, bits, {r.shard: r.n for r in rows.collect()})  # one small row a shard


def _list(values: np.ndarray, begins: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(begins, pa.int64()), pa.array(values, kind)).cast(pa.list_(kind))


def bounds(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Per set, its members by hash range in units of 1 << max(0, bits of its size - 7), rounded up: one byte a range."""
    size = np.diff(begins)
    owner = np.repeat(np.arange(len(size)), size)
    counts = np.bincount(owner * SUFFIX_RANGES + (values >> np.uint64(58)).astype(np.int64), minlength=len(size) * SUFFIX_RANGES).reshape(-1, SUFFIX_RANGES)
    unit = _unit(size)[:, None]
    return (-(-counts // unit)).astype(np.uint8)


def _unit(size: np.ndarray) -> np.ndarray:
    return 1 << np.maximum(0, np.ceil(np.log2(np.maximum(size, 1) + 1)).astype(np.int64) - 7)


def sets(docs: DataFrame, table: arrays.Sharded, n: int, num: int, den: int) -> DataFrame:
    """Per row SETS: hash is of the text, class names its set, tokens and places are of the prefix; bound and shingles if there are tokens."""

    def run(batches):
        for batch in batches:
            for row, end, data, offsets in words.chunks(batch.column(2)):
                value, begins = words.shingles(*words.hashes(data, offsets), n)
                size = np.diff(begins)
                owner = np.repeat(np.arange(len(size)), size)
                node = np.zeros((len(size), 2), "<u8")
                for k, salt in enumerate((0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)):
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(words.mix(value ^ np.uint64(salt)), dtype=np.uint64)])
                    node[:, k] = words.mix(sums[begins[1:]] - sums[begins[:-1]] + size.astype(np.uint64))
                at, df = table.find(value, "counts")
                shared = np.flatnonzero(at >= 0)
                order = shared[np.lexsort((value[shared], df[shared], owner[shared]))]
                held = np.bincount(owner[order], minlength=len(size))
                first = np.concatenate([[0], np.cumsum(held)[:-1]])
                place = (size - held)[owner[order]] + np.arange(len(order)) - first[owner[order]]
                keep = place <= (size - -(-num * size // den))[owner[order]]
                tokens, token_owner = value[order][keep], owner[order][keep]
                starts = np.searchsorted(token_owner, np.arange(len(size) + 1))
                has = np.diff(starts) > 0
                bound = bounds(value, begins)
                cols = [batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), pa.array(size, pa.int64()), pa.array([x.tobytes() for x in node], pa.binary())]
                cols += [_list(tokens.view(np.int64), starts, pa.int64()), _list(place[keep], starts, pa.int64())]
                cols.append(pa.array([bound[i].tobytes() if has[i] else None for i in range(len(size))], pa.binary()))
                cols.append(pa.array([value[begins[i] : begins[i + 1]].tobytes() if has[i] else None for i in range(len(size))], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "hash", "n_shingles", "class", "tokens", "places", "bound", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("hash"), "text").mapInArrow(run, SETS)


class Joined:
    """The sets of a table, its nodes and its prefix rows; the threshold is num/den."""

    def __init__(self, docs: DataFrame, n: int, num: int, den: int):
        self.num, self.den = num, den
        # row is stored with the sets, so every reading gives a document the same one
        self.sets = written(sets(docs, frequencies(docs, n), n, num, den).withColumn("row", F.monotonically_increasing_id()), "sets")
        known = self.sets.filter("n_shingles > 0 and doc_id is not null")
        # a class is named by one of its rows, which stands for it
        self.classes = written(known.groupBy("class").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "classes")
        chosen = known.filter(F.size("tokens") > 0).join(self.classes.select(F.col("node").alias("row")), "row", "left_semi")
        self.nodes = written(chosen.select(F.col("row").alias("node"), F.col("n_shingles").alias("n"), "tokens", "places"), "nodes")
        self.rows = written(self.exploded(self.nodes), "prefixes")

    def exploded(self, nodes: DataFrame, *more: str) -> DataFrame:
        """token, node, n, place (and more columns of the nodes), one row for each shingle of a prefix."""
        return nodes.select("node", "n", *more, F.explode(F.arrays_zip("tokens", "places")).alias("p")).select(F.col("p.tokens").alias("token"), "node", "n", F.col("p.places").alias("place"), *more)

    def may_link(self, x: str, y: str) -> Column:
        """Length, index prefix and positional filters of the prefix rows x and y, at one shared shingle."""
        nx, ny, px, py = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.place"), F.col(f"{y}.place")
        num, den = self.num, self.den
        low, high = F.least(nx, ny), F.greatest(nx, ny)
        # the smaller set's shared shingle lies in its shorter prefix: it must have 2t/(1+t) of itself in common
        ahead = F.when(nx < ny, px).when(nx > ny, py).otherwise(F.least(px, py))
        short = low * (num + den) - 2 * num * low >= ahead * (num + den)
        rest = F.least(nx - px, ny - py)  # this shingle and all after it
        return (low * den >= high * num) & short & (rest * (num + den) >= num * (nx + ny))

    def with_both(self, pairs: DataFrame, column: str) -> DataFrame:
        """Pairs (a, b) with that column of both nodes, x and y. pairs: a written table, whose size the planner knows."""
        ends = written(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "ends")
        held = self.sets.filter(F.col(column).isNotNull()).select("row", column).filter(arrays.listed(arrays.stored(ends, "row"), "row"))
        salts = []
        for end, other in (("a", "b"), ("b", "a")):
            hot = pairs.groupBy(F.col(end).alias("h")).agg(F.ceil(F.count("*") / HOT).cast("int").alias("k")).filter("k > 1")
            salts.append((end, f"{end}_salt", F.pmod(F.xxhash64(other), F.coalesce("k", F.lit(1))).cast("int"), written(hot, "hot")))
        for end, salt, of, hot in salts:
            pairs = pairs.join(hot, F.col(end) == F.col("h"), "left").withColumn(salt, of).drop("h", "k")
        pairs = written(pairs, "pairs")
        for (end, salt, _, hot), name in zip(salts, ("x", "y"), strict=True):
            times = F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1))
            copies = held.join(hot, F.col("row") == F.col("h"), "left").select(F.col("row").alias(end), F.col(column).alias(name), times.alias(salt))
            pairs = pairs.join(copies, [end, salt])
        return pairs

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b) of nodes those that link; first the suffix filter, then the whole sets."""
        num, den = self.num, self.den

        def bounded(batches):
            for batch in batches:
                low = np.zeros(batch.num_rows, np.int64)
                nx, ny = (batch.column(k).to_numpy() for k in (2, 3))
                if batch.num_rows:
                    x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SUFFIX_RANGES) for k in (4, 5))
                    low = np.minimum(x * _unit(nx)[:, None], y * _unit(ny)[:, None]).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(low * (num + den) >= num * (nx + ny)))

        def checked(batches):
            for batch in batches:
                a, b = (batch.column(k) for k in (2, 3))
                hit = np.zeros(batch.num_rows, bool)
                for i in range(batch.num_rows):
                    x, y = (np.frombuffer(z[i].as_buffer(), np.uint64) for z in (a, b))
                    need = -(-num * (len(x) + len(y)) // (num + den))
                    hit[i] = len(np.intersect1d(x, y, assume_unique=True)) >= need
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(hit))

        pairs = written(pairs, "candidates")
        near = written(self.with_both(pairs, "bound").select("a", "b", "nx", "ny", "x", "y").mapInArrow(bounded, "a long, b long").distinct(), "bounded")
        return self.with_both(near, "shingles").select("a", "b", "x", "y").mapInArrow(checked, "a long, b long").distinct()

    def candidates(self, x: DataFrame, y: DataFrame, apart: Column) -> DataFrame:
        """Distinct pairs (a < b) with the sizes nx, ny of prefix rows x and y that share a shingle and may link."""
        found = x.alias("x").join(y.alias("y"), (F.col("x.token") == F.col("y.token")) & apart & self.may_link("x", "y"))
        swap = F.col("x.node") > F.col("y.node")
        ends = [F.when(swap, F.col(f"{q}.{c}")).otherwise(F.col(f"{p}.{c}")) for p, q, c in (("x", "y", "node"), ("y", "x", "node"), ("x", "y", "n"), ("y", "x", "n"))]
        return found.select(*[e.alias(name) for e, name in zip(ends, ("a", "b", "nx", "ny"), strict=True)]).distinct()

    def similar_pairs(self) -> DataFrame:
        """All linked pairs (a < b) of nodes, by the least doc_ids of their classes."""
        pairs = self.verified(self.candidates(self.rows, self.rows, F.col("x.node") < F.col("y.node")))
        a, b = (self.classes.select(F.col("node").alias(end), F.col("least").alias(f"{end}_id")) for end in "ab")
        out = pairs.join(a, "a").join(b, "b")
        return out.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))

    def linked(self) -> DataFrame:
        """(node, component) of nodes that a link names; components are those of all links."""
        least = F.min(F.struct("place", "node", "n")).alias("p")
        pivots = self.rows.groupBy("token").agg(least, F.count("*").alias("k")).filter("k > 1").select("token", "p.*")
        first = self.verified(self.candidates(self.rows, pivots, F.col("x.node") != F.col("y.node")))
        stars = written(connected_components(first), "pivoted")
        # who is left: shingles whose nodes are in several components, there the rows outside the largest
        joined = self.nodes.join(stars, "node", "left").withColumn("component", F.coalesce("component", "node"))
        rows = self.exploded(joined, "component")
        unsettled = written(rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("token"), "unsettled")
        rows = written(rows.join(unsettled, "token", "left_semi"), "prefixes")
        sizes = rows.groupBy("token", "component").count()
        top = sizes.groupBy("token").agg(F.max_by("component", F.struct("count", "component")).alias("top"))
        left = written(rows.join(top, "token").filter("component <> top").select("token", "node", "n", "place", "component"), "apart")
        second = self.verified(self.candidates(left, rows, F.col("x.component") != F.col("y.component")))
        second = written(second, "links")
        if not second.limit(1).count():
            return stars
        return connected_components(second.unionByName(stars.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    def documents(self) -> DataFrame:
        """doc_id, hash, n_shingles, component_id, and component (the node that names the connected set) of every row."""
        classes = self.classes.join(self.linked(), "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
        classes = classes.join(least, "component").select("class", "component", "component_id")
        out = self.sets.select("doc_id", "hash", "n_shingles", "class").join(classes, "class", "left")
        links = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
        return out.select("doc_id", "hash", "n_shingles", F.when(links, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(links, F.col("component")).alias("component"))


def components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: sets of n-word shingles link from a Jaccard similarity of num/den."""
    return Joined(docs, n, num, den).documents().select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of `docs` without all but one of each component: the one of least doc_id, then least hash of the text.

    Rows without shingles or without a doc_id link with nothing and all stay. Rows are known by doc_id and text, so that
    no second reading need give them in the same order or partitions; of those equal in both, one stays. Texts of rows
    that no group names are not shuffled.
    """
    found = Joined(docs, n, num, den).documents().filter("component is not null")
    rows = written(found.groupBy("doc_id", "hash").agg(F.min("component").alias("component"), F.count("*").alias("rows")), "rows")
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "hash")).alias("first"), F.sum("rows").alias("all"))
    many = rows.join(first.filter("all > 1"), "component").withColumn("stays", F.struct("doc_id", "hash") == F.col("first"))
    many = many.filter("not stays or rows > 1").select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "stays")
    many = written(many, "groups")
    table = arrays.stored(many, "_id", "_hash")
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("own"))
    named = arrays.listed(table, "id", "own")
    same = (F.col("id") == F.col("_id")) & (F.col("own") == F.col("_hash"))
    other = held.filter(~named).unionByName(held.filter(named).join(many, same, "left_anti"))
    again = held.filter(named).join(many.filter("stays"), same, "left_semi").groupBy("id", "own").agg(F.min("row").alias("row"))
    return other.select("row").unionByName(again.select("row")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op9(docs: DataFrame) -> DataFrame:
    """All documents, three-word shingles, a similarity of 0.9."""
    return components(docs, 3, 90, 100)

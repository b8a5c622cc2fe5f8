"""Sorted hash arrays: numpy files in the shared folder that workers map into memory.

A set of arrays is cut into shards by the leading bits of a 64-bit key, so that the shards in order are one sorted
array. Each shard is one ``.npy`` file per column. Where the shared folder is mounted (``file:``), workers map the
files; elsewhere they read them through pyarrow's file systems. A task holds its arrays in a Folder, which goes with the
task: a worker that Spark uses again keeps none of them.
"""

from __future__ import annotations

import io
import math
import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensgraph.shared import new_folder, partitions

#: Keys that a task gathers before it sorts them.
HELD_KEYS = 2_000_000
#: Bytes of input for one shard.
SHARD_BYTES = 32 << 20
SHARDS = pa.schema([("shard", pa.int32()), ("blob", pa.binary())])


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def save(uri: str, array: np.ndarray) -> None:
    """Writes one array under a temporary name, then renames it: a repeated task leaves the same file."""
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            np.save(f, array)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    held = io.BytesIO()
    np.save(held, array)
    with store.open_output_stream(part := f"{path}.{uuid.uuid4().hex}") as f:
        f.write(held.getbuffer())
    store.move(part, path)


class Folder:
    """The arrays below a URI, opened when asked for. Pickles as the URI alone, so that each task opens its own."""

    def __init__(self, uri: str):
        self.uri, self._open = uri, {}

    def __getstate__(self) -> dict:
        return {"uri": self.uri, "_open": {}}

    def get(self, name: str) -> np.ndarray:
        """The array, mapped where the folder is mounted, else read whole."""
        if name not in self._open:
            uri = f"{self.uri}/{name}.npy"
            if path := _local(uri):
                self._open[name] = np.load(path, mmap_mode="r")
            else:
                from pyarrow import fs

                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as f:
                    self._open[name] = np.load(io.BytesIO(f.read()))
        return self._open[name]


class Sharded:
    """Shards of sorted keys with value columns; shards: shard -> number of keys. Pickles as a few numbers.

    Keys that use only their leading `width` bits are stored without the bits that the shard gives and without the unused.
    """

    def __init__(self, uri: str, bits: int, shards: dict[int, int], width: int = 64):
        self.folder, self.bits, self.shards, self.width = Folder(uri), bits, shards, width
        counts = np.array([shards.get(s, 0) for s in range(1 << bits)], np.int64)
        self.base = np.concatenate([[0], np.cumsum(counts)])

    @property
    def size(self) -> int:
        return int(self.base[-1])

    def column(self, name: str, shard: int) -> np.ndarray:
        return self.folder.get(f"{name}-{shard:05d}")

    def keys_at(self, positions: np.ndarray) -> np.ndarray:
        """The keys at sorted positions of the whole array."""
        out = np.zeros(len(positions), np.uint64)
        cuts = np.searchsorted(positions, self.base)
        for s in np.flatnonzero(np.diff(cuts)):
            stored = self.column("keys", int(s))[positions[cuts[s] : cuts[s + 1]] - self.base[s]]
            if self.width < 64:
                stored = (stored.astype(np.uint64) << np.uint64(64 - self.width)) | np.uint64(int(s) << (64 - self.bits))
            out[cuts[s] : cuts[s + 1]] = stored
        return out

    def find(self, keys: np.ndarray, *columns: str) -> tuple[np.ndarray, ...]:
        """Position of each key in the whole array (-1: absent), then its values (0 where absent)."""
        order = np.arange(len(keys)) if (keys[1:] >= keys[:-1]).all() else np.argsort(keys)
        ordered = keys[order]
        at = np.full(len(keys), -1, np.int64)
        values = [np.zeros(len(keys), np.int64) for _ in columns]
        for s, a, b in runs(shard_of(ordered, self.bits)):
            n = self.shards.get(s, 0)
            if not n:
                continue
            mine, stored = narrowed(ordered[a:b], self.bits, self.width), self.column("keys", s)
            pos = np.minimum(np.searchsorted(stored, mine), n - 1)
            hit = stored[pos] == mine
            where = order[a:b][hit]
            at[where] = self.base[s] + pos[hit]
            for value, name in zip(values, columns, strict=True):
                value[where] = self.column(name, s)[pos[hit]]
        return (at, *values)


def shard_bits(docs: DataFrame) -> int:
    """Bits of the shard number: at least as many shards as shuffle partitions, and one for every SHARD_BYTES of the
    input as the planner knows it, so that a task's shard stays of one size as the input grows."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(1, math.ceil(math.log2(max(2, partitions(docs.sparkSession)))), min(20, math.ceil(math.log2(max(1, size / SHARD_BYTES)))))


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def runs(shards: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of each shard that these sorted shard numbers name."""
    if len(shards):
        cuts = np.concatenate([[0], np.flatnonzero(shards[1:] != shards[:-1]) + 1, [len(shards)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield int(shards[a]), a, b


def narrowed(keys: np.ndarray, bits: int, width: int) -> np.ndarray:
    """Keys as a shard stores them."""
    if width == 64:
        return keys
    rest = (keys << np.uint64(bits)) >> np.uint64(bits + 64 - width)
    return rest.astype(np.uint32 if width - bits <= 32 else np.uint64)


def least(values: np.ndarray) -> np.ndarray:
    """The same unsigned values in the narrowest type."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with summed counts."""
    if not len(keys):
        return keys, counts.astype(np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first)


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences in byte planes, then counts in byte planes: small once the shuffle compresses it.

    Low bits that no key uses are left out.
    """
    step = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    used = int(np.bitwise_or.reduce(step))
    unused = (used & -used).bit_length() - 1 if used else 0
    step >>= np.uint64(unused)
    planes = np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T)
    narrow = least(counts)
    tail = np.ascontiguousarray(narrow.view(np.uint8).reshape(-1, narrow.itemsize).T)
    return bytes([narrow.itemsize, unused]) + planes.tobytes() + tail.tobytes()


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    width, unused = blob[0], blob[1]
    raw = np.frombuffer(blob, np.uint8, offset=2)
    n = len(raw) // (8 + width)
    keys = np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64) << np.uint64(unused)
    return keys, np.ascontiguousarray(raw[8 * n :].reshape(width, n).T).view(f"<u{width}").ravel().astype(np.int64)


def blobs(keys: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """One row a shard that has keys; rows of one batch together, since a flush may meet many shards."""
    shards, packed = [], []
    for s, a, b in runs(shard_of(keys, bits)):
        shards.append(s)
        packed.append(pack(keys[a:b], counts[a:b]))
    if shards:
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(packed, pa.binary())], schema=SHARDS)


class Held:
    """Keys gathered until there are enough to sort and send off."""

    def __init__(self, bits: int):
        self.bits, self.parts, self.n = bits, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(keys)
        self.n += len(keys)
        if self.n >= HELD_KEYS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            keys = np.concatenate(self.parts)
            self.parts, self.n = [], 0
            yield from blobs(*merged(keys, np.ones(len(keys), np.int64)), self.bits)


def joined(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All blobs of one shard as sorted keys with counts."""
    parts = [unpack(x.as_py()) for x in table["blob"]]
    return merged(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def stored(rows: DataFrame, *columns: str) -> Sharded:
    """The distinct hashes of these columns of `rows` (a written table, whose size the planner knows) as sorted arrays."""
    bits, uri = shard_bits(rows), new_folder(rows.sparkSession, "listed")

    def gather(batches):
        held = Held(bits)
        for batch in batches:
            yield from held.add(batch.column(0).to_numpy().view(np.uint64))
        yield from held.flush()

    def write(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        keys = joined(table)[0]
        save(f"{uri}/keys-{shard:05d}.npy", keys)
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": [len(keys)]})

    hashed = rows.select(F.xxhash64(*columns)).mapInArrow(gather, "shard int, blob binary").groupBy("shard").applyInArrow(write, "shard int, n long")
    return Sharded(uri, bits, {r.shard: r.n for r in hashed.collect()})  # one small row a shard


def listed(table: Sharded, *columns: str) -> Column:
    """Whether the hash of these columns is in a stored table: always true of its rows, of another by a chance of size / 2^64.

    Only hashes go to the workers. A join after it settles the rest exactly, over few rows rather than all.
    """

    @F.pandas_udf("boolean")
    def found(key: pd.Series) -> pd.Series:
        return pd.Series(table.find(key.to_numpy().view(np.uint64))[0] >= 0)

    return found(F.xxhash64(*columns))

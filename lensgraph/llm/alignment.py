"""Alignment of two tokenizers: which ids of A and B cover the same bytes, and how many documents hold each pair.

A text, with a space before it, is encoded by both; byte offsets where tokens of both end cut them into groups, and tokens
whose bytes overlap are linked. A single space between two other characters ends a token of either kind, so texts are cut
there and each distinct piece is aligned once while a bounded memo holds it.

1. Each task writes its documents' figures, their distinct links (id pair, times) in blobs by stripe of the A id, and the
   number of documents of each pair, summed over the task. A block is about HELD links.
2. A stripe is every STRIPES-th A id. Its counts are added up in one dense matrix of its A ids by all B ids, whose size
   depends on the vocabularies alone, and stored as its entries that are not 0.
3. Links are dealt by stripe (large ones also by block), so that each task scores them against the dense matrix and the
   row maxima of its stripe; per document and stripe one sum goes back to the document's block.

Edge cases: null and empty texts, and those that a tokenizer does not give back byte for byte, have no tokens and zeros;
rows are told apart by block and place, so repeated and null ids keep a row each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensgraph.llm import arrays
from lensgraph.llm.tokens import blocks, byte_letters
from lensgraph.shared import new_folder, partitions, written

STRIPES = 128
#: Links that a task gathers before it writes a block; pairs whose sums it holds.
HELD, HELD_PAIRS = 2_000_000, 4_000_000
#: Pieces in one generation of the memo, and the characters of a piece that it may hold.
MEMO, MEMO_CHARS = 200_000, 64
#: Bytes of links, as stored, that one task scores for a stripe.
STRIPE_BYTES = 64 << 20
#: A single space with no white space beside it.
CUT = re.compile(r" (?<=\S )(?=\S)")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_DOC = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
ENCODED = pa.schema([("block", pa.int64()), ("place", pa.int32()), *((c, pa.string() if c == "groups_sha256" else pa.int64()) for c in _DOC), ("stripe", pa.int32()), ("links", pa.binary()), ("counts", pa.binary())])
_loaded: dict[tuple[str, str], tuple] = {}


def _tokenizers(a_path: str, b_path: str) -> tuple:
    """Both libraries' tokenizers with the bytes of each id's token, loaded once in a worker's life."""
    if (a_path, b_path) not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(a_path)
        a.encode_special_tokens = True  # their strings in a text are ordinary text
        of = {letter: byte for byte, letter in byte_letters().items()}
        a_bytes = {i: bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t, i in a.get_vocab().items()}
        b = SentencePieceProcessor(model_file=b_path)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        _loaded[a_path, b_path] = (a, [a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)], b, b_bytes)
    return _loaded[a_path, b_path]


class Aligner:
    """Groups and links of texts; the memo goes with the aligner, so with the task that made it."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.a_bytes, self.b, self.b_bytes = _tokenizers(a_path, b_path)
        self.sizes = [np.array([len(t) for t in tokens]) for tokens in (self.a_bytes, self.b_bytes)]
        #: What is said of an A id, then of a B id: inside and at the end of a group.
        self.said = [f"{i}{mark}".encode() for tokens, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for i in range(len(tokens)) for mark in marks]
        self.old: dict[str, tuple | None] = {}
        self.young: dict[str, tuple | None] = {}

    def _ids(self, pieces: list[str]) -> list[tuple | None]:
        """Ids of each piece and the space before it as 16-bit integers, by A and by B; None if bytes differ."""
        out, b_of = [], self.b_bytes.__getitem__
        raw = [f" {p}" for p in pieces]
        # A's tokens are bytes of the text itself: its vocabulary has every byte and nothing is normalised
        for text, a, b in zip(raw, self.a.encode_batch_fast(raw, add_special_tokens=False), self.b.encode(pieces, num_threads=1), strict=True):
            out.append((array("H", a.ids).tobytes(), array("H", b).tobytes()) if b"".join(map(b_of, b)) == text.encode() else None)
        return out

    def ids(self, texts: list[str]) -> list[tuple | None]:
        """A and B ids of each text as 16-bit integers; None for a text without tokens."""
        cut = [CUT.split(t) if t else [] for t in texts]
        if len(self.young) > MEMO:
            self.old, self.young = self.young, {}
        known, fresh = self.young, {}
        for piece in {p for pieces in cut for p in pieces}:
            if piece not in known:
                if piece in self.old:
                    known[piece] = self.old[piece]
                else:
                    fresh[piece] = None
        long = [p for p in fresh if len(p) > MEMO_CHARS]
        if fresh:
            known.update(zip(fresh, self._ids(list(fresh)), strict=True))
        of, out = known.__getitem__, []
        for pieces in cut:
            held = list(map(of, pieces))
            out.append(tuple(b"".join(x) for x in zip(*held, strict=True)) if held and None not in held else None)
        for piece in long:
            del known[piece]
        return out

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Per text n_a, n_b, n_groups, n_links; each link's text; each link's pair (A id above B id); each text's groups.

        All texts lie in one row of bytes: the ends of either side's tokens cut it so that each part is one link.
        """
        found = self.ids(texts)
        sides, ends, counts = [], [], np.zeros((len(texts), 4), np.int64)
        for k, size in enumerate(self.sizes):
            sides.append(np.frombuffer(b"".join([x[k] for x in found if x]), "<u2").astype(np.int64))
            ends.append(np.cumsum(size[sides[k]]))
            counts[:, k] = [len(x[k]) // 2 if x else 0 for x in found]
        (a, b), (a_end, b_end) = sides, ends
        cuts = np.sort(np.concatenate([a_end, b_end]), kind="stable")  # merges two sorted runs
        cuts = cuts[np.diff(cuts, append=-1) != 0]
        at_a, at_b = np.searchsorted(a_end, cuts), np.searchsorted(b_end, cuts)
        pairs = a[at_a] << 16 | b[at_b]
        owner = np.repeat(np.arange(len(texts)), counts[:, 0])[at_a]
        shared = (a_end[at_a] == cuts) & (b_end[at_b] == cuts)
        counts[:, 2], counts[:, 3] = np.bincount(owner[shared], minlength=len(texts)), np.bincount(owner, minlength=len(texts))
        of_a, of_b = np.searchsorted(cuts[shared], a_end), np.searchsorted(cuts[shared], b_end)  # group of each token
        order = np.empty(len(a) + len(b), np.int64)
        last = lambda group: np.diff(group, append=-1) != 0
        order[np.arange(len(a)) + np.searchsorted(of_b, of_a)] = 2 * a + last(of_a)
        order[np.arange(len(b)) + np.searchsorted(of_a, of_b, "right")] = 2 * (len(self.a_bytes) + b) + last(of_b)
        upto = np.concatenate([[0], np.cumsum(counts[:, 0] + counts[:, 1])])
        said = self.said.__getitem__
        return counts, owner, pairs, [b"".join(map(said, order[x:y].tolist()))[:-1] for x, y in zip(upto[:-1], upto[1:], strict=True)]


def _encoded(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of three kinds: documents (place), links of a block and stripe, document counts of a task's pairs by stripe."""

    def run(batches):
        aligner, number, first = Aligner(a_path, b_path), 0, TaskContext.get().partitionId() << 24
        rows, links, held = [], [], 0
        sums, sum_size = [], 0

        def table(n, **columns):
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in ENCODED], schema=ENCODED)

        def by_stripe(keys, counts, name, block):
            """Blobs of pairs (with what stands above them) by stripe of their A id."""
            stripe = (keys >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int64) % STRIPES
            order = np.argsort(stripe, kind="stable")
            found = [(s, arrays.pack(keys[order[a:b]], counts[order[a:b]])) for s, a, b in arrays.runs(stripe[order])]
            return table(len(found), block=pa.array([block] * len(found), pa.int64()), stripe=pa.array([s for s, _ in found], pa.int32()), **{name: pa.array([x for _, x in found], pa.binary())})

        def close():
            nonlocal rows, links, held, number, sums, sum_size
            block = first + number
            columns = {name: pa.array([r[k] for r in rows], ENCODED.field(name).type) for k, name in enumerate(_DOC)}
            yield table(len(rows), block=pa.array([block] * len(rows), pa.int64()), place=pa.array(range(len(rows)), pa.int32()), **columns)
            if held:
                keys, counts = (np.concatenate(x) for x in zip(*links, strict=True))
                yield by_stripe(keys, counts, "links", block)
                sums.append(arrays.merged(keys & np.uint64(0xFFFFFFFF), np.ones(len(keys), np.int64)))
                sum_size += len(sums[-1][0])
            rows, links, held, number = [], [], 0, number + 1
            if sum_size > HELD_PAIRS:
                sums = [arrays.merged(*(np.concatenate(x) for x in zip(*sums, strict=True)))]
                if (sum_size := len(sums[0][0])) > HELD_PAIRS // 2:
                    yield from spilled()

        def spilled():
            nonlocal sums, sum_size
            if sums:
                yield by_stripe(*arrays.merged(*(np.concatenate(x) for x in zip(*sums, strict=True))), "counts", first)
            sums, sum_size = [], 0

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in blocks(texts):
                counts, owner, pairs, groups = aligner.texts([t or "" for t in texts[a:b]])
                keys = (owner + len(rows)).astype(np.uint64) << np.uint64(32) | pairs.astype(np.uint64)
                links.append(arrays.merged(keys, np.ones(len(keys), np.int64)))
                held += len(links[-1][0])
                rows += [(doc_id, *n, hashlib.sha256(g).hexdigest() if g else "") for doc_id, n, g in zip(ids[a:b], counts.tolist(), groups, strict=True)]
                if held >= HELD or len(rows) >= HELD:
                    yield from close()
        if rows:
            yield from close()
        yield from spilled()

    types = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(f"{f.name} {types[f.type]}" for f in ENCODED))


class Alignment:
    """The links of a table's texts, counted; a_size and b_size are the numbers of ids."""

    def __init__(self, docs: DataFrame, a_path: str, b_path: str):
        _, a_bytes, _, b_bytes = _tokenizers(a_path, b_path)
        self.rows, self.b_size = -(-len(a_bytes) // STRIPES), len(b_bytes)
        if max(len(a_bytes), self.b_size) > 1 << 16:
            raise ValueError("ids have 16 bits at most")
        self.spark, uri = docs.sparkSession, new_folder(docs.sparkSession, "stripes")
        self.folder = arrays.Folder(uri)
        self.encoded = written(_encoded(docs, a_path, b_path), "aligned")
        self.stripes = {r.stripe for r in self._count(uri).collect()}  # at most STRIPES rows

    def _dealt(self, column: str, salts: int = 1) -> DataFrame:
        """block, stripe and that column's blobs, a stripe's together and in order."""
        rows = self.encoded.filter(F.col(column).isNotNull()).select("block", "stripe", column)
        return rows.repartition(min(STRIPES * salts, partitions(self.spark)), "stripe", F.pmod(F.xxhash64("block"), F.lit(salts))).sortWithinPartitions("stripe")

    def _count(self, uri: str) -> DataFrame:
        shape = (self.rows, self.b_size)

        def run(batches):
            stripe, dense = -1, None

            def close():
                at = np.flatnonzero(dense)
                arrays.save(f"{uri}/cells-{stripe:05d}.npy", arrays.least(at))
                arrays.save(f"{uri}/counts-{stripe:05d}.npy", arrays.least(dense.ravel()[at]))
                return pa.RecordBatch.from_pydict({"stripe": pa.array([stripe], pa.int32())})

            for batch in batches:
                for s, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    if s != stripe:
                        if dense is not None:
                            yield close()
                        stripe, dense = s, np.zeros(shape, np.int64)
                    keys, counts = arrays.unpack(blob)
                    np.add.at(dense, _cells(keys), counts)
            if dense is not None:
                yield close()

        return self._dealt("counts").mapInArrow(run, "stripe int")

    def best(self) -> DataFrame:
        """(a_id, b_id, documents): for each A id the B ids linked with it in the most documents, ties included."""
        folder, width = self.folder, self.b_size

        def run(batches):
            for batch in batches:
                for s in batch.column(0).to_pylist():
                    cells, counts = (folder.get(f"{name}-{s:05d}").astype(np.int64) for name in ("cells", "counts"))
                    row = cells // width
                    first = np.flatnonzero(np.diff(row, prepend=-1))
                    top = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(row)))) == counts
                    yield pa.RecordBatch.from_arrays([pa.array(row[top] * STRIPES + s), pa.array(cells[top] % width), pa.array(counts[top])], names=["a_id", "b_id", "documents"])

        stripes = self.spark.range(STRIPES).filter(F.col("id").isin(self.stripes)).select("id")
        return stripes.mapInArrow(run, "a_id long, b_id long, documents long")

    def documents(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
        size = int(self.encoded._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        shape, folder = (self.rows, self.b_size), self.folder

        def score(batches):
            stripe, dense, top = -1, None, None
            for batch in batches:
                out = []
                for block, s, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if s != stripe:
                        stripe, dense, top = s, np.zeros(shape, np.int64), np.zeros(shape[0], np.int64)
                        cells, counts = folder.get(f"cells-{s:05d}"), folder.get(f"counts-{s:05d}")
                        dense.ravel()[cells] = counts
                        np.maximum.at(top, cells // shape[1], counts)
                    keys, times = arrays.unpack(blob)
                    row, column = _cells(keys)
                    count, place = dense[row, column], keys >> np.uint64(32)
                    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                    best, total = np.add.reduceat(times * (count == top[row]), first), np.add.reduceat(times * count, first)
                    out.append((block, arrays.pack(place[first], best), arrays.least(total).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.binary(), pa.binary())], names=["block", "best", "total"])

        def add(table: pa.Table) -> pa.Table:
            """All sums of one block, which has about HELD links."""
            places, best, total = [], [], []
            for b, t in zip(table["best"].to_pylist(), table["total"].to_pylist(), strict=True):
                at, n = arrays.unpack(b)
                places.append(at.astype(np.int64))
                best.append(n)
                total.append(np.frombuffer(t, f"<u{len(t) // len(at)}").astype(np.int64))
            at = np.concatenate(places)
            sums = np.zeros((int(at.max()) + 1, 2), np.int64)
            np.add.at(sums, at, np.column_stack([np.concatenate(best), np.concatenate(total)]))
            n = len(sums)
            return pa.table({"block": pa.array([table["block"][0].as_py()] * n, pa.int64()), "place": pa.array(range(n), pa.int32()), "n_best": sums[:, 0], "count_sum": sums[:, 1]})

        sums = self._dealt("links", max(1, -(-size // (STRIPES * STRIPE_BYTES)))).mapInArrow(score, "block long, best binary, total binary")
        sums = sums.groupBy("block").applyInArrow(add, "block long, place int, n_best long, count_sum long")
        docs = self.encoded.filter("place is not null").select("block", "place", *_DOC)
        none = F.lit(0).cast("long")
        return docs.join(sums, ["block", "place"], "left").select(*_DOC[:5], F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")


def _cells(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row in its stripe and column of each pair."""
    return ((keys >> np.uint64(16) & np.uint64(0xFFFF)) // np.uint64(STRIPES)).astype(np.int64), (keys & np.uint64(0xFFFF)).astype(np.int64)


def op12(docs: DataFrame) -> DataFrame:
    """All documents: A is byte-level BPE, B is BPE with byte fallback."""
    import public_tokenizers

    return Alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).documents()

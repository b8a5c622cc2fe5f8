"""Token-id output as directly addressable codes.

An id is cut into chunks of bits, the lowest first. Level k keeps the k-th chunk of every id that has one, packed at
that level's width, and a bitmap that says which of them go on to level k+1. A directory holds the bitmap's ones
before each block of 512 bits, so the place of an id's next chunk is a rank: any token is read by itself, without
decoding its neighbours. Each file chooses its widths from its own ids.

A data set is a folder of ``.dac`` files in ascending doc_id order, written by range partitions. A file also holds its
documents' ids and offsets.

Edge cases: null and empty texts have only the end token; rows with a null doc_id come first; repeated ids stay, in the
order of their texts' hashes; an empty table gives no rows and no files; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensgraph.llm import tokens
from lensgraph.shared import new_folder, partitions

MAGIC = b"DACv1\0\0\0"
BLOCK = 512
#: A partition starts another file once one has so many tokens.
FILE_TOKENS = 8_000_000
#: Tokens that the reader asks for at once.
READ_TOKENS = 1_000_000


def widths(ids: np.ndarray) -> list[int]:
    """Chunk widths of least size for these ids, by dynamic programming over the bits already stored."""
    values, counts = np.unique(ids, return_counts=True) if len(ids) and ids.max() >= 1 << 24 else (None, np.bincount(ids))
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    above = lambda s: counts[1 << s :].sum() if values is None else counts[values >> s > 0].sum()
    longer = [int(above(s)) if s else len(ids) for s in range(bits + 1)]
    best: list[tuple[float, list[int]]] = [(0.0, [])] * (bits + 1)
    for s in range(bits - 1, -1, -1):
        best[s] = min((longer[s] * (w + (1 + 32 / BLOCK) * (s + w < bits)) + best[s + w][0], [w, *best[s + w][1]]) for w in range(1, min(16, bits - s) + 1))
    return best[0][1]


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Values of `width` bits each, one after the other; three bytes of margin for the reader."""
    out = []
    for a in range(0, len(values), 1 << 18):  # a multiple of 8 values ends on a byte
        planes = np.ascontiguousarray(values[a : a + (1 << 18)].astype("<u4")).view(np.uint8).reshape(-1, 4)
        out.append(np.packbits(np.unpackbits(planes, axis=1, bitorder="little")[:, :width], bitorder="little"))
    return np.concatenate([*out, np.zeros(3, np.uint8)])


def encode(ids: np.ndarray) -> tuple[list[int], dict[str, np.ndarray]]:
    """Widths, and for each level its chunks, bitmap and rank directory."""
    parts, left = {}, ids.astype(np.uint32)
    cut = widths(ids)
    for k, w in enumerate(cut):
        parts[f"chunks{k}"] = _packed(left & np.uint32((1 << w) - 1), w)
        if k + 1 < len(cut):
            goes_on = (left >> np.uint32(w)) > 0
            bitmap = np.packbits(goes_on, bitorder="little")
            bitmap = np.concatenate([bitmap, np.zeros(-len(bitmap) % (BLOCK // 8), np.uint8)])
            ones = np.bitwise_count(bitmap.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1)
            parts[f"bitmap{k}"] = bitmap
            parts[f"ranks{k}"] = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
            left = left[goes_on] >> np.uint32(w)
    return cut, parts


class Codes:
    """Random access to the ids of one file; `parts` may be mapped arrays."""

    def __init__(self, cut: list[int], parts: dict[str, np.ndarray]):
        self.cut, self.parts = cut, parts
        self.bits = [np.asarray(parts[f"bitmap{k}"]).view(np.uint64) for k in range(len(cut) - 1)]
        self.ranks = []
        for k, words in enumerate(self.bits):  # within a block, ones before each 64-bit word
            ones = np.bitwise_count(words).reshape(-1, BLOCK // 64).astype(np.int64)
            self.ranks.append((np.asarray(parts[f"ranks{k}"])[:-1, None].astype(np.int64) + np.cumsum(ones, 1) - ones).ravel())

    def get(self, at: np.ndarray) -> np.ndarray:
        """The ids at these positions."""
        out = np.zeros(len(at), np.uint32)
        live, at, shift = slice(None), np.asarray(at, np.int64), 0
        for k, w in enumerate(self.cut):
            raw, bit = self.parts[f"chunks{k}"], at * w
            byte = bit >> 3
            value = raw[byte].astype(np.uint32) | raw[byte + 1].astype(np.uint32) << np.uint32(8) | raw[byte + 2].astype(np.uint32) << np.uint32(16)
            out[live] |= (value >> (bit & 7).astype(np.uint32) & np.uint32((1 << w) - 1)) << np.uint32(shift)
            if k + 1 == len(self.cut):
                break
            word, inside = self.bits[k][at >> 6], (at & 63).astype(np.uint64)
            on = np.flatnonzero(word >> inside & np.uint64(1))
            below = np.bitwise_count(word[on] & ((np.uint64(1) << inside[on]) - np.uint64(1)))
            live = on if k == 0 else live[on]
            at, shift = self.ranks[k][at[on] >> 6] + below.astype(np.int64), shift + w
            if not len(at):
                break
        return out


def write_file(uri: str, doc_ids: list, lengths: list[int], ids: np.ndarray) -> int:
    """One file: magic, length of the header, header as JSON, then its arrays; returns its bytes."""
    cut, parts = encode(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts |= {"doc_ids": np.array([d or 0 for d in doc_ids], "<i8"), "known": known, "offsets": np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")}
    places, at = {}, 0
    for name, a in parts.items():
        places[name] = [at, a.dtype.str, len(a)]
        at += a.nbytes + -a.nbytes % 8
    head = json.dumps({"widths": cut, "tokens": len(ids), "documents": len(doc_ids), "parts": places}).encode()
    head += b" " * (-len(head) % 8)

    def pour(f) -> None:
        f.write(MAGIC + len(head).to_bytes(8, "little") + head)
        for a in parts.values():
            f.write(a.tobytes() + bytes(-a.nbytes % 8))

    url = urlparse(uri)
    if url.scheme in ("", "file"):
        os.makedirs(os.path.dirname(url.path), exist_ok=True)
        with open(part := f"{url.path}.{uuid.uuid4().hex}", "wb") as f:
            pour(f)
        os.replace(part, url.path)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(os.path.dirname(path), recursive=True)
        with store.open_output_stream(part := f"{path}.{uuid.uuid4().hex}") as f:
            pour(f)
        store.move(part, path)
    return 16 + len(head) + at


def open_file(uri: str) -> tuple[dict, dict[str, np.ndarray], Codes]:
    """Header, arrays and codes of a file; mapped where the folder is mounted."""
    url = urlparse(uri)
    if url.scheme in ("", "file"):
        raw = np.memmap(url.path, np.uint8, "r")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with store.open_input_file(path) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    if raw[:8].tobytes() != MAGIC:
        raise ValueError(f"{uri} is not a token code file")
    start = 16 + int.from_bytes(raw[8:16].tobytes(), "little")
    head = json.loads(raw[16:start].tobytes())
    parts = {name: raw[start + at : start + at + n * np.dtype(kind).itemsize].view(kind) for name, (at, kind, n) in head["parts"].items()}
    return head, parts, Codes(head["widths"], parts)


def write(docs: DataFrame, uri: str, tokenizer: str, end_id: int | None = 1, id_column: str = "doc_id") -> DataFrame:
    """Writes the texts' ids in ascending order of id_column; returns the files (file, part, number, documents, tokens, bytes)."""
    parts = partitions(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder, part, number = tokens.Encoder(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids, held, lengths, total = [], [], [], 0

        def close():
            nonlocal doc_ids, held, lengths, total, number
            uri_file = f"{uri}/part-{part:05d}-{number:05d}.dac"
            size = write_file(uri_file, doc_ids, lengths, np.frombuffer(b"".join(held), "<u4"))
            row = pa.RecordBatch.from_pydict({"file": [uri_file], "part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "documents": [len(lengths)], "tokens": [total], "bytes": [size]})
            doc_ids, held, lengths, total, number = [], [], [], 0, number + 1
            return row

        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for a, b in tokens.blocks(texts):
                for doc_id, code in zip(ids[a:b], encoder.encode([t or "" for t in texts[a:b]]), strict=True):
                    doc_ids.append(doc_id)
                    held.append(code + tail)
                    lengths.append(len(held[-1]) // 4)
                    total += lengths[-1]
                if total >= FILE_TOKENS:
                    yield close()
        if lengths:
            yield close()

    return rows.mapInArrow(run, "file string, part int, number int, documents long, tokens long, bytes long")


def read(files: DataFrame) -> DataFrame:
    """Per document of these files (file, first): doc_id, start, n_tokens, ids_crc32; `first` counts the ids before a file."""

    def run(batches):
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head, parts, codes = open_file(uri)
                offsets = np.asarray(parts["offsets"]).astype(np.int64)
                sums, row = np.zeros(head["documents"], np.int64), 0
                while row < head["documents"]:
                    end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + READ_TOKENS, "right")) - 1)
                    ids = codes.get(np.arange(offsets[row], offsets[end])).astype("<u4")
                    for d in range(row, end):
                        sums[d] = zlib.crc32(ids[offsets[d] - offsets[row] : offsets[d + 1] - offsets[row]].tobytes())
                    row = end
                known = np.asarray(parts["known"]).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(parts["doc_ids"]), pa.int64(), mask=~known), pa.array(first + offsets[:-1]), pa.array(np.diff(offsets)), pa.array(sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2(docs: DataFrame) -> DataFrame:
    """Writes all documents and reads them back from the files."""
    import public_tokenizers

    spark = docs.sparkSession
    listed = sorted(write(docs, new_folder(spark, "token-codes"), public_tokenizers.path("word_bpe_49k.json")).collect(), key=lambda r: (r.part, r.number))  # one row a file
    rows, first = [], 0
    for r in listed:
        rows.append((r.file, first))
        first += r.tokens
    return read(spark.createDataFrame(rows, "file string, first long").repartition(max(1, len(rows))))

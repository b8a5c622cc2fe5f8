"""Packing token sequences into windows by minimum bin slack.

A document's ids are cut at whole windows; what is left over is packed. Leftovers are dealt by hash into groups of
about GROUP pieces, and only their lengths and digests travel. In a group, each window begins with the longest piece
that is left; a bitset (bit s: some multiset of remaining lengths sums to s) grows by the remaining lengths, longest
first and each by halves of its count, until the sum that fills the window exactly appears or the lengths run out. The
highest sum is taken, and going back through the stored bitsets gives how many pieces of each length it uses.

Edge cases: null and empty texts have only the end id; repeated rows are separate documents; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensgraph.llm import tokens
from lensgraph.shared import written

WINDOW = 4096
#: Pieces that are packed together, on average.
GROUP = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def fill(left: dict[int, int], capacity: int) -> dict[int, int]:
    """How many pieces of each length to take so that they sum to as much as `capacity` allows. left: length -> count."""
    mask, states, steps = (1 << capacity + 1) - 1, [1], []
    for length in sorted((x for x in left if x <= capacity), reverse=True):
        count, times = min(left[length], capacity // length), 1
        while count and not states[-1] >> capacity:
            times = min(times, count)
            states.append((states[-1] | states[-1] << length * times) & mask)
            steps.append((length, times))
            count, times = count - times, times * 2
        if states[-1] >> capacity:
            break
    at, taken = states[-1].bit_length() - 1, defaultdict(int)
    for (length, times), before in zip(reversed(steps), reversed(states[:-1]), strict=True):
        if not before >> at & 1:
            taken[length] += times
            at -= length * times
    return taken


def pack(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece."""
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    places: dict[int, list[int]] = defaultdict(list)
    for i, n in enumerate(lengths.tolist()):
        places[n].append(i)
    left, w = {n: len(x) for n, x in places.items()}, 0
    while left:
        longest, at = max(left), 0
        left[longest] -= 1
        chosen = fill({n: c for n, c in left.items() if c}, window - longest)
        left[longest] += 1
        chosen[longest] += 1
        for length, count in chosen.items():
            for _ in range(count):
                i = places[length].pop()
                number[i], offset[i] = w, at
                at += length
            left[length] -= count
            if not left[length]:
                del left[length]
        w += 1
    return number, offset


def pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """Each document's ids cut at whole windows."""
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = tokens.Encoder(tokenizer)
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for a, b in tokens.blocks(texts):
                rows = []
                for doc_id, code in zip(ids[a:b], encoder.encode([t or "" for t in texts[a:b]]), strict=True):
                    code += tail
                    n = len(code) // 4
                    for s in range(0, n, window):
                        piece = code[4 * s : 4 * (s + window)]
                        rows.append((doc_id, s, len(piece) // 4, zlib.crc32(piece), n))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def assign(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to pieces: a whole window alone, the others packed in groups."""
    whole = F.col("length") == window
    rest = cut.filter(~whole)
    groups = max(1, -(-rest.count() // GROUP))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "ascending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        number, offset = pack(table["length"].to_numpy(), window)
        group = table["group"][0].as_py()
        return table.drop_columns(["group"]).append_column("sequence_id", pa.array((group << 32) + number)).append_column("offset", pa.array(offset))

    # repeated rows differ by nothing, so the salt that parts them is their place in the written table
    dealt = rest.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    packed = dealt.groupBy("group").applyInArrow(run, f"{PIECES}, sequence_id long, offset long")
    alone = cut.filter(whole).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(packed)


def packed(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return assign(written(pieces(docs, tokenizer, end_id, window), "pieces"), window)


def op7(docs: DataFrame) -> DataFrame:
    """All documents in windows of at most 4096 tokens."""
    import public_tokenizers

    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))

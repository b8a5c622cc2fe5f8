"""Media columns: GIF images decoded to timed frames with colour histograms, and bytes stored as GIF.

The decoder reads LZW code streams, local and global palettes, interlacing, disposal and transparency. A code stream is
decoded without a loop over its codes: a code's width follows from its place after the last clear code, and the string
of code 258+r is what the output holds where code r wrote, one byte longer. So every output byte is a literal or a copy
of an earlier one, and pointer doubling finds its literal.

Payloads are stored as frames of 64 pixels a row with a palette of greys, so that a pixel's colour is its byte.

Edge cases: null and empty texts give one row of zero bytes; a null image has no frames; data that is no GIF, or is cut
off, gives the frames before the fault; repeated rows give equal values; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensgraph.llm import tokens
from lensgraph.shared import written

WIDTH, FRAME_ROWS, DELAY = 64, 4096, 4
#: Levels of each colour in a histogram.
LEVELS = 4


@dataclass
class Frame:
    """A frame as shown: the canvas after it, its delay in hundredths of a second, and the frame's own box."""

    canvas: np.ndarray
    delay: int
    box: tuple[int, int, int, int]


def _widths(n: int, size: int) -> np.ndarray:
    """Bits of the first n codes after a clear code."""
    at = np.arange(1, n + 1)
    made = (1 << size) + np.maximum(at, 2)
    return np.clip(np.frexp(made.astype(np.float64))[1], size + 1, 12).astype(np.int64)


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    """Code stream for 8-bit samples; the table is cleared when it is full."""
    clear, end = 1 << size, (1 << size) + 1
    codes, cuts, table, free = [clear], [0], {}, end + 1
    prior = data[0] if data else None
    for b in data[1:]:
        key = prior << 8 | b
        code = table.get(key)
        if code is not None:
            prior = code
            continue
        codes.append(prior)
        prior = b
        if free < 4096:
            table[key] = free
            free += 1
        else:
            codes.append(clear)
            cuts.append(len(codes) - 1)
            table, free = {}, end + 1
    if data:
        codes.append(prior)
    codes.append(end)
    cuts.append(len(codes) - 1)
    widths = np.concatenate([[size + 1], *(_widths(b - a, size) for a, b in zip(cuts[:-1], cuts[1:], strict=True))])
    at = np.cumsum(widths) - widths
    value = np.array(codes, np.int64) << (at & 7)
    n = int((at[-1] + widths[-1] + 7) // 8)
    out = np.zeros(n + 3)
    for k in range(3):
        out += np.bincount((at >> 3) + k, weights=(value >> 8 * k & 255).astype(np.float64), minlength=n + 3)[: n + 3]
    return out[:n].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, size: int, most: int) -> np.ndarray:
    """At most `most` samples of a code stream; fewer if it ends or fails before."""
    raw = np.concatenate([np.frombuffer(stream, np.uint8), np.zeros(3, np.uint8)])
    total, clear, end = 8 * len(stream), 1 << size, (1 << size) + 1
    segments, at, done = [], 0, False
    while not done:
        parts, count, stop = [], 0, None
        while stop is None:  # a block of codes at a time, to the next clear code or the end
            widths = _widths(count + 4096, size)[count:]
            places = at + np.cumsum(widths) - widths
            n = int(np.searchsorted(places + widths, total, "right"))
            places, widths = places[:n], widths[:n]
            byte = places >> 3
            codes = (raw[byte].astype(np.int64) | raw[byte + 1].astype(np.int64) << 8 | raw[byte + 2].astype(np.int64) << 16) >> (places & 7) & (1 << widths) - 1
            marks = np.flatnonzero((codes == clear) | (codes == end))
            if len(marks):
                stop = int(marks[0])
                done = codes[stop] == end
                at = int(places[stop] + widths[stop])
                codes = codes[:stop]
            elif n < 4096:
                stop, done = n, True
            else:
                at = int(places[-1] + widths[-1])
            parts.append(codes)
            count += len(codes)
        segments.append(np.concatenate(parts))
    codes = np.concatenate(segments)
    lengths = np.array([len(s) for s in segments])
    base = np.repeat(np.cumsum(lengths) - lengths, lengths)
    index = np.arange(len(codes))
    copied = codes > end
    ref = np.where(copied, base + codes - end - 1, index)
    wrong = copied & (ref >= index)
    if wrong.any():
        keep = int(np.flatnonzero(wrong)[0])
        codes, copied, ref, index = codes[:keep], copied[:keep], ref[:keep], index[:keep]
    hop, far = ref.copy(), copied.astype(np.int64)
    while copied[hop].any():
        far, hop = far + far[hop], hop[hop]
    size_of = far + 1
    starts = np.cumsum(size_of) - size_of
    source = np.repeat(np.where(copied, starts[ref] - starts, 0) if len(starts) else starts, size_of).astype(np.int64)
    source += np.arange(len(source))
    value = np.zeros(len(source), np.uint8)
    literal = np.zeros(len(source), bool)
    literal[starts[~copied]] = True
    value[starts[~copied]] = codes[~copied]
    while not literal[source].all():
        source = source[source]
    return value[source][:most]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_payload(payload: bytes) -> bytes:
    """GIF of a payload whose length is a multiple of WIDTH."""
    rows = len(payload) // WIDTH
    greys = bytes(v for k in range(256) for v in (k, k, k))
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, FRAME_ROWS), 0xF7, 0, 0), greys]
    for row in range(0, rows, FRAME_ROWS):
        part = payload[row * WIDTH : (row + FRAME_ROWS) * WIDTH]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, DELAY, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08" + _blocks(lzw_encode(part)))
    return b"".join([*out, b"\x3b"])


def _gather(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def decode(data: bytes) -> Iterator[Frame]:
    """Frames of a GIF in order, composited."""
    try:
        if data[:6] not in (b"GIF87a", b"GIF89a"):
            return
        width, height, flags, back, _ = struct.unpack("<HHBBB", data[6:13])
        at, shared = 13, None
        if flags & 0x80:
            n = 2 << (flags & 7)
            shared = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(-1, 3)
            at += 3 * n
        canvas = np.zeros((height, width, 3), np.uint8)
        delay, disposal, clear = 0, 0, None
        while data[at] != 0x3B:
            if data[at] == 0x21:
                label = data[at + 1]
                block, at = _gather(data, at + 2)
                if label == 0xF9:
                    bits, delay, index = struct.unpack("<BHB", block[:4])
                    disposal, clear = bits >> 2 & 7, index if bits & 1 else None
                continue
            x, y, w, h, bits = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at, palette = at + 10, shared
            if bits & 0x80:
                n = 2 << (bits & 7)
                palette = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(-1, 3)
                at += 3 * n
            size = data[at]
            stream, at = _gather(data, at + 1)
            pixels = lzw_decode(stream, size, w * h)
            if len(pixels) < w * h or palette is None:
                return
            pixels = pixels.reshape(h, w)
            if bits & 0x40:
                order = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
                straight = np.empty_like(pixels)
                straight[order] = pixels
                pixels = straight
            before = canvas.copy() if disposal == 3 else None
            box = canvas[y : y + h, x : x + w]
            seen = pixels[: box.shape[0], : box.shape[1]]
            colours = palette[np.minimum(seen, len(palette) - 1)]
            box[...] = colours if clear is None else np.where((seen == clear)[..., None], box, colours)
            yield Frame(canvas.copy(), delay, (x, y, w, h))
            if disposal == 2:
                box[...] = 0
            elif disposal == 3:
                canvas = before
            delay, disposal, clear = 0, 0, None
    except (IndexError, struct.error, ValueError):
        return


def histogram(frame: Frame) -> np.ndarray:
    """Pixels of the frame's box by LEVELS levels of red, green and blue: LEVELS ** 3 counts."""
    x, y, w, h = frame.box
    level = frame.canvas[y : y + h, x : x + w].reshape(-1, 3) >> 6
    return np.bincount((level[:, 0].astype(np.int64) * LEVELS + level[:, 1]) * LEVELS + level[:, 2], minlength=LEVELS**3)


def frames(images: DataFrame, column: str = "media", keep: list[str] | None = None) -> DataFrame:
    """One row per frame: columns `keep`, frame, shown_at and delay (hundredths of a second), left, top, width, height, histogram."""
    keep = keep or []
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in images.select(*keep).schema] if keep else []
    names = ["frame", "shown_at", "delay", "left", "top", "width", "height", "histogram"]

    def run(batches):
        for batch in batches:
            for i, data in enumerate(batch.column(len(keep))):
                rows, shown = [], 0
                for k, f in enumerate(decode(data.as_py() or b"")):
                    rows.append((k, shown, f.delay, *f.box, histogram(f).tolist()))
                    shown += f.delay
                if rows:
                    own = [pa.concat_arrays([batch.column(j).slice(i, 1)] * len(rows)) for j in range(len(keep))]
                    cols = [pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:-1]]
                    yield pa.RecordBatch.from_arrays([*own, *cols, pa.array([r[-1] for r in rows], pa.list_(pa.int64()))], names=[*keep, *names])

    fields = ", ".join([*kept, *(f"{n} long" for n in names[:-1]), "histogram array<long>"])
    return images.select(*keep, column).mapInArrow(run, fields)


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's bytes, padded, as a GIF."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in tokens.blocks(texts):
                raw = [(t or "").encode() for t in texts[a:b]]
                media = [encode_payload(r + bytes(-len(r) % WIDTH or (0 if r else WIDTH))) for r in raw]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def digested(images: DataFrame) -> DataFrame:
    """What the stored images hold, from their decoded frames."""

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, n_bytes, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                parts, counts, time = [], np.zeros(LEVELS**3, np.int64), 0
                for f in decode(data):
                    x, y, w, h = f.box
                    parts.append(f.canvas[y : y + h, x : x + w, 0].tobytes())
                    counts += histogram(f)
                    time += f.delay
                payload = b"".join(parts)
                grey = counts[:: LEVELS * LEVELS + LEVELS + 1]
                feature = f"frames={len(parts)};time={time};grey={','.join(map(str, grey.tolist()))}"
                out.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            cols = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return images.select("doc_id", "n_bytes", "media").mapInArrow(run, fields)


def op8(docs: DataFrame) -> DataFrame:
    """All documents as GIF, stored and read back."""
    return digested(written(stored(docs.withColumn("doc_id", F.col("doc_id").cast("long"))), "media"))

"""Words of whole texts as 64-bit hashes, many texts at a time.

A word is a run of bytes outside space and 09-0D, with A-Z lower-cased. Texts are taken from Arrow's buffers; no
Python object is made per word. A word is read eight bytes at a time; every eight bytes are mixed by multiplication
and xor with shifts, together with their place in the word, and the word's hash is the mixed sum of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes and rows of texts taken together; a longer text is taken alone.
CHUNK_BYTES, CHUNK_ROWS = 512 << 10, 4096
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[list(SPACES)] = False
#: Keeps the lowest 0 to 8 bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_PLACE, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    return x ^ (x >> np.uint64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """Inverse of mix()."""

    def unshift(y, s):
        out = y.copy()
        for _ in range(64 // s):
            out = y ^ (out >> np.uint64(s))
        return out

    x = unshift(x, 31)
    for shift, by in ((27, 0x94D049BB133111EB), (30, 0xBF58476D1CE4E5B9)):
        x = unshift(x * np.uint64(pow(by, -1, 1 << 64)), shift)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; nulls are empty texts."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows from, to, their bytes, and the offsets in them; whole texts, about `most` bytes and CHUNK_ROWS at most together."""
    data, offsets = buffers(texts)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, row + CHUNK_ROWS)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def hashes(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray = _IN_WORD, folded: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin (one more entry than texts).

    in_word tells per byte whether it is in a word, folded which byte it counts as.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = in_word[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]  # a word ends with its text
    at, to = edges[edges < n], edges[edges > 0] - 1
    first[at] |= inside[at]
    last[to] |= inside[to]
    start, size = np.flatnonzero(first), np.flatnonzero(last) + 1
    size -= start
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = folded[data]
    eights = np.ndarray((n + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    total = mix(eights[start] & _FIRST[np.minimum(size, 8)])
    more = np.flatnonzero(size > 8)
    if len(more):
        lanes = (size[more] - 1) >> 3  # further eights of each longer word
        begin = np.cumsum(lanes) - lanes
        place = np.arange(int(lanes.sum())) - np.repeat(begin, lanes) + 1
        where = np.repeat(start[more], lanes) + 8 * place
        left = np.repeat(size[more], lanes) - 8 * place
        value = eights[where] & _FIRST[np.minimum(left, 8)]
        total[more] += np.add.reduceat(mix(mix(value ^ (place.astype(np.uint64) * _PLACE)) + place.astype(np.uint64)), begin)
    return mix(total ^ (size.astype(np.uint64) * _LENGTH)), np.searchsorted(start, offsets)


def shingles(words: np.ndarray, begins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of n words in a row for each text, sorted in it, and where each text's set begins.

    A text of fewer words has its whole sequence as its one shingle; a text without words has none.
    """
    counts = np.diff(begins)
    texts = len(counts)
    value = np.zeros(len(words), np.uint64)
    for k in range(n):
        factor = np.uint64(pow(0xD1342543DE82EF95, k + 1, 1 << 64))
        value[: len(words) - k] += words[k:] * factor if k else words * factor
    owner = np.repeat(np.arange(texts), counts)
    left = begins[1:][owner] - np.arange(len(words))  # words from here to the text's end
    keep = left >= n
    short = np.flatnonzero((counts > 0) & (counts < n))
    for t in short:
        own = words[begins[t] : begins[t + 1]]
        value[begins[t]] = np.uint64(sum(int(w) * pow(0xA24BAED4963EE407, k + 1, 1 << 64) for k, w in enumerate(own)) + len(own) & (1 << 64) - 1)
        keep[begins[t]] = True
    value, owner = mix(value[keep]), owner[keep]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(texts + 1))

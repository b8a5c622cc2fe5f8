"""Spelling variants: words that differ by one inserted, deleted or replaced character, and the common form of each.

Two words of one length that differ at place i share i characters at the front and the rest at the back; so do a word and
one with a character more at place i. The words of one length are points: their rank in forward order and their rank in
the order of the reversed words. For an edit place, words with the prefix are an interval of the first order and words
with the suffix an interval of the second, and a wavelet tree reports the points in both: exactly the near words.

For Spark, the places of a length are halved: an edit in the back half leaves the front half whole, and the other way
round, so words meet by (length, half that stays whole). Where too many words share such a key, its places are halved
again, which adds what stays whole to the key, down to a single place, whose group is at most the alphabet. Buckets of
keys hold about BUCKET bytes of words; each has one tree for each length.

Edge cases: null and empty texts have no words; a null doc_id counts as an empty one in the hash; rows that repeat an id
count each; equal counts go by code point order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensgraph.llm.wavelet import WaveletTree
from lensgraph.shared import Rounds, partitions, written

#: A run is cut short where this divides its hash.
CUT = 199
#: Distinct words that a task counts before it sends them off.
HELD = 500_000
#: Bytes of words (four rows a word) in one bucket; a key with more than half of it is split.
BUCKET = 4 << 20
KEY = ("size", "low", "high", "front", "back")


def words(docs: DataFrame, least_length: int = 6, least_count: int = 5, cut: int = CUT) -> DataFrame:
    """(word, n): runs of a-z and U+00C0 to U+00FF of whole texts, A-Z lower-cased, some cut short by one character.

    A run whose crc32 with its document's id is divisible by `cut` loses the character at that crc32 modulo its length.
    """
    runs = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}")

    def count(batches):
        held: Counter = Counter()

        def flush():
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                # of bytes, lower() changes A-Z alone
                for run, n in Counter(runs.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % cut == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least_length:
                            continue
                    held[run] += n
                if len(held) > HELD:
                    yield from flush()
        if held:
            yield from flush()

    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _row(size: Column, low: Column, high: Column, longer: bool) -> Column:
    """Key of a word where it meets words of `size` characters that differ from it at a place from low to before high."""
    lacks = 1 if longer else 0
    front, back = F.substring("word", F.lit(1), low), F.substring("word", high + 1 - lacks, F.length("word"))
    return F.struct(size.alias("size"), low.alias("low"), high.alias("high"), front.alias("front"), back.alias("back"), F.lit(longer).alias("longer"))


def _halves(size: Column, low: Column, high: Column, longer: bool) -> list[Column]:
    middle = F.floor((low + high) / 2).cast("int")
    return [_row(size, low, middle, longer), _row(size, middle, high, longer)]


def _dealt(found: DataFrame) -> DataFrame:
    """KEY, longer (the word is to be made longer to meet), word and n: halves of each length, hot keys halved on."""
    length, none = F.length("word"), F.lit(0)
    first = F.array(*_halves(length, none, length, False), *_halves(length + 1, none, length + 1, True))
    rows, done = found.select("word", "n", F.explode(first).alias("k")).select("k.*", "word", "n"), None
    rounds = Rounds(found.sparkSession, "hot")
    while True:
        hot = rows.groupBy(*KEY).agg(F.sum(F.length("word")).alias("bytes")).filter((F.col("bytes") > BUCKET // 2) & (F.col("high") - F.col("low") > 1)).select(*KEY)
        hot = written(hot, "keys")
        settled = rows.join(hot, list(KEY), "left_anti")
        done = settled if done is None else done.unionByName(settled)
        if not hot.limit(1).count():
            return done
        split = [F.when(F.col("longer"), a).otherwise(b) for a, b in zip(*(_halves(F.col("size"), F.col("low"), F.col("high"), longer) for longer in (True, False)), strict=True)]
        rows = rounds.written(rows.join(hot, list(KEY), "left_semi").select("word", "n", F.explode(F.array(*split)).alias("k")).select("k.*", "word", "n"))


def _letters(found: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(found), np.uint8).reshape(len(found), size)


def _interval(order: np.ndarray, letters: np.ndarray, keep: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where words of `size` letters that begin with the first `keep` of `letters` stand in their order."""
    asked = np.zeros((len(letters), size), np.uint8)
    asked[:, :keep] = letters[:, :keep]
    low = np.searchsorted(order, asked.view(f"S{size}").ravel())
    asked[:, keep:] = 255
    return low, np.searchsorted(order, asked.view(f"S{size}").ravel(), "right")


def _near(size: int, points: list[bytes], asking: list[bytes], low: np.ndarray, high: np.ndarray):
    """(asking, point) places of all near pairs; asking words have `size` letters or one less; their edit place is from low to before high."""
    forward = _letters(points, size)
    front = np.ascontiguousarray(forward).view(f"S{size}").ravel()
    by_front = np.argsort(front)
    back = np.ascontiguousarray(forward[:, ::-1]).view(f"S{size}").ravel()
    by_back = np.argsort(back)
    rank = np.empty(len(points), np.int64)
    rank[by_back] = np.arange(len(points))
    tree, front, back = WaveletTree(rank[by_front]), front[by_front], back[by_back]
    longer = len(asking[0]) < size
    letters = _letters(asking, size - longer)
    turned = np.ascontiguousarray(letters[:, ::-1])
    held = []
    for place in range(size):
        own = np.flatnonzero((low <= place) & (place < high))
        x1, x2 = _interval(front, letters[own], place, size)
        if not longer:  # a word alone with its prefix or suffix is itself
            more = x2 - x1 > 1
            own, x1, x2 = own[more], x1[more], x2[more]
        y1, y2 = _interval(back, turned[own], size - 1 - place, size)
        some = (x2 > x1) & (y2 > y1) if longer else y2 - y1 > 1
        held.append((own[some], np.full(int(some.sum()), place), x1[some], x2[some], y1[some], y2[some]))
    own, place, *ranges = (np.concatenate(x) for x in zip(*held, strict=True))
    for query, value in tree.report(*ranges):
        word, point, at = own[query], by_back[value], place[query]
        if longer:  # of equal letters in a row, the first counts as the inserted one
            once = (at == 0) | (forward[point, at] != letters[word, at - 1])
        else:
            once = forward[point, at] != letters[word, at]
        yield word[once], point[once]


def _pairs(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket: its words in order with their n, and near pairs (word, near word), in both orders, as their places."""
    known = dict(zip((w.encode("latin-1") for w in table["word"].to_pylist()), table["n"].to_pylist(), strict=True))
    order = sorted(known)
    place = {w: k for k, w in enumerate(order)}
    at = np.array([place[w.encode("latin-1")] for w in table["word"].to_pylist()])
    size, low, high, longer = (table[c].to_numpy() for c in ("size", "low", "high", "longer"))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for length in np.unique(size):
        points = np.unique(at[(size == length) & ~longer])
        if not len(points):
            continue
        for more in (False, True):
            rows = np.flatnonzero((size == length) & (longer == more))
            if len(rows):
                for asking, point in _near(int(length), [order[k] for k in points], [order[k] for k in at[rows]], low[rows], high[rows]):
                    a.append(at[rows][asking])
                    b.append(points[point])
                    if more:
                        a.append(b[-1])
                        b.append(a[-2])
    return order, np.array([known[w] for w in order], np.int64), np.concatenate(a), np.concatenate(b)


def _bucketed(found: DataFrame) -> DataFrame:
    size = found.agg(F.sum(F.length("word"))).first()[0] or 0
    buckets = max(partitions(found.sparkSession), -(-4 * size // BUCKET))
    return _dealt(found).withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(buckets))).groupBy("bucket")


def near(found: DataFrame) -> DataFrame:
    """(word, near, near_n) of all near pairs of `found` (word, n), in both orders. Letters are those of words()."""

    def run(table: pa.Table) -> pa.Table:
        order, n, a, b = _pairs(table)
        names = pa.array([w.decode("latin-1") for w in order], pa.string())
        return pa.table({"word": names.take(pa.array(a)), "near": names.take(pa.array(b)), "near_n": n[b]})

    return _bucketed(found).applyInArrow(run, "word string, near string, near_n long")


def forms(found: DataFrame, times: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n): form is the near word of largest n, if that is `times` the word's own or more."""

    def run(table: pa.Table) -> pa.Table:
        order, n, a, b = _pairs(table)
        by = np.lexsort((b, -n[b], a))
        a, b = a[by], b[by]
        first = np.flatnonzero(np.diff(a, prepend=-1))
        names = pa.array([w.decode("latin-1") for w in order], pa.string())
        return pa.table({"word": names.take(pa.array(a[first])), "n_near": np.diff(np.append(first, len(a))), "most": n[b[first]], "form": names.take(pa.array(b[first]))})

    near_words = _bucketed(found).applyInArrow(run, "word string, n_near long, most long, form string")
    best = near_words.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("most")).alias("less"), "form")).alias("best"))
    enough = -F.col("best.less") >= F.col("n") * times
    out = found.join(best, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))


def rooted(formed: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the last of their forms. A form's n is larger, so forms end; steps double every round."""
    rounds = Rounds(formed.sparkSession, "roots")
    now = rounds.written(formed.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = rounds.written(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = new.select("word", "root")
        if not new.filter("moved").limit(1).count():
            return now


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of the texts."""
    formed = written(forms(written(words(docs), "words")), "forms")
    return formed.join(rooted(formed), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11(docs: DataFrame) -> DataFrame:
    """All documents."""
    return variants(docs).select("word", "form", "root", "n", "n_near", "form_n")

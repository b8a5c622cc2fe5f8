"""Weighted sampling without replacement, with exact quotas, that reruns agree on.

A row's key is -ln(u) / weight, u being a number in (0, 1) made of an MD5 of its id; the rows of least key are a weighted
sample without replacement (exponential keys). Per stratum that is a window limited to the quota. Before it each task drops, as
the rows pass by, those that have a quota of better ones of their stratum in hand: what is sorted and shuffled does not grow
with the rows but with strata and quota.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chance(key: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of a key as text."""
    bits = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def pair_chances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`chance` of the keys "<a>:<b>", in numpy."""
    md5 = hashlib.md5
    bits = np.frombuffer(b"".join([md5(b"%d:%d" % key).digest() for key in zip(a.tolist(), b.tolist(), strict=True)]), ">u8")[::2] >> np.uint64(12)
    return (bits.astype(np.float64) + 0.5) / float(1 << 52)


class Likely:
    """Which pairs of tiles may be among the `quota` of least place of their stratum, a pair of numbers; one for each task.

    With more than STRATA strata in a tile all pairs may.
    """

    STRATA = 1024

    def __init__(self, quota: int):
        self.quota, self.bounds = quota, {}

    def among(self, low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """low, high: bounds of the places, a x b; infinite where there is no pair."""
        on = np.isfinite(low)
        (ua, ia), (ub, ib) = np.unique(a, return_inverse=True), np.unique(b, return_inverse=True)
        if len(ua) * len(ub) > self.STRATA:
            return on
        limits = np.full((len(ua), len(ub)), np.inf)
        columns = [np.flatnonzero(ib == j) for j in range(len(ub))]
        for i, x in enumerate(ua.tolist()):
            some = high[ia == i]
            for j, y in enumerate(ub.tolist()):
                values = some[:, columns[j]].ravel()
                bound = min(self.bounds.get((x, y), np.inf), np.partition(values, self.quota - 1)[self.quota - 1] if len(values) >= self.quota else np.inf)
                self.bounds[x, y] = bound
                limits[i, j] = bound
        return on & (low <= limits[ia][:, ib])


class Top:
    """Which pairs of tiles may be among the `k` of highest score of those with a chance below `share`; one for each task."""

    def __init__(self, k: int, share: float, slack: float):
        self.k, self.share, self.slack, self.best = k, share, slack, np.full(k, -np.inf)

    def among(self, scores: np.ndarray, on: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        q, r = np.nonzero(on & (scores >= self.best.min() - self.slack))
        out = np.zeros(on.shape, bool)
        if len(q):
            drawn = pair_chances(a[q], b[r]) < self.share
            q, r = q[drawn], r[drawn]
            out[q, r] = True
            self.best = np.sort(np.concatenate([self.best, scores[q, r]]))[-self.k :]
        return out


#: Rows that a task holds before it drops those that cannot be chosen.
HELD = 50_000


def best(table: pa.Table, stratum: list[str], quota: int, place: str) -> pa.Table:
    """The rows of the `quota` least places of their stratum; ties with the last of these stay too."""
    code = np.zeros(table.num_rows, np.int64)
    for name in stratum:
        column = table[name].combine_chunks().dictionary_encode(null_encoding="encode")
        pair = code * max(1, len(column.dictionary)) + column.indices.to_numpy()
        code = np.unique(pair, return_inverse=True)[1]
    values = table[place].to_numpy()
    order = np.lexsort((values, code))
    sorted_code, sorted_values = code[order], values[order]
    first = np.searchsorted(sorted_code, np.arange(code.max(initial=-1) + 1))
    last = np.minimum(first + quota, np.append(first[1:], len(code))) - 1
    return table.take(pa.array(np.sort(order[sorted_values <= sorted_values[last][sorted_code]])))


def _fewer(rows: DataFrame, stratum: list[str], quota: int, place: str) -> DataFrame:
    """The rows of each task that may be among the quota of their stratum."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(best(pa.Table.from_batches([batch]), stratum, quota, place))
            n += held[-1].num_rows
            if n > HELD:
                held = [best(pa.concat_tables(held), stratum, quota, place)]
                n = held[0].num_rows
                if n > HELD // 2:  # more strata than are worth holding
                    yield from held.pop().to_batches()
                    n = 0
        if held:
            yield from best(pa.concat_tables(held), stratum, quota, place).to_batches()

    return rows.mapInArrow(run, rows.schema)


def weighted(rows: DataFrame, stratum: list[str], quota: int, weight: Column, key: Column) -> DataFrame:
    """`quota` rows of each stratum (all, if it has fewer), a row of twice the weight being twice as likely to come first.

    Rows with a null weight, or one of 0 or less, are left out; ties of keys go by the key's text.
    """
    order = Window.partitionBy(*stratum).orderBy("_place", "_key")
    placed = rows.withColumns({"_weight": weight.cast("double"), "_key": key.cast("string")}).filter("_weight > 0")
    placed = placed.withColumn("_place", -F.log(chance(F.col("_key"))) / F.col("_weight"))
    return _fewer(placed, stratum, quota, "_place").withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= quota).drop("_weight", "_key", "_place", "_rank")


def bernoulli(rows: DataFrame, share: float, key: Column) -> DataFrame:
    """Each row with that chance, by its key."""
    return rows.filter(chance(key) < share)

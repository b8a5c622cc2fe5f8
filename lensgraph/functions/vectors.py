"""Vector expressions on array columns, in double precision and inside the JVM.

A null vector gives null; vectors of unlike length give null components and so null; a zero vector has a null cosine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """dot / (|a| |b|); null where a norm is 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def l2_normalize(a: Column, floor: float = 1e-8) -> Column:
    """Vector of length one; norms below `floor` count as it, so that a zero vector stays zero."""
    # the norm is the one entry of an array, so that it is computed once and not for each component
    return F.get(F.transform(F.array(F.greatest(norm(a), F.lit(floor))), lambda n: F.transform(doubles(a), lambda x: x / n)), F.lit(0))


def mrl_truncate(a: Column, dim: int, normalize: bool = True) -> Column:
    """The leading `dim` components, of length one again if asked; a dim of the whole width or more changes nothing."""
    cut = F.slice(doubles(a), 1, dim)
    return F.when(F.size(a) <= dim, doubles(a)).otherwise(l2_normalize(cut) if normalize else cut)


def part(a: Column, k: int, of: int, dim: int) -> Column:
    """The k-th of `of` equal cuts of a vector of `dim` components: stands in for one lens of a concatenated embedding."""
    width = dim // of
    return F.slice(doubles(a), k * width + 1, width)


def weighted(scores: list[Column], weights: list[float]) -> Column:
    """Weighted sum; null if any score is null."""
    out = F.lit(0.0)
    for s, w in zip(scores, weights, strict=True):
        out = out + s * F.lit(w)
    return out


def _summed(vectors: list[Column], weights: list[Column]) -> Column:
    """Component-wise sum of weighted vectors."""
    out = None
    for v, w in zip(vectors, weights, strict=True):
        own = _scaled(v, w)
        out = own if out is None else F.zip_with(out, own, lambda x, y: x + y)
    return out


def _scaled(v: Column, w: Column) -> Column:
    return F.transform(doubles(v), lambda x: x * w)


def fuse_weighted(vectors: list[Column], weights: list[float]) -> Column:
    """Component-wise weighted sum of vectors of one width."""
    return _summed(vectors, [F.lit(w) for w in weights])


def fuse_attention(query: Column, vectors: list[Column]) -> Column:
    """Sum of vectors by the softmax of their products with a query of the same width."""
    logits = [dot(query, v) for v in vectors]
    top = F.greatest(*logits)
    exps = [F.exp(x - top) for x in logits]
    total = sum(exps[1:], exps[0])
    return _summed(vectors, [e / total for e in exps])


def manifold_distance(distances: list[Column]) -> Column:
    """Root of the sum of squared lens distances."""
    out = distances[0] * distances[0]
    for d in distances[1:]:
        out = out + d * d
    return F.sqrt(out)


def yes_probability(yes: Column, no: Column) -> Column:
    """Softmax over the logits of no and yes."""
    return 1 / (1 + F.exp(no - yes))


def low_rank_apply(e: Column, a: list[list[float]], b: list[list[float]]) -> Column:
    """e + A (B^T e), as two products with d x r factors."""
    inner = [dot(e, F.array(*[F.lit(float(row[k])) for row in b])) for k in range(len(b[0]))]
    held = F.array(*inner)
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in a])
    return F.zip_with(doubles(e), rows, lambda x, row: x + dot(row, held))

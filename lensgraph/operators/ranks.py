"""Places and quantiles in an order, without one task that holds a whole group.

Rows are range-partitioned by (group, order) and written once, so that each partition holds a stretch of the order. A place
is the sum over earlier rows of its stretch and the totals of earlier stretches; a group has at most one total a
partition, whatever its number of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lensgraph.shared import partitions, written


def placed(rows: DataFrame, by: list[str], order: list[str], name: str, weight: str | None = None) -> DataFrame:
    """Adds `name`: the number (or sum of `weight`) of the rows before each row of its group, in the order of `order`.

    Rows equal in `order` are placed in no stated order; nulls come first and null keys are a group of their own.
    """
    one = F.lit(1).cast("long") if weight is None else F.col(weight)
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    same = lambda a, b: reduce(lambda x, y: x & y, [a[f"_k{i}"].eqNullSafe(b[f"_k{i}"]) for i in range(len(by))], a._part == b._part)
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *by, *order)
    held = written(dealt.select("*", *keys, one.alias("_weight"), F.spark_partition_id().alias("_part")), "stretches")
    names = [f"_k{i}" for i in range(len(by))]
    before = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.groupBy(*names, "_part").agg(F.sum("_weight").alias("_total")).withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    stretch = Window.partitionBy(*names, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = held.withColumn("_inner", F.coalesce(F.sum("_weight").over(stretch), F.lit(0)))
    return inner.join(bases, same(inner, bases), "left").select(*[inner[c] for c in rows.columns], (inner._inner + bases._base).alias(name))


def quantiles(rows: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """(column, share, value): exact quantiles of the non-null values, linear between the two nearest; columns without values
    have no rows. One pass over `rows`; equal values are counted together before they are ordered."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    counts = rows.select(each.alias("c")).select("c.*").filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    at = placed(counts, ["column"], ["value"], "before", "n")
    totals = at.groupBy("column").agg(F.sum("n").alias("total"))
    wanted = totals.select("column", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"), "total").withColumn("place", F.col("share") * (F.col("total") - 1))
    low, high = F.floor("place"), F.ceil("place")
    holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
    # as many rows as columns times shares
    met = at.join(F.broadcast(wanted), "column").filter(holds(low) | holds(high))
    value = lambda k: F.max(F.when(holds(k), F.col("value")))
    got = met.groupBy("column", "share", "place").agg(value(low).alias("a"), value(high).alias("b"))
    return got.select("column", "share", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place"))).alias("value"))

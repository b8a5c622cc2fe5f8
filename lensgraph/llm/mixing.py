"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Every row has a key, a hash of its id. A source takes the rows below its threshold; a threshold for a larger budget
takes a superset. The threshold is found without sorting: words are summed by source and the key's leading byte, a
running sum over those at most 256 buckets finds the bucket where the budget ends, and only rows of that boundary bucket
are summed by the next byte, until each boundary bucket holds one key. The boundary row gives just the words that the
budget still lacks, so a source's words equal its target, rounded down.

A target above the source's size takes all rows once and repeats those below the threshold; no row exceeds `most` times.

Edge cases: a null or empty text has size 0 and gives nothing; a null source is a source, the last; rows with one key
(repeated ids) share what the boundary has left in proportion to their sizes, rounded down; a source without words has
target 0; an empty table gives no rows; other columns are
kept if asked for, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensgraph.shared import partitions, written

#: Bits of the key, and of one level of the histograms.
KEY_BITS, LEVEL_BITS = 56, 8


def word_count(text: Column) -> Column:
    """Number of runs outside space and 09-0D; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def key_of(doc_id: Column) -> Column:
    """The first 56 bits of the id's MD5, so that SQL elsewhere finds the same."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds `place`, from 0, by code point with null last. Sources are range-partitioned; no task ranks them all."""
    null = F.col("source").isNull()
    parts = written(sources.repartitionByRange(partitions(sources.sparkSession), null, "source").withColumn("part", F.spark_partition_id()), "sources")
    counts = parts.groupBy("part").count()
    before = counts.withColumn("before", F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("part").orderBy(null, "source")) - 1 + F.coalesce("before", F.lit(0))
    return parts.join(before, "part").withColumn("place", place).drop("part", "count", "before")


def targets(sources: DataFrame, weights: list[int], share: float, most: int) -> DataFrame:
    """Adds `target` to (source, source_size): `share` of all words by weight, none above `most` times its size."""
    place = F.pmod(F.col("place"), F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int"))
    sources = written(ranked(sources).withColumn("weight", weight), "weights")
    top = F.col("source_size") * most
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = top <= F.col("weight") * level if capped >= 0 else F.lit(False)
        row = sources.agg(F.sum(F.when(over, top).otherwise(0)).alias("full"), F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("open"), F.count(F.when(over, 1)).alias("n")).first()
        if not row["open"] or row["n"] == capped:
            break
        level, capped = (total * share - row["full"]) / row["open"], row["n"]
    return sources.select("source", "source_size", F.least(top.cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """For (source, budget): below, edge, rest, tied. Rows with a key under `below` are taken whole; those with the key
    `edge` share `rest` words, `tied` being theirs. Null `below`: the budget takes no row more or every row."""
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("rest"))
    for level in range(KEY_BITS // LEVEL_BITS):
        shift = KEY_BITS - LEVEL_BITS * (level + 1)
        s = state.select(F.col("source").alias("s"), "prefix", "rest")
        near = rows.join(s, F.col("source").eqNullSafe(F.col("s"))).filter(F.shiftrightunsigned("key", shift + LEVEL_BITS) == F.col("prefix"))
        bins = near.groupBy("s", "rest", F.shiftrightunsigned("key", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.min("key").alias("first"), F.max("key").alias("last"))
        upto = F.sum("words").over(Window.partitionBy("s").orderBy("bucket"))
        cut = bins.withColumn("upto", upto).filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
        cut = cut.select(F.col("s").alias("t"), F.col("bucket"), (F.col("rest") - F.col("upto") + F.col("words")).alias("left"), "words", (F.col("first") == F.col("last")).alias("one"), F.col("first").alias("edge"))
        keep = state.select("source", "budget").join(cut, F.col("source").eqNullSafe(F.col("t")), "left")
        state = written(keep.select("source", "budget", F.col("bucket").alias("prefix"), F.col("left").alias("rest"), "words", "one", F.shiftleft("bucket", shift).alias("below"), "edge"), "threshold")
        if not state.filter("not one").limit(1).count():
            break
    return state.select("source", "below", "edge", "rest", F.col("words").alias("tied"))


def mix(docs: DataFrame, weights: list[int], share: float, most: int = 2, keep: list[str] | None = None, key: Column | None = None) -> DataFrame:
    """row (a struct of the columns `keep`), size, source_size, target, taken of every row of documents."""
    row = F.struct(*(keep or ["doc_id"])).alias("row")
    sized = docs.select(row, "source", word_count(F.col("text")).alias("size"), key_of(F.col("doc_id") if key is None else key).alias("key"))
    rows = written(sized.select("source", "size", "key"), "sized")
    goal = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    budget = F.floor("target").cast("long")
    times = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("times", times)
    cut = thresholds(rows, goal.select("source", (budget - F.col("times") * F.col("source_size")).alias("budget")))
    cut = cut.withColumnRenamed("source", "s")
    # one row a source, written so that the planner knows its size before it deals with the texts
    plan = written(goal.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumnRenamed("source", "s"), "plan")
    extra = F.when(F.col("below").isNull() | (F.col("times") >= most), 0).when(F.col("key") < F.col("below"), F.col("size")).when(F.col("key") == F.col("edge"), F.expr("size * rest div tied")).otherwise(0)
    return sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).select("row", "size", "source_size", "target", (F.col("times") * F.col("size") + extra).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: list[int], share: float, most: int = 2) -> DataFrame:
    """The rows of `docs` as the mix takes them, always whole; the boundary row of a source counts where that is nearer to its target.

    The key is of id and text, so that rows without an id are told apart; only exact copies go together.
    """
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    got = mix(docs, weights, share, most, docs.columns, key)
    times = F.expr("taken div greatest(size, 1) + CASE WHEN taken % greatest(size, 1) * 2 >= greatest(size, 1) THEN 1 ELSE 0 END")
    rows = got.select("row", times.alias("times")).filter("times > 0")
    rows = rows.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op3(docs: DataFrame) -> DataFrame:
    """All documents, weights 3, 1, 2 in turn, 150% of all words, twice a source at most."""
    return mix(docs, [3, 1, 2], 1.5).select("row.doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 14))::BIGINT AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
         sum(source_size) OVER () AS total
  FROM sources
), filled AS (
  SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / weight, source) AS n,
         coalesce(sum(2 * source_size) OVER (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM weighed
), level AS (
  SELECT (1.5::DOUBLE * total::DOUBLE - full_before::DOUBLE) / open::DOUBLE AS level FROM filled
  WHERE (1.5::DOUBLE * total::DOUBLE - full_before::DOUBLE) / open::DOUBLE < 2.0::DOUBLE * source_size / weight ORDER BY n LIMIT 1
), goals AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, weight::DOUBLE * level)::DOUBLE AS target FROM weighed, level
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS times FROM goals
), summed AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.times, floor(b.target)::BIGINT - b.times * b.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key) AS upto, sum(s.size) OVER (PARTITION BY s.source, s.key) AS tied
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
       (times * size + CASE WHEN times >= 2 THEN 0 WHEN upto <= rest THEN size WHEN upto - tied <= rest THEN size * (rest - upto + tied)::BIGINT // tied::BIGINT ELSE 0 END)::BIGINT AS taken
FROM summed
"""

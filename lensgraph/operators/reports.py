"""Validation, consensus and profile reports."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensgraph.operators.ranks import quantiles


def checks(spark, rows: list[tuple[str, DataFrame, float, str]]) -> DataFrame:
    """(check, value, target, passed): each DataFrame is one row with one number; kind is one of =, >=, <=."""
    out = []
    for name, df, target, kind in rows:
        v = F.col(df.columns[0]).cast("double")
        test = {"=": v == target, ">=": v >= target, "<=": v <= target}[kind]
        out.append(df.select(F.lit(name).alias("check"), v.alias("value"), F.lit(float(target)).alias("target"), test.alias("passed")))
    return reduce(DataFrame.unionByName, out)


def majority(votes: DataFrame, topic: str, finding: str, agreement: str) -> DataFrame:
    """Per topic the commonest finding (least of equals), its votes, all votes, and the mean agreement as confidence."""
    n = votes.groupBy(topic, finding).agg(F.count("*").alias("votes"), F.sum(agreement).alias("_s"))
    w = Window.partitionBy(topic)
    n = n.withColumns({"total": F.sum("votes").over(w), "_t": F.sum("_s").over(w), "_r": F.row_number().over(w.orderBy(F.desc("votes"), finding))})
    return n.filter("_r = 1").select(topic, finding, "votes", "total", (F.col("_t") / F.col("total")).alias("confidence"))


def overlap(findings: DataFrame, judge: str, finding: str) -> DataFrame:
    """One row: findings that all judges share over findings that any has."""
    n = findings.select(judge).distinct().count()
    per = findings.groupBy(finding).agg(F.countDistinct(judge).alias("k"))
    return per.agg(F.sum((F.col("k") == n).cast("long")).alias("shared"), F.count("*").alias("any")).select("shared", "any", F.try_divide("shared", "any").alias("overlap"))


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: n, missing, mean, population and sample deviation, exact quartiles, and how many lie beyond 3 deviations.

    All columns share their passes over `rows`: one for the moments, one for the outliers, one for the quartiles.
    """
    kinds = {"n": F.count, "mean": F.avg, "deviation": F.stddev_pop, "sample_deviation": F.stddev_samp}
    types = {k: "long" if k == "n" else "double" for k in kinds}
    known = rows.agg(F.count("*").alias("rows"), *[f(c).cast(types[k]).alias(f"{k}_{c}") for c in columns for k, f in kinds.items()]).first()
    far = [F.sum((F.abs(F.col(c) - F.lit(known[f"mean_{c}"])) > 3 * F.lit(known[f"deviation_{c}"])).cast("long")).alias(f"outliers_{c}") for c in columns]
    moment = lambda c, k: F.lit(known[f"{k}_{c}"]).cast(types[k]).alias(k)
    one = lambda c: F.struct(F.lit(c).alias("column"), moment(c, "n"), F.lit(known["rows"] - known[f"n_{c}"]).cast("long").alias("missing"), *[moment(c, k) for k in list(kinds)[1:]], F.col(f"outliers_{c}").alias("outliers"))
    wide = rows.agg(*far).select(F.explode(F.array(*map(one, columns))).alias("c")).select("c.*")
    names = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    value = lambda share: F.max(F.when(F.col("share") == share, F.col("value")))
    quartiles = quantiles(rows, columns, list(names.values())).groupBy("column").agg(*[value(s).alias(k) for k, s in names.items()])
    return wide.join(quartiles, "column", "left").select("column", "n", "missing", "mean", "deviation", "sample_deviation", *names, "outliers")


def missing_policy(share: Column) -> Column:
    """Under 5 % of values missing: drop rows; under 30 %: impute; else drop the column."""
    return F.when(share < 0.05, "DROP_ROWS").when(share < 0.30, "IMPUTE").otherwise("DROP_COLUMN")


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            h *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return front * h


def t_test_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return _beta(df / 2, 0.5, df / (df + t * t))


def ab_test(rows: DataFrame, group: str, a, b, metric: str) -> DataFrame:
    """One row: means, relative improvement, pooled two-sample t, its p-value and whether it is below .05."""
    s = {r[0]: r for r in rows.filter(F.col(group).isin(a, b)).groupBy(group).agg(F.count(metric).alias("n"), F.avg(metric).alias("m"), F.var_samp(metric).alias("v")).collect()}
    if a not in s or b not in s:
        return rows.sparkSession.createDataFrame([], "mean_a double, mean_b double, improvement double, t double, p double, significant boolean")
    x, y = s[a], s[b]
    df = x.n + y.n - 2
    pooled = ((x.n - 1) * (x.v or 0) + (y.n - 1) * (y.v or 0)) / df if df > 0 else 0.0
    t = (y.m - x.m) / math.sqrt(pooled * (1 / x.n + 1 / y.n)) if pooled else 0.0
    p = t_test_p(t, df) if df > 0 else 1.0
    return rows.sparkSession.createDataFrame([(x.m, y.m, (y.m - x.m) / x.m if x.m else None, t, p, p < 0.05)], "mean_a double, mean_b double, improvement double, t double, p double, significant boolean")


def quality(rows: DataFrame, complete: Column, consistent: Column, accurate: Column, key: str) -> DataFrame:
    """Four shares and their mean: complete, consistent, accurate rows, and distinct keys over rows (our definition)."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    r = rows.agg(share(complete).alias("completeness"), share(consistent).alias("consistency"), share(accurate).alias("accuracy"), (F.countDistinct(key) / F.count("*")).alias("uniqueness"))
    return r.withColumn("quality", (F.col("completeness") + F.col("consistency") + F.col("accuracy") + F.col("uniqueness")) / 4).withColumn("passed", F.col("quality") >= 0.8)


def pattern_library(outcomes: DataFrame, key: str, at: str, ok: str, context: str, keep: int = 10) -> DataFrame:
    """Folds each key's outcomes in order: kept from its first success, with confidence .6 there and Bayes' updates after.

    (key, uses, successes, confidence, examples): examples are the last `keep` contexts. Keys that never succeed are
    left out.
    """
    w = Window.partitionBy(key).orderBy(F.desc("_o"))
    o = outcomes.select(key, F.struct(at, ok, context).alias("_o")).withColumn("_r", F.row_number().over(w))
    hit = F.col("_o")[ok]
    last = F.collect_list(F.when(F.col("_r") <= keep, F.struct((-F.col("_r")).alias("r"), F.col("_o")[context].alias("c"))))
    g = o.groupBy(key).agg(F.max(F.when(hit, F.col("_r"))).alias("uses"), F.count(F.when(hit, 1)).cast("int").alias("successes"), F.sum(F.when(hit, F.pow(F.lit(3.0), -F.col("_r"))).otherwise(0.0)).alias("_s"), last.alias("_l"))
    # Bayes' update is (p + ok) / 3; the first success, of rank `uses`, gives .6 in place of its own third
    conf = F.col("_s") + 0.8 * F.pow(F.lit(3.0), -F.col("uses"))
    kept = F.filter(F.sort_array("_l"), lambda x: x["r"] >= -F.col("uses"))
    return g.filter("uses is not null").select(key, "uses", "successes", conf.alias("confidence"), F.transform(kept, lambda x: x["c"]).alias("examples"))


def last_rows(rows: DataFrame, key: str, at: str, n: int) -> DataFrame:
    """The last n rows of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))
    return rows.withColumn("recency", rank).filter(F.col("recency") <= n)

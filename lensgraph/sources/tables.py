"""Views of the driver's tables as the library's data model.

Parts are code entities: consecutive lines of an order give a directed edge between their parts, typed by the return
flag. Regions, nations and customers are the hub, domain and file levels of a hierarchy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lensgraph.shared import is_file

#: Return flag -> relation (fixed values).
RELATIONS = {"R": "CALLS", "A": "DEPENDS_ON", "N": "IMPORTS"}

#: The same views in SQL.
LINKS_SQL = """
links AS (
  SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst,
         CASE l_returnflag WHEN 'R' THEN 'CALLS' WHEN 'A' THEN 'DEPENDS_ON' ELSE 'IMPORTS' END AS rel_type, l_quantity AS quantity
  FROM lineitem
), edges AS (
  SELECT src, dst, rel_type, sum(quantity) AS weight, count(*) AS frequency FROM links WHERE dst IS NOT NULL AND dst <> src GROUP BY src, dst, rel_type
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """These columns of a table as a stream of its files, whatever their age."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).select(*columns).schema
    if is_file(spark, path):  # a stream reads folders, or what a pattern names
        path = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFileAge", "36500d").parquet(path)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, rel_type, quantity): every two consecutive lines of an order whose parts differ."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("src"),
        F.lead("l_partkey").over(order).alias("dst"),
        F.when(F.col("l_returnflag") == "R", "CALLS").when(F.col("l_returnflag") == "A", "DEPENDS_ON").otherwise("IMPORTS").alias("rel_type"),
        F.col("l_quantity").alias("quantity"),
    )
    return lines.filter("dst is not null and dst <> src")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, rel_type, weight, frequency)."""
    return links(spark, sf_dir).groupBy("src", "dst", "rel_type").agg(F.sum("quantity").alias("weight"), F.count("*").alias("frequency"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, kind, size) of the parts."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"))


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent, level): hub, domains, files."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    hub = r.select(F.concat(F.lit("hub:"), "r_regionkey").alias("child"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level"))
    domain = n.select(F.concat(F.lit("domain:"), "n_nationkey").alias("child"), F.concat(F.lit("hub:"), "n_regionkey").alias("parent"), F.lit(1).alias("level"))
    file = c.select(F.concat(F.lit("file:"), "c_custkey").alias("child"), F.concat(F.lit("domain:"), "c_nationkey").alias("parent"), F.lit(2).alias("level"))
    return hub.unionByName(domain).unionByName(file)

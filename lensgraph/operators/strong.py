"""Strongly connected components of a directed graph: trimming, then forward and backward reach by color.

Nodes without an edge in or without one out are components of their own. Of what is left, each node takes the least id that
reaches it as its color; the nodes of a color that reach its first node, inside the color, are that node's component. They
leave, and the rest goes on. Nodes on a cycle of any length are told without listing a path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensgraph.operators.messages import least_labels, run
from lensgraph.shared import written

#: Rounds of trimming before a pass; what they leave is found by the pass itself.
TRIMS = 3


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have one in and one out."""
    both = edges.select(F.col("src").alias("id")).distinct().join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
    both = written(both, "both-ways")
    return written(edges.join(both.withColumnRenamed("id", "src"), "src", "left_semi").join(both.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"), "trimmed")


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component, cyclic): component is the least id of the set; cyclic if the node lies on a cycle (a loop is one)."""
    edges = edges.select("src", "dst").dropna()
    loops = edges.filter("src = dst").select(F.col("src").alias("id")).distinct().withColumn("loop", F.lit(True))
    left, found = written(edges.filter("src <> dst").distinct(), "links"), []
    while True:
        for _ in range(TRIMS):
            left = _trimmed(left)
        if not left.limit(1).count():
            break
        own = left.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        colors = least_labels(own, left).withColumnRenamed("label", "color")
        a, b = colors.toDF("src", "color"), colors.toDF("dst", "color_to")
        inside = left.join(a, "src").join(b, "dst").filter(F.col("color") == F.col("color_to"))
        back = written(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "back")
        root = F.col("id") == F.col("color")
        reached = run(colors, back, {"hit": root, "color": F.col("color")}, F.lit(1), F.max, lambda seen: {"hit": F.lit(True), "color": F.col("color")}, F.col("new_hit") & ~F.col("hit"), 1 << 20, first=root)
        done = written(reached.filter("hit").select("id", F.col("color").alias("component")), "strong")
        found.append(done)
        gone = done.select("id")
        left = written(left.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("src", "dst"), "links")
    ids = nodes.select("id").unionByName(edges.select(F.explode(F.array("src", "dst")).alias("id"))).dropna().distinct()
    none = ids.select("id", F.col("id").alias("component")).limit(0)
    named = reduce(DataFrame.unionByName, found, none)
    sizes = named.groupBy("component").agg((F.count("*") > 1).alias("many"))
    out = ids.join(named, "id", "left").join(sizes, "component", "left").join(loops, "id", "left")
    return out.select("id", F.coalesce("component", "id").alias("component"), (F.coalesce("many", F.lit(False)) | F.coalesce("loop", F.lit(False))).alias("cyclic"))

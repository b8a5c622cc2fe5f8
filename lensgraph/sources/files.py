"""Files and graphs in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is indexed, and folders that are not (fixed values).
EXTENSIONS = (".java", ".xml", ".yml", ".yaml", ".properties")
PRUNED = ("target", "build", ".git", "node_modules", ".idea")
MOST_BYTES = 500 * 1024


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, pruned: tuple[str, ...] = PRUNED, most: int = MOST_BYTES) -> DataFrame:
    """(file_path, file_size, modified, content_hash, text, skipped) of all files below a folder.

    The hash is of the bytes, here and wherever changes are sought. Files above `most` bytes are `skipped`, with null text.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    inside = F.split("path", "/")
    keep = ending.isin(*extensions) & ~F.arrays_overlap(inside, F.array(*[F.lit(p) for p in pruned]))
    large = F.col("length") > most
    return files.filter(keep).select(
        F.col("path").alias("file_path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("content_hash"), F.when(~large, F.col("content").cast("string")).alias("text"), large.alias("skipped")
    )


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str, vectors: tuple[str, ...] = ("embedding",), mode: str = "overwrite") -> None:
    """Nodes, vectors and edges as Parquet; vectors in a table of their own, edges by relation. mode "append" adds to what is there."""
    own = [c for c in nodes.columns if c in vectors]
    nodes.drop(*own).write.mode(mode).parquet(f"{folder}/nodes")
    if own:
        nodes.select("id", *own).write.mode(mode).parquet(f"{folder}/vectors")
    edges.write.mode(mode).partitionBy("rel_type").parquet(f"{folder}/edges")


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of write_graph(); a filter on rel_type reads only its folder."""
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def write_json(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").json(folder)


def enriched(rows: DataFrame, call, payload: list[str], schema: str) -> DataFrame:
    """Sends batches of the columns `payload` through call(list of dicts) -> list of dicts; one client a partition.

    `call` is made by a factory in the worker, as clients are not pickled; answers must carry the row's id themselves.
    """
    import pandas as pd

    def run(frames):
        client = call()
        for frame in frames:
            yield pd.DataFrame(client(frame.to_dict("records")))

    return rows.select(*payload).mapInPandas(run, schema)

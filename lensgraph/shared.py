"""Files that every executor and the driver can see.

Tables and arrays that outlive one job go to the folder named by ``spark.checkpoint.dir``, in one folder of this
driver that is deleted when the driver ends. Where that setting is missing, a local session (as in the tests) gets a
temporary folder of this machine; on a cluster that is an error, since executors would write to their own disks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = f"run-{uuid.uuid4().hex}"
_deleted_on_exit: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder; in a local session without one, a new folder of this machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _path(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def new_folder(spark: SparkSession, what: str) -> str:
    """URI of a new folder below the shared one; it goes when the driver ends."""
    run = f"{shared_root(spark)}/{_RUN}"
    if run not in _deleted_on_exit:
        store, path = _path(spark, run)
        store.mkdirs(path)
        store.deleteOnExit(path)
        _deleted_on_exit.add(run)
    return f"{run}/{what}-{uuid.uuid4().hex}"


def is_file(spark: SparkSession, uri: str) -> bool:
    store, path = _path(spark, uri)
    return store.getFileStatus(path).isFile()


def delete(spark: SparkSession, uri: str) -> None:
    """Deletes a folder that nothing reads any more."""
    store, path = _path(spark, uri)
    store.delete(path, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in one new folder, all dropped at once when nothing reads them any more."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.uri, self.n = spark, new_folder(spark, what), 0

    def written(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.uri}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        delete(self.spark, self.uri)


class Rounds:
    """The state of an iteration: each round is written, and only the last two stay on disk."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.uri, self.n = spark, new_folder(spark, what), 0

    def written(self, df: DataFrame) -> DataFrame:
        """Writes a round that reads the last one, and deletes the one before that."""
        self.n += 1
        path = f"{self.uri}/{self.n}"
        df.write.parquet(path)
        if self.n > 2:
            delete(self.spark, f"{self.uri}/{self.n - 2}")
        return self.spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the unit in which files and shards are cut."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

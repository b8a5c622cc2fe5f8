"""Exact deduplication as a stateful stream over Parquet files, in DataFrame and SQL functions only.

The state is kept on disk (RocksDB) and uploaded to the shared folder with every batch; it never expires. For each digest
of a text it retains the row that stays - its id, which is stable, and its content locator: file and place in the file -
and the number of rows. A later call over the same store takes only files that it has not seen, so a corpus that grows
is deduplicated as it comes.

A digest seen more than once is a hit. Texts of hits are compared byte for byte, by grouping them by digest and text: a
task sends each different text once, however many copies it has, so that no task meets all copies of one text. Digests
that different texts share (clashes) are split by text; with SHA-256 there are none.

Edge cases: null and empty texts are equal, both empty; of equal texts the row with the largest doc_id stays, a null
doc_id being the smallest, and of rows with the same id the one last in the last file; so exactly one row of a group has
`kept`; an empty table, or a folder without files, gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lensgraph.shared import _path, new_folder, partitions, written

#: Bytes of input that one batch of the stream takes, about.
BATCH_BYTES = 256 << 30
#: Bits of the bitmap of hits: 4 MB.
FILTER_BITS = 25
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _read(reader, path: str):
    """doc_id and text of the files, with digest-to-be and locator columns still to be added."""
    return reader.schema("doc_id long, text string").parquet(path)


class Store:
    """State of a deduplication in `uri`; `digest` makes a binary key of a text."""

    def __init__(self, spark: SparkSession, uri: str | None = None, digest: Callable[[Column], Column] = sha256):
        self.spark, self.uri, self.digest = spark, uri or new_folder(spark, "seen"), digest

    def _rows(self, df: DataFrame, *more: Column) -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        at = F.struct("doc_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
        return df.select(self.digest(text).alias("digest"), at.alias("at"), *more)

    def feed(self, path: str, batch_bytes: int = BATCH_BYTES) -> None:
        """Takes all files of `path` that the store has not seen, `batch_bytes` of them at a time, and ends."""
        spark = self.spark
        session = spark.newSession()  # the provider is set for this stream alone
        # a store is closed once its task has committed, so that an executor holds on disk and in memory what runs just now
        for key, value in (("providerClass", ROCKSDB), ("rocksdb.boundedMemoryUsage", "true"), ("unloadOnCommit", "true")):
            session.conf.set(f"spark.sql.streaming.stateStore.{key}", value)
        session.conf.set("spark.sql.shuffle.partitions", partitions(spark))
        store, place = _path(spark, path)
        if store.getFileStatus(place).isFile():  # a stream reads folders, or what a pattern names
            path = f"{path[:-1]}[{path[-1]}]"
        # files count whatever their age: by default a stream passes over those a week older than the newest
        reader = session.readStream.option("maxBytesPerTrigger", batch_bytes).option("maxFileAge", "36500d")
        rows = self._rows(_read(reader, path))
        state = rows.groupBy("digest").agg(F.max("at").alias("keep"), F.count("*").alias("n"))
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", self.uri).trigger(availableNow=True).start()
        query.awaitTermination()

    def state(self) -> DataFrame:
        """digest, keep (doc_id, file, place), n of each digest so far, read from the state store."""
        store, place = _path(self.spark, f"{self.uri}/state")
        if not store.exists(place):
            kept = StructType.fromDDL("digest binary, keep struct<doc_id: bigint, file: string, place: bigint>, n bigint")
            return self.spark.createDataFrame([], kept)
        return self.spark.read.format("statestore").load(self.uri).select("key.digest", F.col("value.max").alias("keep"), F.col("value.count").alias("n"))

    def groups(self, path: str) -> DataFrame:
        """Of every row of `path`, which was fed: doc_id, file, place, text_sha256, keep (the row that stays), group_size."""
        spark = self.spark
        texts = self._rows(_read(spark.read, path), F.coalesce("text", F.lit("")).alias("text"))
        hits = written(self.state().filter("n > 1"), "hits")
        clashes = written(self._clashes(texts, hits), "clashes")
        sha = F.lower(F.hex("digest")) if self.digest is sha256 else F.sha2("text", 256)
        light = texts.select("digest", "at", sha.alias("sha"), *([] if self.digest is sha256 else ["text"]))
        out = [light.join(hits.join(clashes, "digest", "left_anti"), "digest", "left").select("at", "sha", "keep", "n")]
        if clashes.limit(1).count():
            out[0] = light.join(clashes, "digest", "left_anti").join(hits, "digest", "left").select("at", "sha", "keep", "n")
            shared = texts.join(clashes, "digest", "left_semi").withColumn("sha", F.sha2("text", 256))
            exact = shared.groupBy("digest", "text").agg(F.max("at").alias("keep"), F.count("*").alias("n"))
            out.append(shared.join(exact, ["digest", "text"]).select("at", "sha", "keep", "n"))
        found = out[0] if len(out) == 1 else out[0].unionByName(out[1])
        keep = F.coalesce("keep", F.col("at"))
        return found.select("at.*", F.col("sha").alias("text_sha256"), keep.alias("keep"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("at")).alias("kept"))

    def _clashes(self, texts: DataFrame, hits: DataFrame) -> DataFrame:
        """Digests of hits whose texts differ in some byte.

        A bitmap of fixed size, which readers are given, has a bit for each hit: texts without theirs are no hits and stay
        in their task. Where it is full of hits all different texts are grouped, which costs more and finds the same.
        """
        slot = (F.pmod(F.xxhash64("digest"), F.lit(1 << FILTER_BITS)) + 1).alias("slot")
        bucket, bit = F.bitmap_bucket_number("slot"), F.bitmap_bit_position("slot")
        marked = hits.select(slot).select(bucket.alias("bucket"), bit.alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
        asked = texts.select("digest", "text", slot).select("digest", "text", bucket.alias("bucket"), bit.alias("bit"))
        is_set = F.expr("shiftright(int(conv(hex(substring(bits, int(bit div 8) + 1, 1)), 16, 10)), int(bit % 8)) & 1 = 1")
        near = asked.join(F.broadcast(marked), "bucket").filter(is_set)  # at most 2^FILTER_BITS bits
        different = near.groupBy("digest", "text").agg(F.count("*").alias("n"))
        return different.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest")


def deduplicated(spark: SparkSession, path: str, store: Store | None = None) -> DataFrame:
    """The rows of `path`, with all their columns, of which no two have equal texts."""
    store = store or Store(spark)
    store.feed(path)
    gone = store.groups(path).filter("not kept").select("file", "place")
    docs = spark.read.parquet(path)
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("row"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    return rows.join(gone, ["file", "place"], "left_anti").select(*[F.col("row").getField(c).alias(c) for c in names])


def op13(spark: SparkSession, path: str) -> DataFrame:
    """All documents of `path`."""
    store = Store(spark)
    store.feed(path)
    return store.groups(path).select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", "kept", "text_sha256")


ORACLE_SQL = """
WITH rows AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) AS place FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size, place = 1 AS kept, sha256(text) AS text_sha256
FROM rows
"""

"""Targets and archives that arrive as streams, hashed and stored as they come.

A file source reads new files below a folder; each micro-batch becomes one delta of ``target_files`` by upsert, so that a
batch which is replayed after a failure changes nothing. Archives come by a source of their own: a batch replaces the rows of
its archives, and is matched with the targets that the store has by then; its matches are in a folder of the batch's number,
which a replay writes anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from twinfold.config import Hashing, Scan
from twinfold.functions import exprs
from twinfold.operators import match
from twinfold.operators.store import Store
from twinfold.sources import archives

_BINARY_FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def read_files(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(_BINARY_FILE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(folder)


def hashed(files: DataFrame, hashing: Hashing, stamp: str, least_bytes: int = 0) -> DataFrame:
    """Rows of target_files; the content is there already, so that both hashes are taken at once."""
    full, quick = exprs.member_hashes(F.col("content"), F.col("length"), hashing.large, hashing.prefix, hashing.name)
    return files.filter(F.col("length") >= least_bytes).select("path", F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"), full.alias("full_hash"), quick.alias("quick_hash"), F.lit(stamp).alias("config"))


def store_targets(spark: SparkSession, folder: str, store: Store, scan: Scan, checkpoint: str) -> StreamingQuery:
    """Takes in what is there and ends; run again for what came since."""
    stream = hashed(read_files(spark, folder), scan.hashing, scan.stamp(), scan.least_bytes)
    return stream.writeStream.foreachBatch(lambda rows, _: store.update_targets(rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_archives(spark: SparkSession, folder: str, hashing: Hashing, depth: int = 10) -> DataFrame:
    """Members of archives as these arrive, with a row (depth -1) of each archive."""
    archives.register(spark)
    options = {"hash": hashing.name, "threshold": hashing.large, "prefix": hashing.prefix, "maxdepth": depth}
    return spark.readStream.format("archive_arrivals").options(**{k: str(v) for k, v in options.items()}).load(folder)


def take_in(kept: Store, rows: DataFrame, scan: Scan) -> DataFrame:
    """Stores the archives of a batch in the place of what was stored of them; their good members."""
    stamp = F.lit(scan.stamp())
    arrived = rows.filter("depth = -1").select(F.col("source_archive").alias("path"), "mtime_ms", "size")
    found = rows.filter("depth >= 0").drop("mtime_ms")
    errors = found.filter(F.col("error").isNotNull()).select("source_archive", "path_in_archive", "error")
    unread = errors.filter("path_in_archive = ''").select(F.col("source_archive").alias("path"))
    failed = errors.filter(~F.col("path_in_archive").endswith("/")).select(F.col("source_archive").alias("path"), F.lit(True).alias("incomplete")).distinct()
    good = archives.good_members(found, scan.least_bytes)
    counts = good.groupBy(F.col("source_archive").alias("path")).agg(F.count("*").alias("file_count"))
    read = arrived.join(unread, "path", "left_anti")
    kept.replace_files(read, good.join(read.select(F.col("path").alias("source_archive")), "source_archive", "left_semi"))
    kept.update_archives(read.join(counts, "path", "left").join(failed, "path", "left").withColumn("file_count", F.coalesce("file_count", F.lit(0)).cast("long")).withColumn("config", stamp))
    kept.replace_unread(arrived, errors)
    return good


def store_archives(spark: SparkSession, folder: str, store: Store, scan: Scan, checkpoint: str, matches: str | None = None) -> StreamingQuery:
    """Takes in the archives that are there and ends; run again for what came since.

    With ``matches`` each batch's matches with the stored targets are written below that folder, as batch=number.
    """

    def one(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            good = take_in(store, rows, scan)
            if matches:
                found = match.one_phase(store.table("target_files").select("path", "size", "full_hash"), good.select(*match.SOURCE_COLUMNS))
                found.write.mode("overwrite").parquet(f"{matches}/batch={number}")
        finally:
            rows.unpersist()

    stream = read_archives(spark, folder, scan.hashing, scan.unpacking.depth)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

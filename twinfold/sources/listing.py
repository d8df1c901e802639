"""Files below directories as rows, hidden ones included.

``list_files`` walks folders that the executors see as local paths: the driver opens folders level by level until there are
enough subtrees to deal out, and the executors list all the rest. ``list_with_spark`` reads any file system that Spark reads, without hidden names.
"""

from __future__ import annotations

import logging
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold import schema
from twinfold.functions import exprs

log = logging.getLogger(__name__)

#: Subtrees for each core from which no more folders are opened on the driver.
SUBTREES_A_CORE = 8


def _row(path: str, root: str) -> tuple | None:
    try:
        s = os.stat(path)
    except OSError as why:
        log.warning("skipped %s: %s", path, why)
        return None
    return path, os.path.basename(path), s.st_size, s.st_mtime_ns // 1_000_000, root


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start, root, deep in zip(batch["path"], batch["root"], batch["deep"], strict=True):
            found = []
            for folder, below, names in os.walk(start):  # does not follow links to directories
                if not deep:
                    below.clear()
                for n in names:
                    found.append(_row(os.path.join(folder, n), root))
                    if len(found) == 10_000:
                        yield _frame(found)
                        found = []
            yield _frame(found)


def _folders(path: str) -> list[str]:
    try:
        return [e.path for e in os.scandir(path) if e.is_dir(follow_symlinks=False)]
    except OSError as why:
        log.warning("skipped %s: %s", path, why)
        return []


def subtrees(root: str, wanted: int) -> Iterator[tuple[str, bool]]:
    """(folder, deep): folders to list with all below (deep) or without it, ``wanted`` or more deep ones if there are so many."""
    level = [root]
    while level and len(level) < wanted:
        yield from ((folder, False) for folder in level)
        level = [below for folder in level for below in _folders(folder)]
    yield from ((folder, True) for folder in level)


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame([r for r in rows if r is not None], columns=schema.LISTING.names)


def list_files(spark: SparkSession, roots: list[str], min_size: int = 0) -> DataFrame:
    """path, name, size, mtime_ms, root of regular files of ``min_size`` bytes or more; a file below two roots is listed once."""
    starts, wanted = [], SUBTREES_A_CORE * spark.sparkContext.defaultParallelism
    for root in roots:
        if os.path.isdir(root):
            starts += [(folder, root, deep) for folder, deep in subtrees(root, wanted)]
        else:
            log.warning("no such directory: %s", root)
    if not starts:
        return spark.createDataFrame([], schema.LISTING)
    tops = spark.createDataFrame(starts, "path string, root string, deep boolean").repartition(min(len(starts), 4 * wanted))
    found = tops.mapInPandas(_walk, schema.LISTING)
    return found.filter(F.col("size") >= min_size).dropDuplicates(["path"])


def list_with_spark(spark: SparkSession, roots: list[str], min_size: int = 0) -> DataFrame:
    """The same from any file system; the sizes are compared at the source and no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    kept = files.filter(F.col("length") >= min_size)
    return kept.select("path", exprs.basename(F.col("path")).alias("name"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"), F.lit(None).cast("string").alias("root")).dropDuplicates(["path"])


def hashes_with_spark(spark: SparkSession, roots: list[str], min_size: int = 0, *, prefix: int | None = None, hash_name: str = "xxh3_64") -> DataFrame:
    """path, name, size, mtime_ms, hash of what ``list_with_spark`` lists, read by Spark, so that any of its file systems will do.

    Contents are read whole, also for the hash of a prefix; files of 2 GB or more are beyond Spark's reader and fail.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots).filter(F.col("length") >= min_size)
    content = F.col("content")
    digest = exprs.content_hash(content, hash_name) if prefix is None else exprs.prefix_hash(content, prefix, hash_name)
    return files.select("path", exprs.basename(F.col("path")).alias("name"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"), digest.alias("hash"))


def archives(listing: DataFrame) -> DataFrame:
    return listing.filter(exprs.is_archive(F.col("name")))


def read_hashes(listing: DataFrame, *, prefix: int | None = None, hash_name: str = "xxh3_64", done=None) -> DataFrame:
    """The listing with a column hash: of whole files, or of their first ``prefix`` bytes, which is all that is read then.

    What cannot be read has a null hash. ``done`` is an accumulator of files that were read.
    """
    from twinfold.sources.digests import hash_file

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if done is not None:
                done.add(len(batch))
            yield batch.assign(hash=[hash_file(p, hash_name, prefix) for p in batch["path"]])

    return listing.mapInPandas(hashed, ", ".join(f"`{n}` {t}" for n, t in listing.dtypes) + ", hash string")

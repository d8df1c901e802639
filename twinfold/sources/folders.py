"""Folders by digests, so that what did not change is neither listed nor looked at file by file.

A folder's ``own`` digest is of its files' names, sizes and times; its ``digest`` is of that and of the digests of the folders in
it, so that two trees with one digest hold the same files. A walk goes down from the roots level by level, one Spark job a
level. A folder whose time is the stored one keeps what is stored of it: one look at the folder instead of one at each file.
Times of folders change as entries come, go or are renamed, not as a file is rewritten in place: ``trust=False`` walks all.
A time that was young when it was stored is not trusted, as more may have changed within its tick.
"""

from __future__ import annotations

import hashlib
import logging
import os
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold import schema, shared
from twinfold.sources.listing import _frame, _row

log = logging.getLogger(__name__)

#: Nanoseconds within which a change may leave a folder's time as it is.
TICK = 2_000_000_000
_VISITED = "path string, parent string, mtime_ns long, seen_ns long, own string, changed boolean, below array<string>"


def own_digest(entries: list[tuple[str, int, int]]) -> str:
    """Of (name, size, mtime_ns) of a folder's files."""
    return hashlib.md5("\0".join(f"{n}\0{s}\0{m}" for n, s, m in sorted(entries)).encode("utf-8", "surrogateescape")).hexdigest()


def _visit(path: str, parent: str | None, known: tuple[int, int, str] | None, trust: bool) -> tuple | None:
    try:
        now, mtime = time.time_ns(), os.stat(path).st_mtime_ns
        if trust and known and known[0] == mtime and mtime < known[1] - TICK:
            return path, parent, mtime, now, known[2], False, None
        files, below = [], []
        with os.scandir(path) as entries:
            for e in entries:
                if e.is_dir(follow_symlinks=False):
                    below.append(e.path)
                else:
                    try:
                        s = e.stat()
                    except OSError as why:
                        log.warning("skipped %s: %s", e.path, why)
                        continue
                    files.append((e.name, s.st_size, s.st_mtime_ns))
    except OSError as why:
        log.warning("skipped %s: %s", path, why)
        return None
    own = own_digest(files)
    return path, parent, mtime, now, own, not known or known[2] != own, below


def _visited(trust: bool):
    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = [None if pd.isna(m) else (int(m), int(s), o) for m, s, o in zip(batch["mtime_ns"], batch["seen_ns"], batch["own"], strict=True)]
            rows = [_visit(p, None if pd.isna(up) else up, k, trust) for p, up, k in zip(batch["path"], batch["parent"], known, strict=True)]
            yield pd.DataFrame([r for r in rows if r], columns=["path", "parent", "mtime_ns", "seen_ns", "own", "changed", "below"])

    return visit


def outermost(roots: list[str]) -> list[str]:
    """The roots that lie below no other one."""
    plain = sorted({os.path.abspath(r) for r in roots})
    return [r for r in plain if not any(r != x and r.startswith(os.path.join(x, "")) for x in plain)]


def walk(spark: SparkSession, roots: list[str], known: DataFrame, trust: bool = True) -> list[DataFrame]:
    """By level: path, parent, mtime_ns, seen_ns, own, changed. ``known`` are folders as they were stored."""
    stored = known.select("path", "mtime_ns", "seen_ns", "own")
    frontier = spark.createDataFrame([(r, None) for r in outermost(roots)], "path string, parent string")
    levels, root = [], shared.folder(spark, "folders")
    while True:
        dealt = frontier.join(stored, "path", "left").select("path", "parent", "mtime_ns", "seen_ns", "own").repartition("path")
        at = f"{root}/{len(levels)}"
        dealt.mapInPandas(_visited(trust), _VISITED).write.parquet(at)
        level = spark.read.schema(_VISITED).parquet(at)
        if level.isEmpty():
            return levels
        levels.append(level.drop("below"))
        listed = level.select(F.explode("below").alias("path"), F.col("path").alias("parent"))
        as_before = known.select("path", "parent").join(level.filter("below is null").select(F.col("path").alias("parent")), "parent", "left_semi").select("path", "parent")
        frontier = listed.unionByName(as_before)


def digests(levels: list[DataFrame]) -> DataFrame:
    """path, parent, mtime_ns, seen_ns, own, changed, digest of all folders of a walk, from the deepest level up.

    What is below a folder is summed up as two sums of hashes, so that folders of any number of folders are one row.
    """
    out = below = None
    root = shared.folder(levels[0].sparkSession, "digests") if levels else None
    for k, level in reversed(list(enumerate(levels))):
        if below is None:
            summed = level.withColumn("below", F.lit(""))
        else:
            each = lambda seed: F.sum(F.xxhash64(F.lit(seed), F.element_at(F.split("path", "/"), -1), "digest").cast("decimal(38,0)")).cast("string")
            sums = below.groupBy("parent").agg(F.concat_ws(":", F.count("*").cast("string"), each(1), each(2)).alias("below")).withColumnRenamed("parent", "path")
            summed = level.join(sums, "path", "left")
        told = summed.withColumn("digest", F.md5(F.concat_ws("/", "own", F.coalesce("below", F.lit(""))).cast("binary"))).drop("below")
        told.write.parquet(f"{root}/{k}")
        below = told.sparkSession.read.schema(told.schema).parquet(f"{root}/{k}")
        out = below if out is None else out.unionByName(below)
    return out


def files_in(changed: DataFrame, min_size: int = 0) -> DataFrame:
    """The files of the folders (path) themselves, as ``listing.list_files`` has them, without a root."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["path"]:
                try:
                    names = [e.path for e in os.scandir(folder) if not e.is_dir(follow_symlinks=False)]
                except OSError as why:
                    log.warning("skipped %s: %s", folder, why)
                    continue
                yield _frame([_row(p, None) for p in names])

    return changed.select("path").mapInPandas(listed, schema.LISTING).filter(F.col("size") >= min_size)


def _in_folders(stored: DataFrame, levels: list[DataFrame], condition: str) -> DataFrame:
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    wanted = every.filter(condition).select(F.col("path").alias("folder"))
    return stored.withColumn("folder", F.regexp_extract("path", r"^(?s)(.*)/[^/]*$", 1)).join(wanted, "folder", "left_semi").drop("folder")


def list_changed(levels: list[DataFrame], stored: DataFrame, min_size: int = 0) -> DataFrame:
    """All files below the roots: those of changed folders as they are now, the others as they are stored (path, size, mtime_ms)."""
    kept = _in_folders(stored, levels, "not changed").select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "size", "mtime_ms", F.lit(None).cast("string").alias("root"))
    now = None
    for level in levels:
        found = files_in(level.filter("changed"), min_size)
        now = found if now is None else now.unionByName(found)
    return now.unionByName(kept.filter(F.col("size") >= min_size))


def gone(levels: list[DataFrame], stored: DataFrame, listed: DataFrame) -> DataFrame:
    """path of the stored files that changed folders do not have any more."""
    return _in_folders(stored, levels, "changed").select("path").join(listed.select("path"), "path", "left_anti")

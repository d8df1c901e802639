"""Carrying out a deletion plan: by default only in appearance, in tasks beside the files.

A file is deleted only if it is what was scanned: of the size and time of the plan, and, where the plan has a hash and it goes
for good, of that content, read again right before. What changed since stays. Each task deletes its share and writes the
outcomes itself, so that neither plan nor outcomes pass the driver. If a task runs again after an executor was lost, what it
deleted before is not there any more; such rows are told as ``gone`` instead of failed.
"""

from __future__ import annotations

import importlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold import shared
from twinfold.sources.digests import hash_file

OUTCOME = "path string, status string, reason string"
#: What a plan can tell of each file; columns that are missing, or null, are not compared.
TOLD = {"target_size": "long", "mtime_ms": "long", "target_hash": "string"}


def _changed(path: str, size: int | None, mtime_ms: int | None, digest: str | None, hash_name: str) -> str | None:
    """Why the file is not the one that was scanned, if it is not."""
    now = os.stat(path)
    if size is not None and now.st_size != size:
        return "changed since it was scanned"
    if mtime_ms is not None and now.st_mtime_ns // 1_000_000 != mtime_ms:
        return "changed since it was scanned"
    if digest is not None:
        found, after = hash_file(path, hash_name), os.stat(path)
        if found is None:
            return "could not be read"
        if found != digest or (after.st_mtime_ns, after.st_size, after.st_ino) != (now.st_mtime_ns, now.st_size, now.st_ino):
            return "changed since it was scanned"
    return None


def _delete(path: str, told: tuple, method: str, dry_run: bool, hash_name: str, repeated: bool) -> tuple[str, str, str | None]:
    size, mtime_ms, digest = told
    try:
        if why := _changed(path, size, mtime_ms, digest if method == "permanent" and not dry_run else None, hash_name):
            return path, "failed", why
        if dry_run:
            return path, "would delete", None
        if method == "trash":
            importlib.import_module("send2trash").send2trash(path)
        else:
            os.unlink(path)
    except FileNotFoundError:
        return (path, "gone", "not there when its task ran again") if repeated else (path, "failed", "File not found")
    except ImportError:
        return path, "failed", "send2trash is not installed"
    except PermissionError:
        return path, "failed", "Permission denied"
    except OSError as why:
        return path, "failed", str(why)
    return path, "deleted", None


def execute(plan: DataFrame, *, way: str = "trash", carried_out: bool = False, folder: str | None = None, hash_name: str = "xxh3_64") -> DataFrame:
    """path, status, reason for each row of the plan (target_path, and any of target_size, mtime_ms and target_hash).

    It is carried out once, now; the outcomes are in the folder (a new shared one, unless told), and read from there.
    """
    spark, folder = plan.sparkSession, folder or shared.folder(plan.sparkSession, "outcomes")

    def deleted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        repeated = context is not None and context.attemptNumber() > 0
        for batch in batches:
            told = [[None if pd.isna(x) else x for x in batch[c]] for c in TOLD]
            rows = [_delete(path, (None if s is None else int(s), None if m is None else int(m), h), way, not carried_out, hash_name, repeated) for path, s, m, h in zip(batch["target_path"], *told, strict=True)]
            yield pd.DataFrame(rows, columns=["path", "status", "reason"])

    columns = [F.col(c) if c in plan.columns else F.lit(None).cast(kind).alias(c) for c, kind in TOLD.items()]
    dealt = plan.select("target_path", *columns).repartition("target_path")
    dealt.mapInPandas(deleted, OUTCOME).write.parquet(folder)
    return spark.read.schema(OUTCOME).parquet(folder)


def existing(paths: DataFrame, listing: DataFrame) -> DataFrame:
    """path, exists: whether each path is in the listing."""
    here = listing.select("path").distinct().withColumnRenamed("path", "__here")
    return paths.join(here, paths["path"] == here["__here"], "left").select("path", here["__here"].isNotNull().alias("exists"))

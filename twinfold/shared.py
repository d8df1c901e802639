"""The folder that driver and executors share, for what has to be written on the way."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in spark.checkpoint.dir (where that is unset, in a local session's temporary folder); it goes when the driver ends."""
    try:
        root = spark.conf.get("spark.checkpoint.dir")
    except PySparkException:
        root = None
    if not root:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _LOCAL.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="twinfold-")
        _LOCAL[context.applicationId] = root
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have gone first
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)

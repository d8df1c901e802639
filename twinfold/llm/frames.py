"""What the operators share: scratch tables, free column names and Arrow batch bounds."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, so that a worker holds a few MB of text whatever the table's size.
BATCH_ROWS = 256
BATCH_BYTES = 16 << 20
#: Bytes of a row group of a scratch table, so that a task that writes one holds no more.
ROW_GROUP = 32 << 20
#: Whether a query's shuffle files go when it ends; else they stay until the driver happens to collect garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_out(scan: DataFrame) -> DataFrame:
    """A table as it was read, dealt out where its few small files give fewer tasks than there are cores."""
    spark = scan.sparkSession
    cores, split = spark.sparkContext.defaultParallelism, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    small = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * split
    return scan.repartition(cores) if small and len(scan.inputFiles()) < cores else scan


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that Python workers get; texts can be long.

    Results are lazy and batches are cut when they run, so the bounds stay set in the session; smaller ones are left alone.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(name), re.IGNORECASE)
        if not (now and 0 < int(now[1]) <= most):
            spark.conf.set(name, most)


#: Scratch folders of this driver, deleted when it ends.
_ROOTS: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _clean(spark: SparkSession) -> None:
    for root in _ROOTS:
        with contextlib.suppress(Exception):  # the JVM may have gone first
            _delete(spark, root)


#: Folders of local sessions that name none, by application.
_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, a temporary one of a local session."""
    try:
        root = spark.conf.get("spark.checkpoint.dir")
    except PySparkException:
        root = None
    if not root:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if context.applicationId not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="twinfold-")
        root = _LOCAL_FOLDERS[context.applicationId]
    return root.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder that cut lineage: a lost executor costs one table's recomputation at most.

    ``drop`` and ``drop_but`` delete tables that no result reads any more; the rest go when the driver ends, as results are
    lazy. The shuffle files of the query that wrote a table go with its end.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.tables: dict[int, DataFrame] = {}
        if not _ROOTS:
            atexit.register(_clean, spark)
        _ROOTS.add(self.root)

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        before = self.spark.conf.get(FREE_SHUFFLES, "false")
        self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
        finally:
            self.spark.conf.set(FREE_SHUFFLES, before)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.scratch_path = path
        self.tables[self.count] = kept
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t.scratch_path)
        self.tables = {k: t for k, t in self.tables.items() if not any(t is x for x in tables)}

    def drop_but(self, *kept: DataFrame | None, since: int = 0) -> None:
        """Drop the tables that were made when the count was over ``since``, other than those kept."""
        self.drop(*[t for k, t in self.tables.items() if k > since and not any(t is x for x in kept)])


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str):
    """The column of exactly this name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")

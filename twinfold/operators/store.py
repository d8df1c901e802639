"""Keyed tables in Parquet, merged as they are read.

A table is what its newest manifest names: a base, in folders by the hash of the key's first column, and the changes since,
each a folder of rows (the later one of a key counts) or of keys whose rows are gone. A write puts its own rows into a new
folder and then publishes a manifest of the next number, which fails if another writer has published that number; the change
is then put on top of what the other one wrote, so that no writer's rows are lost. A write that fails before that changes
nothing, and readers go on with the manifest they started from.

Reads take the rows of the base whose keys no change names, by an anti-join with the changed keys (broadcast up to
BROADCAST_ROWS of them, which compaction keeps them at), and the newest of the changes; the base is neither sorted nor
exchanged, filters reach its scan, and a lookup by the first key column reads one bucket only. After MOST_DELTAS changes, or
BROADCAST_ROWS changed rows, the buckets that they touch are written anew; the others stay as they are. There are as many
buckets as rows need (ROWS_A_BUCKET each), so that a table doubles before all of it is written again. The rows of a bucket
are written by SPREAD tasks, by the whole key, as one archive may hold a third of all rows.

Null keys equal none, so that rows with one are never replaced. File systems must not replace the target of a rename (HDFS
and its kin; local files are linked).
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold import schema
from twinfold.functions import exprs

#: A run reads the version it started from while it writes two more.
KEPT_VERSIONS = 4
MOST_DELTAS = 16
#: Changed keys up to which reads broadcast them (some 100 bytes each), and beyond which a write compacts.
BROADCAST_ROWS = 200_000
ROWS_A_BUCKET, SPREAD, ROWS_A_FILE = 4_000_000, 32, 1_000_000
#: The column by which rows of a table can be declared gone.
GONE_BY = {"files": "source_archive", "unread": "source_archive", "target_files": "path"}
#: Columns that are looked up by value, with Bloom filters in the base's files.
LOOKED_UP = {"files": ("full_hash", "quick_hash"), "target_files": ("full_hash",)}


def last_wins(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The row of the largest seq for each key."""
    newest = Window.partitionBy(*key).orderBy(F.col(seq).desc())
    return rows.withColumn("__rank", F.row_number().over(newest)).filter("__rank = 1").drop("__rank")


def merge(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows without a new one of their key, and the new ones."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


@dataclass(frozen=True)
class Change:
    """Folders of rows and of keys that are gone (both may be missing), and how many there are of both."""

    rows: str | None = None
    gone: str | None = None
    n: int = 0


@dataclass(frozen=True)
class Manifest:
    """``base`` has (folder, rows) by bucket; ``kind`` is v where the base was written anew, else d."""

    number: int = 0
    kind: str = "v"
    buckets: int = 1
    base: dict[int, tuple[str, int]] = field(default_factory=dict)
    changes: tuple[Change, ...] = ()

    def text(self) -> str:
        changes = [{"rows": c.rows, "gone": c.gone, "n": c.n} for c in self.changes]
        return json.dumps({"number": self.number, "kind": self.kind, "buckets": self.buckets, "base": {str(b): list(x) for b, x in self.base.items()}, "changes": changes})

    @staticmethod
    def of(text: str) -> Manifest:
        read = json.loads(text)
        return Manifest(read["number"], read["kind"], read["buckets"], {int(b): tuple(x) for b, x in read["base"].items()}, tuple(Change(**c) for c in read["changes"]))

    def folders(self) -> set[str]:
        return {folder for folder, _ in self.base.values()} | {f for c in self.changes for f in (c.rows, c.gone) if f}

    def changed_rows(self) -> int:
        return sum(c.n for c in self.changes)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self.create()

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        pass

    def create(self) -> None:
        """Empty tables where there are none."""
        for table in schema.TABLES:
            if not self._numbers(table):
                self._commit(table, lambda now: None if now.number else now)

    # manifests

    def _at(self, table: str, name: str) -> str:
        return f"{self.root}/{table}/{name}"

    def _manifest_path(self, table: str, number: int) -> str:
        return self._at(table, f"_manifests/{number:012d}.json")

    def _numbers(self, table: str) -> list[int]:
        folder = self._path(self._at(table, "_manifests"))
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, table: str, number: int) -> Manifest:
        stream = self._fs.open(self._path(self._manifest_path(table, number)))
        try:
            return Manifest.of(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def newest(self, table: str) -> Manifest:
        numbers = self._numbers(table)
        return self._manifest(table, numbers[-1]) if numbers else Manifest()

    def _versions(self, table: str) -> list[tuple[int, str]]:
        """(number, kind and number) of the manifests that are kept, in order."""
        return [(n, f"{self._manifest(table, n).kind}{n}") for n in self._numbers(table)]

    def _publish(self, table: str, manifest: Manifest) -> bool:
        """Whether the manifest's number was free; the file is complete when it appears."""
        final, draft = self._path(self._manifest_path(table, manifest.number)), self._path(self._at(table, f"_manifests/.{uuid.uuid4().hex}"))
        out = self._fs.create(draft, False)
        out.write(bytearray(manifest.text().encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":
                try:
                    os.link(draft.toUri().getPath(), final.toUri().getPath())
                except FileExistsError:
                    return False
                return True
            return not self._fs.exists(final) and self._fs.rename(draft, final)
        finally:
            if self._fs.exists(draft):
                self._fs.delete(draft, False)

    def _commit(self, table: str, change: Callable[[Manifest], Manifest | None]) -> Manifest | None:
        """Publishes what ``change`` makes of the newest manifest, and again if another writer came first; None drops it."""
        while True:
            now = self.newest(table)
            made = change(now)
            if made is None:
                return None
            made = replace(made, number=now.number + 1)
            if self._publish(table, made):
                if made.kind == "v":
                    self._expire(table)
                return made

    def _expire(self, table: str) -> None:
        """Deletes manifests before the KEPT_VERSIONS newest bases, and folders that only those name."""
        manifests = [self._manifest(table, n) for n in self._numbers(table)]
        bases = [m.number for m in manifests if m.kind == "v"]
        if len(bases) <= KEPT_VERSIONS:
            return
        old = [m for m in manifests if m.number < bases[-KEPT_VERSIONS]]
        named = {f for m in manifests if m.number >= bases[-KEPT_VERSIONS] for f in m.folders()}
        for folder in {f for m in old for f in m.folders()} - named:
            gone = self._path(self._at(table, folder))
            self._fs.delete(gone, True)
            whole = gone.getParent()
            if folder.startswith("base/") and not any(x.getPath().getName().startswith("__bucket=") for x in self._fs.listStatus(whole)):
                self._fs.delete(whole, True)
        for m in old:
            self._fs.delete(self._path(self._manifest_path(table, m.number)), False)

    # reads

    def _read(self, table: str, folders: list[str], columns: tuple[str, ...] | None = None) -> DataFrame:
        kind = schema.TABLES[table] if columns is None else T.StructType([f for f in schema.TABLES[table].fields if f.name in columns])
        if not folders:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[self._at(table, f) for f in folders])

    def _bucket(self, table: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(schema.KEYS[table][0]), F.lit(buckets)).cast("int")

    def _bucket_of(self, buckets: int, value: str) -> int:
        return self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(value)), F.lit(buckets))).first()[0] if buckets > 1 else 0

    def _changes(self, table: str, now: Manifest) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """(rows that the changes leave, keys that they name, keys that they declare gone)."""
        key, names = schema.KEYS[table], schema.TABLES[table].names
        written = [(k, c.rows) for k, c in enumerate(now.changes) if c.rows]
        if not written:
            rows = self._read(table, []).withColumn("__at", F.lit(0))
        elif len(written) == 1:
            rows = self._read(table, [written[0][1]]).withColumn("__at", F.lit(written[0][0]))
        else:
            parts = [self._read(table, [folder]).withColumn("__at", F.lit(k)) for k, folder in written]
            every = parts[0]
            for part in parts[1:]:
                every = every.unionByName(part)
            rows = every.groupBy(*[F.col(k) for k in key]).agg(F.max_by(F.struct(*names), "__at").alias("__row"), F.max("__at").alias("__at")).select("__row.*", "__at")
        keys, gone = rows.select(*key), None
        for k, c in enumerate(now.changes):
            if c.gone:
                part = self._read(table, [c.gone], (GONE_BY[table],)).withColumn("__gone", F.lit(k))
                gone = part if gone is None else gone.unionByName(part)
        if gone is not None:
            gone = gone.groupBy(GONE_BY[table]).agg(F.max("__gone").alias("__gone"))
            rows = rows.join(gone, GONE_BY[table], "left").filter(F.col("__gone").isNull() | (F.col("__at") >= F.col("__gone")))
        return rows.select(*names), keys, gone

    def _merged(self, table: str, now: Manifest, base: DataFrame) -> DataFrame:
        """The base as the changes leave it, and what they add."""
        if not now.changes:
            return base
        rows, keys, gone = self._changes(table, now)
        sent = F.broadcast if now.changed_rows() <= BROADCAST_ROWS else (lambda df: df)
        left = base.join(sent(keys), schema.KEYS[table], "left_anti")
        if gone is not None:
            left = left.join(sent(gone.select(GONE_BY[table])), GONE_BY[table], "left_anti")
        return left.select(*schema.TABLES[table].names).unionByName(rows)

    def table(self, name: str, first_key: str | None = None) -> DataFrame:
        """The table, or the rows of one value of the key's first column, for which one bucket is read."""
        now = self.newest(name)
        if first_key is None:
            return self._merged(name, now, self._read(name, [f for f, _ in now.base.values()]))
        folder = now.base.get(self._bucket_of(now.buckets, first_key)) if now.base else None
        return self._merged(name, now, self._read(name, [folder[0]] if folder else [])).filter(F.col(schema.KEYS[name][0]) == first_key)

    # writes

    def _put(self, table: str, rows: DataFrame) -> tuple[str | None, int]:
        """(folder, rows) of what was written; an empty one is not kept."""
        folder = f"changes/{uuid.uuid4().hex}"
        rows.write.parquet(self._at(table, folder))
        n = self.spark.read.schema(rows.schema).parquet(self._at(table, folder)).count()
        if not n:
            self._fs.delete(self._path(self._at(table, folder)), True)
        return (folder, n) if n else (None, 0)

    def _change(self, table: str, rows: DataFrame, gone: DataFrame | None = None) -> None:
        put, n = self._put(table, rows.select(*schema.TABLES[table].names))
        without, m = self._put(table, gone) if gone is not None else (None, 0)
        if n + m:
            made = Change(put, without, n + m)
            done = self._commit(table, lambda now: replace(now, kind="d", changes=(*now.changes, made)))
            if len(done.changes) > MOST_DELTAS or done.changed_rows() > BROADCAST_ROWS:
                self.compact(table)

    def compact(self, table: str) -> None:
        """Folds the changes into the buckets that they touch; changes that others publish meanwhile stay changes."""
        now = self.newest(table)
        if not now.changes:
            return
        rows, keys, gone = self._changes(table, now)
        held = sum(n for _, n in now.base.values()) + now.changed_rows()
        buckets = now.buckets
        while buckets * ROWS_A_BUCKET < held:
            buckets *= 2
        if buckets == now.buckets:
            named = keys.select(schema.KEYS[table][0])
            named = named if gone is None else named.unionByName(gone.select(schema.KEYS[table][0]))
            touched = {r[0] for r in named.select(self._bucket(table, buckets)).distinct().collect()}
            stay = {b: x for b, x in now.base.items() if b not in touched}
        else:
            touched, stay = set(now.base), {}
        base = self._read(table, [now.base[b][0] for b in now.base if b not in stay])
        folder = f"base/{uuid.uuid4().hex}"
        key = schema.KEYS[table]
        merged = self._merged(table, now, base).withColumn("__bucket", self._bucket(table, buckets))
        dealt = merged.repartition("__bucket", F.pmod(F.xxhash64(*key), F.lit(SPREAD))).sortWithinPartitions("__bucket", *key)
        out = dealt.write.partitionBy("__bucket").option("maxRecordsPerFile", ROWS_A_FILE)
        for c in LOOKED_UP.get(table, ()):
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", ROWS_A_FILE)
        out.parquet(self._at(table, folder))
        whole = T.StructType([*schema.TABLES[table].fields]).add("__bucket", T.IntegerType())
        counts = {r[0]: r[1] for r in self.spark.read.schema(whole).parquet(self._at(table, folder)).groupBy("__bucket").agg(F.count("*")).collect()}
        made = stay | {b: (f"{folder}/__bucket={b}", n) for b, n in counts.items()}

        def put(latest: Manifest) -> Manifest | None:
            if latest.base != now.base or latest.changes[: len(now.changes)] != now.changes:
                return None  # another compaction, or a clear, came first
            return replace(latest, kind="v", buckets=buckets, base=made, changes=latest.changes[len(now.changes) :])

        if self._commit(table, put) is None:
            self._fs.delete(self._path(self._at(table, folder)), True)

    def upsert(self, name: str, rows: DataFrame, seq: str | None = None) -> None:
        key = schema.KEYS[name]
        self._change(name, last_wins(rows, key, seq) if seq else rows.dropDuplicates(key))

    # archives and their members

    def archive(self, path: str) -> DataFrame:
        return self.table("archives", path)

    def archives(self) -> DataFrame:
        return self.table("archives").orderBy("path")

    def update_archives(self, rows: DataFrame) -> None:
        """Stamped with the time of this call, but those of a column ``incomplete`` that is true: they stay due."""
        now = F.lit(time.time())
        stamp = F.when(~F.coalesce(F.col("incomplete"), F.lit(False)), now) if "incomplete" in rows.columns else now
        self.upsert("archives", rows.withColumn("last_scanned", stamp))

    def files_by_archive(self, path: str) -> DataFrame:
        return self.table("files", path).orderBy("path_in_archive")

    def add_files(self, rows: DataFrame, seq: str | None = None) -> None:
        self.upsert("files", rows, seq)

    def replace_files(self, archives: DataFrame, rows: DataFrame, seq: str = "seq") -> None:
        """All rows of the archives (path) give way to the new ones, so that members which are gone do not stay.

        What is written are the new rows and the archives' paths; rows of other archives are not touched.
        """
        gone = archives.select(F.col("path").alias("source_archive")).distinct()
        self._change("files", last_wins(rows, schema.KEYS["files"], seq), gone)

    def replace_unread(self, archives: DataFrame, rows: DataFrame) -> None:
        """What could not be read of the archives (path): source_archive, path_in_archive (empty: the archive itself), error."""
        self._change("unread", rows.dropDuplicates(schema.KEYS["unread"]), archives.select(F.col("path").alias("source_archive")).distinct())

    def by_full_hash(self, value: str) -> DataFrame:
        return self.table("files").filter(F.col("full_hash") == value)

    def by_quick_hash(self, value: str) -> DataFrame:
        return self.table("files").filter(F.col("quick_hash") == value)

    def has_quick_hash(self, value: str) -> bool:
        return not self.by_quick_hash(value).limit(1).isEmpty()

    def backfill_full_hash(self, hashes: DataFrame) -> None:
        """hashes: source_archive, path_in_archive, full_hash. Rows that have the hash already are not written."""
        new = hashes.dropDuplicates(schema.KEYS["files"]).select(*schema.KEYS["files"], F.col("full_hash").alias("__full"))
        found = self.table("files").join(new, schema.KEYS["files"]).filter(F.col("__full").isNotNull() & ~F.col("full_hash").eqNullSafe(F.col("__full")))
        self._change("files", found.withColumn("full_hash", F.col("__full")))

    # targets and selections

    def target(self, path: str) -> DataFrame:
        return self.table("target_files", path)

    def update_targets(self, rows: DataFrame) -> None:
        self.upsert("target_files", rows)

    def forget_targets(self, gone: DataFrame) -> None:
        """Of targets that are not there any more (path)."""
        self._change("target_files", self._read("target_files", []), gone.select("path").distinct())

    def selection(self, file_hash: str, target_path: str) -> bool | None:
        row = self.table("selection_state", file_hash).filter(F.col("target_path") == target_path).first()
        return None if row is None else row["selected"]

    def toggle(self, file_hash: str, target_path: str, default: bool = True) -> bool:
        """The stored selection, or the default, turned over and stored."""
        now = self.selection(file_hash, target_path)
        turned = not (default if now is None else now)
        self.select(self.spark.createDataFrame([(file_hash, target_path, turned)], schema.SELECTION))
        return turned

    def select(self, rows: DataFrame, seq: str | None = None) -> None:
        self.upsert("selection_state", rows, seq)

    def statistics(self) -> DataFrame:
        return store_statistics(self.table("archives"), self.table("files"))

    def clear(self) -> None:
        for table in schema.TABLES:
            self._commit(table, lambda now: Manifest())


def backfilled(files: DataFrame, hashes: DataFrame) -> DataFrame:
    new = hashes.select(*schema.KEYS["files"], F.col("full_hash").alias("__full"))
    return files.join(new, schema.KEYS["files"], "left").withColumn("full_hash", F.coalesce("__full", "full_hash")).drop("__full")


def store_statistics(archives: DataFrame, files: DataFrame) -> DataFrame:
    """archive_count, file_count, nested_count."""
    rows = archives.select(F.lit(True).alias("top"), F.lit(False).alias("nested")).unionByName(files.select(F.lit(False).alias("top"), F.col("is_nested_archive").alias("nested")))
    return rows.agg(F.count_if("top").alias("archive_count"), F.count_if(~F.col("top")).alias("file_count"), F.count_if("nested").alias("nested_count"))


def changed(listing: DataFrame, known: DataFrame, recheck: bool = False) -> DataFrame:
    """The listed archives with a column needs_rescan."""
    stored = known.select("path", F.col("mtime_ms").alias("__mtime"), F.col("size").alias("__size"), F.col("last_scanned").alias("__scanned"))
    flag = exprs.needs_rescan(F.col("__mtime"), F.col("__size"), F.col("__scanned"), F.col("mtime_ms"), F.col("size"), recheck)
    return listing.join(stored, "path", "left").withColumn("needs_rescan", flag).drop("__mtime", "__size", "__scanned")


def cached(listing: DataFrame, known: DataFrame, recheck: bool = False) -> DataFrame:
    """The listed targets with columns cache_hit, full_hash and quick_hash (null unless hit)."""
    stored = known.select("path", F.col("mtime_ms").alias("__mtime"), F.col("size").alias("__size"), F.col("full_hash").alias("__full"), F.col("quick_hash").alias("__quick"))
    hit = exprs.cache_hit(F.col("__mtime"), F.col("__size"), F.col("__full"), F.col("__quick"), F.col("mtime_ms"), F.col("size"), recheck)
    with_hit = listing.join(stored, "path", "left").withColumn("cache_hit", F.coalesce(hit, F.lit(False)))
    return with_hit.withColumn("full_hash", F.when(F.col("cache_hit"), F.col("__full"))).withColumn("quick_hash", F.when(F.col("cache_hit"), F.col("__quick"))).drop("__mtime", "__size", "__full", "__quick")

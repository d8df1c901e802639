"""From directories to matches: list, unpack, hash, store, match.

Each scan ends in one new version of each table it touches.
"""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from twinfold.config import Scan
from twinfold.operators import actions, match, report, store
from twinfold.plans.progress import Progress
from twinfold.sources import archives, folders, listing

log = logging.getLogger(__name__)

_TARGET = ("path", "mtime_ms", "size", "full_hash", "quick_hash")


class InvalidScan(ValueError):
    pass


class Counters:
    """Running counters: each is taken while the rows pass through the query that writes them, and is there when that ends."""

    def __init__(self):
        self.seen: dict[str, Observation] = {}

    def count(self, rows: DataFrame, name: str, **more) -> DataFrame:
        """The rows, counted under the name as they pass; ``more`` names further aggregates."""
        self.seen[name] = Observation(f"{name}-{uuid.uuid4().hex}")
        return rows.observe(self.seen[name], F.count(F.lit(1)).alias(name), *[x.alias(k) for k, x in more.items()])

    def taken(self) -> dict[str, int]:
        return {k: n for x in self.seen.values() for k, n in x.get.items()}


def scan_sources(spark: SparkSession, scan: Scan, kept: store.Store, counters: Counters | None = None, progress: Progress | None = None) -> DataFrame:
    """The stored rows of the archives below the source directories; changed ones are unpacked again.

    Archives that cannot be read to the end are left out; those of which some member cannot be read are stored with the others,
    but as incomplete. Both are tried again in the next run, and what was not read is in the store's table ``unread``.
    """
    counters = counters or Counters()
    listed = listing.archives(listing.list_files(spark, list(scan.archives_in)))
    known = kept.table("archives").filter(F.col("config") == scan.stamp())
    todo = store.changed(listed, known, "archives" in scan.afresh).filter("needs_rescan").drop("needs_rescan").persist()
    if progress:
        progress.begin("unpacking", todo.count())
    found = archives.members(todo, scan.hashing, scan.unpacking, progress and progress.counts).persist()
    try:
        broken = found.filter("error is not null and depth = 0 and path_in_archive = ''").select(F.col("source_archive").alias("path"))
        read = todo.join(broken, "path", "left_anti")
        members = archives.good_members(found, scan.least_bytes)
        errors = found.filter(F.col("error").isNotNull()).select("source_archive", "path_in_archive", "error")
        # a nested archive that opens in no reader will not do so next time; a member whose bytes are broken may be mended
        failed = errors.filter(~F.col("path_in_archive").endswith("/")).select(F.col("source_archive").alias("path"), F.lit(True).alias("incomplete")).distinct()
        counted = read.join(report.inventory(read, members), "path").join(failed, "path", "left").withColumn("config", F.lit(scan.stamp()))
        kept.replace_files(read, counters.count(members, "members_read"))
        kept.update_archives(counters.count(counted, "archives_read"))
        kept.replace_unread(todo, errors)
    finally:
        found.unpersist()
        todo.unpersist()
    return kept.table("archives").join(listed.select("path"), "path", "left_semi")


def _hashed(listed: DataFrame, scan: Scan, into: str, prefix: int | None = None, progress: Progress | None = None) -> DataFrame:
    return listing.read_hashes(listed, prefix=prefix, hash_name=scan.hashing.name, done=progress and progress.counts["targets_done"]).withColumnRenamed("hash", into)


def sources(spark: SparkSession, scan: Scan, kept: store.Store) -> DataFrame:
    """The stored members that count as sources: of archives that exist, or all."""
    if scan.gone_count:
        return kept.table("files")
    live = listing.archives(listing.list_files(spark, list(scan.archives_in)))
    return kept.table("files").join(live.select(F.col("path").alias("source_archive")), "source_archive", "left_semi")


def hash_targets(spark: SparkSession, scan: Scan, kept: store.Store, files: DataFrame, counters: Counters | None = None, progress: Progress | None = None) -> DataFrame:
    """The targets with the hashes that the store has of them now.

    Small files are read whole. Of large ones only the prefix is read, and the rest where some source shares the prefix.
    """
    counters = counters or Counters()
    if progress:
        progress.begin("hashing")
    nothing = F.lit(None).cast("string")
    known = kept.table("target_files").filter(F.col("config") == scan.stamp())
    walked = folders.walk(spark, list(scan.files_in), kept.table("folders").filter(F.col("config") == scan.stamp()), "files" not in scan.afresh) if scan.trust_folders else None
    listed = folders.list_changed(walked, known, scan.least_bytes) if walked else listing.list_files(spark, list(scan.files_in), scan.least_bytes)
    seen = store.cached(listed, known, "files" in scan.afresh).persist()
    try:
        new = seen.filter("not cache_hit").drop("full_hash", "quick_hash")
        small = F.col("size") < scan.hashing.large
        whole = _hashed(new.filter(small), scan, "full_hash", progress=progress).withColumn("quick_hash", nothing).select(*_TARGET)
        begun = _hashed(new.filter(~small), scan, "quick_hash", scan.hashing.prefix, progress).withColumn("full_hash", nothing).select(*_TARGET)
        stamp = F.lit(scan.stamp())
        kept.update_targets(counters.count(whole.unionByName(begun), "targets_hashed", targets_failed=F.count_if(F.coalesce("full_hash", "quick_hash").isNull())).withColumn("config", stamp))
        targets = kept.table("target_files").join(listed.select("path"), "path", "left_semi").select(*_TARGET)
        verified = _hashed(match.quick_candidates(targets, files).drop("full_hash"), scan, "full_hash").select(*_TARGET)
        kept.update_targets(counters.count(verified, "targets_verified").withColumn("config", stamp))
        if walked:  # after the files, so that what fails before is listed again
            kept.forget_targets(folders.gone(walked, known, seen))
            kept.upsert("folders", folders.digests(walked).withColumn("config", stamp))
    finally:
        seen.unpersist()
    targets = kept.table("target_files").join(listed.select("path"), "path", "left_semi").select(*_TARGET)
    if scan.look_inside:
        log.info("members of target archives are matched by their archive's path")
        inside = archives.good_members(archives.members(listing.archives(listed), scan.hashing, scan.unpacking), scan.least_bytes)
        targets = targets.unionByName(inside.select(F.concat_ws("!/", "source_archive", "path_in_archive").alias("path"), F.lit(None).cast("long").alias("mtime_ms"), "size", "full_hash", "quick_hash"))
    return targets


def scan_targets(spark: SparkSession, scan: Scan, kept: store.Store, counters: Counters | None = None) -> DataFrame:
    """Matches, with their selection."""
    files = sources(spark, scan, kept)
    matches = match.one_phase(hash_targets(spark, scan, kept, files, counters), files)
    return match.with_selection(matches, kept.table("selection_state"), scan.deletion.unless_stored)


@dataclass
class Outcome:
    matches: DataFrame
    by_archive: DataFrame
    plan: DataFrame
    summary: DataFrame
    outcomes: DataFrame
    #: What of the archives could not be read: source_archive, path_in_archive (empty: the archive itself), error.
    unread: DataFrame
    counters: dict[str, int] = field(default_factory=dict)


def run(spark: SparkSession, scan: Scan, told: Callable[[dict], None] | None = None, every: float = 1.0) -> Outcome:
    """Scan, match, and carry out the plan (in appearance only, unless the scan says otherwise).

    ``told`` is called with the state of the run (``Progress.state``) every so many seconds.

    Counts and the plan come from counts by content, so that a content which very many files share costs no pairs; the
    pairs (``matches``) are made if they are read.
    """
    if found := scan.faults():
        raise InvalidScan("; ".join(found))
    how, counters = scan.deletion, Counters()
    with store.Store(spark, scan.store) as kept, Progress(spark, told, every) as progress:
        scan_sources(spark, scan, kept, counters, progress)
        files = sources(spark, scan, kept)
        targets = hash_targets(spark, scan, kept, files, counters, progress).persist()
        progress.begin("matching")
        stored = kept.table("selection_state")
        matches = match.with_selection(match.one_phase(targets, files), stored, how.unless_stored)
        counts = match.with_selection(match.target_counts(targets, files), stored, how.unless_stored)
        plan = report.deletion_plan(counts.filter(~F.col("target_path").contains("!/"))).persist()
        by_archive = report.by_archive(targets, files).persist()
        by_archive.count(), plan.count()
        progress.begin("deleting" if how.carried_out else "listing what would be deleted")
        outcomes = actions.execute(plan, way=how.way, carried_out=how.carried_out, folder=f"{scan.store}/outcomes/{time.time_ns()}", hash_name=scan.hashing.name)
        unread = kept.table("unread").join(listing.archives(listing.list_files(spark, list(scan.archives_in))).select(F.col("path").alias("source_archive")), "source_archive", "left_semi")
        done = Outcome(matches, by_archive, plan, report.plan_summary(plan, how.way, not how.carried_out), outcomes, unread, counters.taken())
        if scan.forget:
            kept.clear()
    return done

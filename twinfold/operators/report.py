"""What people look at: counts, listings and what would be deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.functions import exprs
from twinfold.operators import match


def by_archive(targets: DataFrame, files: DataFrame) -> DataFrame:
    """source_archive, match_count, redundant_bytes of the matches of targets and files, from counts by content."""
    n, size = F.col("target_count"), F.col("size")
    return match.file_counts(targets, files).groupBy("source_archive").agg(F.sum(n).alias("match_count"), F.sum(n * size).alias("redundant_bytes"))


def totals(targets: DataFrame, files: DataFrame) -> DataFrame:
    """match_count, archive_count, target_count, in one row, from counts by content."""
    sides = match.target_counts(targets, files).select("match_count", F.col("target_path"), F.lit(None).cast("string").alias("source_archive"))
    sides = sides.unionByName(match.file_counts(targets, files).select(F.lit(0).cast("long").alias("match_count"), F.lit(None).cast("string").alias("target_path"), "source_archive").distinct())
    return sides.agg(F.coalesce(F.sum("match_count"), F.lit(0)).alias("match_count"), F.count_distinct("source_archive").alias("archive_count"), F.count_distinct("target_path").alias("target_count"))


def inventory(archives: DataFrame, members: DataFrame) -> DataFrame:
    """path, file_count: archives without members count 0."""
    counts = members.groupBy(F.col("source_archive").alias("path")).agg(F.count("*").alias("n"))
    return archives.select("path").join(counts, "path", "left").select("path", F.coalesce("n", F.lit(0)).cast("long").alias("file_count"))


def deletion_plan(counts: DataFrame) -> DataFrame:
    """target_path, target_size, match_count: each chosen target once. ``counts`` are ``match.target_counts`` with a selection.

    Counts that have mtime_ms give mtime_ms and target_hash as well, by which a file is known again before it goes.
    """
    known = [F.max("mtime_ms").alias("mtime_ms"), F.max("full_hash").alias("target_hash")] if "mtime_ms" in counts.columns else []
    return counts.filter("selected").groupBy("target_path").agg(F.max("target_size").alias("target_size"), F.sum("match_count").alias("match_count"), *known)


def plan_summary(plan: DataFrame, method: str = "trash", dry_run: bool = True) -> DataFrame:
    """file_count, total_size, size_text, method, mode."""
    sums = plan.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("target_size"), F.lit(0)).alias("total_size"))
    return sums.withColumn("size_text", exprs.human_size(F.col("total_size"))).withColumn("method", F.lit(method)).withColumn("mode", F.lit("dry run" if dry_run else "delete"))


def review(matches: DataFrame) -> DataFrame:
    """A header row of each archive and below it its matches, from one grouping; sort by source_archive, is_detail, target_path, path_in_archive."""
    keys = ("source_archive", "target_path", "path_in_archive")
    sets = matches.groupingSets([[F.col(k) for k in keys], [F.col("source_archive")]], *keys)
    rows = sets.agg(F.grouping("target_path").alias("__top"), F.count("*").alias("n"), F.max("target_size").alias("target_size"), F.max("selected").alias("selected"))
    header = F.col("__top") == 1
    label = F.when(header, exprs.archive_label(exprs.basename(F.col("source_archive")), F.col("n"))).otherwise(F.concat_ws(" ", exprs.checkbox(F.col("selected")), F.col("target_path")))
    size = F.when(~header, exprs.human_size(F.col("target_size")))
    return rows.select("source_archive", (~header).alias("is_detail"), "target_path", "path_in_archive", label.alias("label"), size.alias("size_text"))


def review_classes(targets: DataFrame, files: DataFrame, selection: DataFrame, default: bool = True) -> DataFrame:
    """A row for each archive and content that some target has too, instead of one for each pair.

    source_archive, full_hash, size, members (of the archive), targets, chosen (of the targets), pairs, and the first of each by
    name. Members and targets are counted before they meet, so that m members and n targets of a content are one row.
    """
    stored = selection.select(F.col("file_hash").alias("full_hash"), F.col("target_path").alias("path"), F.col("selected").alias("__stored"))
    own = targets.filter(F.col("full_hash").isNotNull()).select("path", "size", "full_hash").join(stored, ["full_hash", "path"], "left")
    by_content = own.groupBy("full_hash", "size").agg(F.count("*").alias("targets"), F.count_if(F.coalesce("__stored", F.lit(default))).alias("chosen"), F.min("path").alias("first_target"))
    by_archive = files.filter(F.col("full_hash").isNotNull()).groupBy("source_archive", "full_hash", "size").agg(F.count("*").alias("members"), F.min("path_in_archive").alias("first_member"))
    found = by_archive.join(by_content, ["full_hash", "size"])
    return found.select("source_archive", "full_hash", "size", "members", "targets", "chosen", (F.col("members") * F.col("targets")).alias("pairs"), "first_member", "first_target")


def review_page(targets: DataFrame, files: DataFrame, archive: str, content: tuple[str, int], after: tuple[str, str] | None = None, rows: int = 100) -> list[tuple[str, str]]:
    """The next pairs (target_path, path_in_archive) of an archive and content (full_hash, size) after one, in order.

    At most ``rows`` of each side are taken in order from where the page starts, whatever their number; pairs are made of these.
    """
    (full_hash, size), (at, member) = content, after or (None, None)
    same = (F.col("full_hash") == full_hash) & (F.col("size") == size)
    ours = files.filter(same & (F.col("source_archive") == archive)).select("path_in_archive")
    theirs = targets.filter(same).select("path")
    first = lambda df, c, n: [r[0] for r in df.orderBy(c).limit(n).collect()]
    rest = first(ours.filter(F.col("path_in_archive") > member), "path_in_archive", rows) if after else []
    page = [(at, m) for m in rest]
    if len(page) < rows and (every := first(ours, "path_in_archive", rows)):
        wanted = -(-(rows - len(page)) // len(every))
        page += [(t, m) for t in first(theirs.filter(F.col("path") > at) if after else theirs, "path", wanted) for m in every]
    return page[:rows]


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("status").agg(F.count("*").alias("n"))

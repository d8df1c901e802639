"""Which targets hold the content of source files.

Targets have path, size, full_hash and quick_hash; sources are rows of ``files``. Hashes decide and sizes must agree, so
that two hashes that collide by chance do not match. The join is an equi-join; Spark picks its kind by size and splits
skewed hashes at run time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap for each key, and keys up to which one is made.
BITS_A_KEY, MOST_BITMAP_KEYS = 16, 4_000_000
#: Bits of one part, as Spark's bitmaps have them.
_PART = 32_768

SOURCE_COLUMNS = ("full_hash", "quick_hash", "filename", "path_in_archive", "source_archive", "size", "is_nested_archive")


def one_phase(targets: DataFrame, files: DataFrame) -> DataFrame:
    """A row for each target and source file of one full hash and size: the source's columns, target_path, target_size."""
    own = targets.filter(F.col("full_hash").isNotNull()).select(F.col("full_hash").alias("__hash"), F.col("path").alias("target_path"), F.col("size").alias("target_size"))
    return files.join(own, (files["full_hash"] == own["__hash"]) & (files["size"] == own["target_size"]), "inner").drop("__hash")


def quick_candidates(targets: DataFrame, files: DataFrame) -> DataFrame:
    """The targets without a full hash whose prefix some source file shares."""
    return targets.filter(F.col("full_hash").isNull()).join(files.select("quick_hash"), "quick_hash", "left_semi")


def prefiltered(rows: DataFrame, column: str, keys: DataFrame, *, most_keys: int = MOST_BITMAP_KEYS) -> DataFrame:
    """The rows whose value in the column may be among the keys (one column); what cannot goes before any exchange.

    The keys set bits of a bitmap, BITS_A_KEY times as many as there are keys, in parts of 32,768. At most
    ``most_keys`` keys are taken, so that it has 2 * BITS_A_KEY * most_keys / 8 bytes at most (16 MB, as parts of 4 KB);
    beyond, and for no keys, the rows are returned as they are, or none. It is broadcast by part and tested where the rows
    are read; about one in BITS_A_KEY rows without a key stays, so that an exact join has to follow. Null values go.
    """
    (key,) = keys.columns
    wanted = keys.filter(F.col(key).isNotNull()).distinct()
    n = wanted.count()
    if n > most_keys:
        return rows
    parts = 1 << max(0, (n * BITS_A_KEY - 1).bit_length() - 15) if n else 1
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(parts * _PART))
    bits = wanted.select(place(F.col(key)).alias("__at")).groupBy(F.expr(f"__at div {_PART}").alias("__part")).agg(F.bitmap_construct_agg(F.col("__at") % _PART).alias("__bits"))
    placed = rows.withColumn("__at", place(F.col(column))).withColumn("__part", F.expr(f"__at div {_PART}"))
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.col("__at") % _PART / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, (F.col("__at") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return placed.filter(F.col(column).isNotNull()).join(F.broadcast(bits), "__part").filter(is_set).select(*rows.columns)


def quick_candidates_prefiltered(targets: DataFrame, files: DataFrame) -> DataFrame:
    """The same candidates: each side is first thinned by a bitmap of the other's prefix hashes, then joined exactly."""
    open_ones = targets.filter(F.col("full_hash").isNull())
    thin_files = prefiltered(files.select("quick_hash"), "quick_hash", open_ones.select("quick_hash"))
    return open_ones.join(thin_files, "quick_hash", "left_semi").select(*targets.columns)


def two_phase(targets: DataFrame, files: DataFrame, with_full: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(matches, targets with what is known of their full hashes now).

    ``with_full`` adds full_hash to rows that passed the first phase, and to no others.
    """
    known = targets.filter(F.col("full_hash").isNotNull())
    verified = with_full(quick_candidates(targets, files).drop("full_hash")).select(*targets.columns)
    return one_phase(known.unionByName(verified), files), verified


def with_selection(matches: DataFrame, selection: DataFrame, default: bool = True) -> DataFrame:
    """The matches with a column selected: as stored by (hash, target), else the default."""
    stored = selection.select(F.col("file_hash").alias("full_hash"), "target_path", F.col("selected").alias("__selected"))
    return matches.join(stored, ["full_hash", "target_path"], "left").withColumn("selected", F.coalesce("__selected", F.lit(default))).drop("__selected")


def select_all(matches: DataFrame, selected: bool) -> DataFrame:
    return matches.withColumn("selected", F.lit(selected))


def target_counts(targets: DataFrame, files: DataFrame) -> DataFrame:
    """target_path, target_size, full_hash, match_count of each target that matches, without the pairs themselves.

    However many files share one content, a target stays one row. Targets that have mtime_ms keep it.
    """
    counts = files.filter(F.col("full_hash").isNotNull()).groupBy("full_hash", "size").agg(F.count("*").alias("match_count"))
    more = [c for c in ("mtime_ms",) if c in targets.columns]
    return targets.join(counts, ["full_hash", "size"]).select(F.col("path").alias("target_path"), F.col("size").alias("target_size"), "full_hash", "match_count", *more)


def file_counts(targets: DataFrame, files: DataFrame) -> DataFrame:
    """source_archive, size, target_count of each file that some target matches, without the pairs."""
    counts = targets.filter(F.col("full_hash").isNotNull()).groupBy("full_hash", "size").agg(F.count("*").alias("target_count"))
    return files.join(counts, ["full_hash", "size"]).select("source_archive", "size", "target_count")


def nested_result(matches: DataFrame, most: int = 10_000, *, in_order: tuple[str, ...] = ()) -> DataFrame:
    """source_archive, part, duplicates: the matches of each archive as arrays of about ``most`` (one part, from 0, if that is all).

    With columns ``in_order`` an archive's parts, of at most ``most`` matches, follow each other in these columns' order; their
    numbers grow with it, but neither start at 0 nor are without gaps.
    """
    rows = F.struct(F.struct(*SOURCE_COLUMNS).alias("source_file"), "target_path", "target_size", "selected")
    if in_order:
        keys = ["source_archive", *in_order]
        # ids grow by task and by row within it, so that no part spans two tasks
        dealt = matches.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.expr(f"monotonically_increasing_id() div {most}"))
    else:
        parts = matches.groupBy("source_archive").agg(F.ceil(F.count("*") / most).alias("__parts"))
        dealt = matches.join(parts, "source_archive").withColumn("part", F.pmod(F.xxhash64("target_path", "path_in_archive"), "__parts"))
    return dealt.groupBy("source_archive", "part").agg(F.sort_array(F.collect_list(rows)).alias("duplicates"))

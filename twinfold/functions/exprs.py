"""Column functions: names, hashes, sizes and change detection. All of them stay in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of file names that are taken for archives, by what reads them.
ARCHIVES = {
    "zip": (".zip", ".jar", ".war", ".ear", ".zipx"),
    "7z": (".7z",),
    "rar": (".rar",),
    "tar": (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz", ".txz", ".tar.zst", ".tzst"),
    "package": (".rpm", ".deb", ".msi", ".cab", ".ar", ".xar", ".pkg"),
    "program": (".exe",),
    "image that runs": (".appimage", ".run"),
    "disk": (".iso", ".img", ".dmg", ".vmdk", ".vdi", ".vhd", ".squashfs"),
    "other": (".cpio", ".wim", ".lzh", ".lha", ".lz"),
}
ARCHIVE_SUFFIXES = tuple(s for some in ARCHIVES.values() for s in some)
HASHES = ("md5", "sha256", "xxhash64", "xxh3_64")

_ARCHIVE = "(?:" + "|".join(map(re.escape, ARCHIVE_SUFFIXES)) + ")$"
UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def is_archive_name(name: str) -> bool:
    return name.lower().endswith(ARCHIVE_SUFFIXES)


def is_archive(name: Column) -> Column:
    """By the lower-cased name alone."""
    return F.lower(name).rlike(_ARCHIVE)


def basename(path: Column) -> Column:
    """The last part of a path; trailing slashes do not count."""
    return F.regexp_extract(path, r"([^/]+)/*$", 1)


def child_path(parent: Column, child: Column) -> Column:
    return F.concat_ws("/", parent, child)


def content_hash(content: Column, name: str = "md5") -> Column:
    """Null for null content, so that what could not be read never matches."""
    if name == "md5":
        return F.md5(content)
    if name == "sha256":
        return F.sha2(content, 256)
    if name == "xxhash64":
        return F.when(content.isNotNull(), F.lower(F.lpad(F.hex(F.xxhash64(content)), 16, "0")))
    if name == "xxh3_64":
        from twinfold.functions.xxh3 import xxh3_hex

        return xxh3_hex(content)
    raise ValueError(f"no such hash: {name}")


def prefix_hash(content: Column, size: int, name: str = "md5") -> Column:
    return content_hash(F.substring(content, 1, size), name)


def member_hashes(content: Column, size: Column, threshold: int, prefix: int, name: str = "md5") -> tuple[Column, Column]:
    """(full, quick) of a member that is in memory anyway: quick for large ones only."""
    return content_hash(content, name), F.when(size >= threshold, prefix_hash(content, prefix, name))


def file_hashes(content: Column, size: Column, threshold: int, prefix: int, name: str = "md5") -> tuple[Column, Column]:
    """(full, quick) before any match: a large file has the quick one only."""
    return F.when(size < threshold, content_hash(content, name)), F.when(size >= threshold, prefix_hash(content, prefix, name))


def has_hash(full: Column, quick: Column) -> Column:
    return F.coalesce(F.nullif(full, F.lit("")), F.nullif(quick, F.lit(""))).isNotNull()


def match_key(full: Column, quick: Column) -> Column:
    """The full hash, or the quick one where that is missing or empty."""
    return F.coalesce(F.nullif(full, F.lit("")), quick)


def human_size(size: Column) -> Column:
    """One decimal, halves to even, in steps of 1024."""
    as_unit = lambda k: F.format_string("%.1f " + UNITS[k], F.bround(size / F.lit(1024.0**k), 1))
    return reduce(lambda rest, k: F.when(size < F.lit(1024.0 ** (k + 1)), as_unit(k)).otherwise(rest), range(len(UNITS) - 2, -1, -1), as_unit(len(UNITS) - 1))


def size_mb(size: Column) -> Column:
    return size / F.lit(1048576.0)


def progress_pct(done: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(done / total * F.lit(100.0))


def needs_rescan(known_mtime: Column, known_size: Column, last_scanned: Column, mtime: Column, size: Column, recheck: bool = False) -> Column:
    """No stored row, never scanned, or another time or size."""
    return F.lit(recheck) | last_scanned.isNull() | ~known_mtime.eqNullSafe(mtime) | ~known_size.eqNullSafe(size)


def cache_hit(known_mtime: Column, known_size: Column, full: Column, quick: Column, mtime: Column, size: Column, recheck: bool = False) -> Column:
    """The stored hashes of a target still hold."""
    return F.lit(not recheck) & known_mtime.eqNullSafe(mtime) & known_size.eqNullSafe(size) & has_hash(full, quick)


def checkbox(selected: Column) -> Column:
    return F.when(selected, F.lit("[X]")).otherwise(F.lit("[ ]"))


def archive_label(name: Column, count: Column) -> Column:
    return F.format_string("%s (%d duplicates)", name, count)

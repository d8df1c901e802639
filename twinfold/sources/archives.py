"""Members of archives as rows of hashes; contents never leave the task that unpacks them.

Formats: zip and its kin, tar with gzip, bzip2, xz or zstd, ar (so deb packages, with the tars in them), cpio, self-extracting
and carved zips; 7z, rar and what else libarchive reads where those libraries are installed. Input is never executed. Nested archives give a row of their own, then their members
under ``outer/inner``, down to the depth of the configuration. A broken archive gives one row with an error, and so does one
beyond a limit of bytes, so that it counts as unread instead of half read.
"""

from __future__ import annotations

import importlib
import io
import itertools
import operator
import os
import pickle
import re
import tarfile
import tempfile
import zipfile
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import replace
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from twinfold import schema
from twinfold.config import Hashing, Unpacking
from twinfold.functions.exprs import ARCHIVES, is_archive_name
from twinfold.sources.digests import TooLarge, hash_stream

SPOOL = 16 << 20
#: Rows of one batch that leaves a task, and tasks for each core.
ROWS, TASKS_A_CORE = 4096, 8

Member = tuple[str, Callable[[], BinaryIO]]


class ArchiveError(Exception):
    pass


def _zip(file: BinaryIO, most: int | None) -> Iterator[Member]:  # noqa: ARG001
    with zipfile.ZipFile(file) as z:
        for info in z.infolist():
            if not info.is_dir():
                yield info.filename, lambda info=info: z.open(info)


def _tar(file: BinaryIO, most: int | None) -> Iterator[Member]:  # noqa: ARG001
    if file.read(len(_ZSTD)) == _ZSTD:
        # decompressed as it is read, and never sought in: its members come one after the other
        stream = pa.CompressedInputStream(pa.PythonFile(_At(file, 0), "r"), "zstd")
        opened = tarfile.open(fileobj=stream, mode="r|")
    else:
        file.seek(0)
        opened = tarfile.open(fileobj=file, mode="r:*")
    with opened as t:
        for info in t:
            if info.isreg():
                yield info.name, lambda info=info: t.extractfile(info)


def _seven(file: BinaryIO, most: int | None) -> Iterator[Member]:
    py7zr = importlib.import_module("py7zr")
    with tempfile.TemporaryDirectory() as folder, py7zr.SevenZipFile(file) as z:
        if most is not None and sum(x.uncompressed or 0 for x in z.list()) > most:
            raise TooLarge(f"more than {most} bytes")
        z.extractall(folder)  # one pass; member by member would unpack the whole for each
        for at, _, names in sorted(os.walk(folder)):
            for name in sorted(names):
                path = os.path.join(at, name)
                if os.path.isfile(path) and not os.path.islink(path):
                    yield os.path.relpath(path, folder), lambda path=path: open(path, "rb")


def _rar(file: BinaryIO, most: int | None) -> Iterator[Member]:  # noqa: ARG001
    with importlib.import_module("rarfile").RarFile(file) as r:
        for info in r.infolist():
            if not info.is_dir():
                yield info.filename, lambda info=info: r.open(info)


class _Part(io.RawIOBase):
    """Bytes of a file from an offset on, so many of them."""

    def __init__(self, file: BinaryIO, offset: int, size: int):
        self.file, self.at, self.end = file, offset, offset + size

    def readable(self):
        return True

    def readinto(self, out):
        self.file.seek(self.at)
        got = self.file.read(min(len(out), self.end - self.at))
        if not got and self.at < self.end:
            raise ArchiveError("cut short")
        out[: len(got)] = got
        self.at += len(got)
        return len(got)


#: How ar and cpio archives begin, and the name of the last cpio entry.
_AR, _CPIO, _CPIO_END = b"!<arch>\n", (b"070701", b"070702"), "TRAILER!!!"


def _ar(file: BinaryIO, most: int | None) -> Iterator[Member]:  # noqa: ARG001
    """Entries have a header of 60 bytes and begin at even offsets; long names are in an entry ``//``, or before the content."""
    if file.read(len(_AR)) != _AR:
        raise ArchiveError("no ar archive")
    at, long_names = len(_AR), b""
    while True:
        file.seek(at)
        header = file.read(60)
        if not header:
            return
        if len(header) < 60 or header[58:] != b"`\n":
            raise ArchiveError("broken entry")
        name, size, start = header[:16].rstrip(b" "), int(header[48:58]), at + 60
        at = start + size + size % 2
        if name == b"//":
            long_names = file.read(size)
        elif name not in (b"/", b"/SYM64/"):
            if name.startswith(b"/"):
                name = long_names[int(name[1:]) :].partition(b"\n")[0]
            elif name.startswith(b"#1/"):
                n = int(name[3:])
                name, start, size = file.read(n).rstrip(b"\0"), start + n, size - n
            yield name.removesuffix(b"/").decode("utf-8", "replace"), lambda start=start, size=size: io.BufferedReader(_Part(file, start, size))


def _cpio(file: BinaryIO, most: int | None) -> Iterator[Member]:  # noqa: ARG001
    """Entries of the portable format: 13 hexadecimal numbers, the name, the content, each from a multiple of four on."""
    at = 0
    while True:
        file.seek(at)
        header = file.read(110)
        if header[:6] not in _CPIO or len(header) < 110:
            raise ArchiveError("no portable cpio archive")
        numbers = [int(header[k : k + 8], 16) for k in range(6, 110, 8)]
        mode, size, length = numbers[1], numbers[6], numbers[11]
        name = file.read(length).rstrip(b"\0").decode("utf-8", "replace")
        if name == _CPIO_END:
            return
        start = -(-(at + 110 + length) // 4) * 4
        at = -(-(start + size) // 4) * 4
        if mode & 0o170000 == 0o100000:
            yield name, lambda start=start, size=size: io.BufferedReader(_Part(file, start, size))


def _libarchive(file: BinaryIO, most: int | None) -> Iterator[Member]:  # noqa: ARG001
    libarchive = importlib.import_module("libarchive")
    with libarchive.stream_reader(file) as entries:
        for e in entries:
            if e.isfile:
                yield e.pathname, lambda e=e: _blocks(e)


def _blocks(entry) -> BinaryIO:
    out = tempfile.SpooledTemporaryFile(SPOOL)
    for block in entry.get_blocks():
        out.write(block)
    out.seek(0)
    return out


def find_magics(file: BinaryIO, magics: tuple[bytes, ...], start: int = 0, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, magic) of all occurrences from ``start`` on, in order, by one pass over the file."""
    pattern, keep = re.compile(b"|".join(map(re.escape, sorted(set(magics), key=len, reverse=True)))), max(map(len, magics)) - 1
    at, held, done = start, b"", False
    while not done:
        file.seek(at + len(held))
        block = file.read(chunk)
        done, held, pos = not block, held + block, 0
        # a magic that begins in the last ``keep`` bytes may be the start of a longer one, so that it waits
        sure = len(held) if done else max(0, len(held) - keep)
        while (found := pattern.search(held, pos)) and found.start() < sure:
            yield at + found.start(), found[0]
            pos = found.start() + 1
        cut = max(pos, sure)
        at, held = at + cut, held[cut:]


def find_magic(file: BinaryIO, magic: bytes, start: int = 0, chunk: int = 1 << 20) -> int | None:
    """Offset of the first occurrence from ``start`` on."""
    return next((at for at, _ in find_magics(file, (magic,), start, chunk)), None)


class _At(io.RawIOBase):
    """A file from an offset on."""

    def __init__(self, file: BinaryIO, offset: int):
        self.file, self.offset, self.at = file, offset, 0
        self.end = file.seek(0, os.SEEK_END) - offset

    def readable(self):
        return True

    def seekable(self):
        return True

    def seek(self, to, whence=os.SEEK_SET):
        self.at = to + {os.SEEK_SET: 0, os.SEEK_CUR: self.at, os.SEEK_END: self.end}[whence]
        return self.at

    def tell(self):
        return self.at

    def readinto(self, out):
        self.file.seek(self.offset + self.at)
        got = self.file.read(len(out))
        out[: len(got)] = got
        self.at += len(got)
        return len(got)


#: Fixed value: how a zstd frame begins.
_ZSTD = b"\x28\xb5\x2f\xfd"
#: Magic numbers of what is embedded in images that run, and how far from the start of it they may stand.
_SQUASHFS, _ISO, _ZIP = (b"hsqs", b"sqsh"), b"CD001", b"PK\x03\x04"
_ISO_PLACES = (0x8001, 0x8801, 0x9001)
#: Offset and value of the major version in a squashfs superblock, offset of its block size's logarithm.
_SQUASHFS_MAJOR, _SQUASHFS_VERSION, _SQUASHFS_LOG = 28, 4, 22
#: Methods of compression that a local zip header may name.
_ZIP_METHODS = frozenset((0, 1, 6, 8, 9, 12, 14, 19, 93, 95, 96, 97, 98, 99))


def _superblock(head: bytes, magic: bytes) -> bool:
    """Whether a squashfs superblock makes sense: its version, and a block size that is the power of two it names."""
    order = "little" if magic == b"hsqs" else "big"
    number = lambda at, n: int.from_bytes(head[at : at + n], order)
    return len(head) >= 32 and number(_SQUASHFS_MAJOR, 2) == _SQUASHFS_VERSION and number(12, 4) == 1 << min(number(_SQUASHFS_LOG, 2), 31)


def _local_header(head: bytes) -> bool:
    """Whether a local zip header makes sense: a known method and a name."""
    return len(head) >= 30 and int.from_bytes(head[8:10], "little") in _ZIP_METHODS and int.from_bytes(head[26:28], "little") > 0


def embedded(file: BinaryIO) -> Iterator[tuple[int, Reader]]:
    """(offset, reader) of what may be embedded in a file, in order; stray magics are passed over by what follows them.

    Members of one zip each have a header, but it is opened by the directory at its end; so only the first sound one counts.
    """
    zipped = False
    for at, magic in find_magics(file, (*_SQUASHFS, _ISO, _ZIP)):
        file.seek(at)
        head = file.read(64)
        if magic in _SQUASHFS and _superblock(head, magic):
            yield at, _libarchive
        elif magic == _ISO and head[5:6] in (b"\x01", b"\x02"):
            yield from ((at - before, _libarchive) for before in _ISO_PLACES if at >= before)
        elif magic == _ZIP and not zipped and _local_header(head):
            zipped = True
            yield at, _zip


def _carved(file: BinaryIO, most: int | None) -> Iterator[Member]:
    """What is embedded in a file, in the order of its offsets; the first that opens."""
    why: Exception = ArchiveError("nothing embedded was found")
    for at, read in sorted(embedded(file), key=lambda x: x[0]):
        given = False
        try:
            for member in read(io.BufferedReader(_At(file, at)), most):
                given = True
                yield member
            if given:
                return
        except Exception as failed:  # another format may stand further on
            if given:
                raise
            why = failed
    raise why


Reader = Callable[[BinaryIO, int | None], Iterator[Member]]

#: Readers to try, in order; libarchive comes last for all.
_READERS = {"zip": (_zip,), "7z": (_seven,), "rar": (_rar,), "tar": (_tar,), "program": (_zip, _seven), "image that runs": (_carved,), "package": (_ar,), "other": (_cpio,)}


def readers_for(name: str) -> tuple[Reader, ...]:
    kind = next((kind for kind, ends in ARCHIVES.items() if name.lower().endswith(ends)), None)
    return (*_READERS.get(kind, ()), _libarchive) if kind else ()


class _Held:
    """Rows that wait for their reader to come to the end; beyond SPOOL bytes on disk."""

    def __init__(self):
        self.file, self.n = tempfile.SpooledTemporaryFile(SPOOL), 0

    def add(self, row: dict) -> None:
        pickle.dump(row, self.file)
        self.n += 1

    def __iter__(self) -> Iterator[dict]:
        self.file.seek(0)
        with self.file:
            for _ in range(self.n):
                yield pickle.load(self.file)


class Unpacker:
    """All rows of one archive."""

    def __init__(self, archive: str, hashing: Hashing, unpacking: Unpacking):
        self.archive, self.hashing, self.unpacking = archive, hashing, unpacking
        self.seq, self.read = 0, 0

    def rows(self, file: BinaryIO) -> Iterator[dict]:
        name = os.path.basename(self.archive)
        start = f"{name}/" if name.lower().endswith(ARCHIVES["image that runs"]) else ""
        try:
            yield from self.members(file, name, start, 0)
        except Exception as why:
            yield self.row("", None, 0, error=f"{type(why).__name__}: {why}")

    def row(self, path: str, size: int | None, depth: int, *, nested: bool = False, full: str | None = None, quick: str | None = None, error: str | None = None) -> dict:
        self.seq += 1
        return dict(source_archive=self.archive, path_in_archive=path, filename=path.rpartition("/")[2], size=size, is_nested_archive=nested, depth=depth, seq=self.seq, full_hash=full, quick_hash=quick, error=error)

    def room(self) -> int | None:
        """Bytes that may still be unpacked."""
        return None if self.unpacking.archive_bytes is None else self.unpacking.archive_bytes - self.read

    def members(self, file: BinaryIO, name: str, start: str, depth: int) -> Iterator[dict]:
        """By the first reader that gives anything; what a reader gave before it failed is not kept.

        An archive in which one reader comes to the end without a member, and no other one finds any, is empty.
        """
        readers, why, empty, before = readers_for(name), None, False, (self.seq, self.read)
        if not readers:
            raise ArchiveError(f"no reader for {name}")
        for read in readers:
            self.seq, self.read = before
            held = _Held()
            try:
                file.seek(0)
                for path, opened in read(file, self.room()):
                    for row in self.one(start + path, opened, depth):
                        held.add(row)
            except TooLarge:
                raise
            except Exception as failed:
                if not isinstance(failed, ImportError) or why is None:
                    why = failed
                continue
            if held.n:
                yield from held
                return
            empty = True
        if not empty:
            raise ArchiveError(f"{name}: {why}")

    def one(self, path: str, opened: Callable[[], BinaryIO], depth: int) -> Iterator[dict]:
        nested, h, limits = is_archive_name(path), self.hashing, [x for x in (self.unpacking.member_bytes, self.room()) if x is not None]
        deeper = nested and depth < self.unpacking.depth
        with tempfile.SpooledTemporaryFile(SPOOL) as copy:
            try:
                with opened() as stream:
                    size, full, quick = hash_stream(stream, h.name, h.prefix, min(limits, default=None), copy if deeper else None)
            except TooLarge:
                raise
            except Exception as why:  # the other members may be sound
                yield self.row(path, None, depth, nested=nested, error=f"{type(why).__name__}: {why}")
                return
            self.read += size
            yield self.row(path, size, depth, nested=nested, full=full, quick=quick if size >= h.large else None)
            if deeper:
                try:
                    yield from self.members(copy, path.rpartition("/")[2], path + "/", depth + 1)
                except TooLarge:
                    raise
                except Exception as why:
                    yield self.row(path + "/", None, depth + 1, error=f"{type(why).__name__}: {why}")


def unpack(path: str, hashing: Hashing | None = None, unpacking: Unpacking | None = None, content: bytes | None = None) -> Iterator[dict]:
    unpacker = Unpacker(path, hashing or Hashing(), unpacking or Unpacking())
    if content is not None:
        yield from unpacker.rows(io.BytesIO(content))
        return
    try:
        file = open(path, "rb")
    except OSError as why:
        yield unpacker.row("", None, 0, error=f"{type(why).__name__}: {why}")
        return
    with file:
        yield from unpacker.rows(file)


def members(archives: DataFrame, hashing: Hashing | None = None, unpacking: Unpacking | None = None, counts: dict | None = None) -> DataFrame:
    """Member rows of the archives (path[, content]); errors are rows as well.

    ``counts`` are accumulators to which tasks add archives_done, members_done and bytes_done.

    The archives are dealt out to many more tasks than there are cores, so that a task has few and a large one holds up
    no others. Rows leave a task in batches.
    """
    with_content = "content" in archives.columns

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, path in enumerate(batch["path"]):
                for rows in itertools.batched(unpack(path, hashing, unpacking, batch["content"].iloc[k] if with_content else None), ROWS):
                    if counts is not None:
                        counts["members_done"].add(sum(r["error"] is None for r in rows))
                        counts["bytes_done"].add(sum(r["size"] or 0 for r in rows))
                    yield pd.DataFrame(rows, columns=schema.MEMBERS.names)
                if counts is not None:
                    counts["archives_done"].add(1)

    wanted = archives.select("path", *(["content"] if with_content else []))
    return wanted.repartition(archives.sparkSession.sparkContext.defaultParallelism * TASKS_A_CORE).mapInPandas(read, schema.MEMBERS)


def good_members(found: DataFrame, min_size: int = 0) -> DataFrame:
    """Without errors and small members. Children of a small nested archive stay."""
    return found.filter(F.col("error").isNull() & (F.col("size") >= min_size))


#: Bytes of archives that one partition holds, and what an archive counts at least; folders' entries from which the driver leaves the rest to tasks.
PARTITION_BYTES, LEAST_BYTES, MOST_LISTED = 256 << 20, 1 << 20, 100_000


class _Pack(InputPartition):
    """Archives to read, and folders of which a task lists and reads all archives below."""

    def __init__(self, paths: list[str], folders: list[str]):
        super().__init__(len(paths) + len(folders))
        self.paths, self.folders = paths, folders


def packed(sizes: list[tuple[str, int]], most: int) -> list[list[str]]:
    """Paths in packs of ``most`` bytes or one archive: the largest first, each into the last pack or a new one."""
    out, held = [], 0
    for path, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        if not out or held + size > most:
            out.append([])
            held = 0
        out[-1].append(path)
        held += size
    return out


class _Wanted:
    """What filters on source_archive, size and depth leave to be read.

    An archive is opened only if its path passes. A bound on depth is kept as archives are unpacked; sizes are tested
    before rows leave the task. Filters of other kinds and columns are left to Spark.
    """

    def __init__(self):
        self.paths: set[str] | None = None
        self.starts: list[str] = []
        self.depth: int | None = None
        self.sizes: list[tuple[str, int]] = []

    def take(self, f: Filter) -> bool:
        """Whether the filter is kept here to the letter."""
        column = getattr(f, "attribute", None)
        value = getattr(f, "value", None)
        if column == ("source_archive",) and isinstance(f, EqualTo) and isinstance(value, str):
            self._only({value})
        elif column == ("source_archive",) and isinstance(f, In):
            self._only(set(f.value))
        elif column == ("source_archive",) and isinstance(f, StringStartsWith):
            self.starts.append(value)
        elif column == ("size",) and isinstance(f, GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | EqualTo):
            self.sizes.append((type(f).__name__, value))
        elif column == ("depth",) and isinstance(f, LessThan | LessThanOrEqual | EqualTo):
            most = value - isinstance(f, LessThan)
            self.depth = most if self.depth is None else min(self.depth, most)
            return not isinstance(f, EqualTo)
        else:
            return False
        return True

    def _only(self, paths: set[str]) -> None:
        self.paths = paths if self.paths is None else self.paths & paths

    def opens(self, path: str) -> bool:
        return (self.paths is None or path in self.paths) and all(path.startswith(x) for x in self.starts) and (self.depth is None or self.depth >= 0)

    def passes(self, size: int | None) -> bool:
        tests = {"GreaterThan": operator.gt, "GreaterThanOrEqual": operator.ge, "LessThan": operator.lt, "LessThanOrEqual": operator.le, "EqualTo": operator.eq}
        return all(size is not None and tests[kind](size, bound) for kind, bound in self.sizes)


class ArchiveReader(DataSourceReader):
    """Archives in partitions of about PARTITION_BYTES; rows as Arrow batches."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.hashing = Hashing(options.get("hash", "xxh3_64"), int(options.get("threshold", 1 << 20)), int(options.get("prefix", 8 << 10)))
        self.unpacking = Unpacking(int(options.get("maxdepth", 10)))
        self.bytes, self.listed = int(options.get("partitionbytes", PARTITION_BYTES)), int(options.get("mostlisted", MOST_LISTED))
        self.wanted = _Wanted()

    def pushFilters(self, filters):
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self):
        if os.path.isfile(self.root):
            return [_Pack([self.root], [])] if self.wanted.opens(self.root) else []
        if self.wanted.paths is not None:  # named archives are looked for where they are
            below = os.path.join(self.root, "")
            named = [p for p in self.wanted.paths if p.startswith(below) and is_archive_name(os.path.basename(p)) and os.path.isfile(p) and self.wanted.opens(p)]
            return [_Pack(paths, []) for paths in packed([(p, max(os.path.getsize(p), LEAST_BYTES)) for p in named], self.bytes)]
        found, folders, seen = [], deque([self.root]), 0
        while folders and seen < self.listed:
            try:
                with os.scandir(folders.popleft()) as entries:
                    for e in entries:
                        seen += 1
                        if e.is_dir(follow_symlinks=False):
                            folders.append(e.path)
                        elif is_archive_name(e.name) and e.is_file() and self.wanted.opens(e.path):
                            found.append((e.path, max(e.stat().st_size, LEAST_BYTES)))
            except OSError:
                continue
        return [*(_Pack(paths, []) for paths in packed(found, self.bytes)), *(_Pack([], [folder]) for folder in folders)]

    def _paths(self, pack: _Pack) -> Iterator[str]:
        yield from pack.paths
        for folder in pack.folders:
            for at, _, names in os.walk(folder):
                yield from (os.path.join(at, n) for n in sorted(names) if is_archive_name(n) and os.path.isfile(os.path.join(at, n)) and self.wanted.opens(os.path.join(at, n)))

    def read(self, partition):
        unpacking = self.unpacking if self.wanted.depth is None else replace(self.unpacking, depth=min(self.unpacking.depth, self.wanted.depth))
        rows = (r for path in (self._paths(partition) if partition else ()) for r in unpack(path, self.hashing, unpacking) if self.wanted.passes(r["size"]))
        for some in itertools.batched(rows, ROWS):
            yield pa.RecordBatch.from_pylist(list(some), schema=_ARROW)


#: MEMBERS as Arrow has them.
_ARROW = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[f.dataType.simpleString()]) for f in schema.MEMBERS.fields])


class ArchiveSource(DataSource):
    """``spark.read.format("archive_members").load(folder or archive)``.

    Filters on source_archive (=, in, starting with), size and depth are pushed down. Options: hash, threshold, prefix,
    maxdepth, partitionbytes, and mostlisted: the entries that the driver lists before it leaves subtrees to tasks.
    """

    @classmethod
    def name(cls):
        return "archive_members"

    def schema(self):
        return schema.MEMBERS

    def reader(self, schema):  # noqa: ARG002
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


#: MEMBERS, and the time of the archive's file in the row of the archive itself (depth -1).
ARRIVALS = T.StructType([*schema.MEMBERS.fields, T.StructField("mtime_ms", T.LongType())])
_ARROW_ARRIVALS = _ARROW.append(pa.field("mtime_ms", pa.int64()))


class _Arrived(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        super().__init__(len(files))
        self.files = files


class ArrivalReader(DataSourceStreamReader):
    """Archives below a folder in the order of their times and paths, which are the offsets.

    A batch has the archives after its start up to its end; they are listed again when it is replayed. An archive that comes
    with a time before the last offset (moved in, or unpacked with its time) is not seen; a scan of the folder finds it.
    """

    def __init__(self, options: dict):
        self.root, self.bytes = options["path"], int(options.get("partitionbytes", PARTITION_BYTES))
        self.hashing = Hashing(options.get("hash", "xxh3_64"), int(options.get("threshold", 1 << 20)), int(options.get("prefix", 8 << 10)))
        self.unpacking = Unpacking(int(options.get("maxdepth", 10)))

    def _listed(self) -> Iterator[tuple[str, int, int]]:
        for at, _, names in os.walk(self.root):
            for n in names:
                path = os.path.join(at, n)
                if is_archive_name(n) and os.path.isfile(path):
                    s = os.stat(path)
                    yield path, s.st_size, s.st_mtime_ns

    def initialOffset(self):
        return {"mtime_ns": -1, "path": ""}

    def latestOffset(self):
        mtime, path = max(((m, p) for p, _, m in self._listed()), default=(-1, ""))
        return {"mtime_ns": mtime, "path": path}

    def partitions(self, start, end):
        after, last = ((x["mtime_ns"], x["path"]) for x in (start, end))
        found = {p: (size, m) for p, size, m in self._listed() if after < (m, p) <= last}
        return [_Arrived([(p, *found[p]) for p in paths]) for paths in packed([(p, max(size, LEAST_BYTES)) for p, (size, _) in found.items()], self.bytes)]

    def read(self, partition):
        for path, size, mtime in partition.files:
            mine = {"source_archive": path, "path_in_archive": "", "filename": os.path.basename(path), "size": size, "is_nested_archive": False, "depth": -1, "seq": 0, "mtime_ms": mtime // 1_000_000}
            for some in itertools.batched(itertools.chain([mine], unpack(path, self.hashing, self.unpacking)), ROWS):
                yield pa.RecordBatch.from_pylist(list(some), schema=_ARROW_ARRIVALS)

    def commit(self, end):
        pass


class ArrivalSource(DataSource):
    """``spark.readStream.format("archive_arrivals").load(folder)``: archives as they come, each with a row of its own."""

    @classmethod
    def name(cls):
        return "archive_arrivals"

    def schema(self):
        return ARRIVALS

    def streamReader(self, schema):  # noqa: ARG002
        return ArrivalReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Makes the sources known, and lets Spark hand filters to sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    spark.dataSource.register(ArrivalSource)

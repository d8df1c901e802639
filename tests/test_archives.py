import contextlib
import hashlib
import io
import pathlib
import sys
import tarfile
import zipfile

import pytest
import xxhash

from twinfold.config import Hashing, Unpacking
from twinfold.sources import archives, listing


def zip_of(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
    return out.getvalue()


def tar_of(members: dict[str, bytes], mode: str = "w:gz") -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, content in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            t.addfile(info, io.BytesIO(content))
    return out.getvalue()


def rows(path, content, hashing=None, **unpacking):
    return list(archives.unpack(path, hashing, Unpacking(**unpacking), content))


def paths(found):
    return [r["path_in_archive"] for r in found if r["error"] is None]


def test_zip_and_directories():
    found = rows("x.zip", zip_of({"d/": b"", "d/a.txt": b"A", "b.txt": b""}))
    assert paths(found) == ["d/a.txt", "b.txt"]
    assert [r["size"] for r in found] == [1, 0]
    assert found[0]["full_hash"] == xxhash.xxh3_64_hexdigest(b"A") and found[0]["quick_hash"] is None
    assert found[0]["filename"] == "a.txt"


@pytest.mark.parametrize("name, mode", [("x.tar", "w"), ("x.tar.gz", "w:gz"), ("x.tgz", "w:gz"), ("x.tar.bz2", "w:bz2"), ("x.txz", "w:xz")])
def test_tars(name, mode):
    assert paths(rows(name, tar_of({"a/b": b"12", "c": b"3"}, mode))) == ["a/b", "c"]


def chain(depth):
    content = zip_of({"deep.txt": b"deep"})
    for k in range(depth):
        content = zip_of({f"level{k}.zip": content})
    return content


def test_nesting_and_depth():
    assert len(rows("x.zip", chain(4), depth=0)) == 1
    found = rows("x.zip", chain(4), depth=10)
    assert found[-1]["path_in_archive"] == "level3.zip/level2.zip/level1.zip/level0.zip/deep.txt" and found[-1]["depth"] == 4
    assert [r["is_nested_archive"] for r in found] == [True] * 4 + [False]
    assert paths(rows("x.zip", chain(2), depth=1)) == ["level1.zip", "level1.zip/level0.zip"]


def test_nested_tar_in_zip():
    inner = tar_of({"t.txt": b"t"})
    assert paths(rows("x.zip", zip_of({"a.tar.gz": inner}))) == ["a.tar.gz", "a.tar.gz/t.txt"]


def test_broken_input_is_a_row():
    whole = zip_of({"a": b"x" * 1000})
    (bad,) = rows("x.zip", whole[:100])
    assert bad["error"] and bad["full_hash"] is None
    found = rows("x.zip", zip_of({"inner.zip": b"no zip", "b": b"1"}))
    assert paths(found) == ["inner.zip", "b"] and sum(r["error"] is not None for r in found) == 1
    assert rows("x.rar", b"")[0]["error"]
    assert rows("x.zip", zip_of({})) == []
    assert next(archives.unpack("/no/such.zip"))["error"]


def test_self_extracting_and_carved():
    payload = zip_of({"m.txt": b"m"})
    assert paths(rows("setup.exe", b"MZ" + b"\0" * 64 + payload)) == ["m.txt"]
    assert paths(rows("dir/tool.AppImage", b"\x7fELF" + b"\1" * 500 + payload)) == ["tool.AppImage/m.txt"]


def test_limits_leave_an_archive_unread():
    two = zip_of({"a": b"x" * 60, "b": b"x" * 60})
    for limit in ({"member_bytes": 50}, {"archive_bytes": 100}):
        (row,) = rows("x.zip", two, **limit)
        assert row["error"].startswith("TooLarge") and row["path_in_archive"] == "" and row["depth"] == 0
        (row,) = rows("x.zip", zip_of({"first": b"1", "in.zip": two}), **limit)
        assert row["error"].startswith("TooLarge") and row["path_in_archive"] == ""
    assert len(rows("x.zip", two, member_bytes=60, archive_bytes=120)) == 2 and len(rows("x.zip", two)) == 2


class StandIn:
    """A module in the place of a library that is not installed."""

    def __init__(self, members):
        self.members = members

    def SevenZipFile(self, file):  # noqa: N802
        class Archive:
            def __enter__(self):
                return self

            def __exit__(self, *_):
                pass

            def list(own):
                return [type("Info", (), {"uncompressed": len(v)}) for v in self.members.values()]

            def extractall(own, folder):
                for name, content in self.members.items():
                    (pathlib.Path(folder) / name).parent.mkdir(parents=True, exist_ok=True)
                    (pathlib.Path(folder) / name).write_bytes(content)

        return Archive()

    def RarFile(self, file):  # noqa: N802
        class Archive:
            def __enter__(self):
                return self

            def __exit__(self, *_):
                pass

            def infolist(own):
                return [type("Info", (), {"filename": n, "is_dir": lambda _, n=n: n.endswith("/")})() for n in self.members]

            def open(own, info):
                return io.BytesIO(self.members[info.filename])

        return Archive()

    @contextlib.contextmanager
    def stream_reader(self, file):
        yield [type("Entry", (), {"pathname": n, "isfile": not n.endswith("/"), "get_blocks": lambda _, v=v: iter([v[:2], v[2:]])})() for n, v in self.members.items()]


@pytest.mark.parametrize("name, module", [("x.7z", "py7zr"), ("x.rar", "rarfile"), ("x.iso", "libarchive"), ("x.deb", "libarchive"), ("x.tar.zst", "libarchive"), ("x.squashfs", "libarchive"), ("x.zip", "libarchive")])
def test_readers_of_libraries(monkeypatch, name, module):
    """A zip without members is passed on to the next reader."""
    monkeypatch.setitem(sys.modules, module, StandIn({"d/one.txt": b"one!", "in.zip": zip_of({"two": b"2"})}))
    found = {r["path_in_archive"]: r["full_hash"] for r in rows(name, zip_of({})) if r["error"] is None}
    assert set(found) == {"d/one.txt", "in.zip", "in.zip/two"} and found["d/one.txt"] == xxhash.xxh3_64_hexdigest(b"one!")


def test_seven_zips_are_measured_before_they_are_unpacked(monkeypatch):
    monkeypatch.setitem(sys.modules, "py7zr", StandIn({"a": b"x" * 200}))
    assert rows("x.7z", b"", archive_bytes=100)[0]["error"].startswith("TooLarge")


def test_embedded_disk_image(monkeypatch):
    monkeypatch.setitem(sys.modules, "libarchive", StandIn({"m.txt": b"m"}))
    assert paths(rows("tool.AppImage", b"\x7fELF" + b"\1" * 500 + b"hsqs" + b"\0" * 100)) == ["tool.AppImage/m.txt"]


def test_large_members_have_both_hashes():
    data = bytes(range(256)) * 10
    (row,) = rows("x.zip", zip_of({"a": data}), Hashing(large=len(data), prefix=10))
    assert row["full_hash"] == xxhash.xxh3_64_hexdigest(data) and row["quick_hash"] == xxhash.xxh3_64_hexdigest(data[:10])


def test_find_magic():
    file = io.BytesIO(b"a" * 10 + b"MAGIC" + b"b" * 10)
    assert [archives.find_magic(file, b"MAGIC", chunk=n) for n in (1, 3, 4, 7, 100)] == [10] * 5
    assert archives.find_magic(file, b"MAGIC", start=11) is None and archives.find_magic(file, b"none", chunk=2) is None


def test_data_source_and_listing(spark, tmp_path):
    (tmp_path / "sub" / ".hidden").mkdir(parents=True)
    (tmp_path / "a.zip").write_bytes(zip_of({"1": b"one", "2": b"two"}))
    (tmp_path / "sub" / ".hidden" / "b.TAR.GZ").write_bytes(tar_of({"3": b"three"}))
    (tmp_path / "bad.zip").write_bytes(b"PK")
    (tmp_path / "sub" / "note.txt").write_bytes(b"")
    archives.register(spark)
    read = spark.read.format("archive_members").load(str(tmp_path))
    assert sorted(r["path_in_archive"] for r in read.filter("error is null").collect()) == ["1", "2", "3"]
    listed = listing.list_files(spark, [str(tmp_path), str(tmp_path / "sub"), str(tmp_path / "none")])
    assert listed.count() == 4 and listed.filter("size >= 1").count() == 3
    assert listing.list_files(spark, [str(tmp_path / "none")]).count() == 0
    found = archives.members(listing.archives(listed))
    assert found.filter("error is null").count() == 3 and found.filter("error is not null").count() == 1
    assert listing.list_with_spark(spark, [str(tmp_path)], 1).count() == 2  # without hidden names


def test_folders_are_opened_until_there_are_enough(tmp_path):
    for a in range(3):
        for b in range(4):
            (tmp_path / "one" / f"a{a}" / f"b{b}" / "c").mkdir(parents=True)
    assert list(listing.subtrees(str(tmp_path), 1)) == [(str(tmp_path), True)]
    found = list(listing.subtrees(str(tmp_path), 10))
    assert sum(deep for _, deep in found) == 12 and sum(not deep for _, deep in found) == 5
    assert not any(deep for _, deep in listing.subtrees(str(tmp_path), 100))


def tar_zst_of(members):
    import pyarrow as pa

    plain = io.BytesIO()
    with tarfile.open(fileobj=plain, mode="w") as t:
        for name, content in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            t.addfile(info, io.BytesIO(content))
    out = pa.BufferOutputStream()
    with pa.CompressedOutputStream(out, "zstd") as z:
        z.write(plain.getvalue())
    return out.getvalue().to_pybytes()


def test_tar_of_zstd():
    members = {"a/1": b"one" * 100_000, "empty": b"", "in.tar.gz": tar_of({"deep": b"d"}), "in.tzst": tar_zst_of({"x": b"x", "y.zip": zip_of({"z": b"z"})})}
    told = lambda found: [{k: v for k, v in r.items() if k != "source_archive"} for r in found]
    as_gzip = told(rows("x.tar.gz", tar_of(members)))
    assert told(rows("x.tar.zst", tar_zst_of(members))) == as_gzip == told(rows("x.TZST", tar_zst_of(members)))
    assert paths(rows("x.tar.zst", tar_zst_of(members))) == ["a/1", "empty", "in.tar.gz", "in.tar.gz/deep", "in.tzst", "in.tzst/x", "in.tzst/y.zip", "in.tzst/y.zip/z"]
    assert rows("x.tar.zst", tar_zst_of(members)[:40])[0]["error"] and rows("x.tar.zst", b"\x28\xb5\x2f\xfd")[0]["error"] and rows("x.tzst", tar_zst_of({})) == []
    assert paths(rows("y.tar.zst", tar_of({"plain": b"p"}))) == ["plain"]  # only the name says zstd


def superblock(magic):
    order = "little" if magic == b"hsqs" else "big"
    return magic + b"\0" * 8 + (1 << 17).to_bytes(4, order) + b"\0" * 6 + (17).to_bytes(2, order) + b"\0" * 4 + (4).to_bytes(2, order) + b"\0" * 66


def test_decoys_before_the_image_are_passed_over(monkeypatch):
    seen = []

    def stand_in(file, most):
        at = file.read(4)
        seen.append(at)
        if at == b"hsqs" or at == b"sqsh":
            yield "inside", lambda: io.BytesIO(b"data")
        else:
            raise ValueError("no image")

    monkeypatch.setattr(archives, "_libarchive", stand_in)
    decoys = b"\x7fELF hsqs stray, PK\x03\x04 and more: hsqs" + b"\1" * 300 + b"CD001x"
    for magic in (b"hsqs", b"sqsh"):
        seen.clear()
        assert paths(rows("tool.run", decoys + superblock(magic))) == ["tool.run/inside"] and seen == [magic]
    # a zip after stray headers, and an ISO at each of its fixed places
    assert paths(rows("tool.AppImage", decoys + zip_of({"m": b"m", "n": b"n"}))) == ["tool.AppImage/m", "tool.AppImage/n"]
    for before in (0x8001, 0x8801, 0x9001):
        data = b"\x7fELF" + b"\1" * 100 + b"\0" * before + b"CD001\1"
        assert (104, archives._libarchive) in list(archives.embedded(io.BytesIO(data)))
    assert rows("none.run", decoys)[0]["error"]


def test_all_magics_of_one_pass():
    data, magics = b"..hsqs..PKhsPK" + b"hsqsq", (b"hsqs", b"PK")
    expected = [(2, b"hsqs"), (8, b"PK"), (12, b"PK"), (14, b"hsqs")]
    for chunk in (1, 2, 3, 5, 8, 100):
        assert list(archives.find_magics(io.BytesIO(data), magics, chunk=chunk)) == expected


def test_filters_reach_the_archives(spark, tmp_path, monkeypatch):
    for k in range(6):
        (tmp_path / f"d{k % 2}").mkdir(exist_ok=True)
        (tmp_path / f"d{k % 2}" / f"a{k}.zip").write_bytes(zip_of({"small": b"s", "large": b"l" * 5000, "in.zip": zip_of({"deep.zip": zip_of({"deepest": b"d" * 5000})})}))
    archives.register(spark)
    every = spark.read.format("archive_members").load(str(tmp_path))
    rows_of = lambda df: sorted((r["source_archive"], r["path_in_archive"]) for r in df.collect())
    held = every.toPandas()
    assert len(held) == 30 and list(every.columns) == [f.name for f in archives.schema.MEMBERS.fields]
    one = str(tmp_path / "d1" / "a3.zip")
    cases = {
        f"source_archive = '{one}'": held["source_archive"] == one,
        f"source_archive IN ('{one}', '/none.zip')": held["source_archive"] == one,
        f"source_archive LIKE '{tmp_path}/d0/%' AND size > 4000": held["source_archive"].str.startswith(f"{tmp_path}/d0/") & (held["size"] > 4000),
        "depth < 1": held["depth"] < 1,
        "depth <= 1 AND size < 3": (held["depth"] <= 1) & (held["size"] < 3),
        "depth = 2": held["depth"] == 2,
        "size >= 5000 AND filename = 'large'": (held["size"] >= 5000) & (held["filename"] == "large"),
    }
    for condition, wanted in cases.items():
        expected = sorted(zip(held[wanted]["source_archive"], held[wanted]["path_in_archive"], strict=True))
        assert rows_of(every.filter(condition)) == expected and expected, condition
    # only the archive that is asked for is opened
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    reader = archives.ArchiveReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([EqualTo(("source_archive",), one), LessThanOrEqual(("depth",), 0), GreaterThan(("size",), 10), EqualTo(("filename",), "large")]))
    assert [f.attribute for f in left] == [("filename",)]
    opened, real = [], archives.unpack
    monkeypatch.setattr(archives, "unpack", lambda path, h, u: opened.append((path, u.depth)) or real(path, h, u))
    (pack,) = reader.partitions()
    (batch,) = list(reader.read(pack))
    assert opened == [(one, 0)] and batch.column("path_in_archive").to_pylist() == ["large", "in.zip"]


def test_partitions_by_size(tmp_path):
    sizes = [(f"a{k}", s) for k, s in enumerate([5, 100, 1, 3, 40, 60, 2])]
    packs = archives.packed(sizes, 100)
    assert sorted(p for pack in packs for p in pack) == [f"a{k}" for k in range(7)]
    assert all(sum(dict(sizes)[p] for p in pack) <= 100 for pack in packs) and len(packs) == 3
    for k in range(5):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / "a.zip").write_bytes(zip_of({"m": b"m"}))
    reader = archives.ArchiveReader({"path": str(tmp_path), "mostlisted": "6"})
    packs = reader.partitions()
    assert sum(len(p.folders) for p in packs) == 4 and sum(len(p.paths) for p in packs) == 1
    assert sorted(x for p in packs for b in reader.read(p) for x in b.column("source_archive").to_pylist()) == sorted(str(tmp_path / f"d{k}" / "a.zip") for k in range(5))
    assert len(archives.ArchiveReader({"path": str(tmp_path), "partitionbytes": "1"}).partitions()) == 5


def ar_of(members, long_names=b""):
    out = b"!<arch>\n"
    if long_names:
        out += b"%-16s%-32s%-10d`\n" % (b"//", b"0", len(long_names)) + long_names + b"\n" * (len(long_names) % 2)
    for name, content in members:
        out += b"%-16s%-12s%-6s%-6s%-8s%-10d`\n" % (name, b"0", b"0", b"0", b"100644", len(content)) + content + b"\n" * (len(content) % 2)
    return out


def cpio_of(members):
    out = b""
    for k, (name, mode, content) in enumerate([*members, ("TRAILER!!!", 0, b"")]):
        raw = name.encode() + b"\0"
        head = b"070701" + b"".join(b"%08X" % n for n in (k, mode, 0, 0, 1, 0, len(content), 0, 0, 0, 0, len(raw), 0))
        out += head + raw
        out += b"\0" * (-len(out) % 4) + content
        out += b"\0" * (-len(out) % 4)
    return out


def test_ar_deb_and_cpio():
    deb = ar_of([(b"debian-binary", b"2.0\n"), (b"control.tar.gz/", tar_of({"control": b"c"})), (b"data.tar.zst/", tar_zst_of({"usr/bin/x": b"x" * 999}))])
    assert paths(rows("p.deb", deb)) == ["debian-binary", "control.tar.gz", "control.tar.gz/control", "data.tar.zst", "data.tar.zst/usr/bin/x"]
    data = bytes(range(256))
    found = rows("lib.ar", ar_of([(b"/", b"symbols"), (b"/0", data), (b"#1/8", b"bsd.o\0\0\0" + b"odd"), (b"e/", b"")], b"a-very-long-name-of-an-object.o/\n"))
    assert [(r["path_in_archive"], r["size"]) for r in found] == [("a-very-long-name-of-an-object.o", 256), ("bsd.o", 3), ("e", 0)]
    assert found[0]["full_hash"] == xxhash.xxh3_64_hexdigest(data)
    found = rows("c.cpio", cpio_of([("d", 0o040755, b""), ("d/one", 0o100644, b"1" * 5), ("link", 0o120777, b"d/one"), ("d/in.zip", 0o100644, zip_of({"z": b"z"}))]))
    assert [(r["path_in_archive"], r["size"]) for r in found if r["path_in_archive"] != "d/in.zip"] == [("d/one", 5), ("d/in.zip/z", 1)]
    for name, broken in (("x.deb", deb[:100]), ("x.deb", b"!<arch>\nno header"), ("x.deb", b"PK"), ("x.cpio", b"070701"), ("x.cpio", b""), ("x.ar", ar_of([(b"a", b"b" * 50)])[:-20])):
        assert any(r["error"] for r in rows(name, broken)), (name, broken)
    assert rows("x.ar", ar_of([])) == [] and rows("x.cpio", cpio_of([])) == []


def test_hashes_by_spark(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.bin").write_bytes(b"a" * 100)
    (tmp_path / "sub" / "b.bin").write_bytes(b"b")
    whole = {r["name"]: r["hash"] for r in listing.hashes_with_spark(spark, [str(tmp_path)]).collect()}
    assert whole == {"a.bin": xxhash.xxh3_64_hexdigest(b"a" * 100), "b.bin": xxhash.xxh3_64_hexdigest(b"b")}
    (row,) = listing.hashes_with_spark(spark, [str(tmp_path)], 2, prefix=3, hash_name="md5").collect()
    assert (row["name"], row["size"], row["hash"]) == ("a.bin", 100, hashlib.md5(b"aaa").hexdigest())

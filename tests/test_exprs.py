import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from twinfold.functions import exprs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "size, text",
    [(0, "0.0 B"), (1023, "1023.0 B"), (1024, "1.0 KB"), (1280, "1.2 KB"), (1536, "1.5 KB"), (1048575, "1024.0 KB"), (5 << 20, "5.0 MB"), (3 << 30, "3.0 GB"), (1 << 40, "1.0 TB"), (1 << 50, "1.0 PB"), (1 << 62, "4096.0 PB")],
)
def test_human_size(spark, size, text):
    assert one(spark, exprs.human_size(F.lit(size).cast("long"))) == text


def test_archive_names(spark):
    names = ["a.ZIP", "b.tar.gz", "c.7z", "d.AppImage", "zip", "e.gz", "f.txt", "g.png", "h.pdf", "i.zip.txt", "j.lz"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", exprs.is_archive(F.col("n")).alias("x")).collect()
    assert {r["n"] for r in rows if r["x"]} == {"a.ZIP", "b.tar.gz", "c.7z", "d.AppImage", "j.lz"}
    assert all(exprs.is_archive_name(r["n"]) == r["x"] for r in rows)
    assert len(exprs.ARCHIVE_SUFFIXES) == 38


@pytest.mark.parametrize("path, name", [("a/b/c.txt", "c.txt"), ("c.txt", "c.txt"), ("a/b/", "b"), ("/", ""), ("ü/ñ.tar.gz", "ñ.tar.gz")])
def test_basename(spark, path, name):
    assert one(spark, exprs.basename(F.lit(path))) == name


def test_hash_policy(spark):
    data = b"0123456789abcdefghij"
    content, size = F.lit(data), F.lit(len(data))
    md5 = lambda x: hashlib.md5(x).hexdigest()
    pick = lambda pair: one(spark, F.struct(pair[0].alias("f"), pair[1].alias("q")))
    assert tuple(pick(exprs.file_hashes(content, size, 21, 10))) == (md5(data), None)
    assert tuple(pick(exprs.file_hashes(content, size, 20, 10))) == (None, md5(data[:10]))  # a size at the threshold is large
    assert tuple(pick(exprs.member_hashes(content, size, 20, 10))) == (md5(data), md5(data[:10]))
    assert tuple(pick(exprs.member_hashes(content, size, 21, 10))) == (md5(data), None)


@pytest.mark.parametrize("name", ["md5", "sha256", "xxhash64", "xxh3_64"])
def test_null_content_has_no_hash(spark, name):
    rows = spark.createDataFrame([(b"x",), (None,), (b"",)], "c binary").select(exprs.content_hash(F.col("c"), name).alias("h")).collect()
    assert rows[0]["h"] and rows[1]["h"] is None and rows[2]["h"]


def test_xxh3(spark):
    assert one(spark, exprs.content_hash(F.lit(b"hello"), "xxh3_64")) == xxhash.xxh3_64_hexdigest(b"hello")
    with pytest.raises(ValueError):
        exprs.content_hash(F.lit(b""), "nosuch")


@pytest.mark.parametrize(
    "known, listed, expected",
    [((5, 10, 1.0), (5, 10), False), ((5, 10, 1.0), (6, 10), True), ((5, 10, 1.0), (5, 11), True), ((5, 10, None), (5, 10), True), ((None, None, None), (5, 10), True)],
)
def test_needs_rescan(spark, known, listed, expected):
    lit = lambda x, t="long": F.lit(x).cast(t)
    args = lit(known[0]), lit(known[1]), lit(known[2], "double"), lit(listed[0]), lit(listed[1])
    assert one(spark, exprs.needs_rescan(*args)) is expected
    assert one(spark, exprs.needs_rescan(*args, recheck=True)) is True


def test_small_expressions(spark):
    assert one(spark, exprs.progress_pct(F.lit(1), F.lit(4))) == 25.0
    assert one(spark, exprs.progress_pct(F.lit(0), F.lit(0))) == 0.0
    assert one(spark, exprs.match_key(F.lit(""), F.lit("q"))) == "q"
    assert one(spark, exprs.match_key(F.lit("f"), F.lit("q"))) == "f"
    assert one(spark, exprs.checkbox(F.lit(True))) == "[X]"
    assert one(spark, exprs.archive_label(F.lit("a.zip"), F.lit(3).cast("long"))) == "a.zip (3 duplicates)"
    assert one(spark, exprs.size_mb(F.lit(1 << 19))) == 0.5
    assert one(spark, exprs.child_path(F.lit("a.zip"), F.lit("b"))) == "a.zip/b"

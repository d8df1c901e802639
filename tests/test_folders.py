import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from twinfold import schema
from twinfold.config import Hashing, Scan
from twinfold.operators.store import Store
from twinfold.plans import scan
from twinfold.sources import folders, listing


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "t"
    for folder in ("a/b/c", "a/x", "d", "none"):
        (root / folder).mkdir(parents=True)
    for path in ("top", "a/one", "a/b/two", "a/b/c/deep", "a/x/three", "d/four"):
        (root / path).write_bytes(path.encode())
    age(root)
    return root


def age(root):
    """Folders as they are some time after they changed."""
    for at, _, _ in os.walk(root, topdown=False):
        s = os.stat(at)
        os.utime(at, ns=(s.st_atime_ns, s.st_mtime_ns - 2 * folders.TICK))


def nothing(spark):
    return spark.createDataFrame([], schema.FOLDERS)


def told(root, df):
    return {os.path.relpath(r["path"], root): r for r in df.collect()}


def test_changes_at_any_depth_are_found(spark, tree):
    first = folders.digests(folders.walk(spark, [str(tree), str(tree / "a")], nothing(spark))).withColumn("config", F.lit("c")).cache()
    before = told(tree, first)
    assert set(before) == {".", "a", "a/b", "a/b/c", "a/x", "d", "none"} and all(r["changed"] for r in before.values())
    again = told(tree, folders.digests(folders.walk(spark, [str(tree)], first)))
    assert not any(r["changed"] for r in again.values()) and {k: r["digest"] for k, r in again.items()} == {k: r["digest"] for k, r in before.items()}

    (tree / "a/b/c/new").write_bytes(b"new")
    shutil.rmtree(tree / "d")
    (tree / "a/x/y/z").mkdir(parents=True)
    (tree / "a/x/y/z/five").write_bytes(b"5")
    levels = folders.walk(spark, [str(tree)], first)
    after = told(tree, folders.digests(levels))
    assert {k for k, r in after.items() if r["changed"]} == {"a/b/c", "a/x/y", "a/x/y/z"} and "d" not in after
    assert {k for k in after if k in before and after[k]["digest"] != before[k]["digest"]} == {".", "a", "a/b", "a/b/c", "a/x"}
    names = lambda df: sorted(r["name"] for r in df.collect())
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    assert names(folders.files_in(every.filter("changed"))) == ["deep", "five", "new"]


def test_files_rewritten_in_place_need_a_full_walk(spark, tree):
    first = folders.digests(folders.walk(spark, [str(tree)], nothing(spark))).withColumn("config", F.lit("c")).cache()
    first.count()
    (tree / "a/b/two").write_bytes(b"longer than before")
    assert not any(r["changed"] for r in told(tree, folders.digests(folders.walk(spark, [str(tree)], first))).values())
    found = told(tree, folders.digests(folders.walk(spark, [str(tree)], first, trust=False)))
    assert {k for k, r in found.items() if r["changed"]} == {"a/b"}


def test_young_times_are_not_trusted(spark, tree):
    os.utime(tree / "d", ns=(time.time_ns(), time.time_ns()))
    first = folders.digests(folders.walk(spark, [str(tree)], nothing(spark))).withColumn("config", F.lit("c")).cache()
    first.count()
    s = os.stat(tree / "d")
    (tree / "d" / "six").write_bytes(b"6")
    os.utime(tree / "d", ns=(s.st_atime_ns, s.st_mtime_ns))  # a change within the tick
    assert {k for k, r in told(tree, folders.digests(folders.walk(spark, [str(tree)], first))).items() if r["changed"]} == {"d"}


def test_equal_trees_have_equal_digests(spark, tree, tmp_path):
    shutil.copytree(tree, tmp_path / "other", copy_function=shutil.copy2)
    one, two = (told(r, folders.digests(folders.walk(spark, [str(r)], nothing(spark)))) for r in (tree, tmp_path / "other"))
    assert {k: r["digest"] for k, r in one.items()} == {k: r["digest"] for k, r in two.items()} and one["a"]["digest"] != one["d"]["digest"]
    assert folders.outermost(["/a/b", "/a", "/ab", "/a/b/c"]) == ["/a", "/ab"] and folders.walk(spark, [str(tmp_path / "no")], nothing(spark)) == []


def test_scans_that_trust_folders(spark, tree, tmp_path, monkeypatch):
    (tmp_path / "s").mkdir()
    config = lambda **more: Scan((str(tmp_path / "s"),), (str(tree),), str(tmp_path / "store"), hashing=Hashing(large=1000, prefix=16), trust_folders=True, **more)
    hashed = lambda c: scan.run(spark, c).counters["targets_hashed"]
    assert hashed(config()) == 6 and hashed(config()) == 0
    (tree / "a/b/c/new").write_bytes(b"new")
    (tree / "a/x/three").unlink()
    age(tree / "a")
    with Store(spark, str(tmp_path / "store")) as kept:
        walked = folders.walk(spark, [str(tree)], kept.table("folders"))
        rows = sorted(r["path"] for r in folders.list_changed(walked, kept.table("target_files")).collect())
    assert rows == sorted(r["path"] for r in listing.list_files(spark, [str(tree)]).collect())
    assert hashed(config()) == 1
    (tree / "top").write_bytes(b"rewritten in place")
    assert hashed(config()) == 0 and hashed(config(afresh=frozenset({"files"}))) == 6
    assert hashed(config(least_bytes=2)) == 6  # another stamp: nothing is trusted

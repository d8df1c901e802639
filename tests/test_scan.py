import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from twinfold.cli import config_of, main, parser
from twinfold.config import Deletion, Hashing, Scan, Unpacking, admitted
from twinfold.operators import actions, match, report
from twinfold.operators.store import Store
from twinfold.plans import catalogue, scan
from twinfold.streaming import incremental


def write_zip(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)


def zip_bytes(members):
    out = io.BytesIO()
    write_zip(out, members)
    return out.getvalue()


@pytest.fixture
def dirs(tmp_path):
    for name in ("s", "t"):
        (tmp_path / name).mkdir()
    return tmp_path


def config(dirs, **more):
    return Scan((str(dirs / "s"),), (str(dirs / "t"),), str(dirs / "store"), hashing=Hashing(large=1000, prefix=16), **more)


def find(spark, c):
    with Store(spark, c.store) as kept:
        scan.scan_sources(spark, c, kept)
        return [r.asDict() for r in scan.scan_targets(spark, c, kept).collect()]


def test_two_archives_two_targets(spark, dirs):
    write_zip(dirs / "s" / "a.zip", {"x/one.txt": b"same"})
    write_zip(dirs / "s" / "b.zip", {"two.txt": b"same", "other": b"other"})
    for n in ("c1", "c2"):
        (dirs / "t" / n).write_bytes(b"same")
    (dirs / "t" / "unlike").write_bytes(b"unlike")
    found = find(spark, config(dirs))
    assert len(found) == 4 and all(r["selected"] for r in found)
    assert not any(r["selected"] for r in find(spark, config(dirs, deletion=Deletion(unless_stored=False))))


def test_nested_zero_byte_unicode_and_prefix_collision(spark, dirs):
    big, like = b"p" * 2000, b"p" * 1999 + b"q"
    write_zip(dirs / "s" / "a.zip", {"in.zip": zip_bytes({"naïve ü.txt": "ü".encode() * 3, "empty": b""}), "big": big})
    (dirs / "t" / "copy ü").write_bytes("ü".encode() * 3)
    (dirs / "t" / "empty").write_bytes(b"")
    (dirs / "t" / "big").write_bytes(big)
    (dirs / "t" / "like").write_bytes(like)
    found = {(os.path.basename(r["target_path"]), r["path_in_archive"]) for r in find(spark, config(dirs))}
    assert found == {("copy ü", "in.zip/naïve ü.txt"), ("empty", "in.zip/empty"), ("big", "big")}
    kept = Store(spark, str(dirs / "store")).table("target_files").collect()
    hashes = {os.path.basename(r["path"]): (r["full_hash"] is not None, r["quick_hash"] is not None) for r in kept}
    assert hashes == {"copy ü": (True, False), "empty": (True, False), "big": (True, True), "like": (True, True)}
    assert len(find(spark, config(dirs))) == 3  # from the store


def test_rescan_replaces_members_and_skips_unchanged(spark, dirs):
    path = dirs / "s" / "a.zip"
    write_zip(path, {"one": b"1111", "two": b"2222"})
    write_zip(dirs / "s" / "none.zip", {})
    (dirs / "s" / "bad.zip").write_bytes(b"PK not really")
    (dirs / "t" / "x").write_bytes(b"2222")
    assert len(find(spark, config(dirs))) == 1
    with Store(spark, str(dirs / "store")) as kept:
        first = {os.path.basename(r["path"]): (r["file_count"], r["last_scanned"]) for r in kept.archives().collect()}
    assert {k: v[0] for k, v in first.items()} == {"a.zip": 2, "none.zip": 0}
    write_zip(path, {"one": b"1111 longer"})
    assert find(spark, config(dirs)) == []
    with Store(spark, str(dirs / "store")) as kept:
        again = {os.path.basename(r["path"]): r["last_scanned"] for r in kept.archives().collect()}
        assert kept.files_by_archive(str(path)).count() == 1
    assert again["none.zip"] == first["none.zip"][1] and again["a.zip"] > first["a.zip"][1]
    path.unlink()
    write_zip(dirs / "s" / "c.zip", {"z": b"z"})
    (dirs / "t" / "x").write_bytes(b"1111 longer")
    assert find(spark, config(dirs)) == [] and len(find(spark, config(dirs, gone_count=True))) == 1


def test_min_size_keeps_children(spark, dirs):
    write_zip(dirs / "s" / "a.zip", {"tiny": b"1", "mid": b"m" * 50})
    for n, data in (("tiny", b"1"), ("mid", b"m" * 50)):
        (dirs / "t" / n).write_bytes(data)
    assert [r["filename"] for r in find(spark, config(dirs, least_bytes=30))] == ["mid"]


def test_target_archives(spark, dirs):
    write_zip(dirs / "s" / "a.zip", {"f": b"content"})
    write_zip(dirs / "t" / "t.zip", {"g": b"content", "h": b"more"})
    assert find(spark, config(dirs)) == []
    (row,) = find(spark, config(dirs, look_inside=True))
    assert row["target_path"].endswith("t.zip!/g")


def test_run_deletes_only_when_told(spark, dirs):
    write_zip(dirs / "s" / "a.zip", {"one": b"1111", "again": b"1111"})
    (dirs / "t" / "x").write_bytes(b"1111")
    done = scan.run(spark, config(dirs))
    assert done.plan.count() == 1 and done.summary.first()["file_count"] == 1
    assert [r["status"] for r in done.outcomes.collect()] == ["would delete"] and (dirs / "t" / "x").exists()
    done = scan.run(spark, config(dirs, deletion=Deletion(carried_out=True, way="permanent"), forget=True))
    assert [r["status"] for r in done.outcomes.collect()] == ["deleted"] and not (dirs / "t" / "x").exists()
    assert Store(spark, str(dirs / "store")).statistics().first().asDict() == {"archive_count": 0, "file_count": 0, "nested_count": 0}
    with pytest.raises(scan.InvalidScan):
        scan.run(spark, Scan((), ()))


def test_actions(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"12")
    (tmp_path / "b").write_bytes(b"12")
    plan = spark.createDataFrame([(str(tmp_path / "a"), 2), (str(tmp_path / "b"), 3), (str(tmp_path / "c"), 1)], "target_path string, target_size long")
    status = {os.path.basename(r["path"]): r["reason"] for r in actions.execute(plan, way="permanent", carried_out=True).collect()}
    assert status == {"a": None, "b": "changed since it was scanned", "c": "File not found"}
    assert actions.execute(plan.limit(0)).count() == 0
    (tmp_path / "d").write_bytes(b"")
    plan = spark.createDataFrame([(str(tmp_path / "d"), 0)], "target_path string, target_size long")
    assert actions.execute(plan, way="trash", carried_out=True).first()["reason"] == "send2trash is not installed"


def test_store(spark, tmp_path):
    with Store(spark, str(tmp_path / "st")) as kept:
        files = "full_hash string, quick_hash string, filename string, path_in_archive string, source_archive string, size long, is_nested_archive boolean, seq int"
        kept.add_files(spark.createDataFrame([("h1", None, "a", "a", "z", 1, False, 1), ("h2", "q2", "a", "a", "z", 2, False, 2), (None, "q3", "b", "b", "z", 3, True, 3)], files), "seq")
        assert [r["full_hash"] for r in kept.files_by_archive("z").collect()] == ["h2", None]
        assert kept.by_full_hash("h1").count() == 0 and kept.by_quick_hash("q3").count() == 1
        assert kept.has_quick_hash("q2") and not kept.has_quick_hash("none")
        kept.backfill_full_hash(spark.createDataFrame([("z", "b", "h3")], "source_archive string, path_in_archive string, full_hash string"))
        assert kept.by_full_hash("h3").count() == 1
        pick = lambda *rows: spark.createDataFrame(rows, "file_hash string, target_path string, selected boolean, seq int")
        assert kept.selection("h2", "t") is None
        kept.select(pick(("h2", "t", True, 1), ("h2", "t", False, 2)), "seq")
        assert kept.selection("h2", "t") is False
        kept.select(pick(("h2", "t", True, 1)))
        assert kept.selection("h2", "t") is True
        kept.update_archives(spark.createDataFrame([("z", 5, 10, 2, "c")], "path string, mtime_ms long, size long, file_count long, config string"))
        assert kept.archive("z").first()["last_scanned"] is not None
        assert kept.statistics().first().asDict() == {"archive_count": 1, "file_count": 2, "nested_count": 1}
        kept.clear()
        assert kept.statistics().first()["file_count"] == 0 and kept.target("x").count() == 0
    assert Store(spark, str(tmp_path / "st")).archives().count() == 0


def test_half_written_versions_do_not_count(spark, tmp_path):
    kept = Store(spark, str(tmp_path / "st"))
    os.makedirs(tmp_path / "st" / "files" / "v9")
    assert kept.table("files").count() == 0


def test_phases_agree(spark):
    """With one threshold for both sides, two phases find what one does."""
    import random

    r = random.Random(3)
    contents = ["".join(r.choice("ab") for _ in range(r.choice([2, 6, 7]))) for _ in range(120)]
    rows = [(f"p{k}", len(c), c[:3] + str(len(c)) * 0, c) for k, c in enumerate(contents)]
    df = spark.createDataFrame(rows, "path string, size long, prefix string, content string")
    files = df.filter("path < 'p5'").select(F.md5("content").alias("full_hash"), F.when(F.col("size") >= 6, F.md5("prefix")).alias("quick_hash"), F.col("path").alias("filename"), F.col("path").alias("path_in_archive"), F.lit("z").alias("source_archive"), "size", F.lit(False).alias("is_nested_archive"))
    own = df.filter("path >= 'p5'")
    whole = own.select("path", "size", F.md5("content").alias("full_hash"))
    lazy = own.select("path", "size", F.when(F.col("size") < 6, F.md5("content")).alias("full_hash"), F.when(F.col("size") >= 6, F.md5("prefix")).alias("quick_hash"))
    with_full = lambda c: c.join(whole.select("path", "full_hash"), "path")
    pairs = lambda m: sorted((x["path_in_archive"], x["target_path"]) for x in m.collect())
    both, verified = match.two_phase(lazy, files, with_full)
    one = match.one_phase(whole, files)
    assert pairs(both) == pairs(one) and pairs(one)
    nested = match.nested_result(match.select_all(one, True)).first()
    assert len(nested["duplicates"]) == one.count()
    assert verified.count() <= lazy.filter("full_hash is null").count()
    listing = report.review(match.select_all(one, True))
    assert listing.filter("not is_detail").count() == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"a" * 20)
    kept, c = Store(spark, str(tmp_path / "st")), Scan((), (), hashing=Hashing("md5", 10, 4))
    for extra in (None, "b.bin"):
        if extra:
            (tmp_path / "in" / extra).write_bytes(b"b")
        incremental.store_targets(spark, str(tmp_path / "in"), kept, c, str(tmp_path / "cp")).awaitTermination()
    got = {os.path.basename(r["path"]): (r["size"], r["quick_hash"] is not None) for r in kept.table("target_files").collect()}
    assert got == {"a.bin": (20, True), "b.bin": (1, False)}


def test_config_and_command_line(tmp_path, capsys):
    assert len(Scan((), ()).faults()) == 2
    bad = Scan(("a",), ("b",), least_bytes=-1, hashing=Hashing("none", -1, 0), unpacking=Unpacking(-1, 0), deletion=Deletion(way="burn"))
    assert len(bad.faults()) == 7 and not Scan(("a",), ("b",)).faults()
    assert main([]) == 1 and "no directory with archives" in capsys.readouterr().err
    assert main(["-s", str(tmp_path), "-s", str(tmp_path), "-t", str(tmp_path / "no")]) == 1
    said = capsys.readouterr().err
    assert "already listed" in said and "does not exist" in said
    c = config_of(parser().parse_args(["-s", "a", "-s", "b", "-t", "c", "--recheck", "--no-auto-select", "--min-size", "3", "--dry-run", "--delete"]))
    assert c.archives_in == ("a", "b") and c.afresh == {"archives"} and not c.deletion.unless_stored and not c.deletion.carried_out and c.least_bytes == 3
    assert config_of(parser().parse_args(["--delete"])).deletion.carried_out
    path = admitted(f" {tmp_path} ", [])
    assert path == str(tmp_path.resolve())
    for text, why in (("", "empty path"), (str(tmp_path / "no"), "does not exist"), (__file__, "not a directory"), (str(tmp_path), "already listed")):
        with pytest.raises(ValueError, match=why):
            admitted(text, [path])


def test_deltas_are_merged_and_become_snapshots(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("twinfold.operators.store.MOST_DELTAS", 2)
    kept = Store(spark, str(tmp_path / "st"))
    pick = lambda *rows: spark.createDataFrame(rows, "file_hash string, target_path string, selected boolean")
    kinds = []
    for k in range(5):
        kept.select(pick(("h", "t", k % 2 == 0), (f"h{k}", "t", True)))
        kinds.append(kept._versions("selection_state")[-1][1][0])
        assert kept.selection("h", "t") is (k % 2 == 0) and kept.table("selection_state").count() == k + 2
    assert kinds == ["d", "d", "v", "d", "d"]
    assert kept.toggle("h", "t") is False and kept.selection("h", "t") is False and kept.toggle("new", "t") is False


def test_counts_by_content_are_those_of_the_pairs(spark):
    """One content in very many files and targets makes no pairs in plan and totals."""
    files = spark.range(300).select(F.lit("h").alias("full_hash"), F.lit(None).cast("string").alias("quick_hash"), F.lit("f").alias("filename"), F.col("id").cast("string").alias("path_in_archive"), F.concat(F.lit("z"), F.col("id") % 3).alias("source_archive"), F.lit(5).cast("long").alias("size"), F.lit(False).alias("is_nested_archive"))
    targets = spark.range(200).select(F.col("id").cast("string").alias("path"), F.lit(5).cast("long").alias("size"), F.when(F.col("id") % 2 == 0, F.lit("h")).otherwise(F.lit("other")).alias("full_hash"))
    pairs = match.one_phase(targets, files)
    assert report.totals(targets, files).first().asDict() == {"match_count": pairs.count(), "archive_count": 3, "target_count": 100}
    assert {r["source_archive"]: (r["match_count"], r["redundant_bytes"]) for r in report.by_archive(targets, files).collect()} == dict.fromkeys(("z0", "z1", "z2"), (10_000, 50_000))
    plan = report.deletion_plan(match.target_counts(targets, files).withColumn("selected", F.lit(True)))
    assert plan.count() == 100 and {r["match_count"] for r in plan.collect()} == {300}
    parts = match.nested_result(match.select_all(pairs, True), most=5000).collect()
    assert sum(len(r["duplicates"]) for r in parts) == pairs.count() and {r["part"] for r in parts} == {0, 1}


def test_parts_in_order(spark):
    """In order, parts hold ranges of an archive's matches that grow with the part's number."""
    hashed = spark.range(90).select(F.lit("h").alias("full_hash"), F.lit(None).cast("string").alias("quick_hash"), F.lit("f").alias("filename"), F.col("id").cast("string").alias("path_in_archive"), F.concat(F.lit("z"), F.col("id") % 2).alias("source_archive"), F.lit(5).cast("long").alias("size"), F.lit(False).alias("is_nested_archive"))
    targets = spark.range(40).select(F.col("id").cast("string").alias("path"), F.lit(5).cast("long").alias("size"), F.lit("h").alias("full_hash"))
    pairs = match.select_all(match.one_phase(targets, hashed), True)
    found = match.nested_result(pairs, most=100, in_order=("path_in_archive", "target_path")).collect()
    for archive in ("z0", "z1"):
        parts = [[(x["source_file"]["path_in_archive"], x["target_path"]) for x in r["duplicates"]] for r in sorted(found, key=lambda r: r["part"]) if r["source_archive"] == archive]
        assert max(map(len, parts)) <= 100 and len(parts) >= 18
        assert [x for p in parts for x in sorted(p)] == sorted((str(f), str(t)) for f in range(90) if archive == f"z{f % 2}" for t in range(40))


def test_nested_query_has_one_row_an_archive(spark, tmp_path):
    """However many matches it has: 12,200 of src1 here, more than one part's."""
    source = F.when(F.col("id") < 122, "src1").when(F.col("id") < 125, "src2").otherwise("src10")
    spark.range(225).select(F.col("id").alias("doc_id"), source.alias("source"), F.lit("one text").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(130, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    line = lambda files: ",".join(f"src10/{t} d/{f}.txt {str(t != 130).lower()}" for f in sorted(files, key=lambda f: f"d/{f}.txt") for t in range(125, 225))
    got = sorted(tuple(r) for r in catalogue.QUERIES["matches_nested"](spark, str(tmp_path)).collect())
    assert got == [("src1", 0, line(range(122))), ("src2", 0, line(range(122, 125)))]


def test_running_counters(spark, dirs):
    write_zip(dirs / "s" / "a.zip", {"one": b"1111", "two": b"2" * 2000})
    (dirs / "t" / "x").write_bytes(b"1111")
    (dirs / "t" / "y").write_bytes(b"2" * 2000)
    done = scan.run(spark, config(dirs))
    assert done.counters == {"members_read": 2, "archives_read": 1, "targets_hashed": 2, "targets_failed": 0, "targets_verified": 1}
    assert done.matches.count() == 2 and done.by_archive.first()["match_count"] == 2


def test_changed_files_survive(spark, tmp_path):
    """Another time or other bytes of the same size: what is not what was scanned stays."""
    import xxhash

    paths = [tmp_path / n for n in ("same", "touched", "other", "unknown", "gone")]
    for p in paths[:4]:
        p.write_bytes(b"12345")
    told = [(str(p), 5, p.stat().st_mtime_ns // 1_000_000 if p.exists() else 1, xxhash.xxh3_64_hexdigest(b"12345")) for p in paths]
    told[3] = (told[3][0], None, None, None)
    plan = spark.createDataFrame(told, "target_path string, target_size long, mtime_ms long, target_hash string")
    os.utime(paths[1], (1, 1))
    before = paths[2].stat().st_mtime_ns
    paths[2].write_bytes(b"54321")
    os.utime(paths[2], ns=(before, before))  # rewritten in place, with its size and time
    look = lambda **how: {os.path.basename(r["path"]): (r["status"], r["reason"]) for r in actions.execute(plan, **how).collect()}
    assert look()["same"] == ("would delete", None) and look()["touched"][0] == "failed"
    assert look(way="permanent", carried_out=True, folder=str(tmp_path / "out")) == {
        "same": ("deleted", None), "touched": ("failed", "changed since it was scanned"), "other": ("failed", "changed since it was scanned"), "unknown": ("deleted", None), "gone": ("failed", "File not found")}
    assert [p.exists() for p in paths] == [False, True, True, False, False]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    assert actions._delete(str(paths[0]), (5, None, None), "permanent", False, "xxh3_64", True)[1] == "gone"


def test_a_target_that_changes_between_scan_and_deletion(spark, dirs, monkeypatch):
    write_zip(dirs / "s" / "a.zip", {"one": b"1111"})
    (dirs / "t" / "x").write_bytes(b"1111")
    real = actions.execute

    def late(plan, **how):
        now = (dirs / "t" / "x").stat().st_mtime_ns
        (dirs / "t" / "x").write_bytes(b"2222")
        os.utime(dirs / "t" / "x", ns=(now, now))
        return real(plan, **how)

    monkeypatch.setattr(actions, "execute", late)
    done = scan.run(spark, config(dirs, deletion=Deletion(carried_out=True, way="permanent")))
    assert [r["reason"] for r in done.outcomes.collect()] == ["changed since it was scanned"] and (dirs / "t" / "x").exists()


def test_what_could_not_be_read_is_told_and_tried_again(spark, dirs):
    write_zip(dirs / "s" / "good.zip", {"one": b"1111"})
    (dirs / "s" / "bad.zip").write_bytes(b"PK not really")
    write_zip(dirs / "s" / "nested.zip", {"in.zip": b"no archive", "two": b"2222"})
    broken = zip_bytes({"a": b"a" * 50, "b": b"b" * 50})
    (dirs / "s" / "crc.zip").write_bytes(broken.replace(b"a" * 50, b"a" * 49 + b"z", 1))
    done = scan.run(spark, config(dirs))
    told = sorted((os.path.basename(r["source_archive"]), r["path_in_archive"]) for r in done.unread.collect())
    assert told == [("bad.zip", ""), ("crc.zip", "a"), ("nested.zip", "in.zip/")]
    with Store(spark, str(dirs / "store")) as kept:
        due = {os.path.basename(r["path"]): r["last_scanned"] is None for r in kept.archives().collect()}
        assert due == {"good.zip": False, "nested.zip": False, "crc.zip": True}
        assert {r["path_in_archive"] for r in kept.files_by_archive(str(dirs / "s" / "crc.zip")).collect()} == {"b"}
    now = (dirs / "s" / "crc.zip").stat().st_mtime_ns
    (dirs / "s" / "crc.zip").write_bytes(broken)  # mended, with its size and time
    os.utime(dirs / "s" / "crc.zip", ns=(now, now))
    done = scan.run(spark, config(dirs))
    assert sorted(os.path.basename(r["source_archive"]) for r in done.unread.collect()) == ["bad.zip", "nested.zip"]
    assert done.counters["archives_read"] == 1 and done.counters["members_read"] == 2
    (dirs / "s" / "bad.zip").unlink()
    assert [os.path.basename(r["source_archive"]) for r in scan.run(spark, config(dirs)).unread.collect()] == ["nested.zip"]


def test_review_of_very_many_copies(spark):
    """1e5 x 1e5 copies of one content: one row, and pages of pairs in order."""
    files = spark.range(100_000).select(F.lit("h").alias("full_hash"), F.lit("z").alias("source_archive"), F.format_string("m%06d", "id").alias("path_in_archive"), F.lit(5).cast("long").alias("size"))
    files = files.unionByName(files.limit(2).withColumn("source_archive", F.lit("y")))
    targets = spark.range(100_000).select(F.format_string("t%06d", "id").alias("path"), F.lit(5).cast("long").alias("size"), F.lit("h").alias("full_hash"))
    stored = spark.createDataFrame([("h", "t000003", False)], "file_hash string, target_path string, selected boolean")
    rows = {r["source_archive"]: r for r in report.review_classes(targets, files, stored).collect()}
    assert (rows["z"]["pairs"], rows["z"]["chosen"], rows["y"]["members"], rows["z"]["first_target"]) == (10**10, 99_999, 2, "t000000")
    page = lambda archive, after, n: report.review_page(targets, files, archive, ("h", 5), after, n)
    assert page("z", None, 3) == [("t000000", f"m{k:06d}") for k in range(3)]
    assert page("z", ("t000000", "m099998"), 3) == [("t000000", "m099999"), ("t000001", "m000000"), ("t000001", "m000001")]
    seen, after = [], None
    for _ in range(4):
        seen += page("y", after, 3)
        after = seen[-1]
    assert seen == [(f"t{k // 2:06d}", f"m{k % 2:06d}") for k in range(12)]
    assert page("z", ("t099999", "m099999"), 3) == [] and page("none", None, 3) == []


def test_progress_rises_while_it_runs(spark, dirs):
    for k in range(40):
        write_zip(dirs / "s" / f"a{k}.zip", {f"m{j}": bytes(200_000) + bytes([k, j]) for j in range(20)})
    (dirs / "t" / "x").write_bytes(b"1")
    told = []
    done = scan.run(spark, config(dirs), told.append, every=0.02)
    unpacking = [t["archives_done"] for t in told if t["phase"] == "unpacking"]
    assert unpacking == sorted(unpacking) and len({n for n in unpacking if 0 < n < 40}) >= 2
    assert told[-1]["archives_done"] == told[-1]["archives_found"] == 40 and told[-1]["members_done"] == 800 and told[-1]["percent"] == 100.0 and told[-1]["targets_done"] == 1
    assert done.counters["members_read"] == 800
    assert scan.run(spark, config(dirs), told.append).counters["members_read"] == 0 and told[-1]["percent"] == 100.0


def test_archives_as_a_stream_equal_a_scan(spark, dirs):
    write_zip(dirs / "elsewhere.zip", {})
    kept, c = Store(spark, str(dirs / "stream")), config(dirs)
    content = {"a.zip": {"1": b"one", "in.zip": zip_bytes({"2": b"two"})}, "b.zip": {}, "c.zip": {"3": b"three" * 500, "4": b"one"}}
    kept.update_targets(spark.createDataFrame([("t1", 1, 3, xxh3(b"one"), None, "x"), ("t2", 1, 9, "none", None, "x")], "path string, mtime_ms long, size long, full_hash string, quick_hash string, config string"))

    def take():
        incremental.store_archives(spark, str(dirs / "s"), kept, c, str(dirs / "cp"), str(dirs / "matches")).awaitTermination()

    for k, (name, members) in enumerate(content.items()):
        write_zip(dirs / "s" / name, members)
        os.utime(dirs / "s" / name, (1000 + k, 1000 + k))
        take()
    (dirs / "s" / "bad.zip").write_bytes(b"PK no")
    take()
    take()  # nothing new
    with Store(spark, str(dirs / "scan")) as other:
        scan.scan_sources(spark, Scan(c.archives_in, c.files_in, str(dirs / "scan"), hashing=c.hashing), other)
        same = lambda store, table, *drop: sorted(map(tuple, store.table(table).drop(*drop).collect()), key=repr)
        assert same(kept, "files") == same(other, "files") and len(same(kept, "files")) == 5
        assert same(kept, "archives", "last_scanned") == same(other, "archives", "last_scanned")
        assert same(kept, "unread") == same(other, "unread") and len(same(kept, "unread")) == 1
    found = lambda: sorted((r["path_in_archive"], r["target_path"]) for r in spark.read.parquet(str(dirs / "matches")).collect())
    assert found() == [("1", "t1"), ("4", "t1")]
    # a rewritten archive comes again and replaces its rows; a replay of its batch changes nothing
    write_zip(dirs / "s" / "a.zip", {"5": b"five"})
    take()
    before = same(kept, "files")
    assert len(before) == 3
    last = max((dirs / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    take()
    assert same(kept, "files") == before and found()[-1] == ("4", "t1")


def xxh3(data):
    import xxhash

    return xxhash.xxh3_64_hexdigest(data)


def test_packed_and_default_hashes_as_queries(spark, tmp_path):
    from twinfold.plans import catalogue

    texts = {k: f"text {k} " * (k % 7 * 60) for k in range(60)}
    spark.createDataFrame([(k, f"src{k % 4}", t) for k, t in texts.items()], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in catalogue.QUERIES["xxh3_fingerprints"](spark, str(tmp_path)).collect():
        data = texts[r["doc_id"]].encode()
        assert r["full_hash"] == xxh3(data) and r["quick_hash"] == (xxh3(data[: catalogue.PREFIX]) if len(data) >= catalogue.THRESHOLD else None)
    names = lambda kind: {(r["source_archive"], r["path_in_archive"], r["full_hash"]) for r in catalogue.QUERIES[kind](spark, str(tmp_path)).collect()}
    assert {tuple(x and x.replace("tar.zst", "zip") for x in r) for r in names("member_unnest_tar_zst")} == names("member_unnest")

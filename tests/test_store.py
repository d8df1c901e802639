import contextlib
import io
import os
import re
import threading

import pytest
from pyspark.sql import functions as F

from twinfold import schema
from twinfold.operators import match, store
from twinfold.operators.store import Change, Manifest, Store

FILES = "full_hash string, quick_hash string, filename string, path_in_archive string, source_archive string, size long, is_nested_archive boolean"


def rows(spark, *some):
    """(archive, member, hash) as rows of files."""
    return spark.createDataFrame([(h, None, m, m, a, 1, False) for a, m, h in some], FILES)


def held(kept):
    return sorted((r["source_archive"], r["path_in_archive"], r["full_hash"]) for r in kept.table("files").collect())


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture
def many(spark):
    return spark.range(1000).select(F.concat(F.lit("h"), "id").alias("full_hash"), F.lit(None).cast("string").alias("quick_hash"), F.lit("f").alias("filename"), F.concat(F.lit("m"), F.col("id") % 5).alias("path_in_archive"), F.concat(F.lit("a"), (F.col("id") / 5).cast("int")).alias("source_archive"), F.col("id").alias("size"), F.lit(False).alias("is_nested_archive"))


def test_merge_on_read_against_a_dictionary(spark, tmp_path, monkeypatch):
    import random

    monkeypatch.setattr(store, "MOST_DELTAS", 3)
    monkeypatch.setattr(store, "ROWS_A_BUCKET", 6)
    r, kept, expected = random.Random(4), Store(spark, str(tmp_path / "st")), {}
    for step in range(9):
        some = {(f"a{r.randrange(4)}", f"m{r.randrange(5)}"): f"h{step}" for _ in range(4)}
        if step % 3 == 2:
            gone = {f"a{r.randrange(4)}", "none"}
            expected = {k: v for k, v in expected.items() if k[0] not in gone}
            some = {k: v for k, v in some.items() if k[0] in gone}
            new = rows(spark, *[(*k, v) for k, v in some.items()])
            kept.replace_files(spark.createDataFrame([(g,) for g in gone], "path string"), new.withColumn("seq", F.lit(1)))
        else:
            kept.add_files(rows(spark, *[(*k, v) for k, v in some.items()]))
        expected |= some
        assert held(kept) == sorted((*k, v) for k, v in expected.items())
        for a in ("a0", "a1", "none"):
            assert [(x["path_in_archive"], x["full_hash"]) for x in kept.files_by_archive(a).collect()] == sorted((k[1], v) for k, v in expected.items() if k[0] == a)
    now = kept.newest("files")
    assert now.buckets > 1 and now.kind in "vd" and len(now.changes) <= 3
    kept.compact("files")
    assert not kept.newest("files").changes and held(kept) == sorted((*k, v) for k, v in expected.items())
    kept.clear()
    assert held(kept) == [] and kept.newest("files").base == {}


def test_lookups_neither_exchange_nor_sort_the_base(spark, tmp_path, many, monkeypatch):
    monkeypatch.setattr(store, "ROWS_A_BUCKET", 100)
    kept = Store(spark, str(tmp_path / "st"))
    kept.add_files(many)
    kept.compact("files")
    kept.add_files(rows(spark, ("a3", "m1", "new")))
    found = kept.by_full_hash("h700")
    text = plan(found)
    assert "PushedFilters: [IsNotNull(full_hash), EqualTo(full_hash,h700)]" in text
    scans = text[: text.index("(1) ")]
    # one broadcast of the changed keys; nothing of the base is exchanged
    assert len(re.findall(r"\bExchange \(", scans)) == 0 and len(re.findall(r"BroadcastExchange \(", scans)) == 1 and "Sort" not in scans
    assert [r["path_in_archive"] for r in found.collect()] == ["m0"]
    assert kept.by_full_hash("h16").count() == 0 and kept.by_full_hash("new").count() == 1
    assert kept.newest("files").buckets == 16
    one = kept.table("files", "a3")
    assert len({os.path.dirname(f) for f in one.inputFiles() if "/base/" in f}) == 1 and one.count() == 5


def test_a_rescan_of_one_archive_writes_its_rows_only(spark, tmp_path, many):
    kept = Store(spark, str(tmp_path / "st"))
    kept.add_files(many)
    kept.compact("files")
    before = kept.newest("files")
    kept.replace_files(spark.createDataFrame([("a7",)], "path string"), rows(spark, ("a7", "x", "h")).withColumn("seq", F.lit(1)))
    now = kept.newest("files")
    assert now.base == before.base and [c.n for c in now.changes] == [2]  # the row, and the archive that it replaces
    assert kept.table("files").count() == 996 and kept.files_by_archive("a7").count() == 1
    # nothing new: nothing written
    kept.replace_files(spark.createDataFrame([], "path string"), rows(spark).withColumn("seq", F.lit(1)))
    kept.backfill_full_hash(spark.createDataFrame([("a8", "m0", "h40")], "source_archive string, path_in_archive string, full_hash string"))
    assert kept.newest("files") == now
    kept.backfill_full_hash(spark.createDataFrame([("a8", "m0", "other"), ("none", "m0", "x"), ("a8", "m1", None)], "source_archive string, path_in_archive string, full_hash string"))
    assert kept.newest("files").changes[-1].n == 1 and kept.by_full_hash("other").count() == 1


def test_only_touched_buckets_are_written_anew(spark, tmp_path, many, monkeypatch):
    monkeypatch.setattr(store, "ROWS_A_BUCKET", 100)
    kept = Store(spark, str(tmp_path / "st"))
    kept.add_files(many)
    kept.compact("files")
    before = kept.newest("files").base
    kept.add_files(rows(spark, ("a3", "m1", "new")))
    kept.compact("files")
    after = kept.newest("files").base
    assert sum(after[b] != before[b] for b in before) == 1 and sum(n for _, n in after.values()) == 1000


def test_two_writers_of_one_number(spark, tmp_path, monkeypatch):
    """Both start from one manifest; the second one's change goes on top of the first one's."""
    one, other = Store(spark, str(tmp_path / "st")), Store(spark, str(tmp_path / "st"))
    real, calls = other._publish, []

    def late(table, manifest):
        if not calls:
            calls.append(manifest.number)
            one.add_files(rows(spark, ("a", "m", "one"), ("a", "n", "one")))
        return real(table, manifest)

    monkeypatch.setattr(other, "_publish", late)
    other.add_files(rows(spark, ("a", "m", "other")))
    assert held(one) == [("a", "m", "other"), ("a", "n", "one")] and one.newest("files").number == 3
    assert not one._publish("files", Manifest(number=3)) and one._publish("files", Manifest(number=4))


def test_writers_at_once_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "st")
    Store(spark, root)

    def write(w):
        kept = Store(spark, root)
        for k in range(4):
            kept.add_files(rows(spark, (f"w{w}", f"m{k}", "h"), ("shared", "m", f"{w}-{k}")))

    threads = [threading.Thread(target=write, args=(w,)) for w in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    kept = Store(spark, root)
    assert kept.table("files").count() == 13 and kept.newest("files").number == 13


def test_a_change_during_compaction_stays(spark, tmp_path, monkeypatch):
    kept, other = Store(spark, str(tmp_path / "st")), Store(spark, str(tmp_path / "st"))
    kept.add_files(rows(spark, ("a", "m", "1"), ("b", "m", "1")))
    real = kept._publish
    monkeypatch.setattr(kept, "_publish", lambda t, m: (monkeypatch.setattr(kept, "_publish", real), other.add_files(rows(spark, ("a", "m", "2"))), real(t, m))[-1])
    kept.compact("files")
    assert held(kept) == [("a", "m", "2"), ("b", "m", "1")] and kept.newest("files").changes[0].n == 1
    # of two compactions of the same changes the later one gives way
    monkeypatch.setattr(kept, "_publish", lambda t, m: (monkeypatch.setattr(kept, "_publish", real), other.compact("files"), real(t, m))[-1])
    kept.compact("files")
    assert held(kept) == [("a", "m", "2"), ("b", "m", "1")] and not kept.newest("files").changes


def test_old_folders_go_and_kept_ones_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "KEPT_VERSIONS", 2)
    kept = Store(spark, str(tmp_path / "st"))
    for k in range(5):
        kept.add_files(rows(spark, ("a", f"m{k}", "h")))
        reader = kept.table("files")
        kept.compact("files")
        assert reader.count() == k + 1  # reads on from the version it started from
    base = tmp_path / "st" / "files" / "base"
    assert len(list(base.iterdir())) == 2 and len(kept._numbers("files")) <= 4


def test_wide_changes_are_folded_in_at_once(spark, tmp_path, many, monkeypatch):
    monkeypatch.setattr(store, "BROADCAST_ROWS", 100)
    kept = Store(spark, str(tmp_path / "st"))
    kept.add_files(many)
    assert not kept.newest("files").changes and kept.table("files").count() == 1000
    # a reader that comes between the change and its compaction broadcasts nothing
    monkeypatch.setattr(Store, "compact", lambda *_: None)
    kept.add_files(many.withColumn("size", F.lit(5).cast("long")))
    assert kept.newest("files").changed_rows() == 1000 and "broadcast" not in kept.table("files")._jdf.queryExecution().analyzed().toString().lower()
    assert kept.table("files").filter("size = 5").count() == 1000


def test_manifest_survives_its_text():
    m = Manifest(7, "d", 4, {0: ("base/x/__bucket=0", 5), 3: ("base/y/__bucket=3", 1)}, (Change("changes/a", None, 2), Change(None, "changes/b", 1)))
    assert Manifest.of(m.text()) == m and m.folders() == {"base/x/__bucket=0", "base/y/__bucket=3", "changes/a", "changes/b"}


def test_tables_have_keys():
    assert set(schema.KEYS) == set(schema.TABLES) and all(set(schema.KEYS[t]) <= set(schema.TABLES[t].names) for t in schema.TABLES)


def test_bitmap_keeps_what_the_join_needs(spark):
    targets = spark.range(300).select(F.col("id").cast("string").alias("path"), F.lit(1).cast("long").alias("size"), F.when(F.col("id") % 10 == 0, F.lit("f")).alias("full_hash"), F.when(F.col("id") % 7 != 0, F.md5(F.col("id").cast("string"))).alias("quick_hash"))
    files = spark.range(200, 20_000).select(F.when(F.col("id") % 3 != 0, F.md5(F.col("id").cast("string"))).alias("quick_hash"), F.col("id").alias("other column"))
    thin = match.prefiltered(files, "quick_hash", targets.select("quick_hash"))
    shared = {k for k in range(200, 300) if k % 3 and k % 7}
    assert thin.columns == files.columns and shared <= {r["other column"] for r in thin.collect()} and thin.count() < 4000
    assert "Exchange hashpartitioning(quick_hash" not in plan(thin.select("quick_hash"))
    paths = lambda df: sorted(r["path"] for r in df.collect())
    assert paths(match.quick_candidates_prefiltered(targets, files)) == paths(match.quick_candidates(targets, files)) != []
    assert match.quick_candidates_prefiltered(targets.limit(0), files).count() == 0 and match.quick_candidates_prefiltered(targets, files.limit(0)).count() == 0
    assert match.prefiltered(files, "quick_hash", targets.select("quick_hash"), most_keys=5).count() == files.count()

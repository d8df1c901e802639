import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from twinfold.llm import mixing, sharding
from twinfold.llm.queries import QUERIES


def drawn(doc_id, rate, seed=mixing.SEED):
    u = int(hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u and k < 500:
        k += 1
        p *= rate / k
        total += p
    return k


def test_mix_against_brute_force(spark, docs, corpus, tables):
    found = Counter((r["doc_id"], r["copy_no"]) for r in QUERIES["op2_mixing"](spark, tables(documents=docs)).collect())
    size = Counter()
    for r in corpus:
        size[r[3]] += len((r[1] or "").encode())
    weight = {s: n**mixing.TEMPERATURE for s, n in size.items()}
    rate = {s: weight[s] / sum(weight.values()) * sum(size.values()) / size[s] for s in size}
    expected = Counter((r[0], k + 1) for r in corpus for k in range(drawn(r[0], rate[r[3]])))
    assert found == expected


def test_mix_meets_target_weights(spark):
    rows = [(k, "x" * 100, "big" if k % 10 else "small") for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n = Counter(r["source"] for r in mixing.mix(df, weights={"big": 1.0, "small": 1.0, "absent": 9.0}, size=2.0).select("source").collect())
    assert n["big"] == pytest.approx(6000, rel=0.05) and n["small"] == pytest.approx(6000, rel=0.08)
    assert mixing.mix(df, weights={"big": 1.0}).filter("source = 'small'").count() == 0


def test_mix_by_salted_join_is_the_same(spark, docs, monkeypatch):
    rows = lambda: Counter((r["doc_id"], r["copy_no"], r["mix_key"]) for r in mixing.mix(docs).collect())
    broadcast = rows()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert rows() == broadcast


def test_poisson_inverse(spark):
    us = [0.0, 0.1, 0.5, 0.9, 0.999999]
    for rate in (0.0, 0.3, 1.0, 7.5, 900.0):
        got = spark.createDataFrame([(u,) for u in us], "u double").select(mixing.poisson(F.lit(rate), F.col("u")).alias("k")).collect()
        ks = [r["k"] for r in got]
        assert ks == sorted(ks) and (rate or not any(ks))
        if rate == 900.0:
            assert abs(ks[2] - 900) <= 2
        elif rate:
            p, total, k = math.exp(-rate), 0.0, 0
            for u, found in zip(us, ks, strict=True):
                while total + p <= u:
                    total += p
                    k += 1
                    p *= rate / k
                assert found == k


def test_mix_edges(spark, docs, empty):
    assert mixing.mix(empty).count() == 0
    clash = docs.withColumn("__rate", F.lit(1)).withColumn("copy_no", F.lit("x")).withColumn("rate", F.lit(0))
    assert mixing.mix(clash).columns == [c for c in clash.columns if c != "copy_no"] + ["copy_no", "mix_key"]
    blank = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert mixing.mix(blank).count() == drawn(1, 1.0) + drawn(2, 1.0)
    again = spark.createDataFrame([(5, "t", "s")] * 3, "doc_id long, text string, source string")
    assert mixing.mix(again, size=3.0).count() == 3 * drawn(5, 3.0)


def test_rows_without_ids_draw_by_their_texts(spark):
    df = spark.createDataFrame([(None, f"text {k % 1000:04d}", "s") for k in range(2000)], "doc_id long, text string, source string")
    n = Counter(r["text"] for r in mixing.mix(df).select("text").collect())
    assert sum(n.values()) == pytest.approx(2000, rel=0.1) and all(v % 2 == 0 for v in n.values())
    assert 0.3 < 1 - len(n) / 1000 < 0.45  # exp(-1) of the texts are drawn no time


def law(rows, shards=8):
    """rows: (doc_id, text). The shard and slot of each place in the order of text hash and id."""
    order = sorted(rows, key=lambda r: (hashlib.md5((r[1] or "").encode()).hexdigest(), -(2**63) if r[0] is None else r[0]))
    total, before, slots, out = sum(len((t or "").encode()) + 1 for _, t in rows), 0, Counter(), []
    for i, t in order:
        s = min(shards * before // total, shards - 1)
        out.append((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), s, slots[s]))
        slots[s] += 1
        before += len((t or "").encode()) + 1
    return sorted(out, key=str)


def test_shards_against_brute_force(spark, docs, corpus, tables):
    found = QUERIES["op4_sharding"](spark, tables(documents=docs)).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in found), key=str) == law([(r[0], r[1]) for r in corpus])
    assert {r["law"] for r in found} == {"bytes"} and {r["grown_shard"] for r in found} == {None}


def test_overfull_ranges_are_split(spark, monkeypatch):
    monkeypatch.setattr(sharding, "DRAWN", 1)
    monkeypatch.setattr(sharding, "LEAST_RANGES", 2)
    rows = [(k, "the same text" if k % 3 else f"text {k}" * (k % 50)) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keys = df.select(sharding.key_of(F.col("text"), F.col("doc_id")).alias("key"), sharding.size_of(F.col("text")).alias("size"))
    splitters, sizes = sharding.ranges_of(keys, 4, 1 << 30)
    total = sum(s[0] for s in sizes.values())
    assert sum(s[1] for s in sizes.values()) == 3000 and max(s[0] for s in sizes.values()) <= 3 * total / 8
    found = sharding.shard(df, shards=4).collect()
    assert sorted(((r["doc_id"], r["shard"], r["slot"]) for r in found), key=str) == sorted(((i, s, n) for i, _, _, s, n in law(rows, 4)), key=str)


def test_ids_of_any_type(spark):
    rows = [("a", "one"), ("12", "one"), (None, "one"), ("b", "two"), ("a", "one")]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id string, text string"), shards=2).collect()
    assert len(found) == 5 and sorted((r["shard"], r["slot"]) for r in found) in ([(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)], [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)])
    assert sharding.shard(spark.createDataFrame([(1.5, "x"), (2.5, "y")], "doc_id double, text string"), shards=2).count() == 2


def test_shard_edges(spark, docs, empty, tmp_path):
    assert sharding.shard(empty).count() == 0 and sharding.shard(empty).columns[-2:] == ["shard", "slot"]
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [(r["shard"], r["slot"]) for r in sharding.shard(one).collect()] == [(0, 0)]
    same = spark.createDataFrame([(None, None)] * 20 + [(7, "x" * 500)], "doc_id long, text string")
    rows = sharding.shard(same, shards=3).collect()
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    clash = docs.withColumn("__key", F.lit(1)).withColumn("shard", F.lit("x")).withColumn("range", F.lit(0))
    assert sharding.shard(clash).columns == [c for c in clash.columns if c != "shard"] + ["shard", "slot"]
    sharding.write(docs, str(tmp_path / "out"), shards=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()

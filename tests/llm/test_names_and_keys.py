"""Names that clash on both sides of each bound, and keys that must tell different things apart."""

import pytest
from pyspark.sql import functions as F

from twinfold.llm import line_dedup, mixing, setsketch, sharding, suffix_dedup, url_filter

CLASHES = ("row", "row_", "row_a", "row_b", "row_n", "seen", "salt", "salt_", "salt_of", "rate", "count", "source", "host", "upper", "rule", "whose", "key", "key_of", "whole", "starts")


def clashing(df):
    return df.select("*", *[F.concat(F.lit(x), F.monotonically_increasing_id()).alias(f"__{x}") for x in CLASHES])


def others(df, key):
    return sorted((tuple(r[c] for c in (key, *(f"__{x}" for x in CLASHES))) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, "a shared line of words\n" * (k % 3) + f"own text {k}", f"s{k % 20}") for k in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").cache()


@pytest.mark.parametrize("bound", [4096, -1])
def test_line_dedup(pages, monkeypatch, bound):
    monkeypatch.setattr(line_dedup, "LITERAL_LINES", bound)
    df = clashing(pages).cache()
    left = line_dedup.dedup(df)
    assert left.columns == df.columns and others(left, "doc_id") == others(df, "doc_id")
    assert left.filter("text like '%shared%'").count() == 0 and df.filter("text like '%shared%'").count() == 40


@pytest.mark.parametrize("bound", [20_000, -1])
def test_mixing(pages, monkeypatch, bound):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", bound)
    df = clashing(pages).cache()
    mixed = mixing.mix(df)
    assert mixed.columns == [*df.columns, "copy_no", "mix_key"]
    assert set(others(mixed, "doc_id")) <= set(others(df, "doc_id")) and mixed.count()


@pytest.mark.parametrize("bound", [50_000, -1])
def test_url_filter(spark, monkeypatch, bound):
    monkeypatch.setattr(url_filter, "BROADCAST_HOSTS", bound)
    df = clashing(spark.createDataFrame([(k, f"http://{h}.site.net/{k}") for k in range(6) for h in ("bad", "good")], "page_id long, url string")).cache()
    outcomes = spark.createDataFrame([("http://bad.site.net/", 0)] * 40 + [("http://good.site.net/", 1)] * 40, "url string, good int")
    judged = url_filter.judge(df, outcomes)
    assert judged.columns == [*df.columns, "host", "path", "rule", "verdict"] and others(judged, "page_id") == others(df, "page_id")
    assert {r["host"]: r["verdict"] for r in judged.collect()} == {"bad.site.net": "block", "good.site.net": "allow"}


def test_suffix_dedup(pages):
    df = clashing(pages).cache()
    seen = suffix_dedup.annotate(df, "seen", length=20)
    assert seen.columns == [*df.columns, "seen"] and others(seen, "doc_id") == others(df, "doc_id")


def test_ports_users_and_addresses(spark):
    hosts = {
        "a.shop.com:8080": ("a.shop.com", "com", "shop.com"), "me:pw@b.shop.com": ("b.shop.com", "com", "shop.com"), "u@c.shop.co.uk:1": ("c.shop.co.uk", "co.uk", "shop.co.uk"), "10.0.0.1": ("10.0.0.1", "10.0.0.1", "10.0.0.1"),
        "10.0.0.1:80": ("10.0.0.1", "10.0.0.1", "10.0.0.1"), "[::1]:80": ("[::1]", "[::1]", "[::1]"), "shop.com.": ("shop.com", "com", "shop.com"), "co.uk": ("co.uk", "co.uk", "co.uk"), "": ("", "", ""), ".": (".", "", "."), "me.github.io": ("me.github.io", "github.io", "me.github.io"),
    }
    df = spark.createDataFrame([(h,) for h in hosts], "h string").withColumn("r", url_filter.reputation_host(F.col("h")))
    df = df.withColumn("s", url_filter.suffix_of(F.col("r"))).withColumn("d", url_filter.domain_of(F.col("r"), F.col("s")))
    assert {r["h"]: (r["r"], r["s"], r["d"]) for r in df.collect() if r["h"] != "."} == {h: x for h, x in hosts.items() if h != "."}
    # ports share a reputation, strangers with the same port do not; the column host keeps what the url says
    outcomes = spark.createDataFrame([("http://bad.com:8080/", 0)] * 40 + [("http://good.com:8080/", 1)] * 40, "url string, good int")
    seen = spark.createDataFrame([("http://bad.com:81/",), ("http://good.com:8080/",), ("http://x@bad.com/",)], "url string")
    assert {r["host"]: r["verdict"] for r in url_filter.judge(seen, outcomes).collect()} == {"bad.com:81": "block", "good.com:8080": "allow", "x@bad.com": "block"}


def test_ids_that_cast_alike_have_keys_of_their_own(spark):
    ids = ["1", "01", "+1", " 1", "1.2", "1.7", "x", None, ""]
    keys = spark.createDataFrame([(i,) for i in ids], "i string").select(sharding.key_of(F.lit("text"), F.col("i")).alias("k")).collect()
    assert len({r["k"] for r in keys}) == len(ids) and max(len(r["k"]) for r in keys) <= int(sharding.KEY[1:])
    doubles = spark.createDataFrame([(1.2,), (1.7,)], "i double").select(sharding.key_of(F.lit("text"), F.col("i")).alias("k")).collect()
    assert doubles[0]["k"] != doubles[1]["k"]
    numbers = spark.createDataFrame([(i,) for i in (-5, 3, 20, 100)], "i long").select("i", sharding.key_of(F.lit("text"), F.col("i")).alias("k")).orderBy("k").collect()
    assert [r["i"] for r in numbers] == [-5, 3, 20, 100]


def test_words_of_hostile_structure_have_hashes_of_their_own():
    word = "a"
    while len(word) < 1 << 13:
        word += word.translate({97: 98, 98: 97})
        other = word.translate({97: 98, 98: 97})
        pair = setsketch.word_hashes(f"{word} {other}".encode())
        assert pair[0] != pair[1] and setsketch.word_hashes(word.encode())[0] == pair[0]
    words = [f"w{k}" for k in range(100_000)] + ["".join(chr(97 + (k >> b & 1)) for b in range(14)) for k in range(1 << 14)]
    assert len(set(setsketch.word_hashes(" ".join(words).encode()).tolist())) == len(words)

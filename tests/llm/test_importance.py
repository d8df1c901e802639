import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from twinfold.llm import importance
from twinfold.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def brute(corpus, target, least=20, percent=25):
    """rows (doc_id, text) -> sorted (doc_id, n_features, weight, score, rank)."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for _, x in corpus:
        s.update(map(bucket, features(x)[1]))
    for x in target:
        t.update(map(bucket, features(x)[1]))
    a, b = float(s.total() + 10000), float(t.total() + 10000)
    gain = lambda k: math.floor(1000 * math.log((float(t[k]) + 1) * a / ((float(s[k]) + 1) * b)))
    rows = []
    for i, x in corpus:
        n, f = features(x)
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.fixture
def target(spark):
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 4))) for _ in range(60)) for _ in range(20)] + [None, "", "One ONE one"]
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item_id long, text string")


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_against_brute_force(spark, docs, corpus, target, tables):
    rows = QUERIES["op13_importance"](spark, tables(documents=docs, benchmark=target))
    assert found(rows.select("doc_id", "n_features", "weight", "score", "rank")) == brute([(r[0], r[1]) for r in corpus], [r["text"] for r in target.collect()])


@pytest.mark.parametrize(("chunk_bytes", "chunk_words"), [(0, 1), (0, 2), (100, 7), (1 << 30, 5)])
def test_chunks_lose_and_double_nothing(spark, docs, corpus, target, chunk_bytes, chunk_words):
    rows = importance.weigh(docs, target, chunk_bytes=chunk_bytes, chunk_words=chunk_words).select("doc_id", "n_features", "weight", "score", "rank")
    assert found(rows) == brute([(r[0], r[1]) for r in corpus], [r["text"] for r in target.collect()])


def test_features_of_longer_runs():
    words = [b"a", b"b", b"c", b"d"]
    whole = Counter(importance.features(words, 4, 3, 1 << 20).tolist())
    assert whole == Counter(zlib.crc32(x) % (1 << 20) for x in (b"a", b"b", b"c", b"d", b"a b", b"b c", b"c d", b"a b c", b"b c d"))
    parts = Counter()
    for chunk, own in importance.chunks_of(words, 2, 3):
        parts.update(importance.features(chunk.split(), own, 3, 1 << 20).tolist())
    assert parts == whole


def test_repeated_rows_null_ids_and_other_columns(spark, target):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(5, text, 1, "x"), (5, text, 1, "x"), (None, text, 2, None), (None, text, 3, "z"), (7, None, None, "q"), (8, "", 0, None), (9, text + " more", 4, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int, `a.b c` string")
    kept = importance.weigh(df, target, percent=60, keep=["doc_id", "a.b c", "score"])
    assert kept.columns == ["doc_id", "a.b c", "n_words", "n_features", "weight", "score", "rank"]
    expected = brute([(r[0], r[1]) for r in rows], [r["text"] for r in target.collect()], percent=60)
    assert found(kept.select("doc_id", "n_features", "weight", "score", "rank")) == expected
    drawn = importance.draw(df, target, percent=60)
    assert drawn.columns == df.columns and drawn.count() == 3
    assert importance.draw(df, target, percent=100).count() == 5
    assert importance.draw(df, target, percent=0).count() == 0


def test_empty_tables(spark, docs, corpus, empty, target):
    assert importance.weigh(empty, target).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert found(importance.weigh(docs, none).drop("n_words")) == brute([(r[0], r[1]) for r in corpus], [])


def test_one_row_of_very_many_words_is_dealt_out(spark, target):
    df = spark.createDataFrame([(1, " ".join(str(k) for k in range(50_000))), (2, "short text")], "doc_id long, text string")
    scratch = importance.Scratch(spark, "test")
    chunked = importance.Chunked(df, "text", scratch, 2, 1000, 1000)
    assert chunked.chunks.count() == 50 and chunked.short.count() == 1
    assert importance.tally(chunked.pieces(), 2, 10_000).agg({"n": "sum"}).first()[0] == 99_999 + 3

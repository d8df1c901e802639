import hashlib
import random
from collections import Counter

import pytest

from twinfold.llm import suffix_batches, suffix_dedup
from twinfold.llm.frames import Scratch
from twinfold.llm.queries import QUERIES


def brute(texts, length=400):
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    data = [(t or "").encode() for t in texts]
    count = Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def made(seed, n, length):
    """Texts that share passages of about the length, with other surroundings, copies and edits."""
    r = random.Random(seed)
    rand = lambda k: "".join(r.choice("abcdefghijklmnop é") for _ in range(k))
    passages = [rand(r.choice([length - 1, length, length + 1, 3 * length])) for _ in range(6)]
    texts = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.2 and texts:
            texts.append(r.choice(texts))
        elif kind < 0.4 and texts:
            t = list(r.choice(texts))
            for _ in range(min(len(t), r.randint(1, 3))):
                t[r.randrange(len(t))] = "#"
            texts.append("".join(t))
        else:
            texts.append("".join(rand(r.randint(0, length)) + r.choice(passages)[r.randint(0, 2) :] for _ in range(r.randint(0, 3))))
    return [*texts, "", None, "a" * (4 * length), "ab" * length, "x" * length, "y" * (length + 1), rand(length - 1)]


@pytest.mark.parametrize(("seed", "length"), [(1, 40), (2, 64), (3, 17)])
def test_against_brute_force(spark, seed, length):
    texts = made(seed, 60, length)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = {r["doc_id"]: r["seen"] for r in suffix_dedup.annotate(df, "seen", length=length).collect()}
    expected = brute(texts, length)
    assert [(rows[k]["n_bytes"], rows[k]["n_removed"], rows[k]["n_spans"], bytes(rows[k]["kept"])) for k in range(len(texts))] == expected
    assert sum(e[1] for e in expected) and any(e[2] > 1 for e in expected)


def test_query_against_brute_force(spark, tables):
    texts = made(4, 40, 400)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = sorted(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in QUERIES["op12_suffix_dedup"](spark, tables(documents=df)).collect())
    assert got == [(k, n, gone, spans, hashlib.sha256(kept).hexdigest()) for k, (n, gone, spans, kept) in enumerate(brute(texts))]


def test_any_number_of_batches_is_the_same(spark):
    texts = made(6, 40, 40)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    expected = [e[3] for e in brute(texts, 40)]
    for batches in (1, 3, 8):
        rows = {r["doc_id"]: bytes(r["seen"]["kept"]) for r in suffix_dedup.annotate(df, "seen", length=40, batches=batches).collect()}
        assert [rows[k] for k in range(len(texts))] == expected


def test_levels_merge_geometrically(spark):
    family = suffix_dedup.Family(Scratch(spark, "test"))
    sizes = []
    for k in range(6):
        family.add(spark.createDataFrame([(k, 10 * k, 1, 1), (k, 7, k, 1)], suffix_batches.SUFFIXES))
        sizes.append([n for n, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2]]
    assert {(r["head"], r["stretch"]) for r in family.repeated().collect()} == {(7, k) for k in range(6)}


def test_blocks_of_a_long_text(spark, monkeypatch):
    r = random.Random(9)
    base = "".join(r.choice("abcdefgh") for _ in range(5000))
    texts = [base, "zz" + base[100:3000], base[:2000] + "q" + base[2000:]]
    expected = [e[:3] for e in brute(texts, 40)]
    monkeypatch.setattr(suffix_batches, "BLOCK", 300)
    data = [t.encode() for t in texts]
    assert [[s for s in suffix_batches.stretches(b, 40)] for b in data][0][-1][1] == len(data[0]) - 40
    starts = [{p for p in range(len(b) - 39) if sum(c.count(b[p : p + 40]) for c in data) > 1} for b in data]
    for b, s, e in zip(data, starts, expected, strict=True):
        parts = [{"stretch": suffix_batches.stretch(b, first, last, 40), "low": place - p, "high": place - p} for first, last, place in suffix_batches.stretches(b, 40) for p in range(first, last + 1) if p in s]
        spans = suffix_batches.spans(b, None, parts, 40)
        assert (len(b), sum(y - x for x, y in spans), len(spans)) == e
        covered = [p for first, last, _ in suffix_batches.stretches(b, 40) for p in range(first, last + 1)]
        assert covered == list(range(len(b) - 39))


def test_groups_hold_their_windows():
    r = random.Random(8)
    text = bytes(r.choice(b"abcd") for _ in range(2000))
    for first, last, place in suffix_batches.stretches(text, 400):
        seen = []
        for core, hull, low, high in suffix_batches.groups_of(text, first, last, place, 400):
            g = low // suffix_batches.GROUP
            assert g == high // suffix_batches.GROUP
            inside = text[place - g * 16 : place - (g + 1) * 16 + 401]
            assert len(inside) == 385 and core == suffix_batches._signed(suffix_batches.xxhash.xxh3_64_intdigest(inside, g))
            assert hull == suffix_batches.xxhash.xxh3_128_digest(text[place - high : place - low + 400], high)
            assert all(inside in text[place - o : place - o + 400] for o in range(low, high + 1))
            seen += range(low, high + 1)
        assert sorted(place - o for o in seen) == list(range(first, last + 1))


def test_equal_windows_have_equal_places():
    r = random.Random(2)
    window = bytes(r.choice(b"abcd") for _ in range(400))
    found = set()
    for _ in range(20):
        before = bytes(r.choice(b"abcd") for _ in range(r.randint(0, 300)))
        text = before + window + bytes(r.choice(b"abcd") for _ in range(r.randint(0, 300)))
        found |= {place - len(before) for first, last, place in suffix_batches.stretches(text, 400) if first <= len(before) <= last}
    assert len(found) == 1


def test_columns_pass_and_texts_are_cut(spark, empty):
    passage = "é" * 30 + "the same passage in two texts, word by word"
    rows = [(1, "A " + passage + " end", "k"), (2, "Bé" + passage, "m"), (3, None, None), (4, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `key` string")
    kept = suffix_dedup.dedup(df, length=40)
    assert kept.columns == df.columns
    got = {r["doc_id"]: (r["text"], r["key"]) for r in kept.collect()}
    assert got == {1: ("A  end", "k"), 2: ("Bé", "m"), 3: (None, None), 4: ("", "x")} or got[1][0] == "A  end"
    assert suffix_dedup.annotate(empty, "seen").count() == 0 and suffix_dedup.dedup(empty).columns == empty.columns

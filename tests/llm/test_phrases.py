import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from twinfold.llm import phrase_batches, phrases
from twinfold.llm.queries import QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}


def pieces(text):
    for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield re.findall(r"[^\x20\x09]+", p)


def brute(rows, least=100, top=2000):
    """rows (lang, text) -> {(lang, rank): (phrase, a, l, r, n, score)}."""
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for d in range(1, 6):
                f[lang].update(tuple(w[s : s + d]) for s in range(len(w) - d + 1))
    out = {}
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        told = []
        for p, a in often.items():
            if any(len(q) > len(p) and c >= a and any(q[s : s + len(p)] == p for s in range(len(q) - len(p) + 1)) for q, c in often.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            told.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(told)[:top], 1):
            out[lang, rank] = (phrase.decode(), -a, left, right, n[lang], -score)
    return out


def found(df):
    return {(r["lang"], r["rank"]): tuple(r[c] for c in ("phrase", "a", "l", "r", "n", "score")) for r in df.collect()}


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    fixed = ["new york city", "in spite of that", "a b a b a", "à la carte", "Once upon a time there was"]
    rows = []
    for k in range(500):
        words = [r.choice(fixed) if r.random() < 0.3 else "".join(r.choice("abc") for _ in range(r.randint(1, 3))) for _ in range(r.randint(0, 60))]
        seps = [r.choice([" ", " ", " ", "\t", ". ", ",", "\n", "\r\n", "; "]) for _ in words]
        rows.append((r.choice(["en", "en", "de", None]), "".join(a + b for a, b in zip(words, seps, strict=True)) + ("" if k % 7 else " x" * 50)))
    return [*rows, ("en", None), (None, ""), ("fr", " .,\t"), ("en", "a " * 2000), ("und", "left out " * 120)]


def test_query_against_brute_force(spark, texts, tables):
    df = spark.createDataFrame(texts, "lang string, text string").repartition(7)
    got = found(QUERIES["op11_phrases"](spark, tables(documents=df)))
    assert got == brute(texts) and {lang for lang, _ in got} == {"en", "de", "und"}


def test_tiny_bounds_change_nothing(spark, texts, monkeypatch):
    df = spark.createDataFrame(texts, "lang string, text string").repartition(3)
    expected = brute(texts, least=10, top=50)
    assert found(phrases.collocations(df, least=10, top=50)) == expected
    # a table of 2 ** 15 bits at most, in which bits of many paths fall together
    assert found(phrases.collocations(df, least=10, top=50, filter_bits=15)) == expected


def test_tasks_hand_on_what_grows(monkeypatch):
    monkeypatch.setattr(phrase_batches, "MOST_HELD", 10)
    monkeypatch.setattr(phrase_batches, "MOST_SORTED", 50)
    r = random.Random(1)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(30)) for _ in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array(["x"] * 10), pa.array([t.encode() for t in texts[k : k + 10]])], ["lang", "text"]) for k in range(0, 40, 10)]
    words, paths = Counter(), Counter()
    for b in phrase_batches.count_words(iter(batches)):
        for row in b.to_pylist():
            words[row["word"]] += row["n"]
    assert words == Counter(w for t in texts for w in t.split())
    full = np.full(1 << 12, 255, np.uint8)
    for b in phrase_batches.count_paths(3, lambda: full, 0)(iter(batches)):
        for row in b.to_pylist():
            paths[row["w1"], row["w2"], row["w3"]] += row["n"]
    number = {w: phrase_batches.word_id("x", w.encode(), 0) for w in words}
    assert paths == Counter(tuple(number[w] for w in t.split()[s : s + 3]) for t in texts for s in range(28))


def test_words_that_share_a_number_are_numbered_anew(spark):
    def clashing(words, langs, seed):
        return phrase_batches.ids(words, langs, seed) if seed else pa.array([1] * len(words), pa.int64())

    scratch = phrases.Scratch(spark, "test")
    words = spark.createDataFrame([("en", "a", 200), ("en", "b", 5)], "lang string, word string, n long")
    kept, seed = phrases.numbered(words, 100, scratch, clashing)
    assert seed == 1 and [r["word"] for r in kept.collect()] == ["a"]


def test_products_beyond_64_bits(spark):
    a, n, left, right = 10**15, 9 * 10**16, 10**15, 2 * 10**15
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    score = row.selectExpr("(cast(1000 as decimal(4, 0)) * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0))) div (cast(l as decimal(17, 0)) * cast(r as decimal(17, 0))) AS s").first()["s"]
    assert score == 1000 * a * n // (left * right)


def test_empty_table_and_no_phrases(spark, empty):
    assert phrases.collocations(empty).count() == 0
    few = spark.createDataFrame([("en", "one two three", 1), ("en", None, 2)], "lang string, text string, path int")
    assert phrases.collocations(few).count() == 0

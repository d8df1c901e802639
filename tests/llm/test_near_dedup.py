import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfold.llm import near_dedup, setsketch
from twinfold.llm.components import components, extended
from twinfold.llm.frames import Scratch
from twinfold.llm.queries import QUERIES


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3)))


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_against_brute_force(docs, corpus, tables, spark):
    found = got(QUERIES["op1_near_dedup"](spark, tables(documents=docs)))
    assert found == brute([(r[0], r[1]) for r in corpus])
    assert any(v[1] != k for k, v in found.items())


def test_cloud_of_copies_around_a_base_that_are_no_copies_of_each_other(spark, monkeypatch):
    """Copies are linked to the base only; hubs must find it."""
    monkeypatch.setattr(near_dedup, "PAIRS_PER_ENTRY", 0.05)
    r = np.random.default_rng(4)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(60):
        words = list(base)
        for at in r.choice(100, 9, replace=False) * 4:  # 36 of 397 shingles differ: 0.83 to the base, about 0.7 to others
            words[at] = f"x{k}_{at}"
        rows.append((k + 1, " ".join(words)))
    rows.append((1000, " ".join(base)))
    found = got(near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == brute(rows)
    assert {v[1] for v in found.values()} == {1}


def test_dedup_keeps_one_of_each_class_and_other_columns(docs, corpus):
    left = near_dedup.dedup(docs.withColumn("kept", F.lit("mine")).withColumn("node", F.lit(1)))
    expected = {i for i, v in brute([(r[0], r[1]) for r in corpus]).items() if v[2]}
    rows = left.collect()
    assert {r["doc_id"] for r in rows} == expected and len(rows) == len(expected)
    assert left.columns == [*docs.columns, "kept", "node"] and {r["kept"] for r in rows} == {"mine"}


def test_repeated_rows_null_ids_and_empty_tables(spark, empty):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "alone of its kind here"), (3, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.classes(df).collect()), key=str)
    assert found == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 2, None, True), (3, 0, 3, True), (3, 0, 3, True)], key=str)
    assert sorted((r["doc_id"] for r in near_dedup.dedup(df).collect()), key=str) == [1, 3, None]
    assert near_dedup.classes(empty).count() == 0 and near_dedup.dedup(empty).columns == empty.columns


def test_rows_with_one_id_are_judged_by_their_texts(spark):
    rows = [(7, "one text of id seven here"), (7, "quite another text of that id"), (3, "Quite another text of THAT id"), (8, "one text of id seven here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__seal", F.lit(1)).withColumn("__like", F.lit("x"))
    left = near_dedup.dedup(df)
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == [(3, rows[2][1]), (7, rows[0][1])]
    assert left.columns == df.columns


@pytest.mark.parametrize("chain", [False, True])
def test_one_bucket_of_thousands_takes_few_rounds(spark, chain):
    """Every pair whose sizes allow a link meets once, unless links join its nodes already."""
    r = np.random.default_rng(12)
    n = 2500
    sizes = np.exp(r.uniform(np.log(20), np.log(20_000), n)).astype(int)
    nodes = [int(k).to_bytes(16, "big") for k in range(n)]
    entries = spark.createDataFrame([(1, a, int(s), 0, n) for a, s in zip(nodes, sizes, strict=True)], "bucket long, node binary, n long, own long, size long")
    search, seen = near_dedup.Search(spark.createDataFrame([], "id long, text string")), []
    linked = lambda a, b: chain and a // 50 == b // 50

    def confirmed(pairs):
        found = [(int.from_bytes(x["a"], "big"), int.from_bytes(x["b"], "big")) for x in pairs.collect()]
        seen.extend(tuple(sorted(p)) for p in found)
        return spark.createDataFrame([(nodes[a], nodes[b]) for a, b in found if linked(a, b)], "a binary, b binary")

    search.confirmed = confirmed
    search.nodes = entries.select("node", *[F.lit(0).cast("long").alias(p) for p in near_dedup._ODD])
    roots = {int.from_bytes(x["node"], "big"): int.from_bytes(x["root"], "big") for x in search.links(entries).collect()}
    assert search.rounds <= 5 and len(seen) == len(set(seen))
    low, high = np.minimum.outer(sizes, sizes), np.maximum.outer(sizes, sizes)
    fits = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu((100 * low >= 80 * high) & (9 * low >= 4 * (low + high)), 1)), strict=True)}
    assert set(seen) <= fits
    if not chain:
        assert set(seen) == fits and not roots
        return
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in fits:
        if linked(a, b):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert {k: roots.get(k, k) for k in range(n)} == {k: find(k) for k in range(n)}
    assert all(find(a) == find(b) for a, b in fits - set(seen))


@pytest.mark.parametrize("few", [True, False])
def test_components_grow(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr("twinfold.llm.components.BROADCAST_EDGES", -1)
    r = np.random.default_rng(2)
    edges = [tuple(map(int, e)) for e in r.integers(0, 250, (160, 2)) if e[0] != e[1]] + [(k, k + 1) for k in range(200, 240)]
    frame = lambda some: spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in some], "a binary, b binary")
    scratch = Scratch(spark, "t")
    roots = extended(components(frame(edges[:90]), scratch), frame(edges[90:]), scratch)
    least = list(range(250))
    for _ in range(250):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    found = {x["node"][0]: x["root"][0] for x in roots.collect()}
    assert {k: found.get(k, k) for k in range(250)} == dict(enumerate(least)) and all(k != v for k, v in found.items())


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (20, 10), (20, 11), (20, 12)]
    df = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in edges], "a binary, b binary")
    found = {r["node"][0]: r["root"][0] for r in components(df, Scratch(spark, "t")).collect()}
    assert found == {5: 1, 4: 1, 3: 1, 2: 1, 9: 8, 20: 10, 11: 10, 12: 10}


@pytest.mark.parametrize("j", [0.2, 0.5, 0.8, 0.95])
def test_registers_estimate_similarity(j):
    r = np.random.default_rng(7)
    same, n = [], 600
    for _ in range(12):
        shared = int(2 * n * j / (1 + j))
        pool = r.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[n - shared : 2 * n - shared])
        same.append((setsketch.sketch(a) == setsketch.sketch(b)).mean())
    assert abs(np.mean(same) - j) < 0.04


def test_texts_together_are_as_alone(monkeypatch):
    r = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 50, n)).encode() for n in [0, 1, 2, 3, 4, 5, 40, 400, 3, 0, 9000, 12, 0, 70_000, 1]] + [b" \n ", b"", b"A\nb", b"a b"]
    for piece, part in ((1 << 16, 1 << 14), (512, 64)):
        monkeypatch.setattr(setsketch, "PIECE", piece)
        monkeypatch.setattr(setsketch, "SLICE", part)
        sets = setsketch.shingles_of(texts)
        assert all((a == setsketch.shingles(t)).all() and len(a) == len(setsketch.shingles(t)) for a, t in zip(sets, texts, strict=True))
        assert [len(x) for x in sets] == [len(shingles(t.decode())) for t in texts]
        together = setsketch.sketches(sets)
        assert all((together[k] == setsketch.sketch(x)).mean() > 0.99 for k, x in enumerate(sets))


def test_sketches_merge_and_do_not_depend_on_order():
    r = np.random.default_rng(8)
    a, b = (np.unique(r.integers(0, 1 << 63, n).astype(np.uint64)) for n in (5, 900))
    union = setsketch.sketch(np.unique(np.concatenate([a, b])))
    assert (union == np.maximum(setsketch.sketch(a), setsketch.sketch(b))).all()
    assert (setsketch.sketch(b[::-1].copy()) == setsketch.sketch(b)).all()


def test_likelihood_drops_unlike_pairs_and_keeps_like_ones():
    r = np.random.default_rng(9)
    like, unlike = [], []
    for target, into in ((0.8, like), (0.3, unlike)):
        for _ in range(30):
            n = 300
            shared = int(np.ceil(2 * n * target / (1 + target)))
            pool = r.integers(0, 1 << 63, 2 * n).astype(np.uint64)
            into.append((n, n, setsketch.sketch(pool[:n]), setsketch.sketch(pool[n - shared : 2 * n - shared])))
    judge = lambda pairs: setsketch.candidates(*(np.array([p[k] for p in pairs], float) for k in (0, 1)), *(np.stack([p[k] for p in pairs]) for k in (2, 3)))
    assert judge(like).all() and not judge(unlike).any()


def test_words_that_are_longer_than_a_piece(monkeypatch):
    text = b"short " + b"L" * 3000 + b" words\tand " * 300
    whole = setsketch.word_hashes(text)
    for piece in (64, 100, 1000):
        monkeypatch.setattr(setsketch, "PIECE", piece)
        cut = setsketch.word_hashes(text)
        assert len(cut) == len(whole) == len(text.split())
        assert (np.delete(cut, 1) == np.delete(whole, 1)).all()

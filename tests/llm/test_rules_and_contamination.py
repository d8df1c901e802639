import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfold.llm import decontaminate, quality_rules
from twinfold.llm.queries import QUERIES
from twinfold.llm.wu_manber import Items, WordSearch


def rule_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    seen, covered, lines, repeated = Counter(grams), set(), set(), 0
    for k, g in enumerate(grams):
        if seen[g] > 1:
            covered.update(range(k, k + 5))
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in lines
            lines.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_rules_against_brute_force(spark, docs, corpus, tables):
    found = QUERIES["op3_quality_rules"](spark, tables(documents=docs)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert {r["doc_id"]: tuple(r[k] for k in names) for r in found} == {r[0]: rule_counts(r[1]) for r in corpus}
    assert not any(r["kept"] for r in found if r["base_failed"])


def test_rules_keep_prose_and_drop_noise(spark):
    prose = ["this is a sentence of plain words number %d which says something about itself and ends soon" % k for k in range(60)]
    noise = ["*** ### $$$ %%% &&& ||| <<< >>> *** ### $$$ {} ???".format(k) for k in range(20)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(prose + noise)], "doc_id long, text string")
    kept = {r["doc_id"]: r["seen"]["kept"] for r in quality_rules.judge(df, "seen").collect()}
    assert all(kept[k] for k in range(60)) and not any(kept[k] for k in range(60, 80))


def test_few_distinct_words_at_any_length(spark):
    import random

    r = random.Random(3)
    small = [" ".join(f"w{r.randrange(20)}" for _ in range(n)) for n in (5000, 5001, 40_000)]
    # a quarter of the words distinct is few in 6,000 words, not in 40,000
    large = [" ".join(f"w{k % (n // 4)}" for k in range(n)) for n in (6000, 40_000)]
    df = quality_rules.statistics(spark.createDataFrame(list(enumerate(small + large)), "doc_id long, text string"), "s")
    rows = df.select("doc_id", quality_rules.votes(F.col("s"))["distinct_words"].alias("vote")).orderBy("doc_id").collect()
    assert [x["vote"] for x in rows] == [-1, -1, -1, 0, 1]


def test_rules_edges(spark, docs, empty):
    assert quality_rules.judge(empty, "seen").count() == 0
    clash = docs.withColumn("__words", F.lit("mine")).withColumn("__stats", F.lit(1)).withColumn("symbols", F.lit(2))
    out = quality_rules.judge(clash, "seen")
    assert out.columns == [*clash.columns, "seen"] and out.count() == docs.count()


def test_accuracies_are_estimated():
    import random

    r = random.Random(1)
    patterns = Counter()
    for _ in range(4000):
        truth = 1 if r.random() < 0.8 else -1
        patterns[tuple(truth if r.random() < a else -truth for a in (0.95, 0.8, 0.7, 0.9))] += 1
    share, likely = quality_rules.estimate(sorted(patterns.items()), 4)
    assert share == pytest.approx(0.8, abs=0.05)
    assert quality_rules.accuracies(share, likely) == pytest.approx([0.95, 0.8, 0.7, 0.9], abs=0.06)
    assert quality_rules.estimate([], 0) == (0.5, [])


@pytest.mark.parametrize("times", [1, 100, 10_000])
def test_verdicts_do_not_depend_on_the_size_of_the_corpus(times):
    clean, noise = (1, 0, 1, 1, 1, 0, 0, 1), (-1, 0, 1, 1, 1, 0, 0, 1)
    for n in (1, 20, 60, 120):
        share, likely = quality_rules.estimate([(noise, n * times), (clean, 60 * times)], 8)
        assert quality_rules.log_odds(noise, share, likely) < 0 < quality_rules.log_odds(clean, share, likely)


def em_by_documents(ballots):
    """The posterior of each document, by maximisation over documents instead of patterns and with arrays of votes."""
    votes = np.array(ballots)
    against, voted = votes == -1, votes != 0
    p = np.where(against.any(axis=1), 0.05, 0.95)
    for _ in range(40):
        pi = min(max((p.mean() + 0.05 * 0.9) / 1.05, 0.02), 0.98)
        odds = np.full(len(votes), np.log(pi / (1 - pi)))
        for j in range(votes.shape[1]):
            bad_vote = [(against[:, j] * w).mean() + 1e-4 for w in (p, 1 - p)]
            good_vote = [((votes[:, j] == 1) * p).mean() + 0.05, ((votes[:, j] == 1) * (1 - p)).mean() + 1e-4]
            g, b = (bad_vote[c] / (bad_vote[c] + good_vote[c]) for c in (0, 1))
            if g < b:
                odds += np.where(~voted[:, j], 0, np.where(against[:, j], np.log(g / b), np.log((1 - g) / (1 - b))))
        p = 1 / (1 + np.exp(-odds))
    return p


def test_posterior_and_verdict_against_brute_force(spark, docs, corpus, tables):
    rows = quality_rules.judge(docs, "seen").select("doc_id", "seen.*").collect()
    names = list(rows[0]["votes"].asDict())
    expected = em_by_documents([[r["votes"][k] for k in names] for r in rows])
    assert [r["posterior"] for r in rows] == pytest.approx(list(expected), abs=1e-9)
    found = {r["doc_id"]: (r["posterior"], r["kept"]) for r in QUERIES["op3_quality_rules"](spark, tables(documents=docs)).collect()}
    failed = {r[0]: rule_counts(r[1])[-1] for r in corpus}
    assert found == {r["doc_id"]: (pytest.approx(p, abs=1e-6), bool(p >= 0.5 and not failed[r["doc_id"]])) for r, p in zip(rows, expected, strict=True)}


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def contamination(text, items):
    words, hit, owners = item_words(text), set(), set()
    for item_id, item in items:
        own = item_words(item)
        n = min(13, len(own))
        for k in range(len(own) - n + 1) if own else ():
            for at in range(len(words) - n + 1):
                if words[at : at + n] == own[k : k + n]:
                    hit.update(range(at, at + n))
                    owners.add(str(item_id))
    return len(words), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.fixture(scope="module")
def items():
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"
    return [(1, long), (2, "Short item, of FIVE words"), (10, long.replace("alpha", "omega")), (4, None), (5, " ,.!"), (6, "one"), (7, "naïve ÀÉ")]


def test_contamination_against_brute_force(spark, corpus, items, tables):
    long = items[0][1]
    texts = [r[1] for r in corpus if len(r[1] or "") < 5000] + [long, long.upper() + "!", "x " * 200 + long, "x " * 600 + long, f"{long} {long}", " ".join(long.split()[:12]), "so a short; item of five words it is", long.replace(" ", "\n-- ")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sf = tables(documents=df, benchmark=spark.createDataFrame(items, "item_id long, text string"))
    found = QUERIES["op6_decontaminate"](spark, sf).collect()
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    expected = {k: contamination(t, items) for k, t in enumerate(texts)}
    assert {r["doc_id"]: tuple(r[k] for k in names) for r in found} == expected
    assert sum(e[4] for e in expected.values()) > 3


def test_blocks_of_items_agree_with_one(spark, corpus, items):
    df = spark.createDataFrame([(r[0], r[1]) for r in corpus[:40]] + [(999, items[0][1])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda **o: sorted(tuple(r["seen"]) + (r["doc_id"],) for r in decontaminate.annotate(df, bench, "seen", **o).collect())
    assert rows() == rows(block_bytes=1)


def test_a_large_benchmark_in_passes(spark):
    """Each pass has its own tables; what the passes find together is what one finds."""
    import random

    r = random.Random(6)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [(f"i{k}", " ".join(r.choices(vocabulary, k=r.choice([5, 13, 200])))) for k in range(400)]
    texts = [" ".join(r.choices(vocabulary, k=300)) + " " + r.choice(items)[1] + " " + " ".join(r.choices(vocabulary, k=20_000 if k == 0 else 30)) for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    seen = lambda **o: {x["doc_id"]: tuple(x["seen"]) for x in decontaminate.annotate(df, bench, "seen", **o).collect()}
    some = {k: contamination(t, items)[:4] for k, t in enumerate(texts) if k in (0, 7, 21)}
    found = seen()
    assert found == seen(block_bytes=60_000) and {k: found[k] for k in some} == some


def test_tables_of_a_benchmark_are_compact():
    import pickle
    import random

    r = random.Random(7)
    items = [(k, [b"w%d" % r.randrange(20_000) for _ in range(200)]) for k in range(1000)]
    size = sum(len(w) + 1 for _, words in items for w in words)
    assert len(pickle.dumps(Items(items, 13))) < 10 * size


def test_contamination_edges(spark, docs, empty, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    clash = docs.withColumn("__report", F.lit(1)).withColumn("n_hit", F.lit("x")).withColumn("__hits", F.lit(0))
    assert decontaminate.decontaminate(clash, bench).columns == clash.columns
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_search_jumps_but_misses_nothing():
    import random

    r = random.Random(2)
    for _ in range(300):
        words = [r.choice("abc") for _ in range(60)]
        patterns = {tuple(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(4)}
        marks, found = WordSearch([(p, frozenset([p])) for p in patterns], block=2).hits(words)
        places = {(p, k) for p in patterns for k in range(61 - len(p)) if tuple(words[k : k + len(p)]) == p}
        assert found == {p for p, _ in places}
        assert {k for k, m in enumerate(marks) if m} == {x for p, k in places for x in range(k, k + len(p))}

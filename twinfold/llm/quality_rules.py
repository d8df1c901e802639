"""Quality rules as weak supervision, in DataFrame expressions only.

Each rule votes for a text (1), against it (-1) or abstains (0). The votes of all documents are counted by pattern; on
these counts (at most 3 to the number of rules, whatever the corpus) expectation-maximisation with priors estimates each
rule's accuracy on good and on bad texts and the share of good ones, without labels. The posterior probability of being
good, compiled into one column expression, replaces all-must-pass filtering.

Edge cases: a null text counts as empty; without words every rule abstains, and the posterior is the estimated share.
Other columns pass through. Repeated rows are judged one by one. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.llm.frames import Scratch, col, free_name

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: Words from which the share of distinct ones is measured against a text's length.
LONG_TEXT = 5000
ROUNDS = 40
#: Weight of the priors, in sizes of the corpus; and of votes that were never seen on a class, so that they are possible.
FAITH, RARE = 0.05, 1e-4
#: The prior's share of good texts.
GOOD = 0.9
SHARE = (0.02, 0.98)


def let(value: Column, body) -> Column:
    """body(value), with the value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def windows_of_five(h: Column) -> Column:
    """A hash of each run of five entries: of pairs, of two pairs, and of those with the fifth."""
    n = F.size(h)
    join = lambda x, y: F.xxhash64(x, y)
    pairs = F.zip_with(h, F.slice(h, 2, n), join)
    fives = lambda fours: F.zip_with(fours, F.slice(h, 5, n), join)
    # zip_with pads with nulls, so that the entries beyond the last whole run are cut off
    return let(pairs, lambda p: F.slice(fives(F.zip_with(p, F.slice(p, 3, n), join)), 1, n - 4))


def covered_words(h: Column) -> Column:
    """How many words, given by their 64-bit hashes, lie in windows of five that occur twice or more in the array.

    Windows are compared by hash too. Sorting (hash, position) brings equal ones together, so it takes n log n steps.
    """

    def starts(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda p, k, x: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
        return F.sort_array(let(placed, lambda p: F.transform(F.filter(p, lambda x, k: same(p, k - 1, x) | same(p, k + 1, x)), lambda x: x["i"])))

    def cover(windows: Column) -> Column:
        nothing = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(F.aggregate(starts(windows), nothing, step, lambda a: a["n"]))

    return F.when(F.size(h) < WINDOW, F.lit(0)).otherwise(let(windows_of_five(h), cover)).cast("long")


def statistics(docs: DataFrame, into: str, text_col: str = "text") -> DataFrame:
    """The documents with a struct column of whole-text statistics (all long)."""
    words, text = free_name(docs, "words"), F.coalesce(col(text_col).cast("string"), F.lit(""))
    hashes = free_name(docs, "hashes")
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w, h = col(words), col(hashes)
    return (
        docs.withColumn(words, F.array_remove(F.split(text, SPACE), ""))
        .withColumn(hashes, F.transform(w, lambda x: F.xxhash64(x)))
        .withColumn(
            into,
            F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                (F.length(text) - left(r"[#*$%&|<>]+")).cast("long").alias("n_symbols"),
                let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                covered_words(h).alias("n_repeat_words"),
                let(lines, F.size).cast("long").alias("n_lines"),
                F.size(F.array_distinct(h)).cast("long").alias("n_distinct_words"),
                (F.length(text) - left(r"[A-Z]+")).cast("long").alias("n_capitals"),
                (F.length(text) - left(r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+")).cast("long").alias("n_marks"),
                (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
            ),
        )
        .drop(words, hashes)
    )


def votes(s: Column) -> dict[str, Column]:
    """Rule name to vote. A rule abstains between its two bounds, and where it has too little to judge by."""
    n = s["n_words"]

    def rule(share: Column, good: float, bad: float, when: Column = F.lit(True)) -> Column:
        return F.when(~when | (n == 0), 0).when(share <= good, 1).when(share >= bad, -1).otherwise(0)

    per_word = lambda name: s[name] / F.greatest(n, F.lit(1))
    length = per_word("word_chars")
    # longer texts have fewer distinct words for their length, about as the square root of it
    distinct = per_word("n_distinct_words") * F.sqrt(F.greatest(n, F.lit(LONG_TEXT)) / F.lit(LONG_TEXT))
    return {
        "symbols": rule(per_word("n_symbols"), 0.05, 0.2),
        "marks": rule(per_word("n_marks"), 0.3, 0.45, n >= 20),
        "capitals": rule(s["n_capitals"] / F.greatest(s["word_chars"], F.lit(1)), 0.15, 0.4),
        "shouts": rule(per_word("n_shouts"), 0.1, 0.5),
        "repeated_words": rule(per_word("n_repeat_words"), 0.1, 0.3),
        "repeated_lines": rule(s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1)), 0.2, 0.5, s["n_lines"] >= 3),
        "distinct_words": rule(1 - distinct, 0.5, 0.75, n >= 20),
        "word_length": F.when(n == 0, 0).when((length >= 2.5) & (length <= 10), 1).when((length < 1.5) | (length > 20), -1).otherwise(0),
    }


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def estimate(patterns: list[tuple[tuple[int, ...], int]], width: int, rounds: int = ROUNDS) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Share of good texts, and for each rule how likely each vote is on a good and on a bad text, where it votes at all.

    The maximum a posteriori, by expectation-maximisation over vote patterns and their counts; rules are taken as
    independent given the truth, and whether a rule abstains as independent of it. The priors are shares of the corpus, so
    that only the mix of patterns counts and not how many texts there are: for each rule, FAITH more good texts to which it
    did not object and a few of each other kind, and for the share, FAITH more texts of which GOOD are good. So a rule that objects
    alone is believed unless other rules, which object together elsewhere, speak against it. A rule that comes out no
    better than chance has no say. It starts from distrust of texts that some rule objects to.
    """
    belief = [0.05 if -1 in pattern else 0.95 for pattern, _ in patterns]
    share, likely = 0.5, [{v: (1.0, 1.0) for v in (-1, 0, 1)} for _ in range(width)]
    total = sum(count for _, count in patterns)
    for _ in range(rounds if total else 0):
        good = sum(count * p for (_, count), p in zip(patterns, belief, strict=True)) / total
        share = min(max((good + FAITH * GOOD) / (1 + FAITH), SHARE[0]), SHARE[1])
        for j in range(width):
            seen = {-1: [RARE, RARE], 1: [FAITH, RARE]}
            for (pattern, count), p in zip(patterns, belief, strict=True):
                if pattern[j]:
                    seen[pattern[j]][0] += count / total * p
                    seen[pattern[j]][1] += count / total * (1 - p)
            on_good, on_bad = (seen[-1][c] / (seen[-1][c] + seen[1][c]) for c in (0, 1))
            likely[j] = {-1: (on_good, on_bad), 0: (1.0, 1.0), 1: (1 - on_good, 1 - on_bad)} if on_good < on_bad else {v: (0.5, 0.5) for v in (-1, 0, 1)}
        belief = [1 / (1 + math.exp(-min(max(log_odds(pattern, share, likely), -700), 700))) for pattern, _ in patterns]
    return share, likely


def log_odds(pattern: tuple[int, ...], share: float, likely: list[dict[int, tuple[float, float]]]) -> float:
    return math.log(share / (1 - share)) + sum(math.log(table[v][0] / table[v][1]) for v, table in zip(pattern, likely, strict=True))


def accuracies(share: float, likely: list[dict[int, tuple[float, float]]]) -> list[float]:
    """How often each rule is right when it votes."""
    return [(share * t[1][0] + (1 - share) * t[-1][1]) / (share * (t[1][0] + t[-1][0]) + (1 - share) * (t[1][1] + t[-1][1])) for t in likely]


def posterior(vote_columns: list[Column], share: float, likely: list[dict[int, tuple[float, float]]]) -> Column:
    """The probability of being good, as one expression."""
    weight = lambda t, v: F.lit(math.log(t[v][0] / t[v][1]))
    weighed = [F.when(c == 1, weight(t, 1)).when(c == -1, weight(t, -1)).otherwise(weight(t, 0)) for c, t in zip(vote_columns, likely, strict=True)]
    odds = reduce(lambda a, b: a + b, weighed, F.lit(math.log(share / (1 - share))))
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, into: str, *, text_col: str = "text", keep: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """The columns ``keep`` (all by default) with a struct column ``into``: statistics, votes, posterior, base_failed, kept.

    The texts are read once: statistics and votes are written beside the kept columns before the rules are weighed.
    """
    stats = free_name(docs, "stats")
    with_stats = statistics(docs, stats, text_col)
    ballots = free_name(with_stats, "votes")
    cast = votes(col(stats))
    names = list(cast)
    seen = Scratch(docs.sparkSession, "quality-rules").save(
        with_stats.select(*[col(c) for c in (docs.columns if keep is None else keep)], col(stats), F.struct(*[cast[k].cast("int").alias(k) for k in names]).alias(ballots))
    )
    counted = seen.groupBy(*[col(ballots)[k].alias(k) for k in names]).count().collect()  # at most 3 ** 8 rows
    share, likely = estimate(sorted((tuple(r[k] for k in names), r["count"]) for r in counted), len(names))
    p, s = posterior([col(ballots)[k] for k in names], share, likely), col(stats)
    return seen.withColumn(into, F.struct(s.alias("statistics"), col(ballots).alias("votes"), p.alias("posterior"), base_failed(s).alias("base_failed"), (~base_failed(s) & (p >= least)).alias("kept"))).drop(stats, ballots)

"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees are grown on bootstraps of a bounded sample of labelled rows; every path from a root is a conjunctive rule. A
logistic model with a lasso penalty weighs the rules and most weights become zero. The rest are compiled into one Spark
column expression over the statistics, so that scoring needs no model file and no Python beyond the counting of
characters and words.

Only the statistics enter a score: neither labels nor id, language or source. Texts are counted whole.

Edge cases: a null or empty text has zero statistics and a score like any other. Labels that are null or not 0 or 1 are
not learnt from; of several labels of one id the largest counts. With labels of one class only, every score
is 0.999 or 0.001, and 0.5 without labels. Repeated rows are scored one by one. Other columns pass through.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.llm.batches import texts_of
from twinfold.llm.frames import col, free_name, small_batches

#: Labelled rows that are learnt from at most.
SAMPLE = 8_000
#: Labels of ids with crc32(id as text) mod FOLDS = 0 are held out.
FOLDS = 5
TREES, DEPTH, BINS, LEAST_LEAF = 40, 3, 32, 20
LASSO = 0.002
STEPS = 400
SEED = 5
LEAST_SCORE = 0.3

STATISTICS = ("log_words", "bytes_per_word", "symbols_per_word", "shouts_per_word", "marks_per_word", "capital_share", "digit_share", "distinct_share", "adjacent_share", "top_word_share", "repeated_line_share", "words_per_line")

_CAPITAL, _DIGIT, _SYMBOL, _SHOUT, _MARK, _SPACE, _OTHER = range(7)


def _class_of(c: int) -> int:
    if c in b"#*$%&|<>":
        return _SYMBOL
    if c in b"!?":
        return _SHOUT
    if c in b" \t\n\r\x0b\x0c":
        return _SPACE
    if 65 <= c <= 90:
        return _CAPITAL
    if 48 <= c <= 57:
        return _DIGIT
    return _OTHER if 97 <= c <= 122 or c > 127 else _MARK


_CLASSES = bytes(map(_class_of, range(256)))


def statistics_of(text: bytes) -> tuple[float, ...]:
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    seen = np.bincount(np.frombuffer(text.translate(_CLASSES), np.uint8), minlength=7)
    letters = max(1, len(text) - int(seen[_SPACE]))
    counts = Counter(words)
    return (
        math.log(n),
        letters / n,
        seen[_SYMBOL] / n,
        seen[_SHOUT] / n,
        seen[_MARK] / n,
        seen[_CAPITAL] / letters,
        seen[_DIGIT] / letters,
        len(counts) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        max(counts.values()) / n,
        1 - len(set(lines)) / len(lines),
        n / len(lines),
    )


def statistics(text: Column) -> Column:
    """A struct of the statistics of a text column."""

    def count(texts: pa.Array) -> pa.Array:
        rows = np.array([statistics_of(x) for x in texts_of(texts)], dtype=np.float64).reshape(-1, len(STATISTICS))
        return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(STATISTICS))], list(STATISTICS))

    return F.arrow_udf(count, "struct<" + ", ".join(f"{x}:double" for x in STATISTICS) + ">")(text.cast("string"))


#: A rule is a set of (statistic, is above, bound).
Rule = frozenset


def paths_of_tree(x: np.ndarray, y: np.ndarray, bounds: list[np.ndarray], draw: np.random.Generator) -> list[Rule]:
    """The rules of a tree of depth DEPTH, each node splitting by the best of half of the statistics."""
    found: list[Rule] = []

    def grow(rows: np.ndarray, path: Rule, depth: int) -> None:
        if path:
            found.append(path)
        good = y[rows].sum()
        if depth == DEPTH or not 0 < good < len(rows) or len(rows) < 2 * LEAST_LEAF:
            return
        best = None
        for k in draw.choice(x.shape[1], size=x.shape[1] // 2, replace=False):
            place = np.searchsorted(bounds[k], x[rows, k], side="left")  # rows above bound j have a place over j
            n = np.bincount(place, minlength=len(bounds[k]) + 1).cumsum()[:-1]
            p = np.bincount(place, weights=y[rows], minlength=len(bounds[k]) + 1).cumsum()[:-1]
            m, q = len(rows) - n, good - p
            fit = (n >= LEAST_LEAF) & (m >= LEAST_LEAF)
            if fit.any():
                gini = np.where(fit, p * (n - p) / np.maximum(n, 1) + q * (m - q) / np.maximum(m, 1), np.inf)
                j = int(gini.argmin())
                if best is None or gini[j] < best[0]:
                    best = gini[j], int(k), float(bounds[k][j])
        if best is not None:
            _, k, bound = best
            above = x[rows, k] > bound
            for side in (False, True):
                grow(rows[above == side], path | {(k, side, bound)}, depth + 1)

    grow(np.arange(len(y)), Rule(), 0)
    return found


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, k] > bound) == above for k, above, bound in rule])


def lasso_logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient; the intercept bears no penalty."""
    n, width = z.shape
    w = v = np.zeros(width + 1)
    z1 = np.column_stack([np.ones(n), z])
    step, t = 4 * n / max(np.linalg.norm(z1, 2) ** 2, 1e-9), 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z1 @ v, -30, 30)))
        moved = v - step * (z1.T @ (p - y)) / n
        moved[1:] = np.sign(moved[1:]) * np.maximum(np.abs(moved[1:]) - step * LASSO, 0)
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        w, v = moved, moved + (before - 1) / t * (moved - w)
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self, s: Column) -> Column:
        """The compiled ensemble over a struct of statistics: a probability."""
        met = lambda rule: reduce(lambda a, b: a & b, [s[STATISTICS[k]] > F.lit(bound) if above else s[STATISTICS[k]] <= F.lit(bound) for k, above, bound in sorted(rule)])
        odds = reduce(lambda a, b: a + b, [F.when(met(rule), F.lit(weight)).otherwise(F.lit(0.0)) for rule, weight in self.rules], F.lit(self.intercept))
        return 1 / (1 + F.exp(-odds))

    def score_rows(self, x: np.ndarray) -> np.ndarray:
        odds = self.intercept + sum(weight * holds(rule, x) for rule, weight in self.rules)
        return 1 / (1 + np.exp(-np.broadcast_to(odds, len(x))))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    if not len(y):
        return Model(0.0)
    good = float(y.mean())
    if not 0 < good < 1:
        return Model(math.log(999.0) if good else -math.log(999.0))
    draw = np.random.default_rng(SEED)
    bounds = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        rows = draw.integers(0, len(y), len(y))
        rules |= dict.fromkeys(paths_of_tree(x[rows], y[rows], bounds, draw))
    kept = list(rules)
    if not kept:
        return Model(math.log(good / (1 - good)))
    intercept, weights = lasso_logistic(np.column_stack([holds(r, x) for r in kept]).astype(np.float64), y)
    return Model(intercept, [(r, float(w)) for r, w in zip(kept, weights, strict=True) if abs(w) > 1e-6])


def held_out(record_id: Column) -> Column:
    return F.coalesce(F.crc32(record_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, *, text_col: str, id_col: str, label_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most SAMPLE documents, chosen by a hash of their ids."""
    label = labels.select(col(id_col).alias("id"), col(label_col).cast("double").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0.0, 1.0) & ~held_out(F.col("id")))
    # only labels of documents that are there count, so that others take no place in the sample
    there = docs.select(col(id_col).alias("id")).join(label, "id").groupBy("id").agg(F.max("y").alias("y"))
    chosen = there.orderBy(F.xxhash64(F.lit("sample"), "id"), "id").limit(SAMPLE)
    texts = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    joined = texts.join(F.broadcast(chosen), "id").select("id", "y", statistics(F.col("text")).alias("s"))
    rows = joined.groupBy("id").agg(F.first("y").alias("y"), F.min("s").alias("s")).select("id", "y", "s.*").orderBy("id").collect()
    return np.array([[r[k] for k in STATISTICS] for r in rows], np.float64).reshape(-1, len(STATISTICS)), np.array([r["y"] for r in rows], np.float64)


def train(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality") -> Model:
    small_batches(docs.sparkSession)
    return fit(*labelled_sample(docs, labels, text_col=text_col, id_col=id_col, label_col=label_col))


def score(docs: DataFrame, model: Model, into: str, *, text_col: str = "text") -> DataFrame:
    """The documents with a column ``into``: the probability of good quality."""
    small_batches(docs.sparkSession)
    stats = free_name(docs, "statistics")
    return docs.withColumn(stats, statistics(col(text_col))).withColumn(into, model.score(col(stats))).drop(stats)


def keep_good(docs: DataFrame, model: Model, *, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The documents that score ``least`` or more, with their own columns."""
    into = free_name(docs, "score")
    return score(docs, model, into, text_col=text_col).filter(col(into) >= least).drop(into)

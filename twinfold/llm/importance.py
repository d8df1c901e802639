"""Importance resampling to a target distribution, by hashed n-gram features.

Features are the runs of 1 to ``n`` consecutive words, each hashed into one of ``buckets``. A bucket's gain is the log ratio
of its smoothed shares in the target and in the corpus; a document weighs the mean gain of its features, and of the
documents with ``least_words`` words a share is drawn without replacement by weight plus Gumbel noise that is hashed from
the id, so that a rerun, or a lost executor, draws the same.

Long texts are what skews tasks: a text of more than ``chunk_bytes`` bytes is split at word boundaries into chunks of
``chunk_words`` words, each followed by the n - 1 words after it. A chunk owns the features that start in its own words,
so that none is lost or counted twice. Chunks are dealt out over all tasks, and counts and weights are summed by document.
Other texts are one chunk each and stay where they are read. What is gathered is one number a bucket from each task.

Edge cases: a null or empty text has no features, weight 0, and is never drawn if ``least_words`` is over 0. Rows that
repeat, or have one id, are judged one by one; among equal scores the smaller id comes first, null ids last, rows with one
id in no given order. An empty corpus gives an empty table; an empty target has no counts, only the smoothing.
Input columns named like a result (n_words, n_features, weight, score, rank) are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.llm.batches import texts_of
from twinfold.llm.contamination import words_of
from twinfold.llm.frames import Scratch, col, free_name, small_batches

N, BUCKETS, SEED, LEAST_WORDS, PERCENT = 2, 10_000, 7, 20, 25
CHUNK_BYTES, CHUNK_WORDS = 64 << 10, 8192
#: Documents below this many words are not drawn; gains and noise are in thousandths.
SCALE = 1000.0
RESULTS = ("n_words", "n_features", "weight", "score", "rank")
_MEASURED = "struct<n_words:bigint, n_features:bigint, gain:bigint>"


def chunks_of(words: list[bytes], size: int, n: int) -> Iterator[tuple[bytes, int]]:
    """(words, number of its own) of each chunk of ``size`` words; up to n - 1 words of the next follow them."""
    for start in range(0, len(words), size):
        yield b" ".join(words[start : start + size + n - 1]), min(size, len(words) - start)


def features(words: list[bytes], own: int, n: int, buckets: int) -> np.ndarray:
    """Buckets of the runs of 1 to n words that start in the first ``own`` words."""
    codes = list(map(crc32, words))
    found = codes[:own]
    for longer in range(1, n):
        codes = list(map(crc32, words[longer:], map(crc32, repeat(b" "), codes)))
        found += codes[:own]
    return np.array(found, np.int64) % buckets


def _cut(n: int, size: int):
    def cut(texts: pa.Array) -> pa.Array:
        rows = [[{"words": w, "own": k} for w, k in chunks_of(words_of(t), size, n)] for t in texts_of(texts)]
        return pa.array(rows, pa.list_(pa.struct([("words", pa.binary()), ("own", pa.int32())])))

    return cut


def _rows(texts: pa.Array, own: pa.Array) -> Iterator[tuple[list[bytes], int]]:
    for text, k in zip(texts_of(texts), own.to_pylist(), strict=True):
        words = words_of(text)
        yield words, len(words) if k is None else k


def tally(chunks: DataFrame, n: int, buckets: int) -> DataFrame:
    """bucket, n: features of all chunks (words, own); a task gives one row a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for words, own in _rows(batch.column(0), batch.column(1)):
                total += np.bincount(features(words, own, n, buckets), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    return chunks.select("words", "own").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def _measure(gains: np.ndarray, n: int):
    def measure(texts: pa.Array, own: pa.Array) -> pa.Array:
        rows = []
        for words, k in _rows(texts, own):
            found = features(words, k, n, len(gains))
            rows.append((k, len(found), int(gains[found].sum())))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["n_words", "n_features", "gain"])

    return measure


class Chunked:
    """A table's texts as chunks: short texts where they are, those of long texts dealt out."""

    def __init__(self, docs: DataFrame, text_col: str, scratch: Scratch, n: int, chunk_bytes: int, chunk_words: int):
        self.text, self.row, self.n = col(text_col).cast("string"), free_name(docs, "row"), n
        size = F.coalesce(F.octet_length(self.text), F.lit(0))
        self.short = docs.filter(size <= chunk_bytes)
        # written, so that the numbers of the rows stand
        self.long = scratch.save(docs.filter(size > chunk_bytes).withColumn(self.row, F.monotonically_increasing_id()))
        chunks = self.long.select(col(self.row).alias("row"), F.explode(F.arrow_udf(_cut(n, chunk_words), "array<struct<words:binary, own:int>>")(self.text)).alias("chunk"))
        self.chunks = scratch.save(chunks.select("row", "chunk.*").repartition(F.col("row"), F.xxhash64("words")))

    def pieces(self) -> DataFrame:
        return self.short.select(self.text.cast("binary").alias("words"), F.lit(None).cast("int").alias("own")).unionByName(self.chunks.select("words", "own"))

    def measured(self, gains: np.ndarray, into: str) -> DataFrame:
        """The rows with the struct ``into``: n_words, n_features, gain."""
        measure = F.arrow_udf(_measure(gains, self.n), _MEASURED)
        short = self.short.withColumn(into, measure(self.text.cast("binary"), F.lit(None).cast("int")))
        found = self.chunks.select("row", measure(F.col("words"), F.col("own")).alias("m"))
        sums = found.groupBy("row").agg(F.struct(*[F.sum(f"m.{k}").alias(k) for k in ("n_words", "n_features", "gain")]).alias("sums"))
        none = F.struct(*[F.lit(0).cast("long").alias(k) for k in ("n_words", "n_features", "gain")])  # texts without a word have no chunk
        long = self.long.join(sums.withColumnRenamed("row", free_name(self.long, "sum_row")), col(self.row) == col(free_name(self.long, "sum_row")), "left")
        return short.unionByName(long.select(*[col(c) for c in short.columns if c != into], F.coalesce("sums", none).alias(into)))


def gains_of(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket. There are as many rows as buckets."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, held in ((corpus, s), (target, t)):
        for r in counts.collect():
            held[r["bucket"]] = r["n"]
    whole_s, whole_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(SCALE * math.log((float(b) + 1) * whole_s / ((float(a) + 1) * whole_t))) for a, b in zip(s, t, strict=True)], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-SCALE) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weigh(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", keep: list[str] | None = None, n: int = N, buckets: int = BUCKETS, seed: int = SEED,
          least_words: int = LEAST_WORDS, percent: int = PERCENT, chunk_bytes: int = CHUNK_BYTES, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """The columns ``keep`` (the id alone, unless told) of every document with n_words, n_features, weight, score and rank.

    Drawn are floor(percent N / 100) of the N documents with least_words words; the others have a null rank.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "importance")
    keep = [c for c in ([id_col] if keep is None else keep) if c not in RESULTS]
    docs = docs.select(*[col(c) for c in dict.fromkeys([*keep, id_col, text_col])])
    corpus, wanted = (Chunked(x, name, scratch, n, chunk_bytes, chunk_words) for x, name in ((docs, text_col), (target.select(col(target_text_col)), target_text_col)))
    gains = gains_of(tally(corpus.pieces(), n, buckets), tally(wanted.pieces(), n, buckets), buckets)

    m, key, row = (free_name(docs, x) for x in ("measured", "id", "line"))
    sums = corpus.measured(gains, m)
    n_features, gain = col(m)["n_features"], col(m)["gain"]
    # a mean rounded down, in whole numbers
    weight = F.when(n_features > 0, F.expr(f"(`{m}`.gain - pmod(`{m}`.gain, `{m}`.n_features)) div `{m}`.n_features")).otherwise(F.lit(0)).cast("long")
    slim = sums.select(*[col(c) for c in keep], col(id_col).alias(key), col(m)["n_words"].alias("n_words"), n_features.alias("n_features"), weight.alias("weight"))
    scored = scratch.save(slim.withColumn("score", F.col("weight") + noise(col(key), seed)).withColumn(row, F.monotonically_increasing_id()))
    return ranked(scored, key, row, least_words, percent, scratch).select(*[col(c) for c in keep], *[F.col(c) for c in RESULTS])


def ranked(scored: DataFrame, key: str, row: str, least_words: int, percent: int, scratch: Scratch) -> DataFrame:
    """With a column rank. Scores are whole numbers of a narrow span, so that counts by score say which can be drawn."""
    spark, fit = scored.sparkSession, F.col("n_words") >= least_words
    by_score = {r["score"]: r["n"] for r in scored.filter(fit).groupBy("score").agg(F.count("*").alias("n")).collect()}
    wanted, lowest, above = percent * sum(by_score.values()) // 100, None, 0
    for score in sorted(by_score, reverse=True):
        if above >= wanted:
            break
        lowest, above = score, above + by_score[score]
    nothing = F.lit(None).cast("long")
    if lowest is None:
        return scored.withColumn("rank", nothing)
    near = fit & (F.col("score") >= lowest)
    order = [F.col("score").desc(), col(key).asc_nulls_last(), col(row).asc()]
    part, place, before = (free_name(scored, x) for x in ("part", "place", "before"))
    # ranges of the order, written so that their bounds stand; a place is that in the range and the rows of the ranges before
    ordered = scratch.save(scored.filter(near).repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    counts = sorted((r[part], r["n"]) for r in ordered.groupBy(part).agg(F.count("*").alias("n")).collect())
    starts = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, accumulate([0, *[k for _, k in counts]]), strict=False)], f"`{part}` int, `{before}` long")
    placed = ordered.withColumn(place, F.row_number().over(Window.partitionBy(col(part)).orderBy(*order))).join(F.broadcast(starts), part)
    rank = col(before) + col(place)
    drawn = placed.withColumn("rank", F.when(rank <= wanted, rank)).select(*[col(c) for c in scored.columns], "rank")
    return drawn.unionByName(scored.filter(~F.coalesce(near, F.lit(False))).withColumn("rank", nothing))


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents, with the columns they came with."""
    own = free_name(docs, "rank")
    kept = weigh(docs.select(*[col(c).alias(f"{own}{k}") for k, c in enumerate(docs.columns)], col(options.get("id_col", "doc_id")).alias(f"{own}id"), col(options.get("text_col", "text")).alias(f"{own}text")),
                 target, **{**options, "id_col": f"{own}id", "text_col": f"{own}text", "keep": [f"{own}{k}" for k in range(len(docs.columns))]})
    return kept.filter(F.col("rank").isNotNull()).select(*[col(f"{own}{k}").alias(c) for k, c in enumerate(docs.columns)])

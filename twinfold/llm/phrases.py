"""Phrase collocation mining by count tries of growing depth.

A trie has a node for each run of words, with its count. It is built one depth at a time: each task counts the paths of a
depth in its own share of the texts, as sorted arrays that it hands on whenever they grow beyond a bound; equal paths of all
tasks are then merged by Spark's exchange. Paths are dealt out by a hash of the whole path, so that a frequent prefix is no
hot range. A path is only counted where its first and its last depth - 1 words are frequent themselves (a phrase is no more
frequent than its parts), which a table of bits tells: at most 2 ** FILTER_BITS of them (32 MB) whatever the corpus. Bits of
several paths may fall together, so that some rare paths are counted in vain, and dropped by their exact counts.

In the merged trie a phrase's left part is found on the walk to it, and its right part along suffix links: both are
joins of paths with the nodes. Words are numbers in it, 64 bits hashed from language and word; if a frequent word shared
its number with any other word, all would be numbered anew with another seed, so that counts are exact.

Cut after its first k words, a phrase of count a scores floor(1000 a n / (l r)), n being all words of its language, l and r
the counts of its parts; the lowest score counts. Products are decimals of 38 digits: exact up to n of 10 ** 17. A phrase
goes that lies within a longer frequent one of ``covered`` percent of its count.

Edge cases: a null text has no words; a null language is ``und``. Equal rows count each. Ends of pieces and documents end
phrases. A language without frequent phrases has no rows, and so has an empty table. Other columns do not matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinfold.llm import phrase_batches
from twinfold.llm.frames import Scratch, col, small_batches

LEAST, LONGEST, TOP, COVERED = 100, 5, 2000, 100
FILTER_BITS = 28
#: Bits of one part of a table, as Spark's bitmaps have them.
_PART = 32_768
UNKNOWN = "und"


def numbered(words: DataFrame, least: int, scratch: Scratch, ids=phrase_batches.ids) -> tuple[DataFrame, int]:
    """The frequent words with an id that no other word has, and the seed that gives it."""
    seed = 0
    while True:
        seen = words.select("lang", "word", "n", F.arrow_udf(lambda w, lang, seed=seed: ids(w, lang, seed), "bigint")("word", "lang").alias("id"))
        shared = seen.groupBy("id").agg(F.max("n").alias("n"), F.count("*").alias("words")).filter(((F.col("words") > 1) | (F.col("id") == 0)) & (F.col("n") >= least))
        if shared.isEmpty():
            return scratch.save(seen.filter(F.col("n") >= least)), seed
        seed += 1


def table_of_bits(paths: DataFrame, depth: int, most_bits: int) -> np.ndarray:
    """A bit for each path: 16 bits a path, from 2 ** 15 up to 2 ** most_bits."""
    bits = min(max(15, (16 * paths.count()).bit_length()), most_bits)
    node = F.arrow_udf(phrase_batches.nodes, "bigint")(*phrase_batches.names(depth))
    at = F.shiftrightunsigned(node, 64 - bits)
    parts = paths.select(at.alias("at")).groupBy(F.expr(f"at div {_PART}").alias("part")).agg(F.bitmap_construct_agg(F.col("at") % _PART).alias("bits"))
    table = np.zeros(1 << (bits - 3), np.uint8)
    for part, held in parts.toLocalIterator():
        table[part * _PART // 8 : (part + 1) * _PART // 8] = np.frombuffer(held, np.uint8)
    return table


def trie(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, filter_bits: int = FILTER_BITS, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes: path and count f of all frequent paths; words: lang, word, id; totals: lang, n)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    counted = texts.mapInArrow(phrase_batches.count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    all_words = scratch.save(counted)
    words, seed = numbered(all_words, least, scratch)
    totals = scratch.save(all_words.groupBy("lang").agg(F.sum("n").alias("n")))
    levels = [words.select(F.col("id").alias("w1"), "n")]
    for depth in range(2, longest + 1):
        sent = spark.sparkContext.broadcast(table_of_bits(levels[-1], depth - 1, filter_bits))
        names = phrase_batches.names(depth)
        counts = texts.mapInArrow(phrase_batches.count_paths(depth, lambda sent=sent: sent.value, seed), ", ".join(f"{w} bigint" for w in names) + ", n bigint")
        levels.append(scratch.save(counts.groupBy(*names).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)))
        sent.destroy()
    nodes = None
    for depth, level in enumerate(levels, 1):
        paths = level.select(F.array(*phrase_batches.names(depth)).alias("path"), F.col("n").alias("f"))
        nodes = paths if nodes is None else nodes.unionByName(paths)
    return nodes, words.select("lang", "word", "id"), totals


def collocations(docs: DataFrame, *, top: int = TOP, covered: int = COVERED, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score, count and bytes of the phrase."""
    scratch = Scratch(docs.sparkSession, "phrases")
    nodes, words, totals = trie(docs, scratch=scratch, **options)
    phrases = nodes.filter(F.size("path") > 1).select("path", F.col("f").alias("a"))
    length = F.size("path")
    within = phrases.filter(length > 2).select(
        "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), length - 1), lambda d: F.transform(F.sequence(F.lit(1), F.size("path") - d + 1), lambda s: F.slice("path", s, d))))).alias("path")
    )
    longer = within.groupBy("path").agg(F.max("a").alias("longer"))
    left_over = phrases.join(longer, "path", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))).select("path", "a")

    # a walk down the trie gives the left part of a cut, suffix links its right part
    cuts = left_over.select("path", "a", F.explode(F.sequence(F.lit(1), length - 1)).alias("k"))
    cuts = cuts.select("path", "a", "k", F.slice("path", 1, F.col("k")).alias("left"), F.slice("path", F.col("k") + 1, length - F.col("k")).alias("right"))
    cuts = cuts.join(nodes.select(F.col("path").alias("left"), F.col("f").alias("l")), "left").join(nodes.select(F.col("path").alias("right"), F.col("f").alias("r")), "right")
    of_lang = words.join(totals, "lang").select(F.col("id").alias("first"), "lang", F.col("n"))
    cuts = cuts.withColumn("first", F.get("path", F.lit(0))).join(of_lang, "first")
    score = F.expr("(cast(1000 as decimal(4, 0)) * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0))) div (cast(l as decimal(17, 0)) * cast(r as decimal(17, 0)))")
    best = scratch.save(cuts.withColumn("score", score).groupBy("path", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))

    spelled = best.select("path", F.posexplode("path").alias("k", "id")).join(words.select("id", "word"), "id").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("k", "word"))).alias("words"))
    told = best.join(spelled, "path").select("lang", F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = told.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

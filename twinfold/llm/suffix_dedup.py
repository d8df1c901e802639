"""Removal of long passages that repeat, by a logarithmic family of suffix arrays.

Every byte goes that some string of ``length`` bytes covers which also starts elsewhere, in the same text or another one.

An array has suffixes at sampled places only: of each window of ``length`` bytes the place with the smallest hash of its
first half, so that equal windows have equal suffixes at equal distances. Suffixes are sorted by a fingerprint of that half
(the head) and one of the whole stretch of windows around the place; as only long matches count, fingerprints serve where
bytes would. A new batch gets its array, which is merge-scanned against every level for heads that both have; then levels of
equal size are merged, so that a family of n batches has log2(n) + 1 levels at most and a suffix is rewritten log2(n) times.

A head that the family has once rules all windows of its stretch out. What repeats as a whole stretch repeats in all of its
windows. What is left are stretches that share a head and differ around it, which happens at the ends of repeated passages.
Their windows are compared in groups of 16 that start next to each other: where what all of a group share stands in no other
stretch, none of them is repeated; where all that they cover does, all are. The windows of the other groups are compared one
by one. Of a stretch one text sends its groups and windows, as fingerprints; those that say that something repeats have 128
bits (a stretch has them together with its head).

Texts are told apart by 64 bits; marks name stretches by what they hold, so that texts that share a number do not share
marks. A task passes over a text from its third copy on, as counts matter up to two. Rows are dealt out by fingerprints,
never by source; a head, stretch or window that very many texts share is counted by partial aggregates, and joined with one
row of the other side, so that adaptive execution can split it. Nothing is collected; a text's marks grow with its length.

Edge cases: a null text is empty. A text below ``length`` bytes loses nothing. Rows that repeat count as several texts, so
that all copies of a text of ``length`` bytes or more go, the first as well. Matches do not cross texts. An empty table gives
an empty one. Other columns pass through; one named like ``into`` is replaced. A kept text can end within a character, where
it is bytes; ``dedup`` leaves such broken characters out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm import suffix_batches
from twinfold.llm.frames import Scratch, col, free_name, small_batches

LENGTH = 400
#: Batches in which a whole table is added.
BATCHES = 4


class Family:
    """Suffix arrays of batches, merged geometrically; each level is a table of head, stretch, n and one text's key."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.levels, self.met = scratch, [], []

    def _sorted(self, rows: DataFrame) -> DataFrame:
        array = rows.groupBy("head", "stretch").agg(F.sum("n").alias("n"), F.min("key").alias("key"))
        return self.scratch.save(array.sortWithinPartitions("head", "stretch"))

    def add(self, suffixes: DataFrame) -> None:
        """A batch: its array, a scan against each level, and the merges that follow."""
        array = self._sorted(suffixes)
        heads = array.groupBy("head").agg(F.sum("n").alias("n"))
        met = heads.filter(F.col("n") > 1).select("head")
        for _, level in self.levels:
            met = met.unionByName(heads.select("head").join(level.select("head"), "head", "left_semi"))
        self.met.append(self.scratch.save(met.distinct()))
        self.levels.append((1, array))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, older), (_, newer) = self.levels[-2:]
            merged = self._sorted(older.unionByName(newer))
            self.scratch.drop(older, newer)
            self.levels[-2:] = [(2 * size, merged)]

    def repeated(self) -> DataFrame:
        """head, stretch, n, key of all suffixes whose head the family has more than once."""
        met = self.met[0]
        for more in self.met[1:]:
            met = met.unionByName(more)
        met, rows = met.distinct(), None
        for _, level in self.levels:
            part = level.join(met, "head", "left_semi")
            rows = part if rows is None else rows.unionByName(part)
        return self._sorted(rows)


def marks(texts: DataFrame, scratch: Scratch, *, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """key, whole (stretches that repeat), parts (windows of others that repeat: stretch, low, high) of texts (key, text)."""
    suffixes = scratch.save(texts.mapInArrow(suffix_batches.suffixes(length), suffix_batches.SUFFIXES))
    family = Family(scratch)
    for k in range(batches):
        family.add(suffixes.filter(F.pmod(F.xxhash64("key"), F.lit(batches)) == k))
    repeated = family.repeated()
    scratch.drop(*family.met, *[level for _, level in family.levels])
    whole = suffixes.join(repeated.filter(F.col("n") > 1).select("head", "stretch"), ["head", "stretch"], "left_semi").groupBy("key").agg(F.collect_set("stretch").alias("whole"))

    mixed = repeated.groupBy("head").agg(F.count("*").alias("stretches")).filter(F.col("stretches") > 1).select("head")
    asked = repeated.join(mixed, "head", "left_semi").select("key", "stretch", (F.col("n") == 1).alias("only"))
    groups = scratch.save(_asked(texts, asked, ["stretch", "only"]).mapInArrow(suffix_batches.groups(length), suffix_batches.GROUPS))
    cores, hulls = _of_several(groups, "core"), _of_several(groups, "hull").withColumn("all_repeat", F.lit(True))
    near = scratch.save(groups.join(cores, "core", "left_semi").join(hulls, "hull", "left").drop("hull"))
    done = near.filter("only and all_repeat").select("key", "stretch", "low", "high")

    open_cores = near.filter("only and all_repeat is null").select("core").distinct()
    left = near.join(open_cores, "core", "left_semi").drop("core")
    windows = scratch.save(_asked(texts, left, ["stretch", "only", "low", "high"]).mapInArrow(suffix_batches.windows(length), suffix_batches.WINDOWS))
    single = windows.filter("only").join(_of_several(windows, "window"), "window", "left_semi").select("key", "stretch", "low", F.col("low").alias("high"))
    parts = done.unionByName(single).distinct().groupBy("key").agg(F.collect_list(F.struct("stretch", "low", "high")).alias("parts"))
    found = scratch.save(whole.join(parts, "key", "full"))
    scratch.drop(suffixes, repeated, groups, near, windows)
    return found


def _asked(texts: DataFrame, rows: DataFrame, names: list[str]) -> DataFrame:
    """key, text, asked: the texts that rows (key and the names) ask something of. A text's rows follow from its length."""
    return texts.join(rows.groupBy("key").agg(F.collect_list(F.struct(*names)).alias("asked")), "key").select("key", "text", "asked")


def _of_several(rows: DataFrame, what: str) -> DataFrame:
    """What stands in two stretches or more."""
    return rows.groupBy(what).agg(F.min("stretch").alias("one"), F.max("stretch").alias("other")).filter(F.col("one") < F.col("other")).select(what)


def annotate(docs: DataFrame, into: str, *, text_col: str = "text", **options) -> DataFrame:
    """The documents with a struct ``into``: n_bytes, n_removed, n_spans, spans (start, end in bytes) and kept (bytes)."""
    small_batches(docs.sparkSession)
    scratch, key = Scratch(docs.sparkSession, "suffixes"), free_name(docs, "key")
    text = F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary")
    digest = F.xxhash64(text)
    found = marks(docs.select(digest.alias("key"), text.alias("text")), scratch, **options)
    whole, parts, of = (free_name(docs, x) for x in ("whole", "parts", "key_of"))
    found = found.select(F.col("key").alias(of), F.col("whole").alias(whole), F.col("parts").alias(parts))
    marked = docs.withColumn(key, digest).join(found, col(key) == col(of), "left")
    report = F.arrow_udf(suffix_batches.report(options.get("length", LENGTH)), suffix_batches.REPORT)(text, col(whole), col(parts))
    return marked.withColumn(into, report).select(*[col(c) for c in docs.columns if c != into], col(into))


def dedup(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The documents with what is kept of their texts; bytes of characters that were cut through are left out."""
    into = free_name(docs, "report")
    readable = F.arrow_udf(_readable, "string")(col(into)["kept"])
    kept = annotate(docs, into, text_col=text_col, **options).withColumn(into, F.when(col(text_col).isNotNull(), readable))
    return kept.select(*[col(into).alias(c) if c == text_col else col(c) for c in docs.columns])


def _readable(kept):
    import pyarrow as pa

    return pa.array([x.decode("utf-8", "ignore") for x in kept.to_pylist()], pa.string())

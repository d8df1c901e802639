"""Line deduplication by distinct-site spread, in DataFrame expressions only.

A HyperLogLog sketch of the sites of each line hash is merged by aggregation. Lines whose estimate is clearly over
``least_sites`` are boilerplate; lines whose estimate is near it get an exact distinct count. Boilerplate lines are then
removed wherever they stand. Every line of ``least_words`` words or more counts, by default every line that has a word.

Removal reads each text once more. Few boilerplate lines (LITERAL_LINES) are compared with the texts' lines where these
are; many meet the lines by key, and the places found come back to the texts by a hash of the text. Either way a text is
cut and put together in time linear in its lines.

Edge cases: a null text stays null and has no lines; an empty one has one line, which stays. A null site is no site.
Lines are compared with the blanks around them removed; what is not removed keeps its bytes. Rows that repeat lose the
same lines. An empty table gives an empty one. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.llm.frames import Scratch, col, free_name

LEAST_SITES = 10
LEAST_WORDS = 1
BLANKS = " \t\n\x0b\x0c\r"
#: Registers (log 2) of a sketch: a standard error of about 1.6 %; estimates within NEAR of the bound are counted exactly.
LOG_REGISTERS = 12
NEAR = 0.12
#: Boilerplate lines up to which their hashes are broadcast (some 20 bytes each).
BROADCAST_LINES = 200_000
#: Boilerplate lines up to which their hashes go to the driver (8 bytes each) and into the plan.
LITERAL_LINES = 4096
#: Touched texts, and places in them, up to which the places are broadcast (some 100 and 8 bytes each).
BROADCAST_TEXTS, BROADCAST_PLACES = 50_000, 500_000


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def line_key(line: Column, least_words: int = LEAST_WORDS) -> Column:
    """64-bit hash of a line that counts, else null."""
    bare = F.btrim(line, F.lit(BLANKS))
    # possessive and bound to the start, so that a line of one endless word takes one pass
    return F.when(bare.rlike(r"^(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){%d}[^\x20\x09-\x0D]" % (least_words - 1)), F.xxhash64(bare))


def spread(lines: DataFrame, least_sites: int, scratch: Scratch) -> DataFrame:
    """key: of the lines (key, site) that stand on ``least_sites`` distinct sites or more."""
    sketched = lines.filter(F.col("site").isNotNull()).groupBy("key").agg(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS)).alias("sites"))
    estimated = scratch.save(sketched.select("key", F.hll_sketch_estimate("sites").alias("n")).filter(F.col("n") >= least_sites * (1 - NEAR)))
    sure = estimated.filter(F.col("n") >= least_sites * (1 + NEAR)).select("key")
    near = estimated.filter(F.col("n") < least_sites * (1 + NEAR)).select("key")
    near = F.broadcast(near) if near.count() <= BROADCAST_LINES else near
    pairs = lines.filter(F.col("site").isNotNull()).join(near, "key", "left_semi").groupBy("key", "site").agg(F.lit(1).alias("one"))
    exact = pairs.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= least_sites).select("key")
    return scratch.save(sure.unionByName(exact))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without(lines: Column, places: Column) -> Column:
    """The lines but for those at the places (from 0), joined again: what lies between two places is one slice."""

    def between(lines: Column, ends: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.size(ends) - 2), lambda k: F.slice(lines, F.get(ends, k) + 2, F.get(ends, k + 1) - F.get(ends, k) - 1))
        return F.array_join(F.flatten(cut), "\n")

    return let(lines, lambda x: let(F.concat(F.array(F.lit(-1)), F.array_sort(places), F.array(F.size(x))), lambda ends: between(x, ends)))


def dedup(docs: DataFrame, *, text_col: str = "text", site_col: str = "source", least_sites: int = LEAST_SITES, least_words: int = LEAST_WORDS, report: str | None = None) -> DataFrame:
    """The documents without boilerplate lines; ``report`` names a struct column (n_lines, n_removed) to add."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    text = col(text_col).cast("string")
    own, seen = (free_name(docs, x) for x in ("row", "seen"))
    # equal texts lose equal lines, so that their hash is key enough to bring the places back
    row = lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), F.length(x).alias("n"))
    # texts are cut into lines once: what the steps share is a hash for each line
    keyed = docs.select(col(site_col).cast("string").alias("site"), row(text).alias(own), F.transform(lines_of(text), lambda x: line_key(x, least_words)).alias("keys"))
    keyed = scratch.save(keyed.filter(F.exists("keys", lambda x: x.isNotNull())))
    lines = keyed.select("site", F.explode(F.array_distinct("keys")).alias("key")).filter(F.col("key").isNotNull())
    gone = spread(lines, least_sites, scratch)
    n = gone.count()
    if n <= LITERAL_LINES:
        keys = [r["key"] for r in gone.collect()]
        scratch.drop_but()
        # a line that counts and a line that does not are never equal, so that the hash alone decides
        left = F.filter(lines_of(text), lambda x: ~F.xxhash64(F.btrim(x, F.lit(BLANKS))).isin(keys)) if keys else lines_of(text)
        found = F.when(text.isNotNull(), let(left, lambda x: F.struct(F.array_join(x, "\n").alias("text"), F.size(x).alias("left"))))
        joined = docs.withColumn(seen, found)
        n_left, cleaned = col(seen)["left"], col(seen)["text"]
    else:
        gone = F.broadcast(gone) if n <= BROADCAST_LINES else gone
        placed = keyed.select(own, F.posexplode("keys").alias("at", "key")).filter(F.col("key").isNotNull())
        places = scratch.save(placed.join(gone, "key", "left_semi").groupBy(own).agg(F.collect_set("at").alias("places")))
        scratch.drop_but(places)
        sums = places.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.size("places")), F.lit(0)).alias("places")).first()
        named = {k: free_name(docs, f"row_{k}") for k in ("a", "b", "n")}
        found = places.select(*[col(own)[k].alias(name) for k, name in named.items()], F.col("places").alias(seen))
        found = F.broadcast(found) if sums["texts"] <= BROADCAST_TEXTS and sums["places"] <= BROADCAST_PLACES else found
        joined = docs.withColumns({name: row(text)[k] for k, name in named.items()}).join(found, list(named.values()), "left")
        n_left = F.size(lines_of(text)) - F.coalesce(F.size(col(seen)), F.lit(0))
        cleaned = F.when(col(seen).isNull(), text).otherwise(without(lines_of(text), col(seen)))
    if report is not None:
        n_lines = F.size(lines_of(text))
        joined = joined.withColumn(report, F.when(text.isNull(), F.struct(F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))).otherwise(F.struct(n_lines.cast("long").alias("n_lines"), (n_lines - n_left).cast("long").alias("n_removed"))))
    joined = joined.withColumn(text_col, cleaned)
    return joined.select(*[col(c) for c in docs.columns], *([col(report)] if report else []))

"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is what brings its bytes to its weight in a mix of the wanted size. Each document's count is
the inverse of the Poisson distribution of that rate at a uniform number hashed from seed and id, so that a rerun, or a
lost executor, draws the same. Documents are exploded by their counts, and the copies are dealt out and sorted by a hash
of seed, id, text and copy number: a global shuffle.

Edge cases: a null source is a source of its own. A null text has no bytes; a source without bytes has rate 0 unless
every source is without, when all rates are 1. Rows with one id draw the same count; rows without an id draw by their
texts, so that only equal ones share a count. An empty table gives an empty one.
Other columns pass through; an input column named copy_no or mix_key is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.llm.frames import Scratch, col, free_name

SEED = 17
#: Without given weights a source weighs its bytes to this power: large sources are thinned, small ones repeated.
TEMPERATURE = 0.7
#: Sources up to which their rates are broadcast (some 50 bytes each); beyond, they are joined by source and salt.
BROADCAST_SOURCES = 20_000
SALTS = 32


def uniform(seed: int, record_id: Column, text: Column) -> Column:
    """52 bits of a hash of the id, or of the text where that is null, as a number in [0, 1)."""
    unnamed = F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(record_id.cast("string"), unnamed)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson(rate: Column, u: Column) -> Column:
    """The least k at which the distribution of this rate exceeds u; terms so far out that doubles lose them end it."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("k"))

    def step(a, i):
        log_p = a["log_p"] + F.log(rate / i)
        return F.struct(log_p.alias("log_p"), (a["cdf"] + F.exp(log_p)).alias("cdf"), (a["k"] + F.when(a["cdf"] <= u, 1).otherwise(0)).alias("k"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["k"])).otherwise(F.lit(0))


def rates(docs: DataFrame, *, source_col: str, text_col: str, weights: dict[str, float] | None, temperature: float, size: float, scratch: Scratch) -> DataFrame:
    """source, rate: one row for each source. ``size`` is that of the mix, in sizes of the corpus."""
    n = F.coalesce(F.octet_length(col(text_col).cast("string")), F.lit(0)).cast("long")
    found = docs.groupBy(col(source_col).cast("string").alias("source")).agg(F.sum(n).cast("double").alias("bytes"))
    if weights is None:
        weight = F.pow("bytes", F.lit(temperature))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()), "source string, weight double")
        found = found.join(given, found["source"].eqNullSafe(given["source"]), "left").select(found["*"], F.coalesce("weight", F.lit(0.0)).alias("weight"))
        weight = F.when(F.col("bytes") > 0, F.col("weight")).otherwise(0.0)
    found = scratch.save(found.withColumn("weight", weight))  # the texts are measured once
    sums = found.agg(F.sum("bytes").alias("bytes"), F.sum("weight").alias("weight")).first()
    total, weighed = sums["bytes"] or 0.0, sums["weight"] or 0.0
    rate = F.lit(1.0) if not total else F.when((F.col("bytes") > 0) & F.lit(weighed > 0), F.col("weight") / F.lit(weighed or 1.0) * F.lit(total * size) / F.col("bytes")).otherwise(0.0)
    return found.select("source", rate.alias("rate"))


def mix(docs: DataFrame, *, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, size: float = 1.0, seed: int = SEED) -> DataFrame:
    """Copies of the documents with columns copy_no (from 1) and mix_key, in the order of mix_key within partitions."""
    docs = docs.drop("copy_no", "mix_key")
    by_source = rates(docs, source_col=source_col, text_col=text_col, weights=weights, temperature=temperature, size=size, scratch=Scratch(docs.sparkSession, "mixing"))
    source, rate, salt, other, count = (free_name(docs, x) for x in ("source", "rate", "salt", "salt_of", "count"))
    by_source = by_source.select(F.col("source").alias(source), F.col("rate").alias(rate))
    same = lambda: col(source_col).cast("string").eqNullSafe(col(source))
    if by_source.count() <= BROADCAST_SOURCES:
        rated = docs.join(F.broadcast(by_source), same(), "inner")
    else:
        dealt = docs.withColumn(salt, F.pmod(F.xxhash64(col(id_col), col(text_col)), F.lit(SALTS)))
        rated = dealt.join(by_source.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))).withColumnRenamed(salt, other), same() & (col(salt) == col(other)), "inner").drop(salt, other)
    counted = rated.withColumn(count, poisson(col(rate), uniform(seed, col(id_col), col(text_col).cast("string")))).filter(col(count) > 0).drop(source, rate)
    copies = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(1), col(count)))).drop(count)
    text_hash = F.md5(F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary"))
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(col(id_col).cast("string"), F.lit("")), F.col("copy_no").cast("string"), text_hash)))
    return keyed.repartition(F.col("mix_key")).sortWithinPartitions("mix_key")

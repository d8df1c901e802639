"""Shards of near equal bytes by sampled splitters.

Records are ordered by (hash of the text, id), so equal texts lie side by side. Keys drawn with probability by size give
splitters at their quantiles; the ranges between splitters are measured, and an overfull range is split again by keys
drawn from it. Every range is small, so running sums within ranges plus the bytes before each range give each record its
exact place in the whole order, and the record at byte position p goes to shard floor(shards * p / total). Shards thus
differ by one record at most, whatever was drawn, and a slot is the record's rank in its shard.

Edge cases: a null text has no bytes (size 1). A null id sorts first; ids may be
of any type. Rows equal in text and id are interchangeable. A
group of equal texts is cut where a shard boundary falls into it. An empty table gives an empty table. Input columns
keep their names; an input column named shard or slot is replaced.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.llm.frames import Scratch, col, free_name

SHARDS = 8
#: Bytes meant for one range; between LEAST_RANGES for each shard and MOST_RANGES ranges in all.
RANGE_BYTES = 64 << 20
LEAST_RANGES = 16
MOST_RANGES = 1 << 16
#: Keys drawn for each range that is wanted.
DRAWN = 8
OVERFULL = 3.0
#: Bytes of a key: hashes of text and id, and the id's place between them.
KEY = "S64"
_LOWEST = -(1 << 63)


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def key_of(text: Column, record_id: Column) -> Column:
    """A string that sorts by text hash, then id: by number where it is one, then by hash, so that no two ids have one key."""
    place = F.lpad(F.hex(record_id.try_cast("long").bitwiseXOR(F.lit(_LOWEST))), 16, "0")
    named = F.coalesce(place, F.substring(F.md5(record_id.cast("string").cast("binary")), 1, 16))
    told = F.substring(F.md5(record_id.cast("string").cast("binary")), 1, 16)
    return F.concat(F.md5(F.coalesce(text, F.lit("")).cast("binary")), F.coalesce(named, F.lit("")), F.coalesce(told, F.lit("")))


def draw(keys: DataFrame, n: int) -> list[str]:
    """n keys without replacement, larger records likelier: the smallest of -ln(u) / size, u from the key's hash."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit("draw"), "key"), 11) + 0.5) / float(1 << 53)
    return [r["key"] for r in keys.select("key", (-F.log(u) / F.col("size")).alias("rank")).orderBy("rank", "key").limit(n).collect()]


def quantiles(keys: list[str], parts: int) -> list[str]:
    keys = sorted(set(keys))
    return sorted({keys[len(keys) * k // parts] for k in range(1, parts)}) if keys else []


def in_range(key: Column, splitters: list[str], spark) -> Column:
    """The number of splitters at or below the key."""
    sent = spark.sparkContext.broadcast(np.array(splitters, dtype=KEY))

    def find(keys: pa.Array) -> pa.Array:
        if not len(sent.value):
            return pa.array(np.zeros(len(keys), np.int32))
        return pa.array(np.searchsorted(sent.value, np.array(keys.to_pylist(), dtype=KEY), side="right").astype(np.int32))

    return F.arrow_udf(find, "int")(key)


def measured(keys: DataFrame, splitters: list[str]) -> dict[int, tuple[int, int, bool]]:
    """Bytes, rows and whether it holds more than one key, for each range."""
    spark = keys.sparkSession
    rows = keys.withColumn("range", in_range(F.col("key"), splitters, spark)).groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
    return {r["range"]: (r["size"], r["n"], r["low"] < r["high"]) for r in rows}


def ranges_of(keys: DataFrame, shards: int, range_bytes: int) -> tuple[list[str], dict[int, tuple[int, int, bool]]]:
    """Splitters, and the measure of each range, with no range overfull that could be split."""
    spark = keys.sparkSession
    total = keys.agg(F.sum("size")).first()[0] or 0
    wanted = min(MOST_RANGES, max(LEAST_RANGES * shards, -(-total // range_bytes)))
    splitters = quantiles(draw(keys, DRAWN * wanted), wanted)
    while True:
        sizes = measured(keys, splitters)
        over = [r for r, (size, _, several) in sizes.items() if several and size > OVERFULL * total / wanted]
        if not over:
            return splitters, sizes
        inside = keys.withColumn("range", in_range(F.col("key"), splitters, spark)).filter(F.col("range").isin(over)).drop("range")
        drawn = draw(inside, DRAWN * max(2, round(sum(sizes[r][0] for r in over) * wanted / total)))
        by_range: dict[int, list[str]] = {}
        for key in drawn:
            by_range.setdefault(bisect_right(splitters, key), []).append(key)
        more = {k for r, found in by_range.items() for k in quantiles(found, max(2, round(sizes[r][0] * wanted / total)))}
        before = len(splitters)
        splitters = sorted({*splitters, *more})
        if len(splitters) == before:  # what is left are a few large records under keys that were drawn already
            return splitters, sizes


def shard(docs: DataFrame, *, shards: int = SHARDS, key: Column | None = None, size: Column | None = None, text_col: str = "text", id_col: str = "doc_id", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records with columns shard (int) and slot (long); rows of a range lie together, in order."""
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    key_name, size_name, at, total_name = (free_name(docs, x) for x in ("key", "size", "range", "before"))
    docs = docs.withColumn(key_name, key_of(col(text_col).cast("string"), col(id_col)) if key is None else key).withColumn(size_name, size_of(col(text_col).cast("string")) if size is None else size)
    scratch = Scratch(spark, "sharding")
    keys = scratch.save(docs.select(col(key_name).alias("key"), col(size_name).alias("size")))
    splitters, sizes = ranges_of(keys, shards, range_bytes)
    order = range(len(splitters) + 1)
    bytes_in, rows_in = ([sizes.get(r, (0, 0))[k] for r in order] for k in (0, 1))
    bytes_before, rows_before = ([0, *accumulate(x)][:-1] for x in (bytes_in, rows_in))
    total = sum(bytes_in)

    # rows before each shard: all of the ranges before the one its boundary falls into, and some of that one
    cuts = {s: next((r for r in order if shards * (bytes_before[r] + bytes_in[r]) >= s * total), 0) for s in range(1, shards)}
    offsets = spark.sparkContext.broadcast((np.array(bytes_before, np.int64), np.array(rows_before, np.int64)))

    def before(ranges: pa.Array) -> pa.Array:
        places = ranges.to_numpy(zero_copy_only=False)
        return pa.StructArray.from_arrays([pa.array(x[places]) for x in offsets.value], ["bytes", "rows"])

    def placed(df: DataFrame, key: str, size: str, at: str, into: str) -> DataFrame:
        """Bytes and rows before each record in the whole order."""
        within = Window.partitionBy(at).orderBy(key)
        start = F.arrow_udf(before, "struct<bytes:bigint, rows:bigint>")(col(at))
        so_far = F.sum(col(size)).over(within.rowsBetween(Window.unboundedPreceding, 0)) - col(size)
        df = df.withColumn(into, F.struct(so_far.alias("bytes"), (F.row_number().over(within) - 1).cast("long").alias("rows")))
        return df.withColumn(at, start).withColumn(into, F.struct((col(into)["bytes"] + col(at)["bytes"]).alias("bytes"), (col(into)["rows"] + col(at)["rows"]).alias("rows"))).drop(at)

    cut = keys.withColumn("range", in_range(F.col("key"), splitters, spark)).filter(F.col("range").isin(sorted(set(cuts.values()))))
    cut = placed(cut.withColumn("r", F.col("range")), "key", "size", "range", "at")
    some = cut.agg(*[F.count(F.when((F.col("r") == cuts[s]) & (shards * F.col("at.bytes") < s * total), 1)).alias(str(s)) for s in cuts]).first() if cuts else {}
    starts = [0, *(rows_before[cuts[s]] + some[str(s)] for s in range(1, shards))]
    scratch.drop(keys)

    docs = placed(docs.withColumn(at, in_range(col(key_name), splitters, spark)), key_name, size_name, at, total_name)
    place = f"`{total_name}`.bytes"
    number = F.least(F.expr(f"{shards}L * {place} div {max(total, 1)}L"), F.lit(shards - 1))
    docs = docs.withColumn("shard", number.cast("int"))
    return docs.withColumn("slot", col(total_name)["rows"] - F.get(F.array(*[F.lit(int(x)).cast("long") for x in starts]), F.col("shard"))).drop(key_name, size_name, total_name)


def write(docs: DataFrame, path: str, **options) -> None:
    """One folder for each shard, with the records in slot order within its files."""
    shard(docs, **options).write.partitionBy("shard").parquet(path)

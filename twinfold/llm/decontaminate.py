"""Benchmark decontamination by Wu-Manber search of word windows.

Items are cut into windows of ``window`` words (a shorter item is one window) and searched for in every whole text. The
benchmark comes in blocks of at most ``block_bytes`` of text (or one item), each of which is one pass over the rows with its
own tables: about seven bytes for each byte of the block, on the driver and in each worker. Between passes the rows are
written with the hits so far, and the tables of the pass before are destroyed, so that neither broadcasts nor workers grow
with the benchmark; a larger one takes more passes.

Edge cases: a null text has no words and is never contaminated. An item without words has no window. Windows of an
item whose id is null count as hits but not as an item. Rows that repeat are judged one by one; other columns pass
through whatever their names are. An empty benchmark contaminates nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.llm import contamination
from twinfold.llm.frames import Scratch, col, free_name, small_batches
from twinfold.llm.wu_manber import Items

WINDOW = 13
BLOCK_BYTES = 8 << 20


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark's items in lists of at most ``block_bytes`` of text (or one item)."""
    block, size = [], 0
    for item_id, text in benchmark.select(col(id_col).cast("string"), col(text_col).cast("string")).toLocalIterator():
        more = len((text or "").encode()) + 64
        if block and size + more > block_bytes:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += more
    yield block


def tables_of(block: list[tuple], window: int) -> tuple[Items, list[str | None]]:
    """Search tables and ids of the items; items with one id count once."""
    return Items(((k, contamination.words_of((text or "").encode())) for k, (_, text) in enumerate(block)), window), [i for i, _ in block]


def annotate(docs: DataFrame, benchmark: DataFrame, into: str, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with a struct column ``into``: n_words, n_hit, n_items, items_sha256."""
    spark = docs.sparkSession
    small_batches(spark)
    state, scratch = free_name(docs, "hits"), Scratch(spark, "decontaminate")
    text, before = col(text_col).cast("string"), []
    blocks = item_blocks(benchmark, item_col, item_text_col, block_bytes)
    block, rows = next(blocks), docs
    while True:
        following = next(blocks, None)
        sent = spark.sparkContext.broadcast(tables_of(block, window))
        found = _search(sent, contamination.as_report if following is None else contamination.as_state, bool(before))
        column = F.arrow_udf(found, contamination.REPORT if following is None else contamination.STATE)(text, *before)
        if following is None:
            return rows.withColumn(into, column).drop(state)
        written = scratch.save(rows.withColumn(state, column))
        scratch.drop_but(written)
        sent.destroy()
        block, rows, before = following, written, [col(state)]


def _search(sent, as_column, further: bool):
    """The Arrow function of one pass."""

    def start(texts: pa.Array) -> pa.Array:
        return as_column(contamination.one_pass(texts, None, *sent.value))

    def add(texts: pa.Array, before: pa.Array) -> pa.Array:
        return as_column(contamination.one_pass(texts, before, *sent.value))

    return add if further else start


def is_contaminated(report: Column) -> Column:
    """Some word is hit, and hit words are at least one in twenty."""
    return (report["n_hit"] > 0) & (20 * report["n_hit"] >= report["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    into = free_name(docs, "report")
    return annotate(docs, benchmark, into, **options).filter(~is_contaminated(col(into))).drop(into)

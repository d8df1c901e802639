"""Counts of word paths in batches of texts, as Python workers make them: a trie of one depth, held as sorted arrays."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash

from twinfold.llm.batches import texts_of

#: What ends a piece, and what stands between words.
_ENDS, _GAPS = b".,;:!?\x0a\x0b\x0c\x0d", b" \x09"
#: A byte that no UTF-8 text has stands for the end of a piece.
_END = b"\xff"
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else 255 if c in _ENDS else 32 if c in _GAPS else c for c in range(256))
#: Paths, or words, that a task holds before it hands some on; positions that it sorts at once.
MOST_HELD, MOST_SORTED = 400_000, 1_000_000
ROWS = 1 << 16
_MIX, _FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def tokens(text: bytes) -> list[bytes]:
    """Words, with _END between pieces."""
    return text.translate(_FOLDED).replace(_END, b" \xff ").split()


def word_id(lang: str, word: bytes, seed: int) -> int:
    """A signed number for a word of a language."""
    n = xxhash.xxh3_64_intdigest(lang.encode() + b"\0" + word, seed)
    return n - (n >> 63 << 64)


def ids(words: pa.Array, langs: pa.Array, seed: int) -> pa.Array:
    return pa.array([word_id(lang, w, seed) for lang, w in zip(langs.to_pylist(), texts_of(words), strict=True)], pa.int64())


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, n of (lang, text)."""
    held: dict[str, Counter] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            counts.pop(_END, None)
            listed = sorted(counts.items())
            for k in range(0, len(listed), ROWS):
                part = listed[k : k + ROWS]
                words = pa.array([w for w, _ in part], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), words, pa.array([n for _, n in part], pa.int64())], ["lang", "word", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            held.setdefault(lang, Counter()).update(tokens(text))
        if sum(map(len, held.values())) > MOST_HELD:
            yield from flushed()
    yield from flushed()


class _Ids(dict):
    """Ids of the words of one language, as they are met."""

    def __init__(self, lang: str, seed: int):
        super().__init__({_END: 0})
        self.lang, self.seed = lang, seed

    def __missing__(self, word: bytes) -> int:
        self[word] = found = word_id(self.lang, word, self.seed)
        return found


def node(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of each path of ids; it places paths in the table of bits and sorts them, and never stands for them."""
    with np.errstate(over="ignore"):
        h = columns[0].view(np.uint64)
        for c in columns[1:]:
            h = h * _MIX + c.view(np.uint64)
            h = h ^ (h >> _FOLD)
        return h * _MIX


def nodes(*columns: pa.Array) -> pa.Array:
    return pa.array(node([c.to_numpy(zero_copy_only=False) for c in columns]).view(np.int64))


def in_table(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set; the table has a power of two of bytes."""
    at = h >> np.uint64(61 - (len(table).bit_length() - 1))
    return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


class _Trie:
    """Counts of paths of one depth, sorted by their hashes."""

    def __init__(self, depth: int):
        self.depth, self.rows, self.counts, self.waiting, self.n = depth, np.empty((0, depth), np.int64), np.empty(0, np.int64), [], 0

    def add(self, rows: np.ndarray) -> None:
        self.waiting.append(rows)
        self.n += len(rows)
        if self.n >= MOST_SORTED:
            self.settle()

    def settle(self) -> None:
        rows = np.concatenate([self.rows, *self.waiting])
        counts = np.concatenate([self.counts, np.ones(self.n, np.int64)])
        self.waiting, self.n = [], 0
        order = np.argsort(node([np.ascontiguousarray(rows[:, k]) for k in range(self.depth)]), kind="stable")
        rows, counts = rows[order], counts[order]
        # two paths of one hash may lie mixed; they then give several rows, which add up as they are merged
        starts = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])) if len(rows) else np.empty(0, np.int64)
        self.rows, self.counts = rows[starts], np.add.reduceat(counts, starts) if len(starts) else counts

    def flushed(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        for k in range(0, len(self.rows), ROWS):
            part = self.rows[k : k + ROWS]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(part[:, i])) for i in range(self.depth)), pa.array(self.counts[k : k + ROWS])], [*names(self.depth), "n"])
        self.rows, self.counts = self.rows[:0], self.counts[:0]


def names(depth: int) -> list[str]:
    return [f"w{k + 1}" for k in range(depth)]


def count_paths(depth: int, table: Callable[[], np.ndarray], seed: int):
    """Counts of the paths of a depth whose first and last depth - 1 words are in the table of the depth before."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known, trie = table(), {}, _Trie(depth)
        for batch in batches:
            flat = []
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                if lang not in known:
                    known[lang] = _Ids(lang, seed)
                flat.append(map(known[lang].__getitem__, tokens(text)))
                flat.append((0,))
            line = np.fromiter(chain.from_iterable(flat), np.int64)
            rows = extended(line, depth, bits)
            if len(rows):
                trie.add(rows)
            if sum(map(len, known.values())) > MOST_HELD:
                known.clear()
            if len(trie.rows) > MOST_HELD:
                yield from trie.flushed()
        yield from trie.flushed()

    return count


def extended(line: np.ndarray, depth: int, bits: np.ndarray) -> np.ndarray:
    """The paths of the depth along a line of ids (0: an end) whose two parts of depth - 1 are in the table."""
    n = len(line) - depth + 2
    if n < 2:
        return np.empty((0, depth), np.int64)
    columns = [line[k : k + n] for k in range(depth - 1)]
    sound = np.logical_and.reduce([c != 0 for c in columns])
    at = np.flatnonzero(sound)
    sound[at] = in_table(bits, node([c[at] for c in columns]))
    starts = np.flatnonzero(sound[:-1] & sound[1:])
    return line[starts[:, None] + np.arange(depth)]

"""Wu-Manber search over sequences of words: many patterns at once, most positions skipped.

Patterns of one length share a shift table. The last ``block`` words at a position say how far the search may jump: by
default past the whole block, less where the block stands inside a pattern. At shift 0 the block is the end of some
pattern; its suffix bucket lists those, and comparing the words confirms an occurrence.

The tables are flat arrays: the items' words once, and for each pattern the place of its first word and a hash of its last
block. That is about BYTES_A_BYTE bytes for each byte of the items, however many patterns overlap in them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from xxhash import xxh3_64_intdigest

BYTES_A_BYTE = 7
#: Entries of a shift table for each block of its patterns, so that few blocks share one by chance.
ROOM = 16


def key_of(words: Sequence[bytes]) -> int:
    """64-bit hash of the words of a block."""
    return xxh3_64_intdigest(b" ".join(words))


@dataclass(frozen=True)
class Patterns:
    """Those of one length: every run of ``length`` words of the items."""

    length: int
    block: int
    #: The items' words with one space after each, and where each word starts in them (one start more than words).
    words: bytes
    begins: np.ndarray
    #: The first word of each item, and its number.
    firsts: np.ndarray
    numbers: np.ndarray
    #: By hash of the last block: hashes, and the pattern's first word.
    suffixes: np.ndarray
    starts: np.ndarray
    shifts: bytes

    @classmethod
    def of(cls, items: Sequence[tuple[int, bytes]], length: int, block: int) -> Patterns:
        """items: number and words, one space between two; ``length`` words at least."""
        block = min(block, length)
        text = b" ".join([*(words for _, words in items), b""])
        begins = np.append(0, np.flatnonzero(np.frombuffer(text, np.uint8) == ord(" ")) + 1)
        counts = np.array([words.count(b" ") + 1 for _, words in items], np.int64)
        firsts = np.cumsum(counts) - counts
        hashes = np.empty(counts.sum(), np.uint64)
        for first, (_, joined) in zip(firsts, items, strict=True):
            words = joined.split(b" ")
            hashes[first : first + len(words)] = [key_of(words[k : k + block]) for k in range(len(words))]
        inside = np.concatenate([np.arange(n - length + 1) + first for first, n in zip(firsts, counts, strict=True)])
        last = length - block
        size = 1 << max(8, int(ROOM * counts.sum()).bit_length())
        shifts = np.full(size, min(last + 1, 255), np.uint8)  # a shorter jump is right too
        for at in range(last + 1):  # the least shift comes last and stays
            shifts[hashes[inside + at] & np.uint64(size - 1)] = min(last - at, 255)
        suffixes = hashes[inside + last]
        order = np.argsort(suffixes, kind="stable")
        narrow = np.int32 if len(text) < 1 << 31 else np.int64
        return cls(length, block, text, begins.astype(narrow), firsts.astype(narrow), np.array([k for k, _ in items], np.int64), suffixes[order], inside[order].astype(narrow), shifts.tobytes())

    def search(self, words: Sequence[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(start, numbers of the items that have it) of each occurrence, ends ascending."""
        shifts, mask, block, length = self.shifts, len(self.shifts) - 1, self.block, self.length
        last, stop = length - block, len(words) - block
        at = last
        while at <= stop:
            key = key_of(words[at : at + block])
            if jump := shifts[key & mask]:
                at += jump
                continue
            low, high = (int(np.searchsorted(self.suffixes, np.uint64(key), side=side)) for side in ("left", "right"))
            if low < high:
                start = at - last
                run = b" ".join([*words[start : start + length], b""])
                found = [s for s in self.starts[low:high].tolist() if self.words[self.begins[s] : self.begins[s + length]] == run]
                if found:
                    yield start, self.numbers[np.searchsorted(self.firsts, found, side="right") - 1].tolist()
            at += 1


class Items:
    """All windows of ``window`` words of the items; an item of fewer words is one window."""

    def __init__(self, items: Iterable[tuple[int, Sequence[bytes]]], window: int, block: int = 3):
        by_length = defaultdict(list)
        for number, words in items:
            if words:
                by_length[min(window, len(words))].append((number, b" ".join(words)))
        self.groups = [Patterns.of(some, length, block) for length, some in sorted(by_length.items())]

    def hits(self, words: Sequence[bytes]) -> tuple[bytearray, set[int]]:
        """A mark for each word that lies in an occurrence, and the numbers of the items of what occurs."""
        marks, found = bytearray(len(words)), set()
        for group in self.groups:
            one = b"\x01" * group.length
            for start, numbers in group.search(words):
                marks[start : start + group.length] = one
                found.update(numbers)
        return marks, found


class WordSearch:
    """Patterns of any lengths, each with its owners. Words are strings or bytes without blanks."""

    def __init__(self, patterns: Iterable[tuple[Sequence, frozenset]], block: int = 3):
        self.owners, parts = [], []
        for words, owners in patterns:
            parts.append((len(self.owners), _bytes(words)))
            self.owners.append(owners)
        self.items = Items(parts, max((len(w) for _, w in parts), default=1), block)

    def hits(self, words: Sequence) -> tuple[bytearray, set]:
        """A mark for each word that lies in an occurrence, and the owners of what occurs."""
        words = _bytes(words)
        marks, found = self.items.hits(words)
        return marks, set().union(*(self.owners[k] for k in found))


def _bytes(words: Sequence) -> list[bytes]:
    return [w.encode() if isinstance(w, str) else w for w in words]

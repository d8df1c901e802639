"""Sampled suffixes of texts and what repeats of them, as Python workers find them.

Of the windows of ``length`` bytes, those that share the place with the smallest hash of its next ``head_of(length)`` bytes
(the last such place) make a stretch. What a window holds decides where in it that place is, so that equal windows, wherever
they stand, start the same number of bytes before places with equal heads.
"""

from __future__ import annotations

from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from twinfold.llm.batches import texts_of

#: Windows that are looked at together, so that memory does not follow the text's length.
BLOCK = 1 << 20
#: Texts that a task remembers, to pass over further copies.
REMEMBERED = 100_000
#: Windows of a stretch that are compared together first, by what all of them hold and by what any of them holds.
GROUP = 16
ROWS = 1 << 16
_A, _B, _C, _LOW = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xFFFFFFFF)
_HALF, _KEPT = np.uint64(32), np.uint64(33)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def head_of(length: int) -> int:
    return (length + 1) // 2


def _signed(n: int) -> int:
    return n - (n >> 63 << 64)


def stretches(text: bytes, length: int) -> Iterator[tuple[int, int, int]]:
    """(first window, last window, place) of each stretch, in order."""
    for start in range(0, len(text) - length + 1, BLOCK):
        part = text[start : start + BLOCK + length - 1]
        for first, last, place in zip(*_stretches(part, length), strict=True):
            yield start + first, start + last, start + place


def _stretches(text: bytes, length: int) -> tuple[list[int], list[int], list[int]]:
    head, n = head_of(length), len(text)
    width, places = length - head + 1, n - head + 1
    eights = np.ndarray((n - 7,), np.dtype("<u8"), text, strides=(1,)) * _A
    eights ^= eights >> _HALF
    eights *= _B
    sums = np.zeros(n - 6, np.uint64)
    np.cumsum(eights, out=sums[1:])
    keys = np.full(-(-places // width) * width, _MOST, np.uint64)
    h = (sums[head - 7 :] - sums[:places]) * _C
    keys[:places] = ((h >> _KEPT) << _HALF) | (_LOW - np.arange(places, dtype=np.uint64))
    rows = keys.reshape(-1, width)
    so_far = np.minimum.accumulate(rows, axis=1).ravel()
    to_come = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    at = (_LOW - (np.minimum(to_come[:windows], so_far[width - 1 : width - 1 + windows]) & _LOW)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [windows - 1]])
    return first.tolist(), last.tolist(), at[first].tolist()


def head(text: bytes, place: int, length: int) -> int:
    return _signed(xxhash.xxh3_64_intdigest(text[place : place + head_of(length)]))


def stretch(text: bytes, first: int, last: int, length: int) -> int:
    """A number for all bytes of a stretch, apart from that for its head."""
    return _signed(xxhash.xxh3_64_intdigest(text[first : last + length], 1))


class _Seen:
    """How often the texts of late were met."""

    def __init__(self):
        self.known: OrderedDict[tuple[int, int], int] = OrderedDict()

    def times(self, key: int, text: bytes) -> int:
        told = (key, hash(text))
        n = self.known[told] = self.known.pop(told, 0) + 1
        if len(self.known) > REMEMBERED:
            self.known.popitem(last=False)
        return n


SUFFIXES = "key bigint, head bigint, stretch bigint, n bigint"
GROUPS = "core bigint, hull binary, key bigint, stretch bigint, only boolean, low bigint, high bigint"
WINDOWS = "window binary, key bigint, stretch bigint, only boolean, low bigint"
_KINDS = {"bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], kind: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in kind.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _KINDS[t]) for k, t in enumerate(kinds)], list(names))


def suffixes(length: int):
    """key, head, stretch, n of (key, text): the sampled suffixes of each text. A text's third copy says nothing new."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = _Seen(), []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                if len(text) >= length and seen.times(key, text) <= 2:
                    found = Counter((head(text, place, length), stretch(text, first, last, length)) for first, last, place in stretches(text, length))
                    rows += [(key, h, s, n) for (h, s), n in found.items()]
                if len(rows) >= ROWS:
                    yield _batch(rows, SUFFIXES)
                    rows = []
        yield _batch(rows, SUFFIXES)

    return sample


def groups_of(text: bytes, first: int, last: int, place: int, length: int) -> Iterator[tuple[int, bytes, int, int]]:
    """(core, hull, low, high) of groups of windows that start low to high bytes before the place.

    Windows are grouped by that distance, GROUP at a time, alike in all stretches. The core is what all windows of a whole group
    share, so that it lies within each; the hull is what the group's windows in this stretch cover.
    """
    for g in range((place - last) // GROUP, (place - first) // GROUP + 1):
        low, high = max(g * GROUP, place - last), min((g + 1) * GROUP - 1, place - first)
        core = text[place - g * GROUP : place - (g + 1) * GROUP + 1 + length]
        hull = text[place - high : place - low + length]
        yield _signed(xxhash.xxh3_64_intdigest(core, g)), xxhash.xxh3_128_digest(hull, high), low, high


def groups(length: int):
    """The groups of windows of the stretches asked for: (key, text, asked) with asked: stretch, only (it stands here alone)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = _Seen(), []
        for batch in batches:
            for key, text, asked in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if seen.times(key, text) > 1:
                    continue
                wanted = {a["stretch"]: a["only"] for a in asked}
                for first, last, place in stretches(text, length):
                    if (s := stretch(text, first, last, length)) in wanted:
                        rows += [(core, hull, key, s, wanted[s], low, high) for core, hull, low, high in groups_of(text, first, last, place, length)]
                    if len(rows) >= ROWS:
                        yield _batch(rows, GROUPS)
                        rows = []
        yield _batch(rows, GROUPS)

    return each


def windows(length: int):
    """Every window of the groups asked for: (key, text, asked) with asked: stretch, only, low, high."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = _Seen(), []
        for batch in batches:
            for key, text, asked in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if seen.times(key, text) > 1:
                    continue
                wanted: dict[int, list] = {}
                for a in asked:
                    wanted.setdefault(a["stretch"], []).append((a["only"], a["low"], a["high"]))
                for first, last, place in stretches(text, length):
                    s = stretch(text, first, last, length)
                    for only, low, high in wanted.pop(s, ()):
                        rows += [(xxhash.xxh3_128_digest(text[place - o : place - o + length], o), key, s, only, o) for o in range(low, high + 1)]
                    if len(rows) >= ROWS:
                        yield _batch(rows, WINDOWS)
                        rows = []
        yield _batch(rows, WINDOWS)

    return each


def spans(text: bytes, whole: list[int] | None, parts: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes (start, end) that repeated windows cover.

    ``whole`` are stretches whose windows all repeat, ``parts`` (stretch, low, high) windows by their distance from the place.
    """
    known, some = set(whole or ()), {}
    for p in parts or ():
        some.setdefault(p["stretch"], []).append((p["low"], p["high"]))
    repeated = []
    for first, last, place in stretches(text, length):
        s = stretch(text, first, last, length)
        repeated += [(first, last)] if s in known else [(place - high, place - low) for low, high in some.get(s, ())]
    out: list[tuple[int, int]] = []
    for first, last in sorted(repeated):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last + length))
        else:
            out.append((first, last + length))
    return out


def without(text: bytes, removed: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for start, end in removed:
        kept.append(text[at:start])
        at = end
    return b"".join([*kept, text[at:]])


REPORT = "struct<n_bytes:bigint, n_removed:bigint, n_spans:bigint, spans:array<struct<start:bigint, end:bigint>>, kept:binary>"


def report(length: int):
    def judge(texts: pa.Array, whole: pa.Array, parts: pa.Array) -> pa.Array:
        rows = []
        for text, w, p in zip(texts_of(texts), whole.to_pylist(), parts.to_pylist(), strict=True):
            removed = spans(text, w, p, length) if w or p else []
            rows.append({"n_bytes": len(text), "n_removed": sum(e - b for b, e in removed), "n_spans": len(removed), "spans": [{"start": b, "end": e} for b, e in removed], "kept": without(text, removed)})
        one = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return pa.array(rows, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(one)), ("kept", pa.binary())]))

    return judge

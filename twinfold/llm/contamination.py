"""Contamination of a batch of texts, as Python workers find it."""

from __future__ import annotations

import hashlib

import pyarrow as pa

from twinfold.llm.batches import texts_of
from twinfold.llm.wu_manber import Items

STATE = "struct<marks:binary, items:array<string>>"
REPORT = "struct<n_words:bigint, n_hit:bigint, n_items:bigint, items_sha256:string>"

#: A-Z lower-cased; what is not a letter, a digit or beyond ASCII becomes a space.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def found_in(text: bytes, items: Items, ids: list[str | None]) -> tuple[bytearray, set[str]]:
    """A mark for each word that is hit, and the ids of the items that have a window in the text."""
    marks, numbers = items.hits(words_of(text))
    return marks, {ids[k] for k in numbers if ids[k] is not None}


def merged(marks: bytes, more: bytes) -> bytes:
    return (int.from_bytes(marks, "big") | int.from_bytes(more, "big")).to_bytes(len(marks), "big")


def one_pass(texts: pa.Array, before: pa.Array | None, items: Items, ids: list[str | None]) -> list[tuple[bytes, list[str]]]:
    """Marks and item ids of each text, with those of the passes before."""
    out = []
    for text, state in zip(texts_of(texts), [None] * len(texts) if before is None else before.to_pylist(), strict=True):
        marks, found = found_in(text, items, ids)
        if state is not None:
            marks, found = merged(marks, state["marks"]), found.union(state["items"])
        out.append((bytes(marks), sorted(found)))
    return out


def as_state(rows: list[tuple[bytes, list[str]]]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array([m for m, _ in rows], pa.binary()), pa.array([i for _, i in rows], pa.list_(pa.string()))], ["marks", "items"])


def as_report(rows: list[tuple[bytes, list[str]]]) -> pa.Array:
    return pa.StructArray.from_arrays(
        [
            pa.array([len(m) for m, _ in rows], pa.int64()),
            pa.array([m.count(1) for m, _ in rows], pa.int64()),
            pa.array([len(i) for _, i in rows], pa.int64()),
            pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for _, i in rows], pa.string()),
        ],
        ["n_words", "n_hit", "n_items", "items_sha256"],
    )

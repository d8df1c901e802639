"""Arrow functions over batches of texts and sketches, as Python workers run them."""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa

from twinfold.llm import setsketch
from twinfold.llm.batches import texts_of

#: Columns of the parity bits.
ODD = [f"p{k}" for k in range(setsketch.PARITIES // 64)]
PRINT = "struct<n:bigint, node:binary, sketch:binary, " + ", ".join(f"{p}:bigint" for p in ODD) + ">"
#: Bytes of element sets that ``are_linked`` keeps for the pairs to come.
RECENT = 8 << 20


def prints(texts: pa.Array) -> pa.Array:
    """Of each text: the size of its set, a fingerprint of the set, its sketch and its parity bits."""
    sets = setsketch.shingles_of(texts_of(texts))
    registers, odd = setsketch.sketches(sets), np.array([setsketch.parities(x) for x in sets], np.int64).reshape(-1, len(ODD))
    nodes = [setsketch.fingerprint(x) if len(x) else None for x in sets]
    columns = [pa.array([len(x) for x in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array([r.tobytes() for r in registers], pa.binary())]
    return pa.StructArray.from_arrays([*columns, *(pa.array(odd[:, k]) for k in range(len(ODD)))], ["n", "node", "sketch", *ODD])


def elements(texts: pa.Array) -> pa.Array:
    return pa.array([x.view(np.int64) for x in setsketch.shingles_of(texts_of(texts))], pa.list_(pa.int64()))


def bands(sketches: pa.Array) -> pa.Array:
    rows = [setsketch.bands(np.frombuffer(x, "<u2")) for x in sketches.to_pylist()]
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * setsketch.BANDS), pa.array(flat))


def may_link(n_a: pa.Array, n_b: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether sets of these sizes and sketches may be similar, by likelihood."""
    if not len(n_a):
        return pa.array([], pa.bool_())
    rows = lambda x: np.frombuffer(b"".join(x.to_pylist()), "<u2").reshape(-1, setsketch.REGISTERS)
    sizes = lambda x: x.to_numpy(zero_copy_only=False).astype(np.float64)
    return pa.array(setsketch.candidates(sizes(n_a), sizes(n_b), rows(a), rows(b)))


def are_linked(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether the whole sets of two texts are similar. Pairs of one hub follow each other, so its set is made once."""
    recent: OrderedDict[bytes, np.ndarray] = OrderedDict()
    held = 0

    def of(text: bytes) -> np.ndarray:
        nonlocal held
        if text not in recent:
            recent[text] = setsketch.shingles(text)
            held += len(text) + recent[text].nbytes
            while held > RECENT and len(recent) > 1:
                old, made = recent.popitem(last=False)
                held -= len(old) + made.nbytes
        return recent[text]

    return pa.array([setsketch.linked(of(x), of(y)) for x, y in zip(texts_of(a), texts_of(b), strict=True)], pa.bool_())

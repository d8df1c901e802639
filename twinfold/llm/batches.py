"""What Python workers need of a batch of texts; it imports Arrow only, so that a worker stays small."""

from __future__ import annotations

import pyarrow as pa


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text of a batch; a null text is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]

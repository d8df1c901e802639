"""XXH3-64 as an Arrow function; Spark's own xxhash64 is another hash."""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F


def _hex(contents: pa.Array) -> pa.Array:
    return pa.array([None if x is None else xxhash.xxh3_64_hexdigest(x) for x in contents.to_pylist()], pa.string())


def xxh3_hex(content: Column) -> Column:
    return F.arrow_udf(_hex, "string")(content)

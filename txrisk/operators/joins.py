"""Join helpers (ops 42-49 are composed in plans from these and plain joins).

``broadcast_if_small`` is the only way an *aggregated* lookup table (one row
per category, class, ...) gets broadcast: it is persisted, measured, and
broadcast only under a limit of rows and of bytes; above it the join stays a
shuffle join and AQE (with skew-join splitting) plans it at runtime.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 << 20

_persisted: list[DataFrame] = []


def row_bytes(schema: T.StructType) -> Column:
    """An upper estimate of a row's bytes in memory: 16 a field, text and binary by their length,
    elements of arrays and maps and fields of structs by the text that shows them."""
    size = F.lit(16 * len(schema.fields)).cast("long")
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + 8 * F.coalesce(F.octet_length(c.cast("string")), F.lit(0))
    return size


def broadcast_if_small(small: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
                       max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``small``, with the broadcast hint if it was measured to be small. It stays persisted until ``release_lookups``."""
    small = small.persist(StorageLevel.MEMORY_AND_DISK)
    _persisted.append(small)
    # evaluated once; the persisted result feeds the join
    size = small.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_bytes(small.schema)), F.lit(0)).alias("bytes")).first()
    return F.broadcast(small) if size["rows"] <= max_rows and size["bytes"] <= max_bytes else small


def release_lookups() -> int:
    """Unpersist the lookup tables kept so far, for a long session between its queries; returns their number.

    A DataFrame built on one stays right: it computes the lookup again."""
    n = len(_persisted)
    while _persisted:
        _persisted.pop().unpersist()
    return n


def lookup_join(big: DataFrame, small: DataFrame, on, how: str = "left",
                max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    return big.join(broadcast_if_small(small, max_rows), on, how)

"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txrisk.session import materialize, run_folder

#: Bytes of text that an Arrow function handles at a time (a longer document is handled alone).
CHUNK_BYTES = 2 << 20

#: White space of word splitting, as in the pattern ``[^\x20\x09-\x0D]+``.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Keep Arrow batches of long texts small: at most ``rows`` rows and about ``size`` bytes each.

    Tighter settings stay.  The session keeps these: what is returned runs later
    and reads them then.  For jobs that end at once see ``arrow_batches``.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    to_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if not 0 < to_bytes(spark.conf.get(key)) <= to_bytes(size):
        spark.conf.set(key, size)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows and about ``size`` bytes for what is run inside; restored after it.

    For jobs that end inside the block: a query that is still to run reads the
    settings of its own time.
    """
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows),
              "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Folders made inside each open ``scratch_scope``, innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables of every ``Scratch`` made inside it.

    What is read after it must have been written elsewhere inside it: results
    of the operators read their tables only when they run.
    """
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for root in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Numbered Parquet tables of one run in the shared checkpoint folder; see ``scratch_scope``."""

    def __init__(self, spark: SparkSession, name: str):
        self.root = run_folder(spark, name)
        if _SCOPES:
            _SCOPES[-1].append(self.root)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df, f"{self.root}/{name}-{uuid.uuid4().hex[:8]}")


def number_rows(df: DataFrame, scratch: Scratch, group: list[str], order: list[Column]) -> DataFrame:
    """``df`` with ``pos`` (from 0, gapless, by ``order``) and ``total`` (number of rows) inside each ``group``.

    Rows are sorted by range, so a group of any size lies over many tasks; the counts
    by (group, range), at most groups + ranges rows, give each range's first
    position.  Nulls of a group column are a group; no group column: all rows are one.
    """
    keys = [F.col(c).asc_nulls_first() for c in group]
    dealt = scratch.keep(
        df.repartitionByRange(partitions(df.sparkSession), *keys, *order).sortWithinPartitions(*keys, *order)
        .withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)), "dealt")
    per = dealt.groupBy(*group, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_count"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_range").alias("_r"),
        (F.coalesce(F.sum("_count").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_count").over(Window.partitionBy(*group)).alias("total"))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(group):
        same &= dealt[c].eqNullSafe(F.col(f"_g{i}"))
    return dealt.join(starts, same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "total")


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column end to end, and its n + 1 offsets (null: empty)."""
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_binary())
    _, offs, data = arr.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[arr.offset: arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]: offs[-1]], offs - offs[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` bytes, whole rows each."""
    _, offs = text_buffer(batch.column(column))
    start, n = 0, len(batch)
    while start < n:
        end = int(np.searchsorted(offs, offs[start] + limit, "right")) - 1
        end = min(n, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor-shift multiply), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS = np.ones(1, dtype=np.uint64)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the polynomial base modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n:
        size = max(64, 1 << (n - 1).bit_length())
        p = np.full(size, _BASE, dtype=np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document index) of every word; words never cross documents."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~WHITE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True  # a document starts (or the buffer ends) here
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    where = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    value = _BYTE_VALUES[data[np.repeat(start, size) + where]]
    value *= powers(int(size.max()))[where]
    return mix64(np.add.reduceat(value, np.cumsum(size) - size) + size.astype(np.uint64))

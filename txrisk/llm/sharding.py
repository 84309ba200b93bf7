"""Sharding by jump consistent hashing, with DataFrame functions only.

The shard of a row depends on its key and the number of shards alone: the key
seeds a 64-bit linear congruential generator whose draws give the growing
sequence of shard counts at which the key moves.  The shard is the last of
them below the shard count, so one more shard takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txrisk.llm.common import Scratch, partitions, table

# Fixed values of jump consistent hashing: the generator's multiplier and increment.
MULTIPLIER = 2862933555777941757
INCREMENT = 1

_LIMB = (1 << 22) - 1
_TOP = (1 << 20) - 1
#: A key moves about ln(n) times in all; so many moves never happen.
_MOST_MOVES = 128


def _lit(n: int) -> Column:
    return F.lit(n).cast("long")


def _next_state(key: Column) -> Column:
    """key * MULTIPLIER + INCREMENT modulo 2^64, by 22-bit limbs (long products would overflow)."""
    m0, m1, m2 = MULTIPLIER & _LIMB, MULTIPLIER >> 22 & _LIMB, MULTIPLIER >> 44
    k0 = key.bitwiseAND(_lit(_LIMB))
    k1 = F.shiftrightunsigned(key, 22).bitwiseAND(_lit(_LIMB))
    k2 = F.shiftrightunsigned(key, 44)
    r0 = k0 * _lit(m0) + _lit(INCREMENT)
    r1 = k0 * _lit(m1) + k1 * _lit(m0) + F.shiftright(r0, 22)
    r2 = k0 * _lit(m2) + k1 * _lit(m1) + k2 * _lit(m0) + F.shiftright(r1, 22)
    low = r0.bitwiseAND(_lit(_LIMB)).bitwiseOR(F.shiftleft(r1.bitwiseAND(_lit(_LIMB)), 22))
    return low.bitwiseOR(F.shiftleft(r2.bitwiseAND(_lit(_TOP)), 44))


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 .. shards - 1 of a long key (null key: as 0)."""
    if shards < 1:
        raise ValueError("shards must be positive")
    start = F.struct(F.coalesce(key.cast("long"), _lit(0)).alias("key"), _lit(0).alias("at"),
                     _lit(0).alias("next"))

    def move(s: Column, _: Column) -> Column:
        drawn = _next_state(s["key"])
        # floor((at + 1) * 2^31 / (top 31 bits + 1)), in whole numbers
        then = F.call_function("div", (s["next"] + _lit(1)) * _lit(1 << 31),
                               F.shiftrightunsigned(drawn, 33) + _lit(1))
        return F.when(s["next"] < _lit(shards),
                      F.struct(drawn.alias("key"), s["next"].alias("at"), then.alias("next"))
                      ).otherwise(s)

    steps = F.sequence(F.lit(1), F.lit(min(shards, _MOST_MOVES)))
    return F.aggregate(steps, start, move, lambda s: s["at"].cast("int"))


def assign_shards(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, size, text_crc32, law, shard, slot, grown_shard of every row.

    Size is the text's UTF-8 bytes plus 1 (null text: 1, checksum null).  Slots
    number the rows of a shard from 0 without gaps in the order of key, size and
    checksum (null first).  They come from a range-partitioned, written table:
    counts by (shard, partition), at most shards x partitions rows, give each
    partition's first slot, so no task ever orders a whole shard.  Rows with a
    null key go where key 0 goes; repeated rows are numbered one after another.
    An empty table gives an empty result.  Other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "sharding")
    rows = df.select(
        F.col(key),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.encode(F.col(text), "UTF-8")).alias("text_crc32"),
        jump_shard(F.col(key), shards).alias("shard"),
        jump_shard(F.col(key), shards + 1).alias("grown_shard"),
    )
    order = [F.col(key).asc_nulls_first(), F.col("size"), F.col("text_crc32").asc_nulls_first()]
    dealt = scratch.keep(
        rows.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id()),
        "dealt")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = (dealt.groupBy("shard", "part").count()
             .select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first")))
    inside = Window.partitionBy("shard", "part").orderBy(*order)
    return (dealt.withColumn("rank", F.row_number().over(inside))
            .join(F.broadcast(first), ["shard", "part"])  # at most shards x partitions rows
            .select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("first") + F.col("rank") - 1).alias("slot"), "grown_shard"))


def op4_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), 8)

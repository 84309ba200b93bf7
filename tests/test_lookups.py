"""Lookup tables are broadcast by measured rows and bytes, and released."""

from pyspark.sql import functions as F

from txrisk.operators import joins


def _strategy(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "strategy=broadcast" in plan


def test_bytes_decide_as_well_as_rows(spark):
    big = spark.range(100).withColumnRenamed("id", "k")
    few = spark.range(10).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    heavy = spark.range(10).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 100_000).alias("v"))
    assert _strategy(joins.lookup_join(big, few, "k"))
    assert not _strategy(joins.lookup_join(big, few, "k", max_rows=9))
    assert not _strategy(big.join(joins.broadcast_if_small(heavy, max_bytes=900_000), "k"))
    nested = heavy.select("k", F.struct("v").alias("s"), F.array("v").alias("a"))
    assert not _strategy(big.join(joins.broadcast_if_small(nested, max_bytes=900_000), "k"))
    assert _strategy(big.join(joins.broadcast_if_small(heavy.limit(0)), "k"))


def test_released_lookups_leave_results_right(spark):
    joins.release_lookups()
    out = joins.lookup_join(spark.range(50).withColumnRenamed("id", "k"),
                            spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), "k")
    before = sorted(map(tuple, out.collect()), key=repr)
    assert joins.release_lookups() == 1 and joins.release_lookups() == 0
    assert sorted(map(tuple, out.collect()), key=repr) == before

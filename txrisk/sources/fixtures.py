"""Fixture views over the driver's Parquet tables (FIXTURES.md §3).

``tx`` stands in for the reference's transaction table: events are the
transactions, ``user_id`` the customer, ``event_type`` the channel, and the
customer/nation/region join supplies merchant category, location and an
age band.  ``scored`` adds a deterministic model-probability stand-in.

Join strategy: ``nation`` and ``region`` are TPC-H fixed-size dimensions
(25 and 5 rows by definition), so their join is broadcast.  ``customer``
grows with the scale factor and is *not* forced to broadcast; Catalyst/AQE
pick broadcast or sort-merge from runtime sizes, and AQE's skew-join split
handles a hot ``user_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.sources.tables import read_table

# Fixed values of the fixture (FIXTURES.md)
MERCHANT_RISK = {
    "AUTOMOBILE": 0.1,
    "BUILDING": 0.2,
    "FURNITURE": 0.3,
    "HOUSEHOLD": 0.4,
    "MACHINERY": 0.5,
}
ONLINE_CHANNELS = ["view", "click", "signup"]
TIME_SPLIT_DATE = "2024-01-24"


def night(hour: Column) -> Column:
    return (hour >= 22) | (hour < 6)


def base(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """``events`` may be a streaming DataFrame: the dimension joins are then stream-static."""
    e = events if events is not None else read_table(spark, sf_dir, "events")
    e = e.select("event_id", "ts", "user_id", "event_type", "value", "props")
    c = read_table(spark, sf_dir, "customer",
                   ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    r = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    # 25 x 5 rows: a bounded TPC-H dimension, safe to broadcast.
    geo = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name")
    cust = c.join(F.broadcast(geo), c.c_nationkey == geo.n_nationkey)
    j = e.join(cust, e.user_id == cust.c_custkey)
    hour = F.hour("ts").cast("int")
    return j.select(
        F.col("event_id").alias("transaction_id"),
        F.col("user_id").alias("customer_id"),
        F.col("ts"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("channel"),
        F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"),
        F.col("c_mktsegment").alias("merchant_category"),
        F.concat(F.lit("B"), (F.col("user_id") % 10).cast("string")).alias("bank"),
        F.col("r_name").alias("location"),
        hour.alias("hour"),
        F.weekday("ts").cast("int").alias("day_of_week"),
        F.month("ts").cast("int").alias("month"),
        F.when(F.col("c_acctbal") < 1000, "<20")
        .when(F.col("c_acctbal") < 4000, "20-29")
        .when(F.col("c_acctbal") < 7000, "30-39")
        .otherwise("40+").alias("age_group"),
    )


def tx(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    b = base(spark, sf_dir, events)
    night_large = night(F.col("hour")) & (F.col("amount") > 100) & (F.col("k") < 60)
    return b.select(
        "*",
        F.when((F.col("k") < 1) | night_large, 1).otherwise(0).cast("int").alias("is_fraud"),
        F.when(F.col("k") < 1, "random").when(night_large, "night_large")
        .alias("fraud_technique"),
    )


def score_expr(night_bonus: bool = True) -> Column:
    s = F.floor(F.col("amount") * 2).cast("int")
    if night_bonus:
        s = s + F.when(night(F.col("hour")), 200).otherwise(0)
    s = s + ((F.col("transaction_id") * 37) % 100).cast("int")
    return F.least(F.lit(1000), s).cast("double") / F.lit(1000.0)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tx`` + ``score`` (model A stand-in) + ``score_b`` (model B, no night bonus)."""
    return tx(spark, sf_dir).select(
        "*", score_expr(True).alias("score"), score_expr(False).alias("score_b"))


def merchant_risk_col(col: str = "merchant_category") -> Column:
    m = F.create_map(*[x for k, v in MERCHANT_RISK.items() for x in (F.lit(k), F.lit(v))])
    return m[F.col(col)]

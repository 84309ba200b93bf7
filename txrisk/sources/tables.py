"""Scans (ops 1, 2): explicit-schema readers for transaction tables.

Parquet is the fast path (vectorised reader, pushed filters, pruned
``ReadSchema``); CSV is accepted with an explicit ``StructType`` only, never
with schema inference.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Canonical raw transaction schema (38 columns of the reference dictionary).
TRANSACTION_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("amount_log", T.DoubleType()),
    T.StructField("amount_rounded", T.IntegerType()),
    T.StructField("channel", T.StringType()),
    T.StructField("merchant_category", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("bank", T.StringType()),
    T.StructField("age_group", T.StringType()),
    T.StructField("hour", T.IntegerType()),
    T.StructField("day_of_week", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("is_weekend", T.BooleanType()),
    T.StructField("is_peak_hour", T.BooleanType()),
    T.StructField("hour_sin", T.DoubleType()),
    T.StructField("hour_cos", T.DoubleType()),
    T.StructField("day_sin", T.DoubleType()),
    T.StructField("day_cos", T.DoubleType()),
    T.StructField("month_sin", T.DoubleType()),
    T.StructField("month_cos", T.DoubleType()),
    T.StructField("tx_count_24h", T.DoubleType()),
    T.StructField("amount_sum_24h", T.DoubleType()),
    T.StructField("amount_mean_7d", T.DoubleType()),
    T.StructField("amount_std_7d", T.DoubleType()),
    T.StructField("tx_count_total", T.IntegerType()),
    T.StructField("amount_mean_total", T.DoubleType()),
    T.StructField("amount_std_total", T.DoubleType()),
    T.StructField("channel_diversity", T.IntegerType()),
    T.StructField("location_diversity", T.IntegerType()),
    T.StructField("online_channel_ratio", T.DoubleType()),
    T.StructField("amount_vs_mean_ratio", T.DoubleType()),
    T.StructField("velocity_score", T.DoubleType()),
    T.StructField("merchant_risk_score", T.DoubleType()),
    T.StructField("composite_risk", T.DoubleType()),
    T.StructField("is_fraud", T.IntegerType()),
    T.StructField("fraud_technique", T.StringType()),
])


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    """Read one driver table; ``columns`` prunes the scan (op 2)."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def scan_transactions(spark: SparkSession, path: str, fmt: str = "parquet",
                      schema: T.StructType = TRANSACTION_SCHEMA,
                      columns: list[str] | None = None) -> DataFrame:
    """Op 1: load a transaction table; Parquet first, CSV with a fixed schema.

    ``columns`` (op 2) is applied as a projection so Catalyst prunes the
    physical read to those columns.
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "csv":
        df = (spark.read.schema(schema).option("header", True)
              .option("mode", "FAILFAST").csv(path))
    elif fmt == "json":
        df = spark.read.schema(schema).json(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return df.select(*columns) if columns else df

"""Categorical encodings, schema-driven selection and quantile bins (ops 26-29)."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.operators.joins import lookup_join
from txrisk.operators.profile import exact_quantiles, numeric_columns
from txrisk.session import materialize, run_folder


def dictionary(df: DataFrame, col: str, code: str) -> DataFrame:
    """One row per distinct value of ``col`` (nulls left out) with its rank from 0 as ``code``.

    The distinct values are range-partitioned and written once to the shared checkpoint
    folder with the number of their range, so that ranges do not change in a re-run of a
    task; a value's rank is its place in its range plus the sizes of the ranges before (one
    row per shuffle partition).
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = (df.select(col).filter(F.col(col).isNotNull()).distinct().repartitionByRange(parts, col)
              .select(col, F.spark_partition_id().alias("__range")))
    ranges = materialize(ranges, run_folder(spark, "dictionary"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select(
        "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(col))
    return ranges.join(F.broadcast(sizes), "__range").select(col, (F.col("__before") + place - 1).alias(code))


# op 26
def label_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Alphabetical integer code per category (LabelEncoder semantics); null stays null.

    The codes are those of ``dictionary``, joined back: broadcast after a size check,
    shuffled for a column of many values.
    """
    out = out or f"{col}_encoded"
    codes = dictionary(df, col, out)
    return lookup_join(df, codes.select(col, F.col(out).cast("int").alias(out)), col, "left")


#: Most columns that ``one_hot`` makes when it looks up the values itself.
MAX_COLUMNS = 1_000


# op 27
def one_hot(df: DataFrame, col: str, values: list[str] | None = None,
            prefix: str | None = None) -> DataFrame:
    """One 0/1 int column per value (all kept, no drop-first).

    ``values`` fixes the output schema; when omitted the distinct values are looked up,
    at most ``MAX_COLUMNS`` of them: a wider column is an error here and a case for
    ``one_hot_sparse``.
    """
    prefix = prefix or col
    if values is None:
        found = df.select(col).filter(F.col(col).isNotNull()).distinct().limit(MAX_COLUMNS + 1).collect()
        if len(found) > MAX_COLUMNS:
            raise ValueError(f"{col} has more than {MAX_COLUMNS} values: use one_hot_sparse or name the values")
        values = sorted(r[0] for r in found)
    return df.select("*", *[(F.col(col) == F.lit(v)).cast("int").alias(f"{prefix}_{v}")
                            for v in values])


def one_hot_sparse(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """One sparse vector column with a place for every value of ``col``, in the values' order; null is all zeros.

    The wide form of ``one_hot``: its width is the size of the dictionary, and a row holds one number.
    """
    out, code = out or f"{col}_vector", "__code"
    codes = dictionary(df, col, code)
    n = codes.count()
    # nulls take the place behind the last value, which the encoder leaves out
    meta = {"ml_attr": {"name": code, "type": "nominal", "num_vals": n + 1}}
    coded = lookup_join(df, codes, col, "left").select(
        *df.columns, F.coalesce(F.col(code), F.lit(n)).cast("double").alias(code, metadata=meta))
    encoder = OneHotEncoder(inputCol=code, outputCol=out, dropLast=True)
    return encoder.fit(coded).transform(coded).drop(code)


# op 28
def prefix_select(df: DataFrame, prefixes=(), numeric: bool = False, exclude=(),
                  keep=()) -> DataFrame:
    cols = list(keep)
    if numeric:
        cols += [c for c in numeric_columns(df, exclude) if c not in cols
                 and not any(c.startswith(p) for p in prefixes)]
    cols += [c for c in df.columns if any(c.startswith(p) for p in prefixes) and c not in cols]
    cols = [c for c in cols if c not in set(exclude) or c in keep]
    return df.select(*cols)


# op 29
QUANTILE_LABELS = ["Low", "Medium", "High", "Very High"]


def quantile_bin(df: DataFrame, col: str, labels=QUANTILE_LABELS, out: str | None = None) -> DataFrame:
    """qcut-like bins: linear-interpolated quantile edges, right-closed intervals,
    lowest edge included; duplicate edges collapse bins (``duplicates='drop'``)."""
    out = out or f"{col}_bin"
    k = len(labels)
    probs = [i / k for i in range(1, k)]
    edges = exact_quantiles(df, [col], probs).select(F.col("q0").alias("__q"))  # one row
    j = df.crossJoin(F.broadcast(edges))
    x = F.col(col)
    expr = None
    for i, lab in enumerate(labels[:-1]):
        cond = x <= F.col("__q")[i]
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    expr = expr.when(x.isNotNull(), F.lit(labels[-1]))
    return j.select(*df.columns, expr.alias(out),
                    F.when(x.isNotNull(), F.lit(1) + sum(
                        (x > F.col("__q")[i]).cast("int") for i in range(k - 1)))
                    .alias(f"{out}_rank"))

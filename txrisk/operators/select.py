"""Filters, subsets, sorts and top-k (ops 37-41, 82-84a)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# op 37
def outcome(actual: str = "is_fraud", predicted: str = "predicted") -> Column:
    a, p = F.col(actual), F.col(predicted)
    return (F.when((a == 1) & (p == 1), "TP").when((a == 1) & (p == 0), "FN")
            .when((a == 0) & (p == 1), "FP").when((a == 0) & (p == 0), "TN"))


def outcome_subset(df: DataFrame, which: str | None = None, actual: str = "is_fraud",
                   predicted: str = "predicted") -> DataFrame:
    o = df.select("*", outcome(actual, predicted).alias("outcome"))
    return o.filter(F.col("outcome") == which) if which else o


# op 38
def sign_split(ranked: DataFrame, value: str = "r", name: str = "feature") -> DataFrame:
    """Positive side sorted descending, non-positive side ascending, ranked per side.

    The input is a short ranked list (one row per feature), so the per-side
    window is bounded by the number of features.
    """
    v = F.col(value)
    side = F.when(v > 0, "positive").otherwise("negative")
    key = F.when(v > 0, -v).otherwise(v)
    w = Window.partitionBy(side).orderBy(key, F.col(name))
    return ranked.select("*", side.alias("side"), F.row_number().over(w).alias("side_rank"))


# op 39
def queue_filter(cases: DataFrame, which: str = "all", case_type: str = "case_type") -> DataFrame:
    if which == "all":
        return cases
    return cases.filter(F.col(case_type) == which)


def queue_counts(cases: DataFrame, case_type: str = "case_type") -> DataFrame:
    ct = F.col(case_type)
    return cases.agg(F.count(F.lit(1)).alias("n_all"),
                     F.sum((ct == "true_fraud").cast("long")).alias("n_true_fraud"),
                     F.sum((ct == "false_positive").cast("long")).alias("n_false_positive"))


# op 39a
def case_lookup(cases: DataFrame, case_id, id_col: str = "id") -> DataFrame:
    return cases.filter(F.col(id_col) == F.lit(case_id))


# op 40
def allowlist_filter(df: DataFrame, col: str, allow: list[str] | None = None,
                     deny: list[str] | None = None) -> DataFrame:
    spark = df.sparkSession
    out = df
    if allow is not None:  # literal parameter list: bounded, broadcast
        a = spark.createDataFrame([(x,) for x in allow], f"`{col}` string")
        out = out.join(F.broadcast(a), col, "left_semi")
    if deny:
        d = spark.createDataFrame([(x,) for x in deny], f"`{col}` string")
        out = out.join(F.broadcast(d), col, "left_anti")
    return out


# op 41
def dropna_stats(df: DataFrame, col: str) -> DataFrame:
    x = F.col(col).cast("double")
    return (df.dropna(subset=[col])
            .agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")))


# op 82
def top_bottom_union(df: DataFrame, value: str, name: str, n: int = 10) -> DataFrame:
    """Top n and bottom n by value (ties by name), union, de-duplicated, re-sorted."""
    top = df.orderBy(F.col(value).desc(), F.col(name)).limit(n)
    bottom = df.orderBy(F.col(value).asc(), F.col(name)).limit(n)
    return top.union(bottom).distinct().orderBy(F.col(value).desc(), F.col(name))


# op 83
def triage_order(cases: DataFrame, case_type: str = "case_type", prob: str = "fraud_probability",
                 fraud_first: bool = False) -> DataFrame:
    """By case type then probability descending.  The reference sorts the type
    ascending (false_positive first); ``fraud_first`` gives the documented intent."""
    ct = F.col(case_type).desc() if fraud_first else F.col(case_type).asc()
    return cases.orderBy(ct, F.col(prob).desc())


# op 84
def top_k_abs(df: DataFrame, value: str, name: str, k: int = 2) -> DataFrame:
    return df.orderBy(F.abs(F.col(value)).desc(), F.col(name)).limit(k)


# op 84a
def preview(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    return df.orderBy(key).limit(n)

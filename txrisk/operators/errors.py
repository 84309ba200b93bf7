"""Error analysis and fairness over scored rows (ops 111-117).

Every table is one grouped aggregation with conditional counts; the group
threshold search (117) reuses per-group cumulative counts over distinct
scores, so no group's raw rows are ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR_BANDS = [(0, 6, "00-06"), (6, 12, "06-12"), (12, 18, "12-18"), (18, 24, "18-24")]


# op 111
def fn_by(df: DataFrame, group: str = "channel", label: str = "is_fraud",
          predicted: str = "predicted") -> DataFrame:
    f = df.filter((F.col(label) == 1) & F.col(group).isNotNull())
    return (f.groupBy(group)
            .agg(F.count(F.lit(1)).alias("total_fraud"),
                 F.sum((F.col(predicted) == 0).cast("long")).alias("missed"))
            .select("*", (F.col("missed").cast("double") / F.col("total_fraud")).alias("fn_rate")))


# op 112
def fp_by(df: DataFrame, group: str = "channel", label: str = "is_fraud",
          predicted: str = "predicted") -> DataFrame:
    f = df.filter((F.col(label) == 0) & F.col(group).isNotNull())
    return (f.groupBy(group)
            .agg(F.sum((F.col(predicted) == 1).cast("long")).alias("fp_count"),
                 F.count(F.lit(1)).alias("legit_rows"))
            .select("*", (F.col("fp_count").cast("double") / F.col("legit_rows")).alias("fp_rate")))


# op 113
def fn_amount_share(df: DataFrame, amount: str = "amount", mean: str = "amount_mean_prior",
                    std: str = "amount_std_prior", small: float = 200.0, k_sigma: float = 2.0,
                    label: str = "is_fraud", predicted: str = "predicted") -> DataFrame:
    fn = df.filter((F.col(label) == 1) & (F.col(predicted) == 0))
    within = (F.abs(F.col(amount) - F.col(mean)) <= F.lit(k_sigma) * F.col(std))
    return fn.agg(F.count(F.lit(1)).alias("n_missed"),
                  F.avg((F.col(amount) < small).cast("double")).alias("share_small_amount"),
                  F.avg(F.when(F.col(std).isNotNull(), within.cast("double")))
                  .alias("share_within_k_sigma"))


# op 114
def hour_band(hour: str = "hour"):
    h = F.col(hour)
    e = None
    for lo, hi, name in HOUR_BANDS:
        c = (h >= lo) & (h < hi)
        e = F.when(c, name) if e is None else e.when(c, name)
    return e


def fn_by_hour(df: DataFrame, hour: str = "hour", label: str = "is_fraud",
               predicted: str = "predicted") -> DataFrame:
    return fn_by(df.select("*", hour_band(hour).alias("hour_band")), "hour_band", label, predicted)


# op 115
def fp_profiles(df: DataFrame, label: str = "is_fraud", predicted: str = "predicted",
                large_amount: float = 800.0, ratio: float = 5.0, velocity: float = 5.0,
                new_account: int = 10, online=("view", "click", "signup"),
                amount: str = "amount", ratio_col: str = "amount_vs_mean_ratio_safe",
                count24: str = "tx_count_24h", weekend: str = "is_weekend",
                prior_count: str = "tx_count_prior", hour: str = "hour",
                channel: str = "channel") -> DataFrame:
    """First-match profile of each false positive, with counts and shares."""
    h = F.col(hour)
    prof = (F.when((F.col(amount) > large_amount) & (F.col(ratio_col) > ratio), "large_amount")
            .when((F.col(count24) > velocity) & F.col(weekend), "velocity_weekend")
            .when(F.col(prior_count) < new_account, "new_account")
            .when((h >= 0) & (h < 6) & F.col(channel).isin(list(online)), "off_peak_online")
            .otherwise("other"))
    fp = df.filter((F.col(label) == 0) & (F.col(predicted) == 1)).select(prof.alias("profile"))
    g = fp.groupBy("profile").agg(F.count(F.lit(1)).alias("n"))
    return g.select("profile", "n", (F.col("n").cast("double") / F.sum("n").over(Window.partitionBy()))
                    .alias("share"))


# op 116
def fp_rate_by(df: DataFrame, group: str = "bank", label: str = "is_fraud",
               predicted: str = "predicted") -> DataFrame:
    t = fp_by(df, group, label, predicted)
    overall = (df.filter(F.col(label) == 0)
               .agg((F.sum((F.col(predicted) == 1).cast("long")).cast("double")
                     / F.count(F.lit(1))).alias("overall_fp_rate")))
    return t.crossJoin(overall).select(
        "*", F.when(F.col("overall_fp_rate") > 0, F.col("fp_rate") / F.col("overall_fp_rate"))
        .alias("relative_to_overall"))


# op 117
def group_threshold(df: DataFrame, group: str = "bank", score: str = "score",
                    label: str = "is_fraud", target_fpr: float | None = None,
                    base_threshold: float = 0.5) -> DataFrame:
    """Per-group threshold t_g = smallest legitimate score s of the group with
    #(legit, score > s) / #legit <= target (rule p > t).  Default target: the
    overall FP rate at ``base_threshold``.

    Counts "above s" come from per-group cumulative counts over the distinct
    scores, bucketed like the ROC table -- never a window over one group's
    rows, so a bank holding a third of the rows is still split across tasks.
    """
    from txrisk.operators.metrics import cumulative_by_score

    legit = df.filter((F.col(label) == 0) & F.col(group).isNotNull())
    if target_fpr is None:
        tgt = legit.agg((F.sum((F.col(score) > base_threshold).cast("long")).cast("double")
                         / F.count(F.lit(1))).alias("target_fpr"))
    else:
        tgt = df.sparkSession.range(1).select(F.lit(float(target_fpr)).alias("target_fpr"))
    # legit rows only: every row is a "negative"; fp(s) = #(score >= s)
    cum = cumulative_by_score(legit.select(group, score, F.lit(0).alias("__y")), score, "__y",
                              group=group)
    c = cum.select(group, score, (F.col("fp") - F.col("neg")).alias("__above"),
                   F.col("N").alias("n_legit"))
    c = c.crossJoin(tgt).filter(F.col("__above") <= F.col("target_fpr") * F.col("n_legit"))
    return (c.groupBy(group).agg(F.min(score).alias("threshold"), F.first("n_legit").alias("n_legit"),
                                 F.first("target_fpr").alias("target_fpr"),
                                 F.max_by("__above", F.struct(-F.col(score))).alias("__fp"))
            .select(group, "threshold", F.col("n_legit").cast("long").alias("n_legit"), "target_fpr",
                    (F.col("__fp").cast("double") / F.col("n_legit")).alias("fp_rate_at_threshold")))

"""Invariants for rows-only operators and scale-critical shapes."""

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from txrisk.functions import text as X
from txrisk.operators import history as H, metrics as M, split
from txrisk.sources import fixtures as fx


def test_auc_equals_mllib(spark):
    s = fx.scored(spark, SF_MID)
    ours = M.auc_roc(M.cumulative_by_score(s, "score")).first()["auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="is_fraud", numBins=0)
    ref = ev.evaluate(s.select("score", F.col("is_fraud").cast("double")))
    assert ours == pytest.approx(ref, abs=1e-9)
    assert ours == pytest.approx(0.841450742, abs=1e-9)  # FIXTURES.md


def test_all_scores_equal_auc_half(spark):
    s = fx.tx(spark, SF_SMALL).select("is_fraud", F.lit(0.5).alias("score"))
    assert M.auc_roc(M.cumulative_by_score(s)).first()["auc"] == pytest.approx(0.5)


def test_stratified_split_exact_quota(spark):
    t = fx.tx(spark, SF_MID).select("transaction_id", "is_fraud")
    s = split.stratified_split(t).filter("is_test").groupBy("is_fraud").count()
    got = {r["is_fraud"]: r["count"] for r in s.collect()}
    assert got == {1: 70, 0: 1930}  # FIXTURES.md


def test_split_cut_bucket_with_one_digit(spark):
    """Coarse buckets (16) force big cut buckets; still the exact md5 ranking."""
    t = fx.tx(spark, SF_SMALL).select("transaction_id", "is_fraud")
    a = split.stratified_split(t, hex_digits=1).filter("is_test").select("transaction_id")
    w = Window.partitionBy("is_fraud").orderBy(F.md5(F.col("transaction_id").cast("string")),
                                               "transaction_id")
    b = (t.select("*", F.row_number().over(w).alias("r"),
                  F.count(F.lit(1)).over(Window.partitionBy("is_fraud")).alias("n"))
         .filter(F.col("r") <= F.round(F.col("n") * 0.2)).select("transaction_id"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _hot(spark, d):
    """A third of all rows moved onto one customer (skew fixture derived from tx)."""
    t = fx.tx(spark, d).select("transaction_id", "customer_id", "ts", "amount", "channel", "location")
    return t.withColumn("customer_id", F.when(F.col("transaction_id") % 3 == 0, F.lit(-1))
                        .otherwise(F.col("customer_id")))


@pytest.mark.parametrize("bucket_hours", [None, 6])
def test_halo_window_equals_plain_window_under_skew(spark, bucket_hours):
    t = _hot(spark, SF_MID)
    ours = H.win_24h(t, bucket_us=bucket_hours and bucket_hours * H.US_PER_HOUR)
    w = (Window.partitionBy("customer_id").orderBy(H.epoch_micros("ts"))
         .rangeBetween(-24 * H.US_PER_HOUR, 0))
    ref = t.select("transaction_id", F.count("amount").over(w).alias("c"),
                   F.sum(F.col("amount").cast("decimal(18,2)")).over(w).cast("double").alias("s"))
    j = ours.join(ref, "transaction_id")
    bad = j.filter((F.col("c") != F.col("tx_count_24h")) | (F.abs(F.col("s") - F.col("amount_sum_24h")) > 1e-9))
    assert j.count() == t.count() and bad.count() == 0


def test_prior_prefix_sums_equal_plain_window_under_skew(spark):
    t = _hot(spark, SF_MID)
    ours = H.prior_mean_ratio(t)
    w = (Window.partitionBy("customer_id").orderBy("ts", "transaction_id")
         .rowsBetween(Window.unboundedPreceding, -1))
    ref = t.select("transaction_id", F.coalesce(F.avg("amount").over(w), F.col("amount")).alias("m"))
    bad = ours.join(ref, "transaction_id").filter(
        F.abs(F.col("m") - F.col("customer_mean_amount_prior")) > 1e-9)
    assert bad.count() == 0


def test_halo_plan_partitions_by_customer_and_bucket(spark):
    t = fx.tx(spark, SF_SMALL).select("transaction_id", "customer_id", "ts", "amount")
    plan = H.win_24h(t)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(customer_id" in plan and "__b" in plan


def test_prefix_safety_verdicts(spark):
    from __spark_entry__ import queries

    rows = {r["feature"]: r["is_prefix_safe"] for r in queries()["prefix_safety"](spark, SF_SMALL).collect()}
    assert rows == {"amount_sum_24h": True, "customer_mean_amount_prior": True,
                    "amount_mean_total": False}


def test_manual_prompt_cases(spark):
    """The two hand-tested cases of the reference as literal records."""
    rows = [(6188809, 1, 0.83, 12000.0, "Mobile", 23, "B1", "Lagos", "30-39",
             [("amount", 0.224), ("composite_risk", 0.145), ("merchant_risk_score", -0.020)]),
            (170841, 1, 0.50, 5000.0, "POS", 6, "B2", "Abuja", "20-29",
             [("amount", 0.066), ("merchant_risk_score", -0.044), ("month", 0.036)])]
    df = spark.createDataFrame(rows, "id long, predicted int, fraud_probability double, amount double, "
                                     "channel string, hour int, bank string, location string, "
                                     "age_group string, top_factors array<struct<feature:string,value:double>>")
    p = {r["id"]: r["p"] for r in df.select("id", X.build_prompt().alias("p")).collect()}
    assert "- Transaction amount (contribution: +0.224)" in p[6188809]
    assert "- Merchant risk score (contribution: -0.020)" in p[6188809]
    assert "- Hour: 6 AM" in p[170841] and "- Confidence: 50%" in p[170841]
    assert "- Amount: ₦12,000" in p[6188809] and "- Hour: 11 PM" in p[6188809]


def test_parse_features_rejects_unknown(spark):
    text = "FEATURE: **amount_sum_24h**\nREASONING: x\nfeature: tx_count_24h\nFEATURE: made_up"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.parse_features(F.col("t"))).first()[0] == ["amount_sum_24h", "tx_count_24h",
                                                                  "made_up"]


def test_usefulness_and_faithfulness(spark):
    df = spark.createDataFrame(
        [("Primary reason: large amount at night. Factors:\n- amount\nHigh risk. Block it.",
          [("amount", 0.3), ("hour", 0.1), ("bank_B1", 0.05)])],
        "explanation string, top_factors array<struct<feature:string,value:double>>")
    r = df.select(X.usefulness().alias("u"), X.faithfulness().alias("f"),
                  X.faithfulness(strict=True).alias("s")).first()
    assert r["u"] == 4
    assert r["f"] == pytest.approx(2 / 3)  # 'night' for hour, no bank word
    assert r["s"] == pytest.approx(2 / 3)


def test_empty_and_single_class_metrics(spark):
    s = fx.scored(spark, SF_SMALL)
    empty = s.filter(F.lit(False))
    assert M.core_metrics(empty).first()["accuracy"] == 0.0
    one = s.filter("is_fraud = 0")
    r = M.core_metrics(one).first()
    assert r["recall"] == 0.0 and r["tp"] == 0


def test_prior_distinct_equals_plain_window_under_skew(spark):
    t = _hot(spark, SF_MID)
    ours = H.history_features(t)
    w = (Window.partitionBy("customer_id").orderBy("ts", "transaction_id")
         .rowsBetween(Window.unboundedPreceding, -1))
    ref = t.select("transaction_id", F.size(F.collect_set("channel").over(w)).alias("c"),
                   F.size(F.collect_set("location").over(w)).alias("l"), F.count("amount").over(w).alias("n"))
    bad = ours.join(ref, "transaction_id").filter(
        (F.col("c") != F.col("channel_diversity_prior")) | (F.col("l") != F.col("location_diversity_prior"))
        | (F.col("n") != F.col("tx_count_prior")))
    assert bad.count() == 0


def test_risk_by_many_equals_single_tables(spark):
    from txrisk.operators import risk

    t = fx.tx(spark, SF_SMALL)
    many = risk.risk_by_many(t, ["channel", "bank"])
    for d in ["channel", "bank"]:
        part = many.filter(F.col(d).isNotNull()).select(d, "total", "fraud_cases")
        single = risk.risk_by(t, d).select(d, "total", "fraud_cases")
        assert part.exceptAll(single).count() == 0 and single.exceptAll(part).count() == 0


def test_windows_with_timestamp_ties_on_orders(spark):
    """orders has same-day ties per customer: RANGE frames include peers, ROWS
    frames order by (ts, id); compare with DuckDB's native window frames."""
    import duckdb

    from txrisk.sources.tables import read_table

    o = read_table(spark, SF_SMALL, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    o = o.select(F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("customer_id"),
                 F.col("o_orderdate").alias("ts"), F.round("o_totalprice", 2).alias("amount"))
    ours = H.prior_mean_ratio(H.win_24h_7d(o)).select(
        "transaction_id", "tx_count_24h", F.col("amount_sum_24h").alias("s24"),
        "tx_count_7d", F.col("customer_mean_amount_prior").alias("pm")).toPandas()
    w24 = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)"
    w7 = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)"
    wp = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    a = "CAST(round(o_totalprice, 2) AS DECIMAL(18,2))"
    src = f"read_parquet('{SF_SMALL}/orders.parquet')"
    ref = duckdb.sql(f"""SELECT o_orderkey AS transaction_id, count(*) {w24} AS tx_count_24h,
        CAST(sum({a}) {w24} AS DOUBLE) AS s24, count(*) {w7} AS tx_count_7d FROM {src}""").df()
    pm = duckdb.sql(f"""SELECT o_orderkey AS transaction_id,
        coalesce(CAST(sum({a}) {wp} AS DOUBLE) / count(*) {wp}, CAST({a} AS DOUBLE)) AS pm
        FROM {src}""").df()
    ref = ref.merge(pm, on="transaction_id")
    m = ours.merge(ref, on="transaction_id", suffixes=("", "_ref"))
    assert len(m) == len(ref) == len(ours)
    for c in ["tx_count_24h", "s24", "tx_count_7d", "pm"]:
        bad = m[(m[c] - m[f"{c}_ref"]).abs() >= 1e-6]
        assert bad.empty, (c, bad.head(3).to_dict("records"))


def _exchanges(df):
    import re

    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange (hashpartitioning\([^)]*\)|SinglePartition|rangepartitioning\([^)]*\))",
                      plan)


def test_history_plan_shuffles_rows_once(spark):
    """All prior-row features: the rows are shuffled once, on (customer, bucket); other
    exchanges only move the per-bucket summary table."""
    t = fx.tx(spark, SF_SMALL).select("transaction_id", "customer_id", "ts", "amount", "channel", "location")
    ex = _exchanges(H.history_features(t))
    assert "SinglePartition" not in ex
    assert all(e.startswith(("hashpartitioning(__k", "hashpartitioning(customer_id")) for e in ex)


def test_risk_table_plan_is_partial_aggregate(spark):
    from txrisk.operators import risk

    plan = risk.risk_by(fx.tx(spark, SF_SMALL), "channel")._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "SinglePartition" not in plan


def test_prefix_safety_all_history_ops(spark):
    """Op 80 passes for ops 73-77 (look-back only) and fails for 30 and 66 (lifetime)."""
    t = fx.tx(spark, SF_SMALL).select("transaction_id", "customer_id", "ts", "amount", "channel", "location")

    def feats(x):
        w = H.prior_mean_ratio(H.win_24h_7d(x))
        w = H.history_features(w)
        w = H.amount_vs_lifetime_ratio(H.profile_join_back(w))
        return w

    full = feats(t)
    pre = feats(t.filter(F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")))
    clean = ["tx_count_24h", "amount_sum_24h", "tx_count_7d", "amount_mean_7d", "amount_std_7d",
             "customer_mean_amount_prior", "amount_vs_mean_ratio_safe", "tx_count_prior",
             "amount_mean_prior", "channel_diversity_prior", "online_channel_ratio_prior"]
    leaky = ["amount_mean_total", "tx_count_total", "amount_vs_mean_ratio"]
    got = {}
    for c in clean + leaky:
        got[c] = H.prefix_safety(full, pre, "transaction_id", c).first()["is_prefix_safe"]
    assert all(got[c] for c in clean), got
    assert not any(got[c] for c in leaky), got

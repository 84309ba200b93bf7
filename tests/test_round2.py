"""Awkward inputs of the history frames and sums, quantiles, the narration function and the AUC."""

import datetime as dt
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from txrisk.functions import text as X
from txrisk.operators import history as H
from txrisk.operators import encode
from txrisk.operators import metrics as M
from txrisk.operators import profile
from txrisk.operators import shap
from txrisk.plans import discovery


def test_null_amounts_and_times_in_prior_means(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, "a", day(1), 10.0), (2, "a", day(2), None), (3, "a", day(3), 30.0), (4, "a", None, 7.0)]
    df = spark.createDataFrame(rows, "transaction_id long, customer_id string, ts timestamp_ntz, amount double")
    got = {r.transaction_id: r.customer_mean_amount_prior for r in H.prior_mean_ratio(df).collect()}
    assert got == {4: 7.0, 1: 7.0, 2: 8.5, 3: 8.5}


def test_narrate_with_a_user_function(spark):
    df = spark.createDataFrame([(1, "p"), (2, "q")], "id long, prompt string")
    out = X.narrate(df, fn=lambda s: s + "!")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "p", "p!"), (2, "q", "q!")] and df.columns == ["id", "prompt"]


def test_auc_of_many_rows(spark):
    n = 4_000_000_000
    cum = spark.createDataFrame([(0.9, n, 0, n, 0, n, n), (0.1, 0, n, n, n, n, n)],
                                "score double, pos long, neg long, tp long, fp long, P long, N long")
    assert M.auc_roc(cum.select("*", F.lit(1).alias("x"))).first().auc == 1.0


TX = "transaction_id long, customer_id string, ts timestamp_ntz, amount double"


def test_frames_of_repeated_ids_missing_values_and_small_amounts(spark):
    at = lambda d, h=0: dt.datetime(2024, 1, d, h)
    rows = [(1, "a", at(1), 0.004), (1, "a", at(1), 10.005), (2, "a", at(1, 20), None), (3, "a", at(2), 1.0),
            (4, "a", at(2, 1), 2.0), (5, "a", None, 7.0), (6, "a", None, 8.0), (7, None, at(1), 3.0), (8, None, at(1, 1), 4.0)]
    got = sorted((r.transaction_id, r.tx_count_24h, round(r.amount_sum_24h, 9))
                 for r in H.win_24h(spark.createDataFrame(rows, TX)).collect())
    assert got == [(1, 2, 10.009), (1, 2, 10.009), (2, 2, 10.009), (3, 3, 11.009), (4, 2, 3.0), (5, 2, 15.0), (6, 2, 15.0),
                   (7, 1, 3.0), (8, 2, 7.0)]
    assert H.win_24h_7d(spark.createDataFrame([], TX)).collect() == []


def test_frame_of_null_amounts_alone(spark):
    r = H.win_24h_7d(spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1), None)], TX)).first()
    assert (r.tx_count_24h, r.amount_sum_24h, r.tx_count_7d, r.amount_mean_7d, r.amount_std_7d) == (0, None, 0, None, None)


def test_no_exchange_of_rows_by_customer_alone(spark):
    """Points, events and rows move by (customer, time) or (customer, hour); by customer alone only bucket totals do."""
    plan = H.win_24h_7d(spark.createDataFrame([], TX))._jdf.queryExecution().executedPlan().toString()
    keys = [re.sub(r"#\d+L?", "", k) for k in re.findall(r"hashpartitioning\((.*), \d+\)", plan)]
    assert set(keys) <= {"__at", "customer_id, __t", "__k, __b", "__k"} and keys.count("__k") == 1


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 101, 60_000])
def test_exact_quantiles_against_numpy(spark, n):
    rng = np.random.default_rng(n)
    a, b = rng.normal(size=n), rng.integers(0, 4, size=n).astype(float)  # distinct values; heavy ties
    rows = [(float(x), float(y)) for x, y in zip(a, b)] + [(None, None), (float("nan"), None)]
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    df = spark.createDataFrame(rows, "a double, b double")
    q = profile.exact_quantiles(df, ["a", "b"], probs).first()
    for got, x in ((q.q0, a), (q.q1, b)):
        assert got == ([None] * 6 if n == 0 else pytest.approx(list(np.quantile(x, probs)), abs=1e-12))
    assert "percentile(" not in profile.profile_describe(df)._jdf.queryExecution().executedPlan().toString()


def test_quantile_bins_of_an_empty_table(spark):
    assert encode.quantile_bin(spark.createDataFrame([], "a double"), "a").collect() == []


def test_prior_distinct_of_repeated_rows_nulls_and_inclusive_counts(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, "a", day(1), "x"), (2, "a", day(1), "y"), (3, "a", day(2), None), (4, "a", day(3), "x"), (5, None, day(3), "x")]
    df = spark.createDataFrame(rows, "transaction_id long, customer_id string, ts timestamp_ntz, v string")
    counts = lambda inc: {r.transaction_id: r.d for r in H.prior_distinct(
        df, "customer_id", "ts", "transaction_id", {"d": "v"}, inclusive=inc).collect()}
    assert counts(False) == {1: 0, 2: 1, 3: 2, 4: 2, 5: 0} and counts(True) == {1: 1, 2: 2, 3: 2, 4: 2, 5: 1}


def test_waterfall_steps_by_size_with_running_totals(spark):
    wide = spark.createDataFrame([(1, 0.5, 0.1, -0.3, 0.1), (2, 0.5, 0.0, 0.0, 0.2)],
                                 "id long, base_value double, shap_b double, shap_c double, shap_a double")
    out = shap.shap_waterfall(wide, ["b", "c", "a"], "id")
    got = [(r.id, r.step, r.feature, round(r.cumulative, 9)) for r in out.orderBy("id", "step").collect()]
    assert got == [(1, 1, "c", 0.2), (1, 2, "a", 0.3), (1, 3, "b", 0.4), (2, 1, "a", 0.7), (2, 2, "b", 0.7), (2, 3, "c", 0.7)]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_proposal_without_a_candidate_falls_back_to_the_largest_z(spark):
    z = spark.createDataFrame([("a", -3.0), ("b", 2.0), ("c", 2.5)], "feature string, fn_anomaly_z double")
    said = lambda t: [tuple(r) for r in discovery.accepted_features(
        z, spark.createDataFrame([(t,)], "text string")).orderBy("position").collect()]
    assert said("FEATURE: made_up") == said("") == [(1, "a"), (2, "c")]
    assert said("FEATURE: x\nFEATURE: **b**") == [(1, "b")]

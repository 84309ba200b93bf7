"""Invariants of the rows-only model, SHAP and streaming queries (sf0.001)."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from conftest import SF_SMALL
from txrisk.operators import models as ML

Q = queries()


def test_shap_additivity(spark):
    r = Q["shap_additivity"](spark, SF_SMALL).first()
    assert r["n_rows"] > 0 and r["max_abs_error"] <= 1e-6 and r["additive"]


def test_importance_sums_to_one(spark):
    from txrisk.operators import models as ML
    from txrisk.plans.models import FEATURES

    total = sum(r["importance"] for r in
                ML.rf_importance(__import__("txrisk.plans.models", fromlist=["rf_model"])
                                 .rf_model(spark, SF_SMALL), FEATURES, top=len(FEATURES)).collect())
    assert total == pytest.approx(1.0, abs=1e-9)


def test_model_reload_same_scores(spark):
    assert all(r["same"] for r in Q["model_persist"](spark, SF_SMALL).collect())


def test_shap_top3_sorted_by_abs(spark):
    for r in Q["shap_top3"](spark, SF_SMALL).limit(50).collect():
        v = [abs(x["value"]) for x in r["top_shap_features"]]
        assert v == sorted(v, reverse=True) and len(v) == 3


def test_ablation_and_cv_run(spark):
    a = Q["feature_ablation"](spark, SF_SMALL).first()
    assert a["verdict"] in ("IMPROVED", "NO MEANINGFUL CHANGE", "WORSE")
    assert a["n_newly_caught"] >= 0 and a["n_newly_missed"] >= 0
    cv = Q["random_search_cv"](spark, SF_SMALL).collect()
    assert len(cv) == 100 and all(0.0 <= r["mean_auc"] <= 1.0 for r in cv)


def test_stream_score_dedups(spark):
    df = Q["stream_score"](spark, SF_SMALL)
    assert df.count() == df.select("transaction_id").distinct().count() > 0


def test_training_has_no_more_partitions_than_can_run_at_once(spark, monkeypatch):
    """Every partition sends the statistics of all nodes."""
    seen = []

    class Spy:
        def __init__(self, stages):
            pass

        def fit(self, df):
            seen.append((df.rdd.getNumPartitions(), df.count()))

    monkeypatch.setattr(ML, "Pipeline", Spy)
    rows = spark.range(400).select((F.col("id") % 2).cast("int").alias("is_fraud"), F.col("id").cast("double").alias("a"))
    cores = spark.sparkContext.defaultParallelism
    ML.train_rf(rows.repartition(5 * cores), ["a"])
    ML.train_rf(rows.coalesce(1), ["a"])
    assert seen == [(cores, 400), (1, 400)]


def test_split_and_shap_rows_are_written_once_and_not_cached(spark):
    from txrisk.plans import models as P

    for made in (P.split_frame(spark, SF_SMALL), P.shap_wide(spark, SF_SMALL)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Scan parquet" in plan and "Exchange " not in plan and "InMemoryTableScan" not in plan and "MapInPandas" not in plan
    assert P.shap_wide(spark, SF_SMALL).count() == P.test_rows(spark, SF_SMALL).count()

"""Discovery document, follow-up context, rating sheets, search grid and fitted objects."""

import json
import shutil
import tempfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from __spark_entry__ import queries
from conftest import SF_SMALL
from txrisk.functions import text as X
from txrisk.operators import models as ML, search
from txrisk.plans import discovery as D, models as P

Q = queries()


def case(spark, **over):
    base = dict(amount=1250.0, channel="web", hour=23, bank="B1", location="ASIA", age_group="40+", predicted=1,
                is_fraud=0, fraud_probability=0.805, top_factors=[Row(feature="amount", value=0.5),
                                                                  Row(feature="hour", value=-0.25)],
                explanation="because", question="why?", history=[Row(role="user", text="a"), Row(role="assistant", text=None)])
    base.update(over)
    schema = ("amount double, channel string, hour int, bank string, location string, age_group string, predicted int, "
              "is_fraud int, fraud_probability double, top_factors array<struct<feature:string,value:double>>, "
              "explanation string, question string, history array<struct<role:string,text:string>>")
    return spark.createDataFrame([tuple(base[f.split()[0]] for f in schema.split(", "))], schema)


def test_followup_context_has_case_turns_and_question(spark):
    got = case(spark).select(X.build_followup_context(history="history")).first()[0]
    head, turns = got.split("under 80 words.")
    assert "- Prediction: FRAUD\n- Confidence: 81%\n- Actual outcome: legitimate" in head
    assert ": +0.500\n- " in head and ": -0.250" in head and "ANALYST:\nbecause" in head
    assert turns == "\n\nAnalyst: a\n\nAssistant: \n\nAnalyst: why?"


@pytest.mark.parametrize("question", [None, "", "  "])
def test_followup_context_needs_a_question(spark, question):
    assert case(spark, question=question).select(X.build_followup_context()).first()[0] is None


def test_followup_context_without_turns(spark):
    got = case(spark, history=None).select(X.build_followup_context(history="history")).first()[0]
    assert got.endswith("under 80 words.\n\nAnalyst: why?")


def test_discovery_document_sections(spark):
    doc = json.loads(Q["sink_discovery_json"](spark, SF_SMALL).first()["document"])
    assert set(doc) == {"falseNegativeAnalysis", "llmProposal", "impact", "leakageCheck"}
    z = [abs(c["anomalyZ"]) for c in doc["falseNegativeAnalysis"]["candidates"]]
    assert len(z) == len(D.CANDIDATE_COLUMNS) and z == sorted(z, reverse=True)
    prop, impact, leak = doc["llmProposal"], doc["impact"], doc["leakageCheck"]
    assert prop["modelUsed"] == "template" and "invented_feature" in prop["rawResponse"]
    assert sorted(impact["candidateFeatures"] + impact.get("excludedLeakyFeatures", [])) == sorted(prop["recommendedFeatures"])
    assert not set(impact["candidateFeatures"]) & set(D.KNOWN_LEAKY)
    assert "amount_mean_total" in leak["leakyColumns"] and "amount_sum_24h" in leak["cleanColumns"]
    assert set(leak["compositeRiskCorrelation"]) == set(D.RISK_CORRELATES)
    assert "amount_mean_total" in leak["conclusion"]


def test_ablation_leaves_out_leaky_names(spark):
    a = P.ablation(spark, SF_SMALL, ["amount_vs_mean_ratio", "tx_count_24h"]).first()
    assert a["candidate_features"] == "tx_count_24h" and a["excluded_leaky_features"] == "amount_vs_mean_ratio"
    with pytest.raises(ValueError, match="leak"):
        P.ablation(spark, SF_SMALL, ["amount_vs_mean_ratio"])


def test_ablation_of_a_feature_the_model_has_changes_nothing(spark):
    a = P.ablation(spark, SF_SMALL, ["amount_sum_24h"]).first()
    assert a["auc_delta"] == 0.0 and a["n_newly_caught"] == a["n_newly_missed"] == 0


def test_sheet_and_mapping_number_the_same_cases(spark):
    sheet = {r["case_id"]: r["explanation"] for r in Q["sink_csv_sheets"](spark, SF_SMALL).collect()}
    mapping = {r["case_id"]: r["row_index"] for r in Q["sink_rating_mapping"](spark, SF_SMALL).collect()}
    text = {r["transaction_id"]: r["explanation"] for r in Q["narrate"](spark, SF_SMALL).collect()}
    assert sheet and sheet == {c: text[i] for c, i in mapping.items()}


def test_csv_keeps_quotes_and_line_breaks(spark):
    from txrisk.plans.text import _csv_round_trip

    df = spark.createDataFrame([(1, 'a "b"\nc\\, d'), (2, None)], "case_id bigint, explanation string")
    assert sorted(map(tuple, _csv_round_trip(spark, df, "csv").collect())) == sorted(map(tuple, df.collect()))


def test_search_draws_different_settings_of_the_grid():
    assert search.SEARCH_DRAWS == 100
    n = 1
    for v in search.SEARCH_GRID.values():
        n *= len(v)
    assert n == 324


def test_null_feature_is_an_error_that_names_the_column(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0)], "a double, b double")
    with pytest.raises(Exception, match="a"):
        ML.assemble_features(df, ["a", "b"]).collect()


def test_changed_data_changes_the_model_table(spark):
    d = tempfile.mkdtemp(prefix="txrisk-data-")
    for t in ("region", "nation", "customer", "events"):
        shutil.copyfile(f"{SF_SMALL}/{t}.parquet", f"{d}/{t}.parquet")
    n = P.model_ready(spark, d).count()
    before = P.fitted(spark, d)
    assert P.fitted(spark, d) is before
    small = spark.read.parquet(f"{SF_SMALL}/events.parquet").filter(F.col("event_id") % 2 == 0).toArrow()
    pq.write_table(small, f"{d}/events.parquet")
    assert P.fitted(spark, d) is not before
    assert 0 < P.model_ready(spark, d).count() < n

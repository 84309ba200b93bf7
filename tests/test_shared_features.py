"""The discovery queries pass through the customers' history once."""

import datetime as dt
import json
import random

import pytest

from txrisk.operators import history as H
from txrisk.plans import discovery, models


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d, r = str(tmp_path_factory.mktemp("tables")), random.Random(4)
    start = dt.datetime(2024, 1, 1)
    events = [(i, start + dt.timedelta(minutes=r.randrange(40_000)), r.randrange(40), r.choice(["view", "click", "buy"]),
               round(r.uniform(1, 600), 2), json.dumps({"k": r.randrange(100)})) for i in range(3000)]
    for name, rows, schema in (
            ("events", events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"),
            ("customer", [(i, i % 5, 250.0 * i, "BUILDING") for i in range(40)],
             "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string"),
            ("nation", [(i, i % 2) for i in range(5)], "n_nationkey int, n_regionkey int"),
            ("region", [(0, "ASIA"), (1, "EUROPE")], "r_regionkey int, r_name string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    yield d
    models.release()


@pytest.fixture
def passes(monkeypatch):
    calls, real = [], H.customer_history
    monkeypatch.setattr(H, "customer_history", lambda *a, **k: calls.append(1) or real(*a, **k))
    return calls


def test_one_pass_for_the_document_and_the_same_features(spark, tables, passes):
    models.release()
    before = {r.transaction_id: r for r in models.model_ready_frame(spark, tables).collect()}
    z = sorted(discovery.z_table(spark, tables).collect())
    assert len(passes) == 2
    passes.clear()
    doc = json.loads(discovery.q_sink_discovery_json(spark, tables).first().document)
    assert len(passes) == 1 and set(doc) == {"falseNegativeAnalysis", "llmProposal", "impact", "leakageCheck"}
    assert {r.transaction_id: r for r in models.model_ready_frame(spark, tables).collect()} == before
    assert sorted(discovery.z_table(spark, tables).collect()) == z and len(passes) == 1
    models.release()


def test_one_pass_for_the_ablation(spark, tables, passes):
    models.release()
    [row] = models.ablation(spark, tables).collect()
    assert len(passes) == 1 and row.baseline_n_fraud == row.augmented_n_fraud > 0
    models.release()

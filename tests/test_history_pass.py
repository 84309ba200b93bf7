"""One pass for frames, prior rows and totals, against the operators of each and against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from txrisk.operators import history as H


def table(spark, seed, n=400):
    """A hot customer, rows without a customer, time or amount, times that many rows share, repeated channels."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        customer = None if r.random() < 0.1 else (1 if r.random() < 0.4 else r.randrange(2, 9))
        minute = None if r.random() < 0.05 else r.choice([0, 60, 60 * 24, 60 * 24 * 7]) + r.randrange(60 * 24 * 3)
        amount = None if r.random() < 0.1 else r.choice([0.0, 1.25, round(r.uniform(0, 500), 2)])
        rows.append((i, customer, minute, amount, r.choice(["view", "click", "pay", None]), r.choice("AB")))
    df = spark.createDataFrame(rows, "transaction_id long, customer_id long, m long, amount double, channel string, location string")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return df.withColumn("ts", start + F.make_dt_interval(mins=F.col("m"))).drop("m").repartition(5)


def by_id(df, *cols):
    return {r[0]: [None if v is None else round(v, 6) for v in r[1:]] for r in df.select("transaction_id", *cols).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_operators_of_each_part(spark, seed):
    t = table(spark, seed).cache()
    h = H.customer_history(t).cache()
    assert h.count() == t.count()
    frames = ("tx_count_24h", "amount_sum_24h", "tx_count_7d", "amount_mean_7d", "amount_std_7d")
    assert by_id(h, *frames) == by_id(H.win_24h_7d(t), *frames)
    ratio = ("customer_mean_amount_prior", "amount_vs_mean_ratio_safe")
    assert by_id(h, *ratio) == by_id(H.prior_mean_ratio(t), *ratio)
    prior = ("tx_count_prior", "amount_mean_prior", "amount_std_prior")
    assert by_id(h, *prior) == by_id(H.history_features(t), *prior)
    life = ("tx_count_total", "amount_mean_total", "amount_std_total", "channel_diversity", "location_diversity")
    assert by_id(h, *life) == by_id(H.profile_join_back(t), *life)


def test_prior_rows_by_plain_python(spark):
    t = table(spark, 5)
    rows = sorted(t.collect(), key=lambda r: (r.ts is not None, str(r.ts), r.transaction_id))
    got = {r.transaction_id: r for r in H.history_pass(t, flags={"view": F.col("channel") == "view"},
                                                       distinct={"channels": "channel"}).collect()}
    for i, r in enumerate(rows):
        mine = [x for x in rows[:i] if x.customer_id == r.customer_id]
        every = [x for x in rows if x.customer_id == r.customer_id]
        for part, name in ((mine, "before"), (every, "total")):
            found = {c: got[r.transaction_id][f"{name}_{c}"] for c in ("rows", "n", "s", "view")}
            amounts = [x.amount for x in part if x.amount is not None]
            assert (found["rows"], found["n"], found["view"]) == (len(part), len(amounts), sum(x.channel == "view" for x in part))
            assert float(found["s"]) == pytest.approx(sum(amounts), abs=1e-6)
        assert got[r.transaction_id].total_channels == len({x.channel for x in every} - {None})


def test_three_reads_and_no_exchange_by_the_key_alone(spark, tmp_path):
    table(spark, 3).write.parquet(f"{tmp_path}/t")
    h = H.customer_history(spark.read.parquet(f"{tmp_path}/t"))
    plan = h._jdf.queryExecution().executedPlan().toString()
    assert h._jdf.queryExecution().sparkPlan().toString().count("FileScan parquet") <= 3
    rows = [line for line in plan.splitlines() if "Exchange hashpartitioning(customer_id" in line]
    assert rows == []


def test_empty_table(spark):
    assert H.customer_history(table(spark, 1).limit(0)).collect() == []


def test_keys_with_few_rows_go_through_plain_windows(spark, monkeypatch):
    """No event of any row is made for them (three a row before)."""
    monkeypatch.setattr(H, "FRAME_ROWS", 10_000)
    plan = H.customer_history(table(spark, 4))._jdf.queryExecution().sparkPlan().toString()
    assert "Window" in plan and "Generate" not in plan


def test_crowded_keys_are_spread_with_the_same_rows(spark, monkeypatch):
    t = table(spark, 6).cache()
    cols = [c for c in H.customer_history(t).columns if c not in ("transaction_id", "customer_id", "ts", "channel", "location")]
    frames = [c for c in H.win_24h_7d(t).columns if c not in t.columns]
    whole, alone = by_id(H.customer_history(t), *cols), by_id(H.win_24h_7d(t), *frames)
    for rows_of_key, rows_of_frame in ((100_000, 20), (60, 128), (0, 0)):
        monkeypatch.setattr(H, "KEY_ROWS", rows_of_key)
        monkeypatch.setattr(H, "FRAME_ROWS", rows_of_frame)
        h = H.customer_history(t)
        assert by_id(h, *cols) == whole and by_id(H.win_24h_7d(t), *frames) == alone


def test_equal_amounts_deviate_as_by_prefix_sums(spark, monkeypatch):
    """Squares are rounded to the digits that prefix sums leave, in plain windows too."""
    t = table(spark, 8).withColumn("amount", F.lit(178.35)).cache()
    passed = H.history_pass(t, frames={7 * H.US_PER_DAY: {"std": "stddev"}})
    alone = H.win_7d(t).select("transaction_id", "amount_std_7d").collect()
    monkeypatch.setattr(H, "KEY_ROWS", 0)
    spread = H.history_pass(t, frames={7 * H.US_PER_DAY: {"std": "stddev"}})
    assert dict(passed.dtypes)["before_q"] == dict(spread.dtypes)["before_q"]
    in_order = lambda df: sorted(df.collect(), key=lambda r: r.transaction_id)
    assert in_order(passed) == in_order(spread)
    assert sorted(alone) == sorted(H.win_7d(t).select("transaction_id", "amount_std_7d").collect())

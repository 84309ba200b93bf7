"""The audit of every customer at a seeded cut: what looks ahead shows, what looks back does not."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from txrisk.operators import history as H

SCHEMA = "transaction_id long, customer_id long, ts timestamp_ntz, amount double, channel string, location string"
DAY0 = dt.datetime(2024, 1, 1)
MARKERS = {"amount": 54321.0, "channel": "later", "location": "LATER"}


def rows(n=400, seed=5):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        c = 1 if rnd.random() < 0.33 else rnd.choice([None, *range(2, 25)])
        t = None if rnd.random() < 0.02 else DAY0 + dt.timedelta(minutes=rnd.randrange(30 * 24 * 60))
        out.append((i, c, t, None if rnd.random() < 0.05 else round(rnd.uniform(0, 99), 2),
                    rnd.choice(["view", "click", "pos"]), rnd.choice(["A", "B"])))
    return out


def verdicts(df):
    return {r["feature"]: r for r in df.collect()}


def test_look_back_is_clean_and_lifetime_is_not(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    clean = ["tx_count_24h", "amount_sum_24h", "amount_std_7d", "customer_mean_amount_prior", "tx_count_prior"]
    leaky = ["amount_mean_total", "tx_count_total", "channel_diversity", "amount_vs_mean_ratio"]
    got = verdicts(H.prefix_audit(df, H.customer_history, clean + leaky, markers=MARKERS))
    assert all(got[c]["is_prefix_safe"] and got[c]["n_keys_changed"] == 0 for c in clean), got
    assert not any(got[c]["is_prefix_safe"] for c in leaky), got
    # a marked mean differs for nearly every key that has later rows
    m = got["amount_mean_total"]
    assert m["n_keys"] > 20 and m["n_keys_changed"] >= m["n_keys"] - 3  # the group without a key has no total


def _build(feature):
    """A feature by a plain window, whose frames order rows by time."""
    def build(x):
        w = Window.partitionBy("customer_id").orderBy("ts", "transaction_id")
        return x.select("*", feature(w).alias("f"))
    return build


def test_leak_after_the_fixed_cutoff_is_found(spark):
    data = [(i, c, DAY0 + dt.timedelta(days=i % 30, minutes=i), 1.0 + i, "view", "A") for c in range(20)
            for i in range(c * 30, c * 30 + 30)]
    df = spark.createDataFrame(data, SCHEMA)
    # the next amount, but only on rows from day 18 on
    late = lambda w: F.when(F.col("ts") >= F.lit(DAY0 + dt.timedelta(days=18)), F.lead("amount").over(w))
    fixed = H.prefix_audit(df, _build(late), ["f"], cutoff=F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).first()
    assert fixed["is_prefix_safe"]
    assert not H.prefix_audit(df, _build(late), ["f"], markers=MARKERS).first()["is_prefix_safe"]


def test_existence_and_text_leaks_show(spark):
    df = spark.createDataFrame(rows(600, 8), SCHEMA)
    following = lambda w: F.count(F.lit(1)).over(w.rowsBetween(1, Window.unboundedFollowing))
    nxt = lambda w: F.lead("channel").over(w)
    before = lambda w: F.lag("channel").over(w)
    assert not H.prefix_audit(df, _build(following), ["f"], markers=MARKERS).first()["is_prefix_safe"]
    assert not H.prefix_audit(df, _build(nxt), ["f"], markers=MARKERS).first()["is_prefix_safe"]
    assert H.prefix_audit(df, _build(before), ["f"], markers=MARKERS).first()["is_prefix_safe"]


def test_every_kept_row_counts_once(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    doubled = df.unionByName(df)
    a = H.prefix_audit(df, H.customer_history, ["tx_count_24h"], markers=MARKERS).first()
    b = H.prefix_audit(doubled, H.customer_history, ["tx_count_24h"], markers=MARKERS).first()
    assert b["n_prefix_rows"] == 2 * a["n_prefix_rows"] and b["n_keys"] == a["n_keys"] and b["is_prefix_safe"]


def test_no_rows(spark):
    r = H.prefix_audit(spark.createDataFrame([], SCHEMA), H.customer_history, ["tx_count_24h"], markers=MARKERS).collect()
    assert len(r) == 1 and r[0]["n_prefix_rows"] == 0 and r[0]["n_changed"] == 0 and r[0]["is_prefix_safe"]

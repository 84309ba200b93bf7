"""Seeded property tests: custom window machinery vs brute force on generated tables
(hot customer, timestamp ties, zero amounts, a null customer key)."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from txrisk.operators import history as H

DAY = dt.timedelta(days=1)


def gen(seed: int, n: int = 240) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    cust = rng.choice([1, 2, 3, 4], size=n, p=[0.5, 0.2, 0.2, 0.1]).astype(float)  # 1 is hot
    cust[rng.integers(n)] = np.nan  # one null key
    base = dt.datetime(2024, 1, 1)
    minutes = rng.integers(0, 20 * 24 * 60, size=n)
    minutes[: n // 6] = minutes[n // 6: 2 * (n // 6)]  # deliberate timestamp ties
    amount = np.round(rng.uniform(0, 500, size=n), 2)
    amount[rng.integers(n, size=5)] = 0.0
    return pd.DataFrame({
        "transaction_id": np.arange(n, dtype=np.int64),
        "customer_id": pd.array(cust, dtype="Int64"),
        "ts": [base + dt.timedelta(minutes=int(m)) for m in minutes],
        "amount": amount,
        "channel": rng.choice(["view", "click", "purchase", "signup", "error"], size=n),
        "location": rng.choice(["A", "B"], size=n)})


def brute(p: pd.DataFrame) -> pd.DataFrame:
    out = []
    key = p["customer_id"].astype("float").fillna(-1e18)
    for i, r in p.iterrows():
        same = p[key == key[i]]
        w24 = same[(same.ts >= r.ts - DAY) & (same.ts <= r.ts)].amount
        w7 = same[(same.ts >= r.ts - 7 * DAY) & (same.ts <= r.ts)].amount
        prior = same[(same.ts < r.ts) | ((same.ts == r.ts) & (same.transaction_id < r.transaction_id))]
        pm = prior.amount.mean() if len(prior) else r.amount
        out.append({"transaction_id": r.transaction_id, "c24": len(w24), "s24": w24.sum(),
                    "c7": len(w7), "m7": w7.mean(), "sd7": w7.std(ddof=1) if len(w7) > 1 else np.nan,
                    "pm": pm, "ratio": (r.amount / pm) if pm != 0 else 1.0,
                    "n_prior": len(prior), "ch_prior": prior.channel.nunique()})
    return pd.DataFrame(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_windows_match_brute_force(spark, seed):
    p = gen(seed)
    df = spark.createDataFrame(p, "transaction_id long, customer_id long, ts timestamp_ntz, amount double, "
                                  "channel string, location string")
    w = H.history_features(H.prior_mean_ratio(H.win_24h_7d(df)))
    got = w.select("transaction_id", "tx_count_24h", "amount_sum_24h", "tx_count_7d", "amount_mean_7d",
                   "amount_std_7d", "customer_mean_amount_prior", "amount_vs_mean_ratio_safe",
                   "tx_count_prior", "channel_diversity_prior").toPandas()
    ref = brute(p)
    m = got.merge(ref, on="transaction_id")
    assert len(m) == len(p)
    pairs = [("tx_count_24h", "c24"), ("amount_sum_24h", "s24"), ("tx_count_7d", "c7"),
             ("amount_mean_7d", "m7"), ("amount_std_7d", "sd7"), ("customer_mean_amount_prior", "pm"),
             ("amount_vs_mean_ratio_safe", "ratio"), ("tx_count_prior", "n_prior"),
             ("channel_diversity_prior", "ch_prior")]
    for a, b in pairs:
        x, y = m[a].astype(float), m[b].astype(float)
        ok = ((x - y).abs() <= 1e-6 * (1 + y.abs())) | (x.isna() & y.isna())
        assert ok.all(), (a, m.loc[~ok, ["transaction_id", a, b]].head(3).to_dict("records"))

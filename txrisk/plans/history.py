"""Registered queries: customer history windows, lifetime profile, leakage audits
and derived risk features (ops 18, 29-32, 49, 62, 66, 73-81)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.functions import scalar as S
from txrisk.operators import encode, history as H, profile, risk
from txrisk.plans.common import finish
from txrisk.registry import query
from txrisk.sources import fixtures as fx

ONLINE = "('view', 'click', 'signup')"


def msum(over: str = "") -> str:
    """Exact money sum in DuckDB (twin of history.money_sum)."""
    return f"CAST(sum(CAST(amount AS DECIMAL(24,6))) {over} AS DOUBLE)"


def mavg(over: str = "") -> str:
    return f"({msum(over)} / count(amount) {over})"

W24 = ("OVER (PARTITION BY customer_id ORDER BY ts "
       "RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)")
W7 = ("OVER (PARTITION BY customer_id ORDER BY ts "
      "RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)")
WPRIOR = ("OVER (PARTITION BY customer_id ORDER BY ts, transaction_id "
          "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")


def _narrow(spark, d) -> DataFrame:
    return fx.tx(spark, d).select("transaction_id", "customer_id", "ts", "amount", "channel",
                                  "location", "is_fraud")


# ---------------------------------------------------------------- windows
@query("win_24h", f"""
SELECT transaction_id, customer_id, count(amount) {W24} AS tx_count_24h,
       round(sum(amount) {W24}, 6) AS amount_sum_24h FROM tx""")
def q_win_24h(spark, d):
    t = _narrow(spark, d).select("transaction_id", "customer_id", "ts", "amount")
    return finish(H.win_24h(t).drop("ts", "amount"))


@query("win_7d", f"""
SELECT transaction_id, customer_id, count(amount) {W7} AS tx_count_7d,
       round({mavg(W7)}, 6) AS amount_mean_7d, round(stddev_samp(amount) {W7}, 6) AS amount_std_7d
FROM tx""")
def q_win_7d(spark, d):
    t = _narrow(spark, d).select("transaction_id", "customer_id", "ts", "amount")
    return finish(H.win_7d(t).drop("ts", "amount"))


_PRIOR_SQL = f"""
WITH p AS (SELECT transaction_id, customer_id, amount, {mavg(WPRIOR)} AS pm FROM tx),
q AS (SELECT transaction_id, customer_id, amount, coalesce(pm, amount) AS customer_mean_amount_prior FROM p)
"""


@query("prior_mean", _PRIOR_SQL + """
SELECT transaction_id, customer_id, round(customer_mean_amount_prior, 6) AS customer_mean_amount_prior FROM q""")
def q_prior_mean(spark, d):
    t = _narrow(spark, d).select("transaction_id", "customer_id", "ts", "amount")
    return finish(H.prior_mean_ratio(t).select("transaction_id", "customer_id",
                                               "customer_mean_amount_prior"))


@query("ratio_safe", _PRIOR_SQL + """
SELECT transaction_id, round(coalesce(amount / nullif(customer_mean_amount_prior, 0), 1.0), 6)
  AS amount_vs_mean_ratio_safe FROM q""")
def q_ratio_safe(spark, d):
    t = _narrow(spark, d).select("transaction_id", "customer_id", "ts", "amount")
    return finish(H.prior_mean_ratio(t).select("transaction_id", "amount_vs_mean_ratio_safe"))


@query("history_features", f"""
WITH f AS (SELECT transaction_id, customer_id, ts, channel, location,
   count(*) {WPRIOR} AS n, {mavg(WPRIOR)} AS m, stddev_samp(amount) {WPRIOR} AS s,
   avg(CASE WHEN channel IN {ONLINE} THEN 1.0 ELSE 0.0 END) {WPRIOR} AS o FROM tx),
fc AS (SELECT customer_id, channel, min((ts, transaction_id)) AS first FROM tx GROUP BY 1, 2),
fl AS (SELECT customer_id, location, min((ts, transaction_id)) AS first FROM tx GROUP BY 1, 2)
SELECT f.transaction_id, CAST(f.n AS BIGINT) AS tx_count_prior, round(f.m, 6) AS amount_mean_prior,
  round(f.s, 6) AS amount_std_prior, round(f.o, 6) AS online_channel_ratio_prior,
  (SELECT count(*) FROM fc WHERE fc.customer_id = f.customer_id AND fc.first < (f.ts, f.transaction_id))
    AS channel_diversity_prior,
  (SELECT count(*) FROM fl WHERE fl.customer_id = f.customer_id AND fl.first < (f.ts, f.transaction_id))
    AS location_diversity_prior
FROM f""")
def q_history_features(spark, d):
    t = _narrow(spark, d).drop("is_fraud")
    return finish(H.history_features(t).drop("customer_id", "ts", "amount", "channel", "location"))


_LIFETIME_SQL = f"""
SELECT customer_id, count(*) AS tx_count_total, round({mavg()}, 6) AS amount_mean_total,
  round(stddev_samp(amount), 6) AS amount_std_total, count(DISTINCT channel) AS channel_diversity,
  count(DISTINCT location) AS location_diversity,
  round(avg(CASE WHEN channel IN {ONLINE} THEN 1.0 ELSE 0.0 END), 6) AS online_channel_ratio
FROM tx WHERE customer_id IS NOT NULL GROUP BY customer_id"""


@query("customer_lifetime", _LIFETIME_SQL)
def q_customer_lifetime(spark, d):
    return finish(H.customer_lifetime(_narrow(spark, d)))


@query("profile_join_back", f"""
WITH l AS ({_LIFETIME_SQL})
SELECT t.transaction_id, t.customer_id, l.tx_count_total, l.amount_mean_total, l.amount_std_total,
  l.channel_diversity, l.location_diversity, l.online_channel_ratio
FROM tx t LEFT JOIN l USING (customer_id)""")
def q_profile_join_back(spark, d):
    t = _narrow(spark, d)
    return finish(H.profile_join_back(t).drop("ts", "amount", "channel", "location", "is_fraud"))


@query("cardinality_zero_variance", f"""
WITH l AS ({_LIFETIME_SQL})
SELECT 'channel_diversity' AS column_name, count(DISTINCT channel_diversity) AS n_distinct,
  count(DISTINCT channel_diversity) <= 1 AS is_constant FROM l
UNION ALL SELECT 'location_diversity', count(DISTINCT location_diversity),
  count(DISTINCT location_diversity) <= 1 FROM l
UNION ALL SELECT 'tx_count_total', count(DISTINCT tx_count_total), count(DISTINCT tx_count_total) <= 1 FROM l""")
def q_cardinality_zero_variance(spark, d):
    life = H.customer_lifetime(_narrow(spark, d))
    return profile.zero_variance_columns(
        life, ["channel_diversity", "location_diversity", "tx_count_total"])


@query("amount_vs_lifetime_ratio", f"""
SELECT transaction_id, round(amount / nullif({mavg('OVER (PARTITION BY customer_id)')}, 0), 6)
  AS amount_vs_mean_ratio FROM tx""")
def q_amount_vs_lifetime_ratio(spark, d):
    t = H.profile_join_back(_narrow(spark, d))
    return finish(H.amount_vs_lifetime_ratio(t).select("transaction_id", "amount_vs_mean_ratio"))


# ---------------------------------------------------------------- derived risk features
def risk_features(spark, d) -> DataFrame:
    """tx + 24 h / 7 d windows + lifetime + prior ratio + velocity + merchant risk + age."""
    return H.customer_history(fx.tx(spark, d)).select(
        "*", H.velocity_score().alias("velocity_score"), fx.merchant_risk_col().alias("merchant_risk_score"),
        S.age_ordinal("age_group").alias("age_numeric"))


_FEAT_SQL = f"""
WITH w AS (SELECT *, count(amount) {W24} AS tx_count_24h, {msum(W24)} AS amount_sum_24h,
   count(amount) {W7} AS tx_count_7d, count(*) OVER (PARTITION BY customer_id) AS tx_count_total,
   coalesce({mavg(WPRIOR)}, amount) AS pm FROM tx),
feat AS (SELECT *, (CAST(tx_count_24h AS DOUBLE) * 7 + tx_count_7d) / (tx_count_total + 1) AS velocity_score,
   coalesce(amount / nullif(pm, 0), 1.0) AS amount_vs_mean_ratio_safe FROM w)
"""


def velocity(spark, d) -> DataFrame:
    """transaction_id and velocity_score, from the frames and the lifetime counts alone."""
    t = _narrow(spark, d).select("transaction_id", "customer_id", "ts", "amount")
    total = t.filter("customer_id IS NOT NULL").groupBy("customer_id").agg(F.count(F.lit(1)).alias("tx_count_total"))
    return (H.win_24h_7d(t).join(total, "customer_id", "left")
            .select("transaction_id", H.velocity_score().alias("velocity_score")))


@query("velocity_score", _FEAT_SQL + """
SELECT transaction_id, round(velocity_score, 6) AS velocity_score FROM feat""")
def q_velocity_score(spark, d):
    return finish(velocity(spark, d))


@query("composite_risk", _FEAT_SQL + """,
c AS (SELECT *, avg(CAST(is_fraud AS DOUBLE)) OVER (PARTITION BY channel) AS chr FROM feat),
m AS (SELECT min(velocity_score) AS lv, max(velocity_score) AS hv, min(amount_vs_mean_ratio_safe) AS lr,
   max(amount_vs_mean_ratio_safe) AS hr, min(chr) AS lc, max(chr) AS hc FROM c)
SELECT transaction_id, round(
   (CASE WHEN hv > lv THEN (velocity_score - lv) / (hv - lv) ELSE 0.0 END) * (1.0 / 3)
 + (CASE WHEN hr > lr THEN (amount_vs_mean_ratio_safe - lr) / (hr - lr) ELSE 0.0 END) * (1.0 / 3)
 + (CASE WHEN hc > lc THEN (chr - lc) / (hc - lc) ELSE 0.0 END) * (1.0 / 3), 6) AS composite_risk
FROM c, m""")
def q_composite_risk(spark, d):
    f = risk_features(spark, d).select("transaction_id", "channel", "is_fraud", "velocity_score", "amount_vs_mean_ratio_safe")
    return finish(H.composite_risk(f).select("transaction_id", "composite_risk"))


@query("quantile_bin", _FEAT_SQL + """,
q AS (SELECT quantile_cont(velocity_score, [0.25, 0.5, 0.75]) AS e FROM feat)
SELECT transaction_id, CASE WHEN velocity_score <= e[1] THEN 'Low' WHEN velocity_score <= e[2] THEN 'Medium'
  WHEN velocity_score <= e[3] THEN 'High' WHEN velocity_score IS NOT NULL THEN 'Very High' END AS velocity_bin
FROM feat, q""")
def q_quantile_bin(spark, d):
    return encode.quantile_bin(velocity(spark, d), "velocity_score", out="velocity_bin").select(
        "transaction_id", "velocity_bin")


@query("velocity_gap_by_channel", f"""
WITH w AS (SELECT channel, is_fraud, count(amount) {W24} AS tx_count_24h FROM tx),
g AS (SELECT channel, avg(CASE WHEN is_fraud = 0 THEN tx_count_24h END) AS l,
   avg(CASE WHEN is_fraud = 1 THEN tx_count_24h END) AS f FROM w WHERE channel IS NOT NULL GROUP BY channel)
SELECT channel, round(l, 6) AS legit_velocity, round(f, 6) AS fraud_velocity, round(f - l, 6) AS delta,
  round(round((f - l) / l * 100, 1), 6) AS delta_pct FROM g""")
def q_velocity_gap_by_channel(spark, d):
    w = H.win_24h(_narrow(spark, d))
    return finish(risk.velocity_gap_by_channel(w))


# ---------------------------------------------------------------- leakage audits
_AUDIT_COLS = ["amount_mean_total", "amount_sum_24h", "tx_count_24h", "amount_mean_7d"]


@query("leakage_lifetime_constant", f"""
WITH w AS (SELECT customer_id, round({mavg('OVER (PARTITION BY customer_id)')}, 9) AS amount_mean_total,
   round({msum(W24)}, 9) AS amount_sum_24h, count(amount) {W24} AS tx_count_24h,
   round({mavg(W7)}, 9) AS amount_mean_7d FROM tx),
per AS (SELECT customer_id, count(*) AS n, count(DISTINCT amount_mean_total) AS d0,
   count(DISTINCT amount_sum_24h) AS d1, count(DISTINCT tx_count_24h) AS d2,
   count(DISTINCT amount_mean_7d) AS d3 FROM w GROUP BY customer_id HAVING count(*) >= 2),
top AS (SELECT * FROM per ORDER BY n DESC, customer_id LIMIT 1),
sh AS (SELECT count(*) AS n_customers, avg(CASE WHEN d0 = 1 THEN 1.0 ELSE 0.0 END) AS s0,
   avg(CASE WHEN d1 = 1 THEN 1.0 ELSE 0.0 END) AS s1, avg(CASE WHEN d2 = 1 THEN 1.0 ELSE 0.0 END) AS s2,
   avg(CASE WHEN d3 = 1 THEN 1.0 ELSE 0.0 END) AS s3 FROM per)
SELECT top.customer_id AS customer_checked, top.n AS n_transactions_checked, sh.n_customers,
  x.column_name, x.is_lifetime_constant, round(x.constant_share, 6) AS constant_share
FROM top, sh, LATERAL (VALUES ('amount_mean_total', top.d0 = 1, sh.s0),
  ('amount_sum_24h', top.d1 = 1, sh.s1), ('tx_count_24h', top.d2 = 1, sh.s2),
  ('amount_mean_7d', top.d3 = 1, sh.s3)) x(column_name, is_lifetime_constant, constant_share)""")
def q_leakage_lifetime_constant(spark, d):
    t = _narrow(spark, d)
    w = H.win_24h_7d(t)
    w = w.join(H.customer_lifetime(t).select("customer_id", "amount_mean_total"), "customer_id")
    # round so distinct counts do not depend on float summation order
    w = finish(w, 9)
    return finish(H.leakage_lifetime_constant(w, _AUDIT_COLS))


@query("leakage_recompute", f"""
WITH w AS (SELECT transaction_id, {msum(W24)} AS s FROM tx),
st AS (SELECT transaction_id, s, s + CASE WHEN transaction_id % 250 = 0 THEN 1.0 ELSE 0.0 END AS stored FROM w)
SELECT count(*) AS n_rows, CAST(sum(CASE WHEN abs(stored - s) <= 1e-6 THEN 1 ELSE 0 END) AS BIGINT) AS n_match,
  CAST(sum(CASE WHEN stored - s > 1e-6 THEN 1 ELSE 0 END) AS BIGINT) AS n_stored_higher,
  CAST(sum(CASE WHEN stored - s < -1e-6 THEN 1 ELSE 0 END) AS BIGINT) AS n_stored_lower,
  round(CAST(sum(CASE WHEN abs(stored - s) <= 1e-6 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS match_rate
FROM st""")
def q_leakage_recompute(spark, d):
    t = _narrow(spark, d).select("transaction_id", "customer_id", "ts", "amount")
    w = H.win_24h(t)
    stored = w.select("*", (F.col("amount_sum_24h") + F.when(F.col("transaction_id") % 250 == 0, 1.0)
                            .otherwise(0.0)).alias("stored_sum_24h"))
    return finish(H.leakage_recompute(stored, "stored_sum_24h", "amount_sum_24h"))


_CUTOFF = "2024-01-15"


@query("prefix_safety", f"""
WITH fa AS (SELECT transaction_id, {msum(W24)} AS s24, {mavg('OVER (PARTITION BY customer_id)')} AS lm,
   coalesce({mavg(WPRIOR)}, amount) AS pm FROM tx),
p AS (SELECT * FROM tx WHERE ts < TIMESTAMP '{_CUTOFF} 00:00:00'),
fp AS (SELECT transaction_id, {msum(W24)} AS s24, {mavg('OVER (PARTITION BY customer_id)')} AS lm,
   coalesce({mavg(WPRIOR)}, amount) AS pm FROM p),
j AS (SELECT fa.s24 AS a1, fp.s24 AS b1, fa.lm AS a2, fp.lm AS b2, fa.pm AS a3, fp.pm AS b3
      FROM fp JOIN fa USING (transaction_id))
SELECT feature, count(*) AS n_prefix_rows, CAST(sum(CASE WHEN abs(a - b) <= 1e-9 THEN 0 ELSE 1 END) AS BIGINT)
  AS n_changed, sum(CASE WHEN abs(a - b) <= 1e-9 THEN 0 ELSE 1 END) = 0 AS is_prefix_safe
FROM (SELECT 'amount_sum_24h' AS feature, round(a1, 9) AS a, round(b1, 9) AS b FROM j
      UNION ALL SELECT 'amount_mean_total', round(a2, 9), round(b2, 9) FROM j
      UNION ALL SELECT 'customer_mean_amount_prior', round(a3, 9), round(b3, 9) FROM j) GROUP BY feature""")
def q_prefix_safety(spark, d):
    t = _narrow(spark, d).select("transaction_id", "customer_id", "ts", "amount", "channel", "location")
    audit = H.prefix_audit(t, H.customer_history, ["amount_sum_24h", "amount_mean_total", "customer_mean_amount_prior"],
                           cutoff=F.lit(f"{_CUTOFF} 00:00:00").cast("timestamp_ntz"))
    return audit.select("feature", "n_prefix_rows", "n_changed", "is_prefix_safe")


_MARKERS = {"amount": 54321.0, "channel": "later", "location": "LATER"}
_SHARE = "CAST('0x' || substr(md5('{seed}:' || CAST({c} AS VARCHAR)), 1, 4) AS BIGINT)"


def _versions(over: str) -> str:
    return over.replace("PARTITION BY customer_id", "PARTITION BY version, customer_id")


_AUDITED = {
    "tx_count_24h": f"count(amount) {_versions(W24)}",
    "amount_sum_24h": msum(_versions(W24)),
    "tx_count_7d": f"count(amount) {_versions(W7)}",
    "amount_mean_7d": mavg(_versions(W7)),
    "customer_mean_amount_prior": f"coalesce({mavg(_versions(WPRIOR))}, amount)",
    "tx_count_prior": f"count(*) {_versions(WPRIOR)}",
    "amount_mean_prior": mavg(_versions(WPRIOR)),
    "online_channel_ratio_prior": f"avg(CASE WHEN channel IN {ONLINE} THEN 1.0 ELSE 0.0 END) {_versions(WPRIOR)}",
    "amount_mean_total": mavg("OVER (PARTITION BY version, customer_id)"),
    "tx_count_total": "count(*) OVER (PARTITION BY version, customer_id)",
    "channel_diversity": "count(DISTINCT channel) OVER (PARTITION BY version, customer_id)",
    "amount_vs_mean_ratio": f"amount / nullif({mavg('OVER (PARTITION BY version, customer_id)')}, 0)",
}


@query("prefix_audit", f"""
WITH c AS (SELECT customer_id, min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM tx GROUP BY 1),
r AS (SELECT tx.*, epoch_us(ts) > lo + (hi - lo) // 65536 * {_SHARE.format(seed='42', c='c.customer_id')} AS later
   FROM tx JOIN c USING (customer_id)),
v AS (SELECT 0 AS version, transaction_id, customer_id, ts, amount, channel, location, later FROM r
   UNION ALL SELECT 1, transaction_id, customer_id, ts, CASE WHEN later THEN {_MARKERS['amount']} ELSE amount END,
     CASE WHEN later THEN '{_MARKERS['channel']}' ELSE channel END,
     CASE WHEN later THEN '{_MARKERS['location']}' ELSE location END, later FROM r
   WHERE NOT (later AND {_SHARE.format(seed='42:drop', c='transaction_id')} < 32768)),
f AS (SELECT version, transaction_id, customer_id, later,
  {", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in _AUDITED.items())} FROM v),
j AS (SELECT a.customer_id, x.feature, abs(x.a - x.b) <= 1e-9 OR (x.a IS NULL AND x.b IS NULL) AS same
  FROM f a JOIN f b ON a.transaction_id = b.transaction_id AND a.version = 0 AND b.version = 1,
  LATERAL (VALUES {", ".join(f"('{c}', a.{c}, b.{c})" for c in _AUDITED)}) x(feature, a, b) WHERE NOT a.later)
SELECT feature, count(*) AS n_prefix_rows, count(*) FILTER (WHERE same IS NOT TRUE) AS n_changed,
  (SELECT count(DISTINCT customer_id) FROM r WHERE later) AS n_keys,
  count(DISTINCT customer_id) FILTER (WHERE same IS NOT TRUE) AS n_keys_changed,
  count(*) FILTER (WHERE same IS NOT TRUE) = 0 AS is_prefix_safe
FROM j GROUP BY feature""")
def q_prefix_audit(spark, d):
    t = _narrow(spark, d).select("transaction_id", "customer_id", "ts", "amount", "channel", "location")
    return H.prefix_audit(t, H.customer_history, list(_AUDITED), markers=_MARKERS)

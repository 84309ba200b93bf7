"""Registered queries: scans, audits, projections and the EDA risk tables
(ops 1-2, 9-29, 33-35, 50-61, 63-65, 67-68, 72-72a) with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from txrisk.functions import scalar as S
from txrisk.operators import encode, profile, risk
from txrisk.plans.common import finish
from txrisk.registry import query
from txrisk.sources import fixtures as fx
from txrisk.sources.tables import read_table

LOCATIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]  # TPC-H region names


# ---------------------------------------------------------------- sources
@query("scan_transactions", """
SELECT transaction_id, customer_id, ts, amount, channel, merchant_category, bank, location,
       hour, day_of_week, month, age_group, is_fraud, fraud_technique FROM tx""")
def q_scan_transactions(spark, d):
    return fx.tx(spark, d).drop("k")


@query("scan_pruned", "SELECT event_id, user_id, value FROM events")
def q_scan_pruned(spark, d):
    return read_table(spark, d, "events", ["event_id", "user_id", "value"])


# ---------------------------------------------------------------- profiling
@query("profile_schema", """
WITH c AS (SELECT count(*) AS n_rows,
   [count(transaction_id), count(customer_id), count(ts), count(amount), count(channel), count(k),
    count(merchant_category), count(bank), count(location), count(hour), count(day_of_week),
    count(month), count(age_group), count(is_fraud), count(fraud_technique)] AS nn FROM tx)
SELECT v.position, v.column_name, v.dtype, c.nn[v.position] AS non_null, c.n_rows,
       15 AS n_columns
FROM (VALUES (1, 'transaction_id', 'bigint'), (2, 'customer_id', 'bigint'),
   (3, 'ts', 'timestamp_ntz'), (4, 'amount', 'double'), (5, 'channel', 'string'), (6, 'k', 'int'),
   (7, 'merchant_category', 'string'), (8, 'bank', 'string'), (9, 'location', 'string'),
   (10, 'hour', 'int'), (11, 'day_of_week', 'int'), (12, 'month', 'int'), (13, 'age_group', 'string'),
   (14, 'is_fraud', 'int'), (15, 'fraud_technique', 'string')) v(position, column_name, dtype), c""")
def q_profile_schema(spark, d):
    return profile.profile_schema(fx.tx(spark, d))


_DESC_COLS = ["amount", "hour", "day_of_week", "month", "is_fraud"]


def _describe_sql(cols):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS column_name, count({x}) AS count, round(avg({x}), 6) AS mean,
  round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min,
  round(quantile_cont({x}, 0.25), 6) AS p25, round(quantile_cont({x}, 0.5), 6) AS p50,
  round(quantile_cont({x}, 0.75), 6) AS p75, round(max({x}), 6) AS max FROM tx""")
    return "\nUNION ALL\n".join(parts)


@query("profile_describe", _describe_sql(_DESC_COLS))
def q_profile_describe(spark, d):
    return finish(profile.profile_describe(fx.tx(spark, d), _DESC_COLS))


@query("null_audit", """
SELECT 'fraud_technique' AS column_name, CAST(sum(CASE WHEN fraud_technique IS NULL THEN 1 ELSE 0 END)
  AS BIGINT) AS null_count,
  round(CAST(sum(CASE WHEN fraud_technique IS NULL THEN 1 ELSE 0 END) AS DOUBLE) * 100 / count(*), 6)
  AS null_pct FROM tx""")
def q_null_audit(spark, d):
    return finish(profile.null_audit(fx.tx(spark, d)))


def _tx_dup(spark, d):
    t = fx.tx(spark, d)
    return t.unionAll(t.filter(F.col("transaction_id") % 100 == 0))


@query("duplicate_audit", """
WITH tx_dup AS (SELECT * FROM tx UNION ALL SELECT * FROM tx WHERE transaction_id % 100 = 0),
per AS (SELECT transaction_id, count(*) AS cnt FROM tx_dup GROUP BY transaction_id)
SELECT CAST(sum(cnt) AS BIGINT) AS n_rows, count(*) AS n_keys,
       CAST(sum(cnt - 1) AS BIGINT) AS n_duplicate_rows,
       CAST(sum(CASE WHEN cnt > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_duplicated_keys FROM per""")
def q_duplicate_audit(spark, d):
    return profile.duplicate_audit(_tx_dup(spark, d), "transaction_id")


@query("class_balance", """
WITH per AS (SELECT is_fraud, count(*) AS n FROM tx GROUP BY is_fraud),
tot AS (SELECT sum(n) AS total, sum(CASE WHEN is_fraud = 0 THEN n END) AS n0,
               sum(CASE WHEN is_fraud = 1 THEN n END) AS n1 FROM per)
SELECT is_fraud, n AS count, round(CAST(n AS DOUBLE) * 100 / total, 6) AS pct,
       CAST(floor(n0 / n1) AS BIGINT) AS imbalance_ratio FROM per, tot""")
def q_class_balance(spark, d):
    return finish(profile.class_balance(fx.tx(spark, d)))


@query("range_checks", """
SELECT count(*) AS n_rows, CAST(sum(CASE WHEN amount > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive,
  CAST(sum(CASE WHEN amount = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zero,
  CAST(sum(CASE WHEN amount < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_negative,
  CAST(sum(CASE WHEN amount IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null,
  round(min(amount), 6) AS min_value, round(max(amount), 6) AS max_value FROM tx""")
def q_range_checks(spark, d):
    return finish(profile.range_checks(fx.tx(spark, d), "amount"))


@query("iqr_outliers", """
WITH q AS (SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM tx),
b AS (SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q)
SELECT round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr, round(lower, 6) AS lower,
  round(upper, 6) AS upper, count(*) AS n_rows,
  CAST(sum(CASE WHEN amount < lower OR amount > upper THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers,
  round(CAST(sum(CASE WHEN amount < lower OR amount > upper THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6)
    AS outlier_share
FROM tx, b GROUP BY q1, q3, iqr, lower, upper""")
def q_iqr_outliers(spark, d):
    return finish(profile.iqr_outliers(fx.tx(spark, d), "amount"))


_EXPECTED_CHANNELS = ["click", "purchase", "signup", "view"]


@query("domain_checks", """
SELECT channel, count(*) AS n_rows FROM tx
WHERE channel IS NOT NULL AND channel NOT IN ('click', 'purchase', 'signup', 'view')
GROUP BY channel""")
def q_domain_checks(spark, d):
    return profile.domain_violations(fx.tx(spark, d), "channel", _EXPECTED_CHANNELS)


_CAT = ["channel", "bank", "location", "merchant_category", "age_group"]


@query("domain_cardinality", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM tx" for c in _CAT))
def q_domain_cardinality(spark, d):
    return profile.cardinality(fx.tx(spark, d), _CAT)


@query("time_coverage", """
SELECT min(ts) AS min_ts, max(ts) AS max_ts,
  count(DISTINCT (year(ts), month(ts))) AS n_months, count(DISTINCT CAST(ts AS DATE)) AS n_days FROM tx""")
def q_time_coverage(spark, d):
    return profile.time_coverage(fx.tx(spark, d), "ts")


# ---------------------------------------------------------------- projections
@query("ts_parts", """
SELECT transaction_id, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS day_of_week,
       CAST(month(ts) AS INT) AS month FROM tx""")
def q_ts_parts(spark, d):
    t = fx.tx(spark, d)
    return t.select("transaction_id", *[c.alias(n) for n, c in S.ts_parts("ts").items()])


@query("ts_flags", """
SELECT transaction_id, day_of_week >= 5 AS is_weekend, hour >= 9 AND hour <= 17 AS is_peak_hour FROM tx""")
def q_ts_flags(spark, d):
    t = fx.tx(spark, d)
    return t.select("transaction_id", S.is_weekend("day_of_week").alias("is_weekend"),
                    S.is_peak_hour("hour").alias("is_peak_hour"))


@query("cyclical_encode", """
SELECT transaction_id,
  round(round(sin(2 * pi() * hour / 24.0), 9), 6) AS hour_sin, round(round(cos(2 * pi() * hour / 24.0), 9), 6) AS hour_cos,
  round(round(sin(2 * pi() * day_of_week / 7.0), 9), 6) AS day_sin, round(round(cos(2 * pi() * day_of_week / 7.0), 9), 6) AS day_cos,
  round(round(sin(2 * pi() * month / 12.0), 9), 6) AS month_sin, round(round(cos(2 * pi() * month / 12.0), 9), 6) AS month_cos
FROM tx""")
def q_cyclical_encode(spark, d):
    t = fx.tx(spark, d)
    hs, hc = S.cyclical("hour", 24)
    ds, dc = S.cyclical("day_of_week", 7)
    ms, mc = S.cyclical("month", 12)
    return finish(t.select("transaction_id", hs.alias("hour_sin"), hc.alias("hour_cos"),
                           ds.alias("day_sin"), dc.alias("day_cos"),
                           ms.alias("month_sin"), mc.alias("month_cos")))


@query("amount_transforms", """
SELECT transaction_id, round(ln(amount), 6) AS amount_log, CAST(round(amount, 0) AS INT) AS amount_rounded
FROM tx""")
def q_amount_transforms(spark, d):
    t = fx.tx(spark, d)
    return finish(t.select("transaction_id", S.amount_log("amount").alias("amount_log"),
                           S.amount_rounded("amount").alias("amount_rounded")))


@query("session_bucket", """
SELECT transaction_id, CASE WHEN hour >= 22 OR hour < 6 THEN 'Night (22–05)' ELSE 'Business (06–21)' END
  AS session FROM tx""")
def q_session_bucket(spark, d):
    return fx.tx(spark, d).select("transaction_id", S.session_bucket("hour").alias("session"))


@query("age_ordinal", """
SELECT transaction_id, age_group, CASE age_group WHEN '<20' THEN 1 WHEN '20-29' THEN 2
  WHEN '30-39' THEN 3 WHEN '40+' THEN 4 END AS age_numeric FROM tx""")
def q_age_ordinal(spark, d):
    return fx.tx(spark, d).select("transaction_id", "age_group",
                                  S.age_ordinal("age_group").alias("age_numeric"))


@query("drop_if_present", """
SELECT transaction_id, customer_id, ts, amount, channel, k, merchant_category, bank, location, hour,
       day_of_week, month, age_group, is_fraud FROM tx""")
def q_drop_if_present(spark, d):
    return S.drop_if_present(fx.tx(spark, d))


@query("label_encode", """
WITH codes AS (SELECT channel, CAST(dense_rank() OVER (ORDER BY channel) - 1 AS INT) AS channel_encoded
               FROM (SELECT DISTINCT channel FROM tx WHERE channel IS NOT NULL))
SELECT t.transaction_id, t.channel, c.channel_encoded FROM tx t LEFT JOIN codes c USING (channel)""")
def q_label_encode(spark, d):
    t = fx.tx(spark, d).select("transaction_id", "channel")
    return encode.label_encode(t, "channel")


_BANKS = [f"B{i}" for i in range(10)]


@query("one_hot", "SELECT transaction_id, " + ", ".join(
    f"CAST(CASE WHEN bank = '{b}' THEN 1 ELSE 0 END AS INT) AS bank_{b}" for b in _BANKS) + " FROM tx")
def q_one_hot(spark, d):
    t = fx.tx(spark, d).select("transaction_id", "bank")
    return encode.one_hot(t, "bank", values=_BANKS).drop("bank")


@query("prefix_select", "SELECT transaction_id, " + ", ".join(
    f"CAST(CASE WHEN bank = '{b}' THEN 1 ELSE 0 END AS INT) AS bank_{b}" for b in _BANKS)
    + ", amount, hour, day_of_week, month FROM tx")
def q_prefix_select(spark, d):
    t = encode.one_hot(fx.tx(spark, d), "bank", values=_BANKS)
    return encode.prefix_select(t, prefixes=["bank_"], numeric=True,
                                exclude=["customer_id", "k", "is_fraud"], keep=["transaction_id"])


# ---------------------------------------------------------------- risk tables
def _risk_sql(dim, extra=""):
    return f"""
SELECT {dim}, count(is_fraud) AS total, CAST(sum(is_fraud) AS BIGINT) AS fraud_cases,
       round(CAST(sum(is_fraud) AS DOUBLE) / count(is_fraud) * 100, 6) AS fraud_rate_pct
FROM tx WHERE {dim} IS NOT NULL {extra} GROUP BY {dim}"""


@query("risk_by_channel", _risk_sql("channel") + " ORDER BY fraud_rate_pct DESC, channel")
def q_risk_by_channel(spark, d):
    return finish(risk.risk_by(fx.tx(spark, d), "channel")
                  .orderBy(F.col("fraud_rate_pct").desc(), "channel"))


_RISK_CTE = """WITH t AS (SELECT {dim}, count(is_fraud) AS total, CAST(sum(is_fraud) AS BIGINT) AS fraud_cases,
       CAST(sum(is_fraud) AS DOUBLE) / count(is_fraud) * 100 AS fraud_rate_pct
FROM tx WHERE {dim} IS NOT NULL GROUP BY {dim})"""


@query("risk_by_hour", _RISK_CTE.format(dim="hour") + """
SELECT hour, total, fraud_cases, round(fraud_rate_pct, 6) AS fraud_rate_pct,
  (SELECT arg_max(hour, (fraud_rate_pct, -hour)) FROM t) AS peak_hour,
  round((SELECT max(fraud_rate_pct) FROM t), 6) AS peak_rate_pct FROM t""")
def q_risk_by_hour(spark, d):
    return finish(risk.risk_by_hour(fx.tx(spark, d)))


@query("peak_vs_baseline", _RISK_CTE.format(dim="hour") + """,
a AS (SELECT arg_max(hour, (fraud_rate_pct, -hour)) AS peak_hour, max(fraud_rate_pct) AS peak_rate_pct,
  avg(CASE WHEN hour >= 9 AND hour <= 17 THEN fraud_rate_pct END) AS baseline_rate_pct FROM t)
SELECT peak_hour, round(peak_rate_pct, 6) AS peak_rate_pct, round(baseline_rate_pct, 6) AS baseline_rate_pct,
  round((peak_rate_pct - baseline_rate_pct) / baseline_rate_pct * 100, 6) AS uplift_pct FROM a""")
def q_peak_vs_baseline(spark, d):
    return finish(risk.peak_vs_baseline(fx.tx(spark, d)))


_SESSION = "CASE WHEN hour >= 22 OR hour < 6 THEN 'Night (22–05)' ELSE 'Business (06–21)' END"


@query("risk_by_session", f"""
WITH t AS (SELECT {_SESSION} AS session, count(is_fraud) AS volume, CAST(sum(is_fraud) AS BIGINT) AS fraud_cases
           FROM tx GROUP BY 1)
SELECT session, volume, fraud_cases, round(CAST(fraud_cases AS DOUBLE) / volume * 100, 6) AS fraud_rate_pct,
  round(CAST(volume AS DOUBLE) * 100 / (SELECT sum(volume) FROM t), 6) AS volume_pct FROM t""")
def q_risk_by_session(spark, d):
    return finish(risk.risk_by_session(fx.tx(spark, d)))


@query("risk_by_location", _risk_sql("location"))
def q_risk_by_location(spark, d):
    return finish(risk.risk_by(fx.tx(spark, d), "location"))


@query("risk_by_bank_spread", _RISK_CTE.format(dim="bank") + """,
e AS (SELECT min(fraud_rate_pct) AS lo, max(fraud_rate_pct) AS hi FROM t)
SELECT bank, total, fraud_cases, round(fraud_rate_pct, 6) AS fraud_rate_pct,
  round(lo, 6) AS min_rate_pct, (SELECT min(bank) FROM t WHERE fraud_rate_pct = lo) AS min_bank,
  round(hi, 6) AS max_rate_pct, (SELECT min(bank) FROM t WHERE fraud_rate_pct = hi) AS max_bank
FROM t, e""")
def q_risk_by_bank_spread(spark, d):
    return finish(risk.risk_by_bank_spread(fx.tx(spark, d)))


@query("risk_by_age", _RISK_CTE.format(dim="age_group") + """
SELECT age_group, total, fraud_cases, round(fraud_rate_pct, 6) AS fraud_rate_pct,
  round(CAST(fraud_cases AS DOUBLE) * 100 / (SELECT sum(fraud_cases) FROM t), 6) AS pct_of_all_fraud FROM t""")
def q_risk_by_age(spark, d):
    return finish(risk.risk_by_age(fx.tx(spark, d)))


@query("channel_session_pivot", f"""
WITH p AS (SELECT channel,
  avg(CASE WHEN {_SESSION} = 'Business (06–21)' THEN CAST(is_fraud AS DOUBLE) END) * 100 AS b,
  avg(CASE WHEN {_SESSION} = 'Night (22–05)' THEN CAST(is_fraud AS DOUBLE) END) * 100 AS n
  FROM tx WHERE channel IS NOT NULL GROUP BY channel)
SELECT channel, round(b, 6) AS business_rate_pct, round(n, 6) AS night_rate_pct,
       round((n - b) / b * 100, 6) AS change_pct FROM p""")
def q_channel_session_pivot(spark, d):
    return finish(risk.channel_session_pivot(fx.tx(spark, d)))


@query("bank_location_matrix", "SELECT bank, " + ", ".join(
    f"round(avg(CASE WHEN location = '{loc}' THEN CAST(is_fraud AS DOUBLE) END) * 100, 6) AS \"{loc}\""
    for loc in LOCATIONS) + " FROM tx WHERE bank IS NOT NULL AND location IS NOT NULL GROUP BY bank")
def q_bank_location_matrix(spark, d):
    return finish(risk.bank_location_matrix(fx.tx(spark, d), values=LOCATIONS))


@query("top_risk_cells", """
SELECT bank, location, count(is_fraud) AS total, CAST(sum(is_fraud) AS BIGINT) AS fraud_cases,
  round(CAST(sum(is_fraud) AS DOUBLE) / count(is_fraud) * 100, 6) AS fraud_rate_pct
FROM tx WHERE bank IS NOT NULL AND location IS NOT NULL GROUP BY bank, location
ORDER BY CAST(sum(is_fraud) AS DOUBLE) / count(is_fraud) DESC, bank, location LIMIT 5""")
def q_top_risk_cells(spark, d):
    return finish(risk.top_risk_cells(fx.tx(spark, d)))


@query("risk_cube3", """
SELECT bank, location, channel, CAST(GROUPING(bank, location, channel) AS INT) AS gid,
  count(is_fraud) AS total, CAST(sum(is_fraud) AS BIGINT) AS fraud_cases,
  round(CAST(sum(is_fraud) AS DOUBLE) / count(is_fraud) * 100, 6) AS fraud_rate_pct
FROM tx GROUP BY CUBE (bank, location, channel)""")
def q_risk_cube3(spark, d):
    return finish(risk.risk_cube(fx.tx(spark, d)))


@query("top_cube_cell", """
SELECT bank, location, channel, 0 AS gid, count(is_fraud) AS total, CAST(sum(is_fraud) AS BIGINT) AS fraud_cases,
  round(CAST(sum(is_fraud) AS DOUBLE) / count(is_fraud) * 100, 6) AS fraud_rate_pct
FROM tx GROUP BY bank, location, channel
ORDER BY CAST(sum(is_fraud) AS DOUBLE) / count(is_fraud) * 100 DESC NULLS LAST, bank NULLS FIRST,
  location NULLS FIRST, channel NULLS FIRST LIMIT 1""")
def q_top_cube_cell(spark, d):
    return finish(risk.top_cube_cell(risk.risk_cube(fx.tx(spark, d))))


@query("amount_gap_by_channel", """
WITH g AS (SELECT channel, avg(CASE WHEN is_fraud = 0 THEN amount END) AS l,
                           avg(CASE WHEN is_fraud = 1 THEN amount END) AS f
           FROM tx WHERE channel IS NOT NULL GROUP BY channel)
SELECT channel, round(l, 6) AS legitimate_avg, round(f, 6) AS fraud_avg,
       round(round((f - l) / l * 100, 1), 6) AS differential_pct FROM g""")
def q_amount_gap_by_channel(spark, d):
    return finish(risk.amount_gap_by_channel(fx.tx(spark, d)))


def _features_numeric():
    return ["amount", "hour", "day_of_week", "month", "age_numeric", "merchant_risk_score"]


@query("corr_with_label", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round(r, 6) AS r, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS sign "
    f"FROM (SELECT CASE WHEN isnan(corr(CAST({e} AS DOUBLE), CAST(is_fraud AS DOUBLE))) THEN NULL "
    f"ELSE corr(CAST({e} AS DOUBLE), CAST(is_fraud AS DOUBLE)) END AS r FROM tx)"
    for c, e in [("amount", "amount"), ("hour", "hour"), ("day_of_week", "day_of_week"),
                 ("month", "month"),
                 ("age_numeric", "CASE age_group WHEN '<20' THEN 1 WHEN '20-29' THEN 2 WHEN '30-39' THEN 3 WHEN '40+' THEN 4 END"),
                 ("merchant_risk_score", "CASE merchant_category WHEN 'AUTOMOBILE' THEN 0.1 WHEN 'BUILDING' THEN 0.2 "
                  "WHEN 'FURNITURE' THEN 0.3 WHEN 'HOUSEHOLD' THEN 0.4 WHEN 'MACHINERY' THEN 0.5 END")]))
def q_corr_with_label(spark, d):
    t = fx.tx(spark, d).select("*", S.age_ordinal("age_group").alias("age_numeric"),
                               fx.merchant_risk_col().alias("merchant_risk_score"))
    return finish(risk.corr_with_label(t, _features_numeric()))


@query("corr_one_vs_rest", "\nUNION ALL\n".join(
    f"SELECT 'amount' AS target, '{c}' AS feature, round(corr(CAST({c} AS DOUBLE), amount), 6) AS r FROM tx"
    for c in ["hour", "day_of_week", "is_fraud"]))
def q_corr_one_vs_rest(spark, d):
    return finish(risk.corr_one_vs_rest(fx.tx(spark, d), "amount", ["hour", "day_of_week", "is_fraud"]))


@query("class_conditional_means", """
SELECT is_fraud, round(avg(amount), 6) AS amount, round(avg(CAST(hour AS DOUBLE)), 6) AS hour,
  round(avg(CAST(day_of_week AS DOUBLE)), 6) AS day_of_week FROM tx GROUP BY is_fraud""")
def q_class_conditional_means(spark, d):
    return finish(risk.class_conditional_means(fx.tx(spark, d), ["amount", "hour", "day_of_week"]))


@query("class_weights", """
WITH per AS (SELECT is_fraud, count(*) AS n FROM tx GROUP BY is_fraud)
SELECT is_fraud, n, round(CAST((SELECT sum(n) FROM per) AS DOUBLE) / ((SELECT count(*) FROM per) * n), 6)
  AS weight FROM per""")
def q_class_weights(spark, d):
    return finish(risk.class_weights(fx.tx(spark, d)))


@query("top_customer", """
SELECT customer_id, count(*) AS n_rows FROM tx WHERE customer_id IS NOT NULL GROUP BY customer_id
ORDER BY n_rows DESC, customer_id LIMIT 1""")
def q_top_customer(spark, d):
    return risk.top_key(fx.tx(spark, d), "customer_id")


@query("value_counts", """
SELECT age_group, count(*) AS n_rows FROM tx WHERE age_group IS NOT NULL GROUP BY age_group
ORDER BY age_group""")
def q_value_counts(spark, d):
    return risk.value_counts(fx.tx(spark, d), "age_group")

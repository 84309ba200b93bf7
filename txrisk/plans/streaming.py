"""Registered queries: streaming operators (ops 133-135), each run with an
``availableNow`` trigger over the events table and compared with its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from txrisk.operators import models as ML
from txrisk.plans.common import finish
from txrisk.plans.history import W24, msum
from txrisk.plans.lr_sql import newton_ctes, probability
from txrisk.registry import query
from txrisk.sources import fixtures as fx
from txrisk.streaming import stream as ST


FILES_PER_BATCH = 1000  # bounds what one micro-batch reads


def _tx_stream(spark, d):
    return fx.tx(spark, d, events=ST.file_stream(spark, d, "events.parquet", FILES_PER_BATCH))


@query("stream_risk_windows", """
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, channel,
  count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS fraud_cases,
  round(CAST(sum(is_fraud) AS DOUBLE) / count(*) * 100, 6) AS fraud_rate_pct FROM tx GROUP BY 1, 2, 3""")
def q_stream_risk_windows(spark, d):
    out = ST.stream_risk_windows(_tx_stream(spark, d), ML.shared_path(spark, "risk_windows"),
                                 ML.shared_path(spark, "risk_windows_ckpt"))
    return finish(out)


@query("stream_velocity_24h", f"""
SELECT transaction_id, customer_id, count(amount) {W24} AS tx_count_24h, round({msum(W24)}, 6) AS amount_sum_24h
FROM tx""")
def q_stream_velocity_24h(spark, d):
    out = ST.stream_velocity_24h(_tx_stream(spark, d), ML.shared_path(spark, "velocity"),
                                 ML.shared_path(spark, "velocity_ckpt"))
    return finish(out)


_STREAM_FEATURES = ["amount", "hour", "day_of_week", "merchant_risk_score", "age_numeric"]


@query("stream_score", f"""WITH RECURSIVE feats AS (SELECT transaction_id, is_fraud, amount, hour, day_of_week,
  CASE merchant_category WHEN 'AUTOMOBILE' THEN 0.1 WHEN 'BUILDING' THEN 0.2 WHEN 'FURNITURE' THEN 0.3
    WHEN 'HOUSEHOLD' THEN 0.4 WHEN 'MACHINERY' THEN 0.5 END AS merchant_risk_score,
  CASE age_group WHEN '<20' THEN 1 WHEN '20-29' THEN 2 WHEN '30-39' THEN 3 WHEN '40+' THEN 4 END AS age_numeric FROM tx),
{newton_ctes('feats', _STREAM_FEATURES, 'TRUE')}
SELECT transaction_id, round({probability(_STREAM_FEATURES)}, 6) AS fraud_probability,
  CAST({probability(_STREAM_FEATURES)} > 0.5 AS INT) AS predicted FROM lr_rows, lr_beta""")
def q_stream_score(spark, d):
    from txrisk.functions import scalar as S

    def with_feats(df):
        return df.select("*", fx.merchant_risk_col().alias("merchant_risk_score"),
                         S.age_ordinal("age_group").alias("age_numeric"))

    model = ML.train_lr(with_feats(fx.tx(spark, d)), _STREAM_FEATURES)
    model = ML.model_persist(model, ML.shared_path(spark, "stream_model"))
    return finish(ST.stream_score(with_feats(_tx_stream(spark, d)), model, ML.shared_path(spark, "stream_scores"),
                                  ML.shared_path(spark, "stream_scores_ckpt")))

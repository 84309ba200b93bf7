"""Registered queries: splits, samples, selection, metrics and error analysis
(ops 37-41, 48, 82-89, 100-117) over the ``scored`` fixture, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.functions import scalar as S
from txrisk.operators import errors as E, history as H, metrics as M, risk, select as SEL, split
from txrisk.plans.common import finish
from txrisk.registry import query
from txrisk.sources import fixtures as fx


def scored_pred(spark, d) -> DataFrame:
    """``scored`` + the class rule of predict (p > 0.5)."""
    return fx.scored(spark, d).select("*", M.predict_gt("score").alias("predicted"))


PRED = "CAST(score > 0.5 AS INT)"
CUM = """g AS (SELECT score, CAST(sum(is_fraud) AS BIGINT) AS pos, CAST(sum(1 - is_fraud) AS BIGINT) AS neg
   FROM scored WHERE score IS NOT NULL GROUP BY score),
cum AS (SELECT score, pos, neg,
   CAST(sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp,
   CAST(sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fp,
   CAST(sum(pos) OVER () AS BIGINT) AS P, CAST(sum(neg) OVER () AS BIGINT) AS N FROM g)"""


def _cum(spark, d, score="score"):
    return M.cumulative_by_score(fx.scored(spark, d), score, "is_fraud")


# ---------------------------------------------------------------- metrics
@query("auc_roc", f"""WITH {CUM}
SELECT round(sum(neg * (tp - pos + pos / 2.0)) / (max(P) * max(N)), 6) AS auc FROM cum""")
def q_auc_roc(spark, d):
    return finish(M.auc_roc(_cum(spark, d)))


@query("roc_curve", f"""WITH {CUM}
SELECT CAST(NULL AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr
UNION ALL SELECT score, round(fp / N, 6), round(tp / P, 6) FROM cum""")
def q_roc_curve(spark, d):
    return finish(M.roc_curve(_cum(spark, d)))


@query("pr_curve_f1", f"""WITH {CUM}
SELECT score AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / P, 6) AS recall,
  round(2 * (tp / (tp + fp)) * (tp / P) / ((tp / (tp + fp)) + (tp / P) + 1e-9), 6) AS f1 FROM cum""")
def q_pr_curve_f1(spark, d):
    return finish(M.pr_curve_f1(_cum(spark, d)))


@query("threshold_for_recall", f"""WITH {CUM},
b AS (SELECT max(score) AS threshold FROM cum WHERE tp / P >= 0.75)
SELECT b.threshold, 0.75 AS target_recall, round(c.tp / c.P, 6) AS recall,
  round(c.tp / (c.tp + c.fp), 6) AS precision FROM b LEFT JOIN cum c ON c.score = b.threshold""")
def q_threshold_for_recall(spark, d):
    return finish(M.threshold_for_recall(_cum(spark, d), 0.75))


_CONF = f"""conf AS (SELECT
  CAST(sum(CASE WHEN is_fraud = 0 AND {PRED} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN is_fraud = 0 AND {PRED} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN is_fraud = 1 AND {PRED} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN is_fraud = 1 AND {PRED} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM scored)"""


def _sd(a, b):
    return f"(CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END)"


@query("confusion_matrix", f"""WITH {_CONF}
SELECT tn, fp, fn, tp, CAST(floor(fp / greatest(tp, 1)) AS BIGINT) AS false_alarms_per_catch FROM conf""")
def q_confusion_matrix(spark, d):
    return M.confusion_matrix(fx.scored(spark, d))


_PREC, _REC = _sd("tp", "tp + fp"), _sd("tp", "tp + fn")


@query("core_metrics", f"""WITH {_CONF}
SELECT tp, fp, fn, tn, round({_sd('tp + tn', 'tp + fp + fn + tn')}, 6) AS accuracy,
  round({_PREC}, 6) AS precision, round({_REC}, 6) AS recall,
  round(CASE WHEN {_PREC} + {_REC} > 0 THEN 2 * {_PREC} * {_REC} / ({_PREC} + {_REC}) ELSE 0.0 END, 6) AS f1
FROM conf""")
def q_core_metrics(spark, d):
    return finish(M.core_metrics(fx.scored(spark, d)))


def _cls_sql(name, tp, fp, fn, support):
    p, r = _sd(tp, f"{tp} + {fp}"), _sd(tp, f"{tp} + {fn}")
    f = f"(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END)"
    return p, r, f, support


@query("classification_report", (lambda c0, c1: f"""WITH {_CONF},
r AS (SELECT {c0[0]} AS p0, {c0[1]} AS r0, {c0[2]} AS f0, {c0[3]} AS s0,
             {c1[0]} AS p1, {c1[1]} AS r1, {c1[2]} AS f1, {c1[3]} AS s1,
             tp + fp + fn + tn AS n, {_sd('tp + tn', 'tp + fp + fn + tn')} AS acc FROM conf)
SELECT '0' AS class_label, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1,
  s0 AS support FROM r
UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), s1 FROM r
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), n FROM r
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / n, 6), round((r0 * s0 + r1 * s1) / n, 6),
  round((f0 * s0 + f1 * s1) / n, 6), n FROM r
UNION ALL SELECT 'accuracy', NULL, NULL, round(acc, 6), n FROM r""")(
    _cls_sql("0", "tn", "fn", "fp", "tn + fp"), _cls_sql("1", "tp", "fp", "fn", "tp + fn")))
def q_classification_report(spark, d):
    return finish(M.classification_report(fx.scored(spark, d)))


_THR = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
_SWEEP = """sw0 AS (SELECT t.threshold,
  CAST(sum(CASE WHEN s.score >= t.threshold AND s.is_fraud = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN s.score >= t.threshold AND s.is_fraud = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN s.score < t.threshold AND s.is_fraud = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN s.score < t.threshold AND s.is_fraud = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn
  FROM scored s, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS threshold) t
  GROUP BY t.threshold)"""


@query("threshold_sweep", f"""WITH {_SWEEP}
SELECT threshold, tp, fp, fn, tn, round({_PREC}, 6) AS precision, round({_REC}, 6) AS recall,
  round(2 * {_PREC} * {_REC} / ({_PREC} + {_REC} + 1e-9), 6) AS f1 FROM sw0""")
def q_threshold_sweep(spark, d):
    return finish(M.threshold_sweep(fx.scored(spark, d), thresholds=_THR))


@query("threshold_value", f"""WITH {_SWEEP},
v AS (SELECT threshold, tp, fp, fn, tp - fp * 0.01 - fn * 0.1 AS value FROM sw0)
SELECT threshold, tp, fp, fn, round(value, 6) AS value FROM v
ORDER BY value DESC, threshold ASC LIMIT 1""")
def q_threshold_value(spark, d):
    sw = M.threshold_sweep(fx.scored(spark, d), thresholds=_THR)
    return finish(M.threshold_value(sw, alpha=0.01, beta_ratio=10.0))


def _metrics_sql(col):
    pred = f"CAST({col} > 0.5 AS INT)"
    return f"""(SELECT
  CAST(sum(CASE WHEN is_fraud = 0 AND {pred} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN is_fraud = 0 AND {pred} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN is_fraud = 1 AND {pred} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN is_fraud = 1 AND {pred} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM scored)"""


def _auc_sql(col):
    return f"""(WITH g AS (SELECT {col} AS sc, sum(is_fraud) AS pos, sum(1 - is_fraud) AS neg FROM scored
   GROUP BY {col}), c AS (SELECT pos, neg, sum(pos) OVER (ORDER BY sc DESC ROWS UNBOUNDED PRECEDING) AS tp,
   sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM g)
  SELECT sum(neg * (tp - pos + pos / 2.0)) / (max(P) * max(N)) AS auc FROM c)"""


def _long_metrics(alias, col):
    return f"""{alias} AS (SELECT m.*, ({_auc_sql(col)}) AS auc FROM {_metrics_sql(col)} m),
{alias}l AS (SELECT 'auc' AS metric, auc AS v FROM {alias}
  UNION ALL SELECT 'accuracy', {_sd('tp + tn', 'tp + fp + fn + tn')} FROM {alias}
  UNION ALL SELECT 'precision', {_PREC} FROM {alias}
  UNION ALL SELECT 'recall', {_REC} FROM {alias}
  UNION ALL SELECT 'f1', CASE WHEN {_PREC} + {_REC} > 0 THEN 2 * {_PREC} * {_REC} / ({_PREC} + {_REC})
    ELSE 0.0 END FROM {alias})"""


@query("model_comparison", f"""WITH {_long_metrics('ma', 'score')}, {_long_metrics('mb', 'score_b')}
SELECT a.metric, round(a.v, 6) AS model_a, round(b.v, 6) AS model_b,
  round(CASE WHEN a.v <> 0 THEN (b.v - a.v) / a.v * 100 END, 6) AS relative_change_pct
FROM mal a JOIN mbl b USING (metric)""")
def q_model_comparison(spark, d):
    return finish(M.model_comparison(fx.scored(spark, d), "score", "score_b"))


@query("alert_cost", f"""WITH {_CONF}
SELECT tp + fp AS alerts, round((tp + fp) * 10.0, 6) AS investigation_cost,
  round({_sd('fp', 'tp + fp')}, 6) AS false_discovery_rate, round({_sd('fp', 'fp + tn')}, 6) AS false_positive_rate
FROM conf""")
def q_alert_cost(spark, d):
    return finish(M.alert_cost(fx.scored(spark, d)))


@query("roc_interp_join", """
WITH ga AS (SELECT score AS sc, sum(is_fraud) AS pos, sum(1 - is_fraud) AS neg FROM scored GROUP BY score),
ca AS (SELECT DISTINCT x, y FROM (
   SELECT CAST(sum(neg) OVER (ORDER BY sc DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(neg) OVER () AS x,
          CAST(sum(pos) OVER (ORDER BY sc DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(pos) OVER () AS y FROM ga
   UNION ALL SELECT 0.0, 0.0)),
gb AS (SELECT score_b AS sc, sum(is_fraud) AS pos, sum(1 - is_fraud) AS neg FROM scored GROUP BY score_b),
cb AS (SELECT CAST(sum(neg) OVER (ORDER BY sc DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(neg) OVER () AS x,
          CAST(sum(pos) OVER (ORDER BY sc DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(pos) OVER () AS tpr_b FROM gb
   UNION ALL SELECT 0.0, 0.0),
lx AS (SELECT cb.x, cb.tpr_b, (SELECT max(a.x) FROM ca a WHERE a.x <= cb.x) AS x0,
   (SELECT min(a.x) FROM ca a WHERE a.x > cb.x) AS x1 FROM cb),
lr AS (SELECT lx.*, (SELECT max(a.y) FROM ca a WHERE a.x = lx.x0) AS y0,
   (SELECT min(a.y) FROM ca a WHERE a.x = lx.x1) AS y1 FROM lx),
i AS (SELECT x, tpr_b, CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x = x0 THEN y0
   ELSE y0 + (y1 - y0) * (x - x0) / (x1 - x0) END AS v FROM lr)
SELECT round(x, 6) AS fpr, round(tpr_b, 6) AS tpr_b, round(v, 6) AS tpr_a_interp, round(tpr_b - v, 6) AS gap FROM i""")
def q_roc_interp_join(spark, d):
    s = fx.scored(spark, d)
    ca = M.roc_curve(M.cumulative_by_score(s, "score"))
    cb = M.roc_curve(M.cumulative_by_score(s, "score_b"), "score_b")
    return finish(M.roc_interp_join(ca, cb))


# ---------------------------------------------------------------- splits and samples
_MD5 = "md5(CAST(transaction_id AS VARCHAR))"


@query("stratified_split", f"""
SELECT transaction_id, is_fraud, row_number() OVER (PARTITION BY is_fraud ORDER BY {_MD5}, transaction_id)
  <= round(0.2 * count(*) OVER (PARTITION BY is_fraud)) AS is_test FROM tx""")
def q_stratified_split(spark, d):
    t = fx.tx(spark, d).select("transaction_id", "is_fraud")
    return split.stratified_split(t)


@query("temporal_split", """
SELECT transaction_id, CASE WHEN ts < TIMESTAMP '2024-01-24 00:00:00' THEN 'train' ELSE 'test' END AS split
FROM tx""")
def q_temporal_split(spark, d):
    t = fx.tx(spark, d).select("transaction_id", "ts")
    return split.temporal_split(t, cutoff=fx.TIME_SPLIT_DATE).drop("ts")


@query("stratified_kfold", f"""
SELECT transaction_id, is_fraud,
  CAST((row_number() OVER (PARTITION BY is_fraud ORDER BY {_MD5}, transaction_id) - 1) % 3 AS INT) AS fold
FROM tx""")
def q_stratified_kfold(spark, d):
    return split.stratified_kfold(fx.tx(spark, d).select("transaction_id", "is_fraud"), 3)


_CASES_SQL = f"""cases AS (
  SELECT transaction_id, is_fraud, {PRED} AS predicted, score,
    CASE WHEN is_fraud = 1 THEN 'true_fraud' ELSE 'false_positive' END AS case_type FROM scored
  WHERE is_fraud = 1 OR (is_fraud = 0 AND {PRED} = 1))"""

#: The bounded choice of cases that are explained by a language model and rated by people.
_PICKED_SQL = f"""cases AS (
  (SELECT transaction_id, is_fraud, {PRED} AS predicted, score, 'true_fraud' AS case_type FROM scored
   WHERE is_fraud = 1 ORDER BY md5('42:' || CAST(transaction_id AS VARCHAR)), transaction_id LIMIT 50)
  UNION ALL
  (SELECT transaction_id, is_fraud, {PRED} AS predicted, score, 'false_positive' AS case_type FROM scored
   WHERE is_fraud = 0 AND {PRED} = 1 ORDER BY md5('42:' || CAST(transaction_id AS VARCHAR)), transaction_id
   LIMIT 50))"""


def cases(spark, d) -> DataFrame:
    """Every fraud and every false positive."""
    return split.flagged_cases(scored_pred(spark, d).select("transaction_id", "is_fraud", "predicted", "score"))


def picked_cases(spark, d) -> DataFrame:
    return split.select_cases(scored_pred(spark, d).select("transaction_id", "is_fraud", "predicted", "score"))


@query("select_cases", f"WITH {_PICKED_SQL}\nSELECT * FROM cases")
def q_select_cases(spark, d):
    return picked_cases(spark, d)


@query("blind_rating_sample", f"""WITH {_PICKED_SQL},
c AS (SELECT transaction_id AS row_index, case_type, is_fraud AS actual_is_fraud,
   md5('42:' || CAST(transaction_id AS VARCHAR)) AS h FROM cases),
r AS (SELECT *, row_number() OVER (PARTITION BY case_type ORDER BY h, row_index) AS rk FROM c),
f AS (SELECT * FROM r WHERE rk <= 25),
t AS (SELECT * FROM r WHERE row_index NOT IN (SELECT row_index FROM f)),
tu AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY h, row_index) AS tt FROM t)
       WHERE tt <= 50 - (SELECT count(*) FROM f)),
ch AS (SELECT row_index, case_type, actual_is_fraud FROM f
       UNION ALL SELECT row_index, case_type, actual_is_fraud FROM tu)
SELECT row_index, case_type, actual_is_fraud,
  row_number() OVER (ORDER BY md5('42:shuffle:' || CAST(row_index AS VARCHAR)), row_index) AS case_id FROM ch""")
def q_blind_rating_sample(spark, d):
    c = picked_cases(spark, d).select(F.col("transaction_id").alias("row_index"), "case_type",
                                      F.col("is_fraud").alias("actual_is_fraud"))
    return split.blind_rating_sample(c)


# ---------------------------------------------------------------- selection
@query("outcome_subset", f"""
SELECT transaction_id, CASE WHEN is_fraud = 1 AND {PRED} = 1 THEN 'TP' WHEN is_fraud = 1 THEN 'FN'
  WHEN {PRED} = 1 THEN 'FP' ELSE 'TN' END AS outcome FROM scored""")
def q_outcome_subset(spark, d):
    return SEL.outcome_subset(scored_pred(spark, d)).select("transaction_id", "outcome")


@query("queue_filter", f"WITH {_CASES_SQL}\nSELECT * FROM cases WHERE case_type = 'false_positive'")
def q_queue_filter(spark, d):
    return SEL.queue_filter(cases(spark, d), "false_positive")


@query("case_lookup", f"""WITH {_CASES_SQL}
SELECT * FROM cases WHERE transaction_id = (SELECT min(transaction_id) FROM cases)""")
def q_case_lookup(spark, d):
    c = cases(spark, d)
    first = c.agg(F.min("transaction_id").alias("__id"))
    return c.join(first, c.transaction_id == first.__id).drop("__id")


@query("triage_order", f"WITH {_CASES_SQL}\nSELECT * FROM cases ORDER BY case_type, score DESC")
def q_triage_order(spark, d):
    return SEL.triage_order(cases(spark, d), prob="score")


@query("dropna_subset", """
WITH r AS (SELECT CASE WHEN k < 50 THEN k % 5 + 1 END AS rating FROM tx)
SELECT count(*) AS n, round(avg(CAST(rating AS DOUBLE)), 6) AS mean, round(stddev_samp(CAST(rating AS DOUBLE)), 6)
  AS std FROM r WHERE rating IS NOT NULL""")
def q_dropna_subset(spark, d):
    r = fx.tx(spark, d).select(F.when(F.col("k") < 50, F.col("k") % 5 + 1).alias("rating"))
    return finish(SEL.dropna_stats(r, "rating"))


_CELLS = """cells AS (SELECT bank, location, round(CAST(sum(is_fraud) AS DOUBLE) / count(*) * 100, 6) AS fraud_rate_pct
   FROM tx GROUP BY bank, location)"""


@query("top_bottom_union", f"""WITH {_CELLS}
SELECT DISTINCT * FROM (
  (SELECT * FROM cells ORDER BY fraud_rate_pct DESC, bank, location LIMIT 5)
  UNION ALL (SELECT * FROM cells ORDER BY fraud_rate_pct ASC, bank, location LIMIT 5))""")
def q_top_bottom_union(spark, d):
    cells = finish(risk.risk_by(fx.tx(spark, d), ["bank", "location"])).select(
        "bank", "location", "fraud_rate_pct")
    keyed = cells.select("*", F.concat_ws("|", "bank", "location").alias("__k"))
    return SEL.top_bottom_union(keyed, "fraud_rate_pct", "__k", 5).drop("__k")


@query("top_k_abs", f"""WITH {_CELLS}
SELECT * FROM cells ORDER BY abs(fraud_rate_pct - 3.5) DESC, bank, location LIMIT 2""")
def q_top_k_abs(spark, d):
    cells = finish(risk.risk_by(fx.tx(spark, d), ["bank", "location"])).select(
        "bank", "location", "fraud_rate_pct")
    dev = cells.select("*", (F.col("fraud_rate_pct") - 3.5).alias("__d"),
                       F.concat_ws("|", "bank", "location").alias("__k"))
    return SEL.top_k_abs(dev, "__d", "__k", 2).drop("__d", "__k")


@query("preview", """
SELECT transaction_id, customer_id, amount, channel FROM tx ORDER BY transaction_id LIMIT 5""")
def q_preview(spark, d):
    t = fx.tx(spark, d).select("transaction_id", "customer_id", "amount", "channel")
    return SEL.preview(t, "transaction_id", 5)


@query("sign_split", """
WITH c AS (SELECT 'amount' AS feature, corr(amount, CAST(is_fraud AS DOUBLE)) AS r FROM tx
  UNION ALL SELECT 'hour', corr(CAST(hour AS DOUBLE), CAST(is_fraud AS DOUBLE)) FROM tx
  UNION ALL SELECT 'day_of_week', corr(CAST(day_of_week AS DOUBLE), CAST(is_fraud AS DOUBLE)) FROM tx
  UNION ALL SELECT 'k', corr(CAST(k AS DOUBLE), CAST(is_fraud AS DOUBLE)) FROM tx),
s AS (SELECT feature, round(r, 6) AS r, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS sign,
   CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS side FROM c)
SELECT *, row_number() OVER (PARTITION BY side ORDER BY CASE WHEN r > 0 THEN -r ELSE r END, feature) AS side_rank
FROM s""")
def q_sign_split(spark, d):
    c = finish(risk.corr_with_label(fx.tx(spark, d), ["amount", "hour", "day_of_week", "k"]))
    return SEL.sign_split(c, "r", "feature")


# ---------------------------------------------------------------- error analysis
@query("fn_by_channel", f"""
SELECT channel, count(*) AS total_fraud, CAST(sum(CASE WHEN {PRED} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS missed,
  round(CAST(sum(CASE WHEN {PRED} = 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS fn_rate
FROM scored WHERE is_fraud = 1 AND channel IS NOT NULL GROUP BY channel""")
def q_fn_by_channel(spark, d):
    return finish(E.fn_by(scored_pred(spark, d), "channel"))


@query("fp_by_channel", f"""
SELECT channel, CAST(sum(CASE WHEN {PRED} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp_count, count(*) AS legit_rows,
  round(CAST(sum(CASE WHEN {PRED} = 1 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS fp_rate
FROM scored WHERE is_fraud = 0 AND channel IS NOT NULL GROUP BY channel""")
def q_fp_by_channel(spark, d):
    return finish(E.fp_by(scored_pred(spark, d), "channel"))


_BAND = ("CASE WHEN hour >= 0 AND hour < 6 THEN '00-06' WHEN hour >= 6 AND hour < 12 THEN '06-12' "
         "WHEN hour >= 12 AND hour < 18 THEN '12-18' WHEN hour >= 18 AND hour < 24 THEN '18-24' END")


@query("fn_by_hour", f"""
SELECT {_BAND} AS hour_band, count(*) AS total_fraud,
  CAST(sum(CASE WHEN {PRED} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS missed,
  round(CAST(sum(CASE WHEN {PRED} = 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS fn_rate
FROM scored WHERE is_fraud = 1 GROUP BY 1""")
def q_fn_by_hour(spark, d):
    return finish(E.fn_by_hour(scored_pred(spark, d)))


@query("fp_rate_by_bank", f"""
WITH t AS (SELECT bank, CAST(sum(CASE WHEN {PRED} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp_count,
   count(*) AS legit_rows FROM scored WHERE is_fraud = 0 AND bank IS NOT NULL GROUP BY bank),
o AS (SELECT CAST(sum(CASE WHEN {PRED} = 1 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS ov FROM scored WHERE is_fraud = 0)
SELECT bank, fp_count, legit_rows, round(CAST(fp_count AS DOUBLE) / legit_rows, 6) AS fp_rate,
  round(ov, 6) AS overall_fp_rate, round(CASE WHEN ov > 0 THEN (CAST(fp_count AS DOUBLE) / legit_rows) / ov END, 6)
  AS relative_to_overall FROM t, o""")
def q_fp_rate_by_bank(spark, d):
    return finish(E.fp_rate_by(scored_pred(spark, d), "bank"))


@query("group_threshold", """
WITH l AS (SELECT bank, score FROM scored WHERE is_fraud = 0 AND bank IS NOT NULL),
tg AS (SELECT CAST(sum(CASE WHEN score > 0.5 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS target_fpr FROM l),
g AS (SELECT bank, score, count(*) AS c FROM l GROUP BY bank, score),
c AS (SELECT bank, score, coalesce(sum(c) OVER (PARTITION BY bank ORDER BY score DESC
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
      sum(c) OVER (PARTITION BY bank) AS n_legit FROM g),
ok AS (SELECT c.*, tg.target_fpr FROM c, tg WHERE above <= target_fpr * n_legit)
SELECT bank, min(score) AS threshold, CAST(max(n_legit) AS BIGINT) AS n_legit, round(max(target_fpr), 6) AS target_fpr,
  round(CAST(arg_min(above, score) AS DOUBLE) / max(n_legit), 6) AS fp_rate_at_threshold FROM ok GROUP BY bank""")
def q_group_threshold(spark, d):
    return finish(E.group_threshold(fx.scored(spark, d), "bank"))


_PRIOR = ("OVER (PARTITION BY customer_id ORDER BY ts, transaction_id "
          "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")


def _history_scored(spark, d):
    return H.customer_history(scored_pred(spark, d))


@query("fn_amount_share", f"""
WITH h AS (SELECT *, {PRED} AS predicted,
   CAST(sum(CAST(amount AS DECIMAL(24,6))) {_PRIOR} AS DOUBLE) / count(amount) {_PRIOR} AS m,
   stddev_samp(amount) {_PRIOR} AS s FROM scored)
SELECT count(*) AS n_missed, round(avg(CASE WHEN amount < 200 THEN 1.0 ELSE 0.0 END), 6) AS share_small_amount,
  round(avg(CASE WHEN s IS NOT NULL THEN CASE WHEN abs(amount - m) <= 2 * s THEN 1.0 ELSE 0.0 END END), 6)
  AS share_within_k_sigma FROM h WHERE is_fraud = 1 AND predicted = 0""")
def q_fn_amount_share(spark, d):
    return finish(E.fn_amount_share(_history_scored(spark, d)))


@query("fp_profiles", f"""
WITH h AS (SELECT *, {PRED} AS predicted,
   count(amount) OVER (PARTITION BY customer_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)
     AS tx_count_24h,
   count(*) {_PRIOR} AS tx_count_prior,
   coalesce(amount / nullif(coalesce(CAST(sum(CAST(amount AS DECIMAL(24,6))) {_PRIOR} AS DOUBLE)
     / count(amount) {_PRIOR}, amount), 0), 1.0) AS ratio FROM scored),
p AS (SELECT CASE WHEN amount > 800 AND ratio > 5 THEN 'large_amount'
   WHEN tx_count_24h > 5 AND day_of_week >= 5 THEN 'velocity_weekend'
   WHEN tx_count_prior < 10 THEN 'new_account'
   WHEN hour >= 0 AND hour < 6 AND channel IN ('view', 'click', 'signup') THEN 'off_peak_online'
   ELSE 'other' END AS profile FROM h WHERE is_fraud = 0 AND predicted = 1)
SELECT profile, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS share
FROM p GROUP BY profile""")
def q_fp_profiles(spark, d):
    s = _history_scored(spark, d)
    s = s.select("*", S.is_weekend("day_of_week").alias("is_weekend"))
    return finish(E.fp_profiles(s))

"""Registered queries: model-ready table, MLlib training/scoring, ablation, CV,
persistence and TreeSHAP (ops 3, 8, 90-99, 118-124)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.operators import encode, history as H, metrics as M, models as ML, search, shap as SH, split
from txrisk.plans.common import finish
from txrisk.plans.history import _FEAT_SQL, risk_features
from txrisk.plans.lr_sql import newton_ctes, probability
from txrisk.registry import query
from txrisk.session import data_signature, materialize
from txrisk.sources import sinks

BANKS = [f"B{i}" for i in range(10)]
BANK_COLS = [f"bank_{b}" for b in BANKS]
FEATURES = ML.BASE_FEATURES + BANK_COLS
CANDIDATES = ["tx_count_24h", "amount_mean_7d"]



class Fitted:
    """What the model queries of one data folder share: the model-ready table, the split, the fitted
    models and the SHAP rows, each built at first use.  Tables are written once to the shared folder: a
    cached one would take the memory that the forest's training needs, and be computed twice where
    two stages of a query ask for it at once."""

    def __init__(self, spark, d: str):
        self.spark, self.d = spark, d
        self._made: dict = {}

    def get(self, name, make):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def release(self) -> None:
        for v in self._made.values():
            if isinstance(v, DataFrame):
                v.unpersist()
        self._made.clear()


_CURRENT: dict = {}


def fitted(spark, d) -> Fitted:
    """The fitted objects of folder ``d`` as its files are now.  One folder is held at a time: another
    application, folder or version of the files releases the one before."""
    key = (spark.sparkContext.applicationId, d, data_signature(spark, d))
    if key not in _CURRENT:
        release()
        _CURRENT[key] = Fitted(spark, d)
    return _CURRENT[key]


def release() -> None:
    for (app, _, _), f in _CURRENT.items():
        if app == f.spark.sparkContext.applicationId and f.spark.sparkContext._jsc is not None:
            f.release()
    _CURRENT.clear()


def features(spark, d) -> tuple[DataFrame, bool]:
    """The risk features, and whether they are the table that ``write_features`` left."""
    now = _CURRENT.get((spark.sparkContext.applicationId, d, data_signature(spark, d)))
    made = now and now._made.get("features")
    return (risk_features(spark, d), False) if made is None else (made, True)


def write_features(spark, d) -> DataFrame:
    """The risk features as one table, for queries that read them several times: the history is passed through once."""
    from txrisk.plans.discovery import CANDIDATE_COLUMNS

    def make() -> DataFrame:
        f = risk_features(spark, d)
        used = {"transaction_id", "is_fraud", "channel", "bank", *ML.BASE_FEATURES, *CANDIDATES, *CANDIDATE_COLUMNS}
        return materialize(f.select(*[c for c in f.columns if c in used]), ML.shared_path(spark, "features"))

    return fitted(spark, d).get("features", make)


def model_ready_frame(spark, d) -> DataFrame:
    needed = [c for c in ML.BASE_FEATURES + CANDIDATES if c != "composite_risk"]
    f, written = features(spark, d)
    f = H.composite_risk(f.select("transaction_id", "is_fraud", "channel", "bank", "velocity_score", *needed), written=written)
    f = encode.one_hot(f, "bank", values=BANKS)
    return f.select("transaction_id", *FEATURES, *CANDIDATES, "is_fraud")


def model_ready(spark, d) -> DataFrame:
    """Op 3 used as a lineage cut: written once per data version to the shared folder."""
    return fitted(spark, d).get("model_ready", lambda: sinks.sink_model_ready(
        model_ready_frame(spark, d), ML.shared_path(spark, "model_ready"), partition_by="month"))


def split_frame(spark, d) -> DataFrame:
    return fitted(spark, d).get("split", lambda: materialize(
        split.stratified_split(model_ready(spark, d)), ML.shared_path(spark, "split")))


def rf_model(spark, d):
    return fitted(spark, d).get("rf", lambda: ML.train_rf(
        split_frame(spark, d).filter(~F.col("is_test")), FEATURES))


def lr_model(spark, d):
    return fitted(spark, d).get("lr", lambda: ML.train_lr(
        split_frame(spark, d).filter(~F.col("is_test")), FEATURES))


def test_rows(spark, d) -> DataFrame:
    return split_frame(spark, d).filter(F.col("is_test"))


# ---------------------------------------------------------------- sources / sinks
def _mr_select(r) -> str:
    """The model-ready rows from the CTEs before; ``r`` wraps what is not a whole number."""
    share = " + ".join(f"(CASE WHEN h{i} > l{i} THEN ({v} - l{i}) / (h{i} - l{i}) ELSE 0.0 END) * (1.0 / 3)"
                       for i, v in (("v", "velocity_score"), ("r", "amount_vs_mean_ratio_safe"), ("c", "chr")))
    week = "OVER (PARTITION BY customer_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)"
    risk_score = ("CASE merchant_category WHEN 'AUTOMOBILE' THEN 0.1 WHEN 'BUILDING' THEN 0.2 WHEN 'FURNITURE' THEN 0.3 "
                  "WHEN 'HOUSEHOLD' THEN 0.4 WHEN 'MACHINERY' THEN 0.5 END")
    mean_7d = f"CAST(sum(CAST(amount AS DECIMAL(24,6))) {week} AS DOUBLE) / count(amount) {week}"
    return f"""SELECT transaction_id, {r('amount')} AS amount, hour, day_of_week, month,
  {r(risk_score)} AS merchant_risk_score, {r(share)} AS composite_risk,
  CASE age_group WHEN '<20' THEN 1 WHEN '20-29' THEN 2 WHEN '30-39' THEN 3 WHEN '40+' THEN 4 END AS age_numeric,
  {r('amount_sum_24h')} AS amount_sum_24h, {r('amount_vs_mean_ratio_safe')} AS amount_vs_mean_ratio_safe,
  {", ".join(f"CAST(CASE WHEN bank = '{b}' THEN 1 ELSE 0 END AS INT) AS bank_{b}" for b in BANKS)},
  tx_count_24h, {r(mean_7d)} AS amount_mean_7d, is_fraud
FROM c, m"""


_MR_CTES = _FEAT_SQL + """,
c AS (SELECT *, avg(CAST(is_fraud AS DOUBLE)) OVER (PARTITION BY channel) AS chr FROM feat),
m AS (SELECT min(velocity_score) AS lv, max(velocity_score) AS hv, min(amount_vs_mean_ratio_safe) AS lr,
   max(amount_vs_mean_ratio_safe) AS hr, min(chr) AS lc, max(chr) AS hc FROM c)
"""
_MR_SQL = _MR_CTES + _mr_select(lambda e: f"round({e}, 6)")

#: The fitted regression, found again in SQL from the unrounded model-ready rows.
_LR_CTES = _MR_CTES.strip().replace("WITH", "WITH RECURSIVE", 1) + f""",
mr AS ({_mr_select(lambda e: e)}),
parted AS (SELECT *, row_number() OVER (PARTITION BY is_fraud ORDER BY md5(CAST(transaction_id AS VARCHAR)), transaction_id)
   <= round(0.2 * count(*) OVER (PARTITION BY is_fraud)) AS is_test FROM mr),
{newton_ctes('parted', FEATURES, 'NOT is_test')}
"""


@query("sink_model_ready", _MR_SQL)
def q_sink_model_ready(spark, d):
    return finish(model_ready(spark, d))


@query("scale_features", """
WITH s AS (SELECT transaction_id, is_fraud, amount, CAST(hour AS DOUBLE) AS hour,
   row_number() OVER (PARTITION BY is_fraud ORDER BY md5(CAST(transaction_id AS VARCHAR)), transaction_id)
   <= round(0.2 * count(*) OVER (PARTITION BY is_fraud)) AS is_test FROM tx),
st AS (SELECT avg(amount) AS ma, stddev_pop(amount) AS sa, avg(hour) AS mh, stddev_pop(hour) AS sh
   FROM s WHERE NOT is_test)
SELECT transaction_id, round((amount - ma) / CASE WHEN sa = 0 THEN 1.0 ELSE sa END, 6) AS amount_scaled,
  round((hour - mh) / CASE WHEN sh = 0 THEN 1.0 ELSE sh END, 6) AS hour_scaled FROM s, st""")
def q_scale_features(spark, d):
    from txrisk.sources import fixtures as fx

    t = fx.tx(spark, d).select("transaction_id", "is_fraud", "amount", F.col("hour").cast("double"))
    s = split.stratified_split(t)
    return finish(ML.scale_features(s, ["amount", "hour"], fit_on=s.filter(~F.col("is_test")))
                  .select("transaction_id", "amount_scaled", "hour_scaled"))


# ---------------------------------------------------------------- models
@query("assemble_features")
def q_assemble_features(spark, d):
    a = ML.assemble_features(model_ready(spark, d), FEATURES)
    return a.select("transaction_id", "is_fraud", vector_to_array("features").alias("features"))


@query("train_lr", _LR_CTES + f"""SELECT transaction_id, is_fraud, round({probability(FEATURES)}, 6) AS fraud_probability,
  CAST({probability(FEATURES)} > 0.5 AS INT) AS predicted FROM lr_rows, lr_beta WHERE is_test""")
def q_train_lr(spark, d):
    return finish(ML.score_table(lr_model(spark, d), test_rows(spark, d), ["transaction_id", "is_fraud"]))


@query("lr_coefficients", _LR_CTES + f"""SELECT feature, round(c, 6) AS coefficient, round(abs(c), 6) AS abs_coefficient
FROM (SELECT unnest({FEATURES}) AS feature, unnest(beta[1:{len(FEATURES)}]) AS c FROM lr_beta) q""")
def q_lr_coefficients(spark, d):
    return finish(ML.lr_coefficients(lr_model(spark, d), FEATURES))


@query("train_rf")
def q_train_rf(spark, d):
    return ML.score_table(rf_model(spark, d), test_rows(spark, d), ["transaction_id", "is_fraud"])


@query("rf_importance")
def q_rf_importance(spark, d):
    return ML.rf_importance(rf_model(spark, d), FEATURES)


@query("score_table")
def q_score_table(spark, d):
    return ML.score_table(rf_model(spark, d), split_frame(spark, d),
                          ["transaction_id", "is_fraud", "is_test"])


@query("model_persist")
def q_model_persist(spark, d):
    m = rf_model(spark, d)
    loaded = ML.model_persist(m, ML.shared_path(spark, "rf_model"))
    a = ML.score_table(m, test_rows(spark, d), ["transaction_id"]).withColumnRenamed(
        "fraud_probability", "p_trained")
    b = ML.score_table(loaded, test_rows(spark, d), ["transaction_id"]).withColumnRenamed(
        "fraud_probability", "p_loaded")
    return a.join(b.select("transaction_id", "p_loaded"), "transaction_id").select(
        "transaction_id", "p_trained", "p_loaded",
        (F.abs(F.col("p_trained") - F.col("p_loaded")) <= 1e-12).alias("same"))


def with_candidates(spark, d, candidates) -> DataFrame:
    """The split table with the proposed candidate columns it lacks (null: 0), fetched by id."""
    from txrisk.plans.discovery import candidates_frame

    base = split_frame(spark, d)
    lacking = [c for c in candidates if c not in base.columns]
    if not lacking:
        return base
    extra = candidates_frame(spark, d).select(
        "transaction_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in lacking])
    return base.join(extra, "transaction_id")


def ablation(spark, d, proposed=None) -> DataFrame:
    """Op 97: baseline vs +candidates on the same split; AUC/recall deltas,
    newly caught / missed as set differences, verdict.

    ``proposed`` defaults to the accepted names of the proposal (a row per candidate column at
    most).  Names known to leak are excluded; it is an error when nothing is left to test.
    """
    from txrisk.plans.discovery import KNOWN_LEAKY, accepted_features, proposal_text, z_table

    write_features(spark, d)
    if proposed is None:
        z = materialize(z_table(spark, d), ML.shared_path(spark, "z_table"))  # one row per candidate column
        proposed = [r["feature"] for r in accepted_features(z, proposal_text(z)).orderBy("position").collect()]
    excluded = [c for c in proposed if c in KNOWN_LEAKY]
    candidates = [c for c in proposed if c not in KNOWN_LEAKY]
    if not candidates:
        raise ValueError(f"every proposed feature is known to leak: {excluded}")
    known = [c for c in candidates if c in FEATURES]
    rows = with_candidates(spark, d, candidates)
    if rows is not split_frame(spark, d):
        rows = materialize(rows, ML.shared_path(spark, "ablation_input"))
    test = rows.filter(F.col("is_test"))

    def evaluate(model):
        sc = materialize(ML.score_table(model, test, ["transaction_id", "is_fraud"]),
                         ML.shared_path(spark, "ablation_scores"))
        auc = M.auc_roc(M.cumulative_by_score(sc, "fraud_probability", "is_fraud", written=True))
        rec = sc.filter(F.col("is_fraud") == 1).agg(
            F.avg(F.col("predicted").cast("double")).alias("recall"),
            F.count(F.lit(1)).alias("n_fraud"),
            F.sum((F.col("predicted") == 0).cast("long")).alias("n_false_negatives"))
        fn = sc.filter((F.col("is_fraud") == 1) & (F.col("predicted") == 0)).select("transaction_id")
        return auc.crossJoin(rec), fn

    base, fn_a = evaluate(rf_model(spark, d))
    added = [c for c in candidates if c not in known]
    aug_model = ML.train_rf(rows.filter(~F.col("is_test")), FEATURES + added) if added else rf_model(spark, d)
    aug, fn_b = evaluate(aug_model)
    caught = fn_a.join(fn_b, "transaction_id", "left_anti").agg(F.count(F.lit(1)).alias("n_newly_caught"))
    missed = fn_b.join(fn_a, "transaction_id", "left_anti").agg(F.count(F.lit(1)).alias("n_newly_missed"))
    b = base.select(*[F.col(c).alias(f"baseline_{c}") for c in base.columns])
    a = aug.select(*[F.col(c).alias(f"augmented_{c}") for c in aug.columns])
    j = b.crossJoin(a).crossJoin(caught).crossJoin(missed)
    dauc = F.col("augmented_auc") - F.col("baseline_auc")
    return j.select(F.lit(",".join(candidates)).alias("candidate_features"),
                    F.lit(",".join(excluded)).alias("excluded_leaky_features"), "*",
                    dauc.alias("auc_delta"),
                    (F.col("augmented_recall") - F.col("baseline_recall")).alias("recall_delta"),
                    ML.verdict(dauc).alias("verdict"))


@query("feature_ablation")
def q_feature_ablation(spark, d):
    return ablation(spark, d)


@query("verdict", """
WITH a AS (SELECT (WITH g AS (SELECT score AS sc, sum(is_fraud) AS pos, sum(1 - is_fraud) AS neg FROM scored
   GROUP BY score), c AS (SELECT pos, neg, sum(pos) OVER (ORDER BY sc DESC ROWS UNBOUNDED PRECEDING) AS tp,
   sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM g)
  SELECT sum(neg * (tp - pos + pos / 2.0)) / (max(P) * max(N)) FROM c) AS auc_a,
 (WITH g AS (SELECT score_b AS sc, sum(is_fraud) AS pos, sum(1 - is_fraud) AS neg FROM scored
   GROUP BY score_b), c AS (SELECT pos, neg, sum(pos) OVER (ORDER BY sc DESC ROWS UNBOUNDED PRECEDING) AS tp,
   sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM g)
  SELECT sum(neg * (tp - pos + pos / 2.0)) / (max(P) * max(N)) FROM c) AS auc_b)
SELECT round(auc_a, 6) AS baseline_auc, round(auc_b, 6) AS augmented_auc, dd AS auc_delta,
  CASE WHEN dd > 0.002 THEN 'IMPROVED' WHEN abs(dd) <= 0.002 THEN 'NO MEANINGFUL CHANGE'
  ELSE 'WORSE' END AS verdict FROM (SELECT *, round(round(auc_b, 6) - round(auc_a, 6), 6) AS dd FROM a)""")
def q_verdict(spark, d):
    from txrisk.sources import fixtures as fx

    s = fx.scored(spark, d)
    a = M.auc_roc(M.cumulative_by_score(s, "score")).withColumnRenamed("auc", "baseline_auc")
    b = M.auc_roc(M.cumulative_by_score(s, "score_b")).withColumnRenamed("auc", "augmented_auc")
    j = finish(a.crossJoin(b))
    dd = F.round(F.col("augmented_auc") - F.col("baseline_auc"), 6)
    return j.select("baseline_auc", "augmented_auc", dd.alias("auc_delta"), ML.verdict(dd).alias("verdict"))


@query("random_search_cv")
def q_random_search_cv(spark, d):
    """The search's 100 draws over all training rows, three folds."""
    tr = split_frame(spark, d).filter(~F.col("is_test")).drop("is_test")
    folds = split.stratified_kfold(tr, 3)
    return search.random_search_cv(folds, FEATURES)


# ---------------------------------------------------------------- TreeSHAP
def shap_wide(spark, d) -> DataFrame:
    return fitted(spark, d).get("shap", lambda: materialize(SH.tree_shap_values(
        test_rows(spark, d), rf_model(spark, d).stages[-1], FEATURES, "transaction_id",
        ML.shared_path(spark, "rf_stage")), ML.shared_path(spark, "shap")))


@query("tree_shap")
def q_tree_shap(spark, d):
    return shap_wide(spark, d)


@query("shap_additivity")
def q_shap_additivity(spark, d):
    sc = ML.score_table(rf_model(spark, d), test_rows(spark, d), ["transaction_id"])
    return SH.shap_additivity(shap_wide(spark, d), sc, "transaction_id")


@query("shap_global")
def q_shap_global(spark, d):
    return SH.shap_global(shap_wide(spark, d), FEATURES, ["amount", "composite_risk", "amount_sum_24h"])


@query("shap_top3")
def q_shap_top3(spark, d):
    return SH.shap_top3(shap_wide(spark, d), FEATURES, "transaction_id")


@query("shap_dependence")
def q_shap_dependence(spark, d):
    return SH.shap_dependence(shap_wide(spark, d), test_rows(spark, d), "transaction_id",
                              "amount", "hour")


@query("shap_waterfall")
def q_shap_waterfall(spark, d):
    return SH.shap_waterfall(shap_wide(spark, d), FEATURES, "transaction_id")


@query("importance_agreement")
def q_importance_agreement(spark, d):
    g = ML.rf_importance(rf_model(spark, d), FEATURES, top=len(FEATURES))
    s = SH.shap_global(shap_wide(spark, d), FEATURES)
    return SH.importance_agreement(g, s)

"""Registered queries: feature-discovery loop and joins (ops 6, 40, 42-47, 64,
70, 126, 127, 129) with DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.functions import scalar as S, text as X
from txrisk.operators import history as H, metrics as M, risk, select as SEL, shap as SH
from txrisk.plans import sqltext as Q
from txrisk.plans.common import finish
from txrisk.plans.evaluation import PRED, scored_pred
from txrisk.plans.history import _FEAT_SQL, W7, W24, mavg, msum
from txrisk.plans.text import _CTX_SQL
from txrisk.registry import query
from txrisk.session import materialize
from txrisk.sources import fixtures as fx, sinks

# The candidate columns of the reference's discovery step, the
# leaky column excluded before the ablation.
CANDIDATE_COLUMNS = [
    "tx_count_24h", "amount_sum_24h", "amount_mean_7d", "amount_std_7d", "tx_count_total",
    "amount_mean_total", "amount_std_total", "channel_diversity", "online_channel_ratio",
    "amount_vs_mean_ratio", "velocity_score", "is_weekend", "is_peak_hour",
]
KNOWN_LEAKY = ["amount_vs_mean_ratio"]


def candidates_frame(spark, d) -> DataFrame:
    from txrisk.plans.models import features

    f, _ = features(spark, d)
    f = f.select("*", fx.score_expr(True).alias("score")).select(
        "*", S.is_weekend("day_of_week").cast("double").alias("is_weekend"),
        S.is_peak_hour("hour").cast("double").alias("is_peak_hour"),
        M.predict_gt("score").alias("predicted"))
    return SEL.outcome_subset(f)


def z_table(spark, d) -> DataFrame:
    return finish(risk.candidate_z_table(candidates_frame(spark, d), CANDIDATE_COLUMNS))


_ONLINE = "('view', 'click', 'signup')"
_CAND_SQL = f"""cf AS (SELECT transaction_id, customer_id, ts, amount, channel, is_fraud, score,
   count(amount) {W24} AS tx_count_24h, {msum(W24)} AS amount_sum_24h, {mavg(W7)} AS amount_mean_7d,
   stddev_samp(amount) {W7} AS amount_std_7d, count(amount) {W7} AS tx_count_7d,
   count(*) OVER (PARTITION BY customer_id) AS tx_count_total,
   {mavg('OVER (PARTITION BY customer_id)')} AS amount_mean_total,
   stddev_samp(amount) OVER (PARTITION BY customer_id) AS amount_std_total,
   CAST(day_of_week >= 5 AS DOUBLE) AS is_weekend, CAST(hour >= 9 AND hour <= 17 AS DOUBLE) AS is_peak_hour,
   CASE WHEN is_fraud = 1 AND {PRED} = 1 THEN 'TP' WHEN is_fraud = 1 THEN 'FN' WHEN {PRED} = 1 THEN 'FP'
     ELSE 'TN' END AS outcome FROM scored),
cd AS (SELECT customer_id, count(DISTINCT channel) AS channel_diversity,
   avg(CASE WHEN channel IN {_ONLINE} THEN 1.0 ELSE 0.0 END) AS online_channel_ratio FROM scored GROUP BY 1),
cand AS (SELECT cf.*, cd.channel_diversity, cd.online_channel_ratio,
   amount / nullif(amount_mean_total, 0) AS amount_vs_mean_ratio,
   (CAST(tx_count_24h AS DOUBLE) * 7 + tx_count_7d) / (tx_count_total + 1) AS velocity_score
   FROM cf JOIN cd USING (customer_id)),
zt AS (""" + "\n UNION ALL ".join(f"""SELECT '{c}' AS feature,
   avg(CASE WHEN outcome = 'FN' THEN CAST({c} AS DOUBLE) END) AS fn_mean,
   avg(CASE WHEN outcome = 'TP' THEN CAST({c} AS DOUBLE) END) AS tp_mean,
   avg(CASE WHEN outcome = 'TN' THEN CAST({c} AS DOUBLE) END) AS tn_mean,
   stddev_samp(CASE WHEN outcome = 'TN' THEN CAST({c} AS DOUBLE) END) AS sd FROM cand"""
                                       for c in CANDIDATE_COLUMNS) + """),
cnt AS (SELECT CAST(sum(CASE WHEN outcome = 'FN' THEN 1 ELSE 0 END) AS BIGINT) AS n_false_negatives,
   CAST(sum(CASE WHEN outcome = 'TP' THEN 1 ELSE 0 END) AS BIGINT) AS n_true_positives,
   CAST(sum(CASE WHEN outcome = 'TN' THEN 1 ELSE 0 END) AS BIGINT) AS n_true_negatives FROM cand),
z AS (SELECT feature, round(fn_mean, 6) AS fn_mean, round(tp_mean, 6) AS tp_mean, round(tn_mean, 6) AS tn_mean,
   round(CASE WHEN sd = 0 THEN 1e-9 ELSE sd END, 6) AS tn_std,
   round((fn_mean - tn_mean) / CASE WHEN sd = 0 THEN 1e-9 ELSE sd END, 6) AS fn_anomaly_z,
   n_false_negatives, n_true_positives, n_true_negatives FROM zt, cnt)"""


@query("candidate_z_table", f"WITH {_CAND_SQL}\nSELECT * FROM z")
def q_candidate_z_table(spark, d):
    return z_table(spark, d)


@query("allowlist_filter", f"""WITH {_CAND_SQL}
SELECT * FROM z WHERE feature IN ('amount_sum_24h', 'tx_count_24h', 'velocity_score', 'amount_vs_mean_ratio')
  AND feature NOT IN ('amount_vs_mean_ratio')""")
def q_allowlist_filter(spark, d):
    return SEL.allowlist_filter(z_table(spark, d), "feature",
                                allow=["amount_sum_24h", "tx_count_24h", "velocity_score",
                                       "amount_vs_mean_ratio"], deny=KNOWN_LEAKY)


_ZLINES = ("'- ' || feature || ': z=' || " + Q.signed("fn_anomaly_z", 2) + " || ', missed-fraud mean=' || "
           + Q.fixed("fn_mean", 3) + " || ', caught-fraud mean=' || " + Q.fixed("tp_mean", 3)
           + " || ', legitimate mean=' || " + Q.fixed("tn_mean", 3))


@query("build_feature_prompt", f"""WITH {_CAND_SQL},
t AS (SELECT string_agg({_ZLINES}, chr(10) ORDER BY abs(fn_anomaly_z) DESC, feature) AS tbl,
   max(n_false_negatives) AS n_fn, max(n_true_positives) AS n_tp FROM z)
SELECT """ + Q.template(X.FEATURE_PROMPT, {"n_fn": "CAST(n_fn AS VARCHAR)",
                                           "n_total_fraud": "CAST(n_fn + n_tp AS VARCHAR)",
                                           "feature_table": "tbl"}) + " AS prompt FROM t")
def q_build_feature_prompt(spark, d):
    return X.build_feature_prompt(z_table(spark, d))


def proposal_text(z: DataFrame) -> DataFrame:
    """Default proposer (template stand-in for the LLM call): the two largest |z|,
    the first in bold, plus one unknown name the parser must reject."""
    # one row per candidate column: the ranking window is bounded by the candidate list
    top = z.select("feature", F.row_number().over(
        Window.orderBy(F.abs("fn_anomaly_z").desc(), "feature")).alias("rk")).filter(F.col("rk") <= 2)
    agg = top.agg(F.max(F.when(F.col("rk") == 1, F.col("feature"))).alias("f1"),
                  F.max(F.when(F.col("rk") == 2, F.col("feature"))).alias("f2"))
    return agg.select(F.concat(
        F.lit("FEATURE: **"), F.col("f1"), F.lit("**\nREASONING: largest |z|.\nCONFIDENCE: Low\n"),
        F.lit("FEATURE: "), F.col("f2"), F.lit("\nREASONING: second largest |z|.\nCONFIDENCE: Low\n"),
        F.lit("FEATURE: invented_feature\nREASONING: not a candidate.\nCONFIDENCE: Low")).alias("text"))


def accepted_features(z: DataFrame, texts: DataFrame, fallback: int = 2) -> DataFrame:
    """Candidate names of the proposal (column ``text``) in its order; if it names none, the
    ``fallback`` candidates with the largest |z|.  Both sides have a row per candidate at most."""
    names = texts.select(F.posexplode(X.parse_features(F.col("text"))).alias("pos", "feature"))
    valid = names.join(F.broadcast(z.select("feature")), "feature", "left_semi")
    named = valid.select(F.row_number().over(Window.orderBy("pos")).cast("int").alias("position"), "feature")
    top = z.select(F.row_number().over(Window.orderBy(F.abs("fn_anomaly_z").desc(), "feature")).cast("int")
                   .alias("position"), "feature").filter(F.col("position") <= fallback)
    none = named.agg((F.count(F.lit(1)) == 0).alias("__none"))  # one row
    return named.unionByName(top.crossJoin(F.broadcast(none)).filter("__none").drop("__none"))


@query("parse_features", f"""WITH {_CAND_SQL},
tp AS (SELECT feature, row_number() OVER (ORDER BY abs(fn_anomaly_z) DESC, feature) AS rk FROM z),
txt AS (SELECT 'FEATURE: **' || max(CASE WHEN rk = 1 THEN feature END) || '**' || chr(10) ||
   'REASONING: largest |z|.' || chr(10) || 'CONFIDENCE: Low' || chr(10) || 'FEATURE: ' ||
   max(CASE WHEN rk = 2 THEN feature END) || chr(10) || 'REASONING: second largest |z|.' || chr(10) ||
   'CONFIDENCE: Low' || chr(10) || 'FEATURE: invented_feature' || chr(10) || 'REASONING: not a candidate.'
   || chr(10) || 'CONFIDENCE: Low' AS text FROM tp),
ln AS (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)
   AS pos FROM txt),
nm AS (SELECT pos, trim(regexp_replace(trim(regexp_extract(trim(line), '^[^:]*:(.*)$', 1)), '^\\*+|\\*+$', '', 'g'))
   AS name FROM ln WHERE starts_with(upper(trim(line)), 'FEATURE:'))
SELECT CAST(row_number() OVER (ORDER BY pos) AS INT) AS position, name AS feature FROM nm
WHERE name IN (SELECT feature FROM z)""")
def q_parse_features(spark, d):
    z = z_table(spark, d)
    return accepted_features(z, proposal_text(z))


@query("corr_filter", f"""WITH {_CAND_SQL},
r AS (""" + "\n UNION ALL ".join(
    f"SELECT '{c}' AS feature, CASE WHEN isnan(corr(CAST({c} AS DOUBLE), CAST(is_fraud AS DOUBLE))) THEN NULL "
    f"ELSE corr(CAST({c} AS DOUBLE), CAST(is_fraud AS DOUBLE)) END AS r FROM cand"
    for c in CANDIDATE_COLUMNS) + """)
SELECT feature, round(r, 6) AS r, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS sign FROM r
WHERE abs(r) > 0.01 OR feature IN ('amount_sum_24h')""")
def q_corr_filter(spark, d):
    c = finish(risk.corr_with_label(candidates_frame(spark, d), CANDIDATE_COLUMNS))
    return risk.corr_filter(c, 0.01, ["amount_sum_24h"])


# ---------------------------------------------------------------- joins (ops 42-47)
@query("join_augment_features", f"""
SELECT transaction_id, amount, is_fraud, count(amount) {W24} AS tx_count_24h,
  round({mavg(W7)}, 6) AS amount_mean_7d FROM tx""")
def q_join_augment_features(spark, d):
    base = fx.tx(spark, d).select("transaction_id", "amount", "is_fraud")
    raw = H.win_24h_7d(fx.tx(spark, d).select("transaction_id", "customer_id", "ts", "amount"))
    extra = raw.select("transaction_id", "tx_count_24h", "amount_mean_7d")
    return finish(base.join(extra, "transaction_id", "left"))


@query("join_display_context", """
WITH s AS (SELECT transaction_id, row_number() OVER (PARTITION BY is_fraud ORDER BY md5(CAST(transaction_id AS VARCHAR)),
   transaction_id) <= round(0.2 * count(*) OVER (PARTITION BY is_fraud)) AS is_test FROM tx)
SELECT t.transaction_id, t.channel, t.location, t.age_group, t.bank FROM s JOIN tx t USING (transaction_id)
WHERE s.is_test""")
def q_join_display_context(spark, d):
    from txrisk.operators import split

    t = fx.tx(spark, d)
    test = split.stratified_split(t.select("transaction_id", "is_fraud")).filter("is_test")
    # the display side grows with the data: no broadcast hint, AQE decides from runtime size
    return test.select("transaction_id").join(
        t.select("transaction_id", "channel", "location", "age_group", "bank"), "transaction_id")


@query("semi_subset_stats", f"""
SELECT count(*) AS n_rows, round(avg(amount), 6) AS mean_amount, round(avg(CAST(hour AS DOUBLE)), 6) AS mean_hour
FROM tx WHERE transaction_id IN (SELECT transaction_id FROM scored WHERE is_fraud = 1 AND {PRED} = 0)""")
def q_semi_subset_stats(spark, d):
    fn_ids = scored_pred(spark, d).filter((F.col("is_fraud") == 1) & (F.col("predicted") == 0)) \
        .select("transaction_id")
    rows = fx.tx(spark, d).join(fn_ids, "transaction_id", "left_semi")
    return finish(rows.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("amount").alias("mean_amount"),
                           F.avg(F.col("hour").cast("double")).alias("mean_hour")))


@query("join_explanations", """WITH """ + _CTX_SQL + """
SELECT ex.transaction_id AS row_index, ex.case_type, t.channel, t.bank, ex.explanation
FROM ex JOIN tx t USING (transaction_id)""")
def q_join_explanations(spark, d):
    from txrisk.plans.text import case_records

    recs = case_records(spark, d)
    ctx = fx.tx(spark, d).select(F.col("transaction_id").alias("row_index"), "channel", "bank")
    return recs.join(ctx, "row_index").select("row_index", "case_type", "channel", "bank", "explanation")


@query("newly_caught_missed", """
WITH a AS (SELECT transaction_id FROM scored WHERE is_fraud = 1 AND score <= 0.5),
b AS (SELECT transaction_id FROM scored WHERE is_fraud = 1 AND score_b <= 0.5)
SELECT (SELECT count(*) FROM a WHERE transaction_id NOT IN (SELECT transaction_id FROM b)) AS n_newly_caught,
       (SELECT count(*) FROM b WHERE transaction_id NOT IN (SELECT transaction_id FROM a)) AS n_newly_missed""")
def q_newly_caught_missed(spark, d):
    s = fx.scored(spark, d).filter(F.col("is_fraud") == 1)
    fa = s.filter(F.col("score") <= 0.5).select("transaction_id")
    fb = s.filter(F.col("score_b") <= 0.5).select("transaction_id")
    c = fa.join(fb, "transaction_id", "left_anti").agg(F.count(F.lit(1)).alias("n_newly_caught"))
    m = fb.join(fa, "transaction_id", "left_anti").agg(F.count(F.lit(1)).alias("n_newly_missed"))
    return c.crossJoin(m)


# ---------------------------------------------------------------- rows-only: discovery document, SHAP records
_CRISK_SQL = _FEAT_SQL.strip()[4:] + f""",
crx AS (SELECT *, avg(CAST(is_fraud AS DOUBLE)) OVER (PARTITION BY channel) AS chr,
   amount / nullif({mavg('OVER (PARTITION BY customer_id)')}, 0) AS amount_vs_mean_ratio FROM feat),
crm AS (SELECT min(velocity_score) AS lv, max(velocity_score) AS hv, min(amount_vs_mean_ratio_safe) AS lr,
   max(amount_vs_mean_ratio_safe) AS hr, min(chr) AS lc, max(chr) AS hc FROM crx),
cr AS (SELECT crx.*, (CASE WHEN hv > lv THEN (velocity_score - lv) / (hv - lv) ELSE 0.0 END) * (1.0 / 3)
 + (CASE WHEN hr > lr THEN (amount_vs_mean_ratio_safe - lr) / (hr - lr) ELSE 0.0 END) * (1.0 / 3)
 + (CASE WHEN hc > lc THEN (chr - lc) / (hc - lc) ELSE 0.0 END) * (1.0 / 3) AS composite_risk FROM crx, crm)"""


# The columns whose correlation with composite_risk the reference's audit reports.
RISK_CORRELATES = ["amount_vs_mean_ratio", "velocity_score", "amount_sum_24h"]


def leakage_section(audit: DataFrame, correlations: DataFrame) -> DataFrame:
    """One row: columns constant over the checked customer, columns that vary, correlation of
    ``composite_risk`` with its correlates, and the conclusion drawn from these lists."""
    names = F.collect_list(F.struct("column_name", "is_lifetime_constant"))
    one = audit.agg(F.first("customer_checked").alias("customerChecked"),
                    F.first("n_transactions_checked").alias("nTransactionsChecked"),
                    F.sort_array(names).alias("c"))

    def pick(flag):
        return F.transform(F.filter("c", lambda x: x["is_lifetime_constant"] == F.lit(flag)),
                           lambda x: x["column_name"])

    corr = correlations.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature", "r"))))
                            .alias("compositeRiskCorrelation"))
    j = one.select("customerChecked", "nTransactionsChecked", pick(True).alias("leakyColumns"),
                   pick(False).alias("cleanColumns")).crossJoin(F.broadcast(corr))

    def named(col, none):
        return F.when(F.size(col) > 0, F.array_join(col, ", ")).otherwise(none)

    return j.select("*", F.concat(
        F.lit("Constant over all transactions of the customer, so they look ahead: "),
        named("leakyColumns", "none"),
        F.lit(". Genuine look-back windows: "), named("cleanColumns", "none"), F.lit(".")).alias("conclusion"))


@query("composite_risk_correlation", """WITH """ + _CRISK_SQL + """
SELECT 'composite_risk' AS target, 'amount_vs_mean_ratio' AS feature,
  round(corr(composite_risk, amount_vs_mean_ratio), 6) AS r FROM cr
UNION ALL SELECT 'composite_risk', 'velocity_score', round(corr(composite_risk, velocity_score), 6) FROM cr
UNION ALL SELECT 'composite_risk', 'amount_sum_24h', round(corr(composite_risk, amount_sum_24h), 6) FROM cr""")
def q_composite_risk_correlation(spark, d):
    """Op 65 as the leakage audit uses it."""
    from txrisk.plans.models import features

    f, written = features(spark, d)
    return finish(risk.corr_one_vs_rest(H.composite_risk(f, written=written), "composite_risk", RISK_CORRELATES))


@query("sink_discovery_json")
def q_sink_discovery_json(spark, d):
    """One nested JSON document with the four discovery results (false-negative analysis,
    proposal, impact, leakage audit), written to the shared folder and read back."""
    from txrisk.operators.models import shared_path
    from txrisk.plans.history import q_leakage_lifetime_constant
    from txrisk.plans.models import ablation, write_features

    write_features(spark, d)
    z = materialize(z_table(spark, d), shared_path(spark, "z_table"))  # one row per candidate column
    cand = F.struct(F.abs("fn_anomaly_z").alias("k"), "feature", F.col("fn_mean").alias("fnMean"),
                    F.col("tp_mean").alias("tpMean"), F.col("tn_mean").alias("tnMean"),
                    F.col("fn_anomaly_z").alias("anomalyZ"))
    fn = z.agg(F.first("n_false_negatives").alias("nFalseNegatives"),
               F.first("n_true_positives").alias("nTruePositives"),
               F.first("n_true_negatives").alias("nTrueNegatives"),
               F.transform(F.sort_array(F.collect_list(cand), asc=False), lambda x: x.dropFields("k"))
               .alias("candidates"))
    text = proposal_text(z)
    names = accepted_features(z, text)
    accepted = names.agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "feature"))),
                                     lambda x: x["feature"]).alias("recommendedFeatures"))
    prop = text.crossJoin(F.broadcast(accepted)).select(F.lit("template").alias("modelUsed"),
                                                        F.col("text").alias("rawResponse"), "recommendedFeatures")
    proposed = [r["feature"] for r in names.orderBy("position").collect()]  # candidate columns at most
    ab = ablation(spark, d, proposed)

    def listed(c):
        return F.filter(F.split(c, ","), lambda x: x != "")

    impact = ab.select(listed("candidate_features").alias("candidateFeatures"),
                       listed("excluded_leaky_features").alias("excludedLeakyFeatures"),
                       *[F.col(a).alias(b) for a, b in (
                           ("baseline_auc", "baselineAuc"), ("baseline_recall", "baselineRecall"),
                           ("baseline_n_false_negatives", "baselineFalseNegatives"),
                           ("augmented_auc", "augmentedAuc"), ("augmented_recall", "augmentedRecall"),
                           ("augmented_n_false_negatives", "augmentedFalseNegatives"),
                           ("auc_delta", "aucDelta"), ("recall_delta", "recallDelta"),
                           ("n_newly_caught", "nNewlyCaught"), ("n_newly_missed", "nNewlyMissed"))], "verdict")
    leak = leakage_section(q_leakage_lifetime_constant(spark, d), q_composite_risk_correlation(spark, d))
    doc = (fn.select(F.struct("*").alias("falseNegativeAnalysis"))
           .crossJoin(prop.select(F.struct("*").alias("llmProposal")))
           .crossJoin(impact.select(F.struct("*").alias("impact")))
           .crossJoin(leak.select(F.struct("*").alias("leakageCheck"))))
    path = shared_path(spark, "discovery_json")
    sinks.sink_json(doc, path, single_file=True)
    return spark.read.schema(doc.schema).json(path).select(F.to_json(F.struct("*")).alias("document"))


@query("case_record")
def q_case_record(spark, d):
    """Op 127 with true TreeSHAP factors: RF test-set cases (every fraud and every false
    positive), top-3 SHAP features and the prompt."""
    from txrisk.operators import models as ML, split
    from txrisk.plans.models import FEATURES, rf_model, shap_wide, test_rows

    sc = ML.score_table(rf_model(spark, d), test_rows(spark, d), ["transaction_id", "is_fraud"])
    cs = split.flagged_cases(sc)
    top = SH.shap_top3(shap_wide(spark, d), FEATURES, "transaction_id")
    ctx = fx.tx(spark, d).select("transaction_id", "amount", "channel", "hour", "bank", "location",
                                 "age_group")
    j = cs.join(top, "transaction_id").join(ctx, "transaction_id")
    j = j.select("*", X.build_prompt(factors="top_shap_features").alias("prompt"))
    return j.select(F.col("transaction_id").alias("row_index"), "case_type",
                    F.col("is_fraud").alias("actual_is_fraud"), F.col("predicted").alias("predicted_is_fraud"),
                    "fraud_probability", "top_shap_features", "prompt")

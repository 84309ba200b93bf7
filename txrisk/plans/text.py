"""Registered queries: display functions, case records, prompts, narration,
explanation metrics and the JSON/CSV sinks (ops 4-7, 33-36, 69, 71, 81,
125-128, 130-132) with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.functions import scalar as S, text as X
from txrisk.operators import history as H, models as ML, risk, split
from txrisk.plans import sqltext as Q
from txrisk.plans.common import finish
from txrisk.plans.evaluation import _CASES_SQL, PRED, cases
from txrisk.registry import query
from txrisk.session import materialize
from txrisk.sources import fixtures as fx, sinks
from txrisk.sources.tables import read_table

FACTOR_FEATURES = ["amount", "hour", "day_of_week", "merchant_risk_score", "age_numeric"]
_MRS = ("CASE merchant_category WHEN 'AUTOMOBILE' THEN 0.1 WHEN 'BUILDING' THEN 0.2 WHEN 'FURNITURE' "
        "THEN 0.3 WHEN 'HOUSEHOLD' THEN 0.4 WHEN 'MACHINERY' THEN 0.5 END")
_AGE = "CASE age_group WHEN '<20' THEN 1 WHEN '20-29' THEN 2 WHEN '30-39' THEN 3 WHEN '40+' THEN 4 END"


def case_context(spark, d) -> DataFrame:
    """Selected cases + display context + top-3 factors (standardised deviations)."""
    t = fx.tx(spark, d).select("transaction_id", "amount", "channel", "hour", "bank", "location",
                               "age_group", "day_of_week",
                               fx.merchant_risk_col().alias("merchant_risk_score"),
                               S.age_ordinal("age_group").alias("age_numeric"))
    st = t.agg(*[F.avg(F.col(f).cast("double")).alias(f"__m{i}") for i, f in enumerate(FACTOR_FEATURES)],
               *[F.stddev_samp(F.col(f).cast("double")).alias(f"__s{i}")
                 for i, f in enumerate(FACTOR_FEATURES)])
    c = cases(spark, d).join(t, "transaction_id").crossJoin(st)  # st: one row
    arr = F.array(*[F.struct(F.lit(f).alias("feature"),
                             F.round((F.col(f).cast("double") - F.col(f"__m{i}")) / F.col(f"__s{i}"), 6)
                             .alias("value")) for i, f in enumerate(FACTOR_FEATURES)])
    return c.select("transaction_id", "case_type", "is_fraud", "predicted",
                    F.col("score").alias("fraud_probability"), "amount", "channel", "hour", "bank",
                    "location", "age_group", H.rank_within(arr, 3).alias("top_factors"))


def explained(spark, d) -> DataFrame:
    c = case_context(spark, d)
    c = c.select("*", X.build_prompt().alias("prompt"))
    return X.narrate(c)


_CTX_SQL = _CASES_SQL + f""",
txf AS (SELECT *, {_MRS} AS merchant_risk_score, {_AGE} AS age_numeric FROM tx),
zst AS (SELECT """ + ", ".join(
    f"avg(CAST({f} AS DOUBLE)) AS m{i}, stddev_samp(CAST({f} AS DOUBLE)) AS s{i}"
    for i, f in enumerate(FACTOR_FEATURES)) + """ FROM txf),
ctx AS (SELECT c.transaction_id, c.case_type, c.is_fraud, c.predicted, c.score AS fraud_probability,
   t.amount, t.channel, t.hour, t.bank, t.location, t.age_group, t.day_of_week, t.merchant_risk_score,
   t.age_numeric FROM cases c JOIN txf t USING (transaction_id)),
fac AS (""" + "\n  UNION ALL ".join(
    f"SELECT transaction_id, '{f}' AS feature, round((CAST({f} AS DOUBLE) - m{i}) / s{i}, 6) AS value "
    f"FROM ctx, zst" for i, f in enumerate(FACTOR_FEATURES)) + """),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id
   ORDER BY abs(value) DESC, feature) AS r FROM fac) WHERE r <= 3),
lines AS (SELECT transaction_id,
   string_agg('- ' || """ + Q.cap(Q.label("feature")) + """ || ' (contribution: ' ||
     CASE WHEN value >= 0 THEN '+' ELSE '' END || """ + Q.fixed("value", 3) + """ || ')', chr(10) ORDER BY r)
     AS risk_factors,
   max(CASE WHEN r = 1 THEN feature END) AS f1,
   string_agg(CASE WHEN r > 1 THEN '- ' || """ + Q.label("feature") + """ || ' (' ||
     CASE WHEN value >= 0 THEN '+' ELSE '' END || """ + Q.fixed("value", 3) + """ || ')' END, chr(10) ORDER BY r)
     AS support
   FROM top GROUP BY transaction_id),
pr AS (SELECT ctx.*, lines.*, """ + Q.template(X.PROMPT_HEAD, {
    "preamble": Q.lit(X.SYSTEM_PREAMBLE),
    "flag_word": "CASE WHEN predicted = 1 THEN 'fraudulent' ELSE 'unusual' END",
    "naira_amount": Q.naira("amount"), "channel": "channel", "hour_str": Q.hour12("hour"),
    "bank": "bank", "location": "location", "age_group": "age_group",
    "prediction_label": "CASE WHEN predicted = 1 THEN 'FRAUD' ELSE 'NOT FRAUD' END",
    "confidence": "CAST(CAST(round_even(fraud_probability * 100, 0) AS BIGINT) AS VARCHAR)",
    "risk_factors": "risk_factors"}) + """ AS prompt FROM ctx JOIN lines USING (transaction_id)),
ex AS (SELECT pr.*, 'Primary reason: ' || """ + Q.label("f1") + """ || ' drove the score of this ' || channel ||
   ' transaction.' || chr(10) || 'Supporting factors:' || chr(10) || support || chr(10) || 'Risk level: ' ||
   """ + Q.band("fraud_probability") + """ || ' risk.' || chr(10) || 'Recommended action: ' ||
   CASE """ + Q.band("fraud_probability") + """ WHEN 'High' THEN 'block the transaction'
     WHEN 'Medium' THEN 'step-up authentication' ELSE 'monitor the account' END || '.' AS explanation FROM pr)"""


def _sql(body: str) -> str:
    return "WITH " + _CTX_SQL + "\n" + body


# ---------------------------------------------------------------- display (ops 33-36a)
@query("risk_band", f"SELECT transaction_id, score, {Q.band('score')} AS risk_band FROM scored")
def q_risk_band(spark, d):
    return fx.scored(spark, d).select("transaction_id", "score", S.risk_band("score").alias("risk_band"))


@query("case_outcome", f"""
SELECT transaction_id, CASE WHEN is_fraud = 1 AND {PRED} = 1 THEN 'Caught' WHEN is_fraud = 1 THEN 'Missed'
  WHEN {PRED} = 1 THEN 'False alarm' ELSE 'Correct pass' END AS case_outcome FROM scored""")
def q_case_outcome(spark, d):
    s = fx.scored(spark, d)
    return s.select("transaction_id", S.case_outcome("is_fraud", (F.col("score") > 0.5).cast("int"))
                    .alias("case_outcome"))


@query("format_display", f"""
SELECT transaction_id, {Q.naira('amount')} AS amount_display, {Q.hour12('hour')} AS hour_display,
  CAST(CAST(round_even(score * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS confidence_display FROM scored""")
def q_format_display(spark, d):
    s = fx.scored(spark, d)
    return s.select("transaction_id", S.format_naira("amount").alias("amount_display"),
                    S.format_hour("hour").alias("hour_display"),
                    F.concat(F.bround(F.col("score") * 100, 0).cast("long").cast("string"), F.lit("%"))
                    .alias("confidence_display"))


@query("rank_within", _sql("""
SELECT transaction_id, max(CASE WHEN r = 1 THEN feature END) AS feature_1, max(CASE WHEN r = 1 THEN value END) AS value_1,
  max(CASE WHEN r = 2 THEN feature END) AS feature_2, max(CASE WHEN r = 2 THEN value END) AS value_2,
  max(CASE WHEN r = 3 THEN feature END) AS feature_3, max(CASE WHEN r = 3 THEN value END) AS value_3
FROM top GROUP BY transaction_id"""))
def q_rank_within(spark, d):
    c = case_context(spark, d)
    f = F.col("top_factors")
    return c.select("transaction_id", *[x for i in range(3) for x in (
        f[i]["feature"].alias(f"feature_{i + 1}"), f[i]["value"].alias(f"value_{i + 1}"))])


@query("feature_label", _sql("""
SELECT DISTINCT feature, """ + Q.label("feature") + """ AS label,
  """ + Q.cap(Q.label("feature")) + """ AS display_label FROM top"""))
def q_feature_label(spark, d):
    c = case_context(spark, d).select(F.explode("top_factors").alias("f")).select("f.feature").distinct()
    return c.select("feature", S.feature_label("feature").alias("label"),
                    S.capitalize_first(S.feature_label("feature")).alias("display_label"))


@query("share_of_max_abs", _sql("""
SELECT transaction_id, feature, value, round(CASE WHEN value < 0 THEN -1 ELSE 1 END *
  greatest(CASE WHEN m > 0 THEN abs(value) / m * 100 ELSE 0.0 END, 2.0), 6) AS bar_pct
FROM (SELECT *, max(abs(value)) OVER (PARTITION BY transaction_id) AS m FROM top)"""))
def q_share_of_max_abs(spark, d):
    c = case_context(spark, d).select("transaction_id", F.explode("top_factors").alias("f"))
    c = c.select("transaction_id", "f.feature", "f.value")
    # the window is per case (<= 3 rows each)
    from pyspark.sql import Window

    m = F.max(F.abs("value")).over(Window.partitionBy("transaction_id"))
    return finish(c.select("*", S.share_of_max_abs(F.col("value"), m, floor_pct=2.0).alias("bar_pct")))


# ---------------------------------------------------------------- prompts and narration
@query("build_prompt", _sql("SELECT transaction_id, prompt FROM pr"))
def q_build_prompt(spark, d):
    return explained(spark, d).select("transaction_id", "prompt")


@query("narrate", _sql("SELECT transaction_id, explanation FROM ex"))
def q_narrate(spark, d):
    return explained(spark, d).select("transaction_id", "explanation")


def followup_turns(spark, d) -> DataFrame:
    """Per conversation its last user text as ``question`` and the turns before it as ``history``.
    A conversation is one prompt, so its turns meet in one row."""
    c = read_table(spark, d, "conversations").filter(F.col("role").isin("user", "assistant"))
    row = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    per = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"),
                                   F.max(F.when(F.col("role") == "user", row)).alias("q"))
    return per.select("conv_id", F.col("q.text").alias("question"),
                      F.filter("turns", lambda t: t < F.col("q")).alias("history"))


@query("build_followup_context", _sql(""", cv AS (SELECT conv_id, turn, role, coalesce(text, '') AS text
   FROM conversations WHERE role IN ('user', 'assistant')),
cq AS (SELECT conv_id, turn AS qt, text AS question FROM (SELECT *, row_number() OVER (PARTITION BY conv_id
   ORDER BY turn DESC, text DESC) AS r FROM cv WHERE role = 'user') WHERE r = 1),
chx AS (SELECT conv_id, max(question) AS question, string_agg(CASE WHEN role = 'user' THEN 'Analyst: '
   ELSE 'Assistant: ' END || text, chr(10) || chr(10) ORDER BY turn, role, text) FILTER (WHERE turn < qt
   OR (turn = qt AND (role < 'user' OR (role = 'user' AND text < question)))) AS hist
   FROM cv JOIN cq USING (conv_id) GROUP BY conv_id),
fl AS (SELECT transaction_id, string_agg('- ' || """ + Q.label("feature") + """ || ': ' || """ + Q.signed("value", 3)
    + """, chr(10) ORDER BY r) AS factors FROM top GROUP BY transaction_id)
SELECT transaction_id, CASE WHEN length(trim(question)) > 0 THEN """ + Q.template(X.FOLLOWUP_HEAD, {
        "amount": Q.naira("amount"), "channel": "channel", "hour": Q.hour12("hour"), "bank": "bank",
        "location": "location", "age_group": "age_group",
        "prediction": "CASE WHEN predicted = 1 THEN 'FRAUD' ELSE 'NOT FRAUD' END",
        "confidence": "CAST(CAST(round(fraud_probability * 100, 0) AS BIGINT) AS VARCHAR)",
        "outcome": "CASE WHEN is_fraud = 1 THEN 'confirmed fraud' ELSE 'legitimate' END",
        "factors": "factors", "explanation": "explanation"}) + """ || chr(10) || chr(10) ||
  coalesce(hist || chr(10) || chr(10), '') || 'Analyst: ' || question END AS context
FROM ex JOIN fl USING (transaction_id)
LEFT JOIN chx ON chx.conv_id = ex.transaction_id % (SELECT max(conv_id) + 1 FROM conversations)""").replace(
        "\n, cv AS", ",\ncv AS"))
def q_build_followup_context(spark, d):
    """The fixture asks about case t with conversation t modulo their number."""
    t = followup_turns(spark, d)
    n = read_table(spark, d, "conversations").agg((F.max("conv_id") + 1).alias("__n"))  # one row
    e = explained(spark, d).crossJoin(F.broadcast(n)).withColumn("conv_id", F.col("transaction_id") % F.col("__n"))
    j = e.join(t, "conv_id", "left")
    return j.select("transaction_id", X.build_followup_context(history="history").alias("context"))


# ---------------------------------------------------------------- explanation metrics
_FAITH = ("""m AS (SELECT ex.transaction_id, ex.case_type, top.feature, """ + Q.mentioned("top.feature", "ex.explanation")
          + """ AS hit, """ + Q.mentioned("top.feature", "ex.explanation", True)
          + """ AS strict_hit FROM ex JOIN top USING (transaction_id))""")


@query("faithfulness", _sql(", " + _FAITH + """
SELECT transaction_id, case_type, round(CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6)
  AS faithfulness FROM m GROUP BY transaction_id, case_type""").replace("\n, m AS", ",\nm AS"))
def q_faithfulness(spark, d):
    e = explained(spark, d)
    return finish(e.select("transaction_id", "case_type",
                           X.faithfulness("top_factors", "explanation").alias("faithfulness")))


_VOCAB = ", ".join(Q.lit(k) for k in X.FEATURE_KEYWORDS)


@query("faithfulness_strict", _sql(", " + _FAITH + """,
v AS (SELECT ex.transaction_id, x.vf FROM ex, (SELECT unnest([""" + _VOCAB + """]) AS vf) x
   WHERE x.vf NOT IN (SELECT feature FROM top WHERE top.transaction_id = ex.transaction_id)
     AND """ + Q.mentioned("x.vf", "ex.explanation", True) + """)
SELECT m.transaction_id, round(CAST(sum(CASE WHEN strict_hit THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6)
  AS faithfulness_strict,
  (SELECT count(*) FROM v WHERE v.transaction_id = m.transaction_id) AS n_mentioned_not_in_top
FROM m GROUP BY m.transaction_id""").replace("\n, m AS", ",\nm AS"))
def q_faithfulness_strict(spark, d):
    e = explained(spark, d)
    return finish(e.select("transaction_id",
                           X.faithfulness("top_factors", "explanation", strict=True)
                           .alias("faithfulness_strict"),
                           X.mentioned_not_in_top().cast("long").alias("n_mentioned_not_in_top")))


@query("usefulness", _sql(f"SELECT transaction_id, {Q.usefulness('explanation')} AS usefulness FROM ex"))
def q_usefulness(spark, d):
    return explained(spark, d).select("transaction_id", X.usefulness().alias("usefulness"))


def _metrics_rows(spark, d):
    e = explained(spark, d)
    return e.select("transaction_id", "case_type",
                    X.faithfulness("top_factors", "explanation").alias("faithfulness"),
                    X.usefulness().alias("usefulness"))


@query("metric_by_case_type", _sql(", " + _FAITH + """,
per AS (SELECT m.transaction_id, m.case_type,
   CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS faithfulness,
   CAST(max(""" + Q.usefulness("ex.explanation") + """) AS DOUBLE) AS usefulness
   FROM m JOIN ex USING (transaction_id) GROUP BY m.transaction_id, m.case_type)
SELECT coalesce(case_type, 'ALL') AS case_type, count(*) AS n,
  round(avg(faithfulness), 6) AS mean_faithfulness, round(stddev_samp(faithfulness), 6) AS std_faithfulness,
  round(avg(usefulness), 6) AS mean_usefulness, round(stddev_samp(usefulness), 6) AS std_usefulness,
  coalesce(stddev_samp(faithfulness) = 0, false) OR coalesce(stddev_samp(usefulness) = 0, false)
    AS zero_variance_warning
FROM per GROUP BY ROLLUP (case_type)""").replace("\n, m AS", ",\nm AS"))
def q_metric_by_case_type(spark, d):
    return finish(risk.metric_by_case_type(_metrics_rows(spark, d)))


@query("queue_kpis", f"WITH {_CASES_SQL}\n" + """
SELECT count(*) AS n_cases, CAST(sum(CASE WHEN case_type = 'true_fraud' THEN 1 ELSE 0 END) AS BIGINT) AS n_true_fraud,
  CAST(sum(CASE WHEN case_type = 'false_positive' THEN 1 ELSE 0 END) AS BIGINT) AS n_false_positive,
  round(avg(score), 6) AS mean_confidence FROM cases""")
def q_queue_kpis(spark, d):
    return finish(risk.queue_kpis(cases(spark, d), prob="score"))


# ---------------------------------------------------------------- sinks (ops 4, 5, 7)
RECORD_SCHEMA = T.StructType([
    T.StructField("row_index", T.LongType()), T.StructField("case_type", T.StringType()),
    T.StructField("actual_is_fraud", T.IntegerType()), T.StructField("predicted_is_fraud", T.IntegerType()),
    T.StructField("fraud_probability", T.DoubleType()),
    T.StructField("top_shap_features", T.ArrayType(T.StructType([
        T.StructField("feature", T.StringType()), T.StructField("value", T.DoubleType())]))),
    T.StructField("prompt", T.StringType()), T.StructField("explanation", T.StringType()),
    T.StructField("model_used", T.StringType())])


def case_records(spark, d) -> DataFrame:
    """Op 127 over the fixture cases: nested explanation records."""
    e = explained(spark, d)
    return e.select(F.col("transaction_id").cast("long").alias("row_index"), "case_type",
                    F.col("is_fraud").alias("actual_is_fraud"), F.col("predicted").alias("predicted_is_fraud"),
                    "fraud_probability", F.col("top_factors").alias("top_shap_features"), "prompt",
                    "explanation", F.lit("template").alias("model_used"))


@query("sink_jsonl_resume", f"WITH {_CASES_SQL}\n"
       "SELECT transaction_id AS row_index, case_type FROM cases")
def q_sink_jsonl_resume(spark, d):
    recs = case_records(spark, d).cache()
    path = ML.shared_path(spark, "explanations_jsonl")
    # a first, interrupted run wrote some records ...
    first = recs.filter(F.col("row_index") % 3 == 0)
    sinks.sink_jsonl_resume(first, path)
    # ... the resumed run appends only the missing ones
    sinks.sink_jsonl_resume(recs, path)
    return sinks.read_jsonl(spark, path, RECORD_SCHEMA).select("row_index", "case_type")


@query("anti_resume", f"WITH {_CASES_SQL}\n"
       "SELECT transaction_id AS row_index, case_type FROM cases WHERE transaction_id % 3 <> 0")
def q_anti_resume(spark, d):
    recs = case_records(spark, d)
    path = ML.shared_path(spark, "resumed_jsonl")
    sinks.sink_jsonl_resume(recs.filter(F.col("row_index") % 3 == 0), path)
    done = sinks.logged_ids(spark, path, "row_index long")
    return recs.join(done, "row_index", "left_anti").select("row_index", "case_type")


@query("sink_cases_json", _sql("""
SELECT transaction_id AS id, case_type AS caseType, is_fraud = 1 AS actualIsFraud,
  predicted = 1 AS predictedIsFraud, fraud_probability AS fraudProbability, amount, channel, hour, bank,
  location, age_group AS ageGroup, explanation, 'template' AS modelUsed FROM ex"""))
def q_sink_cases_json(spark, d):
    recs = case_records(spark, d)
    ctx = fx.tx(spark, d).select(F.col("transaction_id").alias("row_index"), "amount", "channel", "hour",
                                 "bank", "location", "age_group")
    j = recs.join(ctx, "row_index")
    doc = j.select(F.col("row_index").alias("id"), F.col("case_type").alias("caseType"),
                   (F.col("actual_is_fraud") == 1).alias("actualIsFraud"),
                   (F.col("predicted_is_fraud") == 1).alias("predictedIsFraud"),
                   F.col("fraud_probability").alias("fraudProbability"), "amount", "channel", "hour", "bank",
                   "location", F.col("age_group").alias("ageGroup"),
                   F.col("top_shap_features").alias("topShapFeatures"), "explanation",
                   F.col("model_used").alias("modelUsed"))
    doc = doc.orderBy("caseType", F.col("fraudProbability").desc())  # op 83 order
    path = ML.shared_path(spark, "cases_json")
    sinks.sink_json(doc, path)
    back = spark.read.schema(doc.schema).json(path)
    return back.drop("topShapFeatures")


_SAMPLE_SQL = _sql(""", c AS (SELECT transaction_id AS row_index, case_type, is_fraud AS actual_is_fraud, explanation,
   md5('42:' || CAST(transaction_id AS VARCHAR)) AS h FROM ex),
r AS (SELECT *, row_number() OVER (PARTITION BY case_type ORDER BY h, row_index) AS rk FROM c),
f AS (SELECT * FROM r WHERE rk <= 25),
t AS (SELECT * FROM r WHERE row_index NOT IN (SELECT row_index FROM f)),
tu AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY h, row_index) AS tt FROM t)
       WHERE tt <= 50 - (SELECT count(*) FROM f)),
ch AS (SELECT row_index, case_type, actual_is_fraud, explanation FROM f
       UNION ALL SELECT row_index, case_type, actual_is_fraud, explanation FROM tu),
sheet AS (SELECT *, row_number() OVER (ORDER BY md5('42:shuffle:' || CAST(row_index AS VARCHAR)), row_index)
       AS case_id FROM ch)
""").replace("\n, c AS", ",\nc AS")


def rating_sample(spark, d) -> DataFrame:
    """The blind sample (50 rows at most), written once: sheet and mapping number the same cases."""
    recs = case_records(spark, d).select("row_index", "case_type", "actual_is_fraud", "explanation")
    s = split.blind_rating_sample(recs).withColumn("case_id", F.col("case_id").cast("long"))
    return materialize(s, ML.shared_path(spark, "rating_sample"))


def _csv_round_trip(spark, df: DataFrame, name: str) -> DataFrame:
    path = ML.shared_path(spark, name)
    sinks.sink_csv(df, path)
    return (spark.read.schema(df.schema).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


@query("sink_csv_sheets", _SAMPLE_SQL + "SELECT case_id, explanation, CAST(NULL AS VARCHAR) AS score FROM sheet")
def q_sink_csv_sheets(spark, d):
    sheet = rating_sample(spark, d).select("case_id", "explanation", F.lit(None).cast("string").alias("score"))
    return _csv_round_trip(spark, sheet.coalesce(1), "rating_sheet")


@query("sink_rating_mapping", _SAMPLE_SQL + "SELECT case_id, row_index, case_type, actual_is_fraud FROM sheet")
def q_sink_rating_mapping(spark, d):
    """The mapping kept from the raters: case number to row, case type and truth."""
    m = rating_sample(spark, d).select("case_id", "row_index", "case_type", "actual_is_fraud")
    return _csv_round_trip(spark, m.coalesce(1), "rating_mapping")


@query("sink_evaluation_results", _sql(", " + _FAITH + """,
fa AS (SELECT transaction_id, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS faithfulness
   FROM m GROUP BY transaction_id)
SELECT transaction_id AS row_index, case_type, round(faithfulness, 6) AS faithfulness,
  """ + Q.usefulness("explanation") + """ AS usefulness FROM ex JOIN fa USING (transaction_id)""").replace(
    "\n, m AS", ",\nm AS"))
def q_sink_evaluation_results(spark, d):
    """Automated metrics of every explanation, written as CSV in as many parts as there are."""
    r = _metrics_rows(spark, d).withColumnRenamed("transaction_id", "row_index")
    return finish(_csv_round_trip(spark, r, "evaluation_results"))

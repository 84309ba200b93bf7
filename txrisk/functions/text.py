"""Prompt text, narration and explanation scoring (ops 125-132) as Column
expressions: ``format_string``, higher-order array functions and ``rlike``
keep everything JVM-side; only a user-supplied narrator runs in Python.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.functions.scalar import (FEATURE_LABELS, capitalize_first, feature_label,
                                     format_hour, format_naira, risk_band)

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference (prompt text, keyword lists,
# section patterns).
# ---------------------------------------------------------------------------
SYSTEM_PREAMBLE = "You are a fraud analyst assistant for a Nigerian bank."

PROMPT_HEAD = """{preamble}
A machine learning model has flagged the following transaction as potentially {flag_word}.

TRANSACTION DETAILS:
- Amount: {naira_amount}
- Channel: {channel}
- Hour: {hour_str}
- Bank: {bank}
- Location: {location}
- Customer age group: {age_group}

MODEL OUTPUT:
- Fraud prediction: {prediction_label}
- Confidence: {confidence}%

KEY RISK FACTORS (from model analysis, ranked by contribution magnitude):
{risk_factors}

A positive contribution means the factor pushed the prediction toward fraud;
a negative contribution means it pushed toward legitimate (i.e. it reduced
risk, it did not add to it).

Write a brief explanation for the fraud analyst that:
1. States the primary reason this was flagged
2. Lists 2-3 supporting risk factors, using ONLY the factors listed above — do not invent or mention any other transaction detail as a risk factor
3. States the risk level (High/Medium/Low)
4. Recommends a specific action (block/step-up auth/monitor)

Keep it under 100 words. Be direct and specific."""

FEATURE_PROMPT = """You are a fraud model feature engineer reviewing a Random Forest
fraud model for a Nigerian bank. The model currently uses 17 features
(transaction amount, hour, day of week, month, merchant risk score,
composite risk score, customer age, and bank identity).

The model missed {n_fn} fraud cases out of {n_total_fraud} in the test set
(false negatives). Below are behavioral/velocity features that were
engineered during EDA but NOT included in the final model, along with how
their average value compares between missed fraud, caught fraud, and
normal legitimate transactions. The "z-score" shows how many standard
deviations (of the legitimate-transaction distribution) the missed-fraud
average sits away from normal — larger |z| means the missed fraud looks
more anomalous on that feature than the model can currently detect.

CANDIDATE FEATURES (ranked by |z-score|):
{feature_table}

Using ONLY the numbers above — do not invent claims about Nigerian banking
behavior not supported by this data — recommend the TOP 2 candidate
features most likely to help the model catch more of the missed fraud if
added. For each, state:
1. The exact feature name (must match one from the list above)
2. One sentence of reasoning grounded in its z-score and mean comparison
3. A confidence level (High/Medium/Low) — be honest that these z-scores
   are modest (well under 1.0), so confidence should reflect that

Respond in this exact format, one block per recommended feature:
FEATURE: <name>
REASONING: <one sentence>
CONFIDENCE: <High/Medium/Low>
"""

FEATURE_KEYWORDS = {
    "amount": ["amount", "transaction size", "transaction value"],
    "hour": ["hour", "am", "pm", "night", "midnight", "morning", "afternoon", "evening"],
    "composite_risk": ["composite risk", "risk score"],
    "merchant_risk_score": ["merchant risk"],
    "day_of_week": ["day of week", "weekend", "weekday"],
    "month": ["month", "seasonal"],
    "age_numeric": ["age"],
}

USEFULNESS_SECTIONS = {
    "reason": [r"reason", r"flagged because", r"primary reason"],
    "factors": [r"factor", r"[-•]\s"],
    "risk_level": [r"\b(high|medium|low)\b.{0,15}risk", r"risk level"],
    "action": [r"\b(block|step-up|step up|monitor|freeze|verify|hold)\b"],
}
# ---------------------------------------------------------------------------

ACTIONS = {"High": "block the transaction", "Medium": "step-up authentication",
           "Low": "monitor the account"}


def fixed(v: Column, digits: int) -> Column:
    """Round half-even at ``digits`` through an integer scale (identical in every
    engine), then print with exactly ``digits`` decimals."""
    scale = 10 ** digits
    k = F.bround(F.abs(v) * F.lit(float(scale)), 0)  # sign kept apart: -0.0004 prints "-0.000"
    return F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")),
                    F.format_string(f"%.{digits}f", k / F.lit(float(scale))))


def signed(v: Column, digits: int) -> Column:
    """'+' for v >= 0, the number's own '-' otherwise (Python '{:+.nf}' for the z table)."""
    return F.concat(F.when(v >= 0, F.lit("+")).otherwise(F.lit("")), fixed(v, digits))


def _template(text: str, values: dict[str, Column]) -> Column:
    """Fill ``{name}`` slots of a fixed text with string columns (no Python per row)."""
    parts, rest = [], text
    while "{" in rest:
        i = rest.index("{")
        j = rest.index("}", i)
        parts += [F.lit(rest[:i]), values[rest[i + 1:j]]]
        rest = rest[j + 1:]
    parts.append(F.lit(rest))
    return F.concat(*parts)


# op 125
def risk_factor_lines(factors: Column) -> Column:
    line = F.transform(factors, lambda f: F.concat(
        F.lit("- "), capitalize_first(feature_label(f["feature"])), F.lit(" (contribution: "),
        F.when(f["value"] >= 0, F.lit("+")).otherwise(F.lit("")), fixed(f["value"], 3), F.lit(")")))
    return F.array_join(line, "\n")


def build_prompt(amount="amount", channel="channel", hour="hour", bank="bank",
                 location="location", age_group="age_group", predicted="predicted",
                 probability="fraud_probability", factors="top_factors") -> Column:
    c = F.col
    flagged = c(predicted) == 1
    conf = F.bround(c(probability) * 100, 0).cast("long").cast("string")
    return _template(PROMPT_HEAD, {
        "preamble": F.lit(SYSTEM_PREAMBLE),
        "flag_word": F.when(flagged, "fraudulent").otherwise("unusual"),
        "naira_amount": format_naira(amount),
        "channel": c(channel).cast("string"), "hour_str": format_hour(hour),
        "bank": c(bank).cast("string"), "location": c(location).cast("string"),
        "age_group": c(age_group).cast("string"),
        "prediction_label": F.when(flagged, "FRAUD").otherwise("NOT FRAUD"),
        "confidence": conf, "risk_factors": risk_factor_lines(c(factors))})


# op 126
def feature_table_line(feature="feature", z="fn_anomaly_z", fn="fn_mean", tp="tp_mean",
                       tn="tn_mean") -> Column:
    c = F.col
    return F.concat(F.lit("- "), c(feature), F.lit(": z="), signed(c(z), 2),
                    F.lit(", missed-fraud mean="), fixed(c(fn), 3),
                    F.lit(", caught-fraud mean="), fixed(c(tp), 3),
                    F.lit(", legitimate mean="), fixed(c(tn), 3))


def build_feature_prompt(z_table: DataFrame) -> DataFrame:
    """One-row DataFrame with the prompt; lines ordered by |z| desc (then name)."""
    lines = z_table.select(
        F.struct(-F.abs(F.col("fn_anomaly_z")), F.col("feature")).alias("k"),
        feature_table_line().alias("line"), "n_false_negatives", "n_true_positives")
    agg = lines.agg(F.sort_array(F.collect_list(F.struct("k", "line"))).alias("ls"),
                    F.first("n_false_negatives").alias("n_fn"), F.first("n_true_positives").alias("n_tp"))
    return agg.select(_template(FEATURE_PROMPT, {
        "n_fn": F.col("n_fn").cast("string"),
        "n_total_fraud": (F.col("n_fn") + F.col("n_tp")).cast("string"),
        "feature_table": F.array_join(F.transform("ls", lambda x: x["line"]), "\n")}).alias("prompt"))


# op 126a
# Fixed value: the context text of the reference's follow-up chat.
FOLLOWUP_HEAD = """You are a fraud analyst assistant for a Nigerian bank, answering a follow-up
question about a transaction that was already reviewed. Stay grounded in the
data below — do not invent transaction details or risk factors that are not
listed. If asked something the data can't answer, say so plainly.

TRANSACTION:
- Amount: {amount}
- Channel: {channel}
- Hour: {hour}
- Bank: {bank}
- Location: {location}
- Customer age group: {age_group}

MODEL OUTPUT:
- Prediction: {prediction}
- Confidence: {confidence}%
- Actual outcome: {outcome}

TOP SHAP RISK FACTORS:
{factors}

ORIGINAL EXPLANATION GIVEN TO THE ANALYST:
{explanation}

Answer the analyst's follow-up question in under 80 words."""


def build_followup_context(question: str = "question", history: str | None = None,
                           explanation: str = "explanation") -> Column:
    """Case context, the earlier turns (array of structs ``role``, ``text``) and the question,
    a blank line between each.  Null where the question is null or blank: there is nothing to ask."""
    c = F.col
    factors = F.array_join(F.transform(c("top_factors"), lambda f: F.concat(
        F.lit("- "), feature_label(f["feature"]), F.lit(": "), signed(f["value"], 3))), "\n")
    parts = [_template(FOLLOWUP_HEAD, {
        "amount": format_naira("amount"), "channel": c("channel").cast("string"),
        "hour": format_hour("hour"), "bank": c("bank").cast("string"),
        "location": c("location").cast("string"), "age_group": c("age_group").cast("string"),
        "prediction": F.when(c("predicted") == 1, "FRAUD").otherwise("NOT FRAUD"),
        "confidence": F.round(c("fraud_probability") * 100, 0).cast("long").cast("string"),
        "outcome": F.when(c("is_fraud") == 1, "confirmed fraud").otherwise("legitimate"),
        "factors": factors, "explanation": c(explanation)})]
    if history:
        parts.append(F.transform(F.coalesce(c(history), F.array()), lambda t: F.concat(
            F.when(t["role"] == "user", "Analyst: ").otherwise("Assistant: "), F.coalesce(t["text"], F.lit("")))))
    parts.append(F.concat(F.lit("Analyst: "), c(question)))
    turns = F.concat(*[p if i == 1 and history else F.array(p) for i, p in enumerate(parts)])
    return F.when(F.length(F.trim(c(question))) > 0, F.array_join(turns, "\n\n"))


# op 128: default narrator (deterministic template with the four required parts)
def default_narration(factors="top_factors", probability="fraud_probability",
                      channel="channel") -> Column:
    c = F.col
    band = risk_band(c(probability))
    first = c(factors)[0]
    rest = F.slice(c(factors), 2, 2)
    support = F.array_join(F.transform(rest, lambda f: F.concat(
        F.lit("- "), feature_label(f["feature"]), F.lit(" ("),
        F.when(f["value"] >= 0, F.lit("+")).otherwise(F.lit("")), fixed(f["value"], 3), F.lit(")"))),
        "\n")
    action = F.when(band == "High", ACTIONS["High"]).when(band == "Medium", ACTIONS["Medium"]) \
        .otherwise(ACTIONS["Low"])
    return F.concat(F.lit("Primary reason: "), feature_label(first["feature"]),
                    F.lit(" drove the score of this "), c(channel).cast("string"),
                    F.lit(" transaction.\nSupporting factors:\n"), support,
                    F.lit("\nRisk level: "), band, F.lit(" risk.\nRecommended action: "), action,
                    F.lit("."))


def narrate(df: DataFrame, prompt: str = "prompt", out: str = "explanation",
            fn: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """Text per case: the default template, or a user batch function prompt -> text
    applied per Arrow batch with ``mapInPandas``."""
    if fn is None:
        return df.select("*", default_narration().alias(out))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        for pdf in batches:
            pdf[out] = fn(pdf[prompt]).astype(str).values
            yield pdf

    return df.mapInPandas(run, schema)


# op 130
def _keywords(feature: Column) -> Column:
    m = F.create_map(*[x for k, v in FEATURE_KEYWORDS.items()
                       for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    return F.coalesce(m[feature], F.array(F.regexp_replace(feature, "_", " ")))


def _mentioned(feature: Column, text: Column, strict: bool) -> Column:
    low = F.lower(text)
    kws = _keywords(feature)
    if strict:
        # whole words only; keywords are plain words/phrases from the fixed list
        hit = F.exists(kws, lambda k: F.regexp_like(low, F.concat(F.lit("\\b"), k, F.lit("\\b"))))
    else:
        hit = F.exists(kws, lambda k: F.contains(low, k))
    bank_name = F.lower(F.substring(feature, 6, 1 << 20))
    bank_hit = (F.contains(low, bank_name) | F.contains(low, F.lit("bank"))) if not strict else \
        (F.regexp_like(low, F.concat(F.lit("\\b"), bank_name, F.lit("\\b"))) | low.rlike("\\bbank\\b"))
    return F.when(feature.startswith("bank_"), bank_hit).otherwise(hit)


def faithfulness(factors="top_factors", text="explanation", strict: bool = False) -> Column:
    f = F.col(factors)
    hits = F.size(F.filter(f, lambda x: _mentioned(x["feature"], F.col(text), strict)))
    return F.when(F.size(f) > 0, hits.cast("double") / F.size(f)).otherwise(F.lit(0.0))


# op 131
def mentioned_not_in_top(factors="top_factors", text="explanation",
                         vocabulary: list[str] = tuple(FEATURE_KEYWORDS)) -> Column:
    """Number of vocabulary features mentioned (whole words) that are not in the top list."""
    names = F.transform(F.col(factors), lambda x: x["feature"])
    vocab = F.array(*[F.lit(v) for v in vocabulary])
    return F.size(F.filter(vocab, lambda v: ~F.array_contains(names, v)
                           & _mentioned(v, F.col(text), True)))


# op 132
def usefulness(text="explanation") -> Column:
    low = F.lower(F.col(text))
    total = None
    for pats in USEFULNESS_SECTIONS.values():
        hit = None
        for p in pats:
            h = low.rlike(p)
            hit = h if hit is None else (hit | h)
        v = hit.cast("int")
        total = v if total is None else total + v
    return F.least(total, F.lit(4))


# op 129
def parse_features(text: Column) -> Column:
    """Names from lines 'FEATURE: name' (case-insensitive tag, '*' stripped)."""
    lines = F.split(text, "\n")
    tagged = F.filter(lines, lambda ln: F.upper(F.trim(ln)).startswith("FEATURE:"))
    return F.transform(tagged, lambda ln: F.trim(F.regexp_replace(
        F.trim(F.regexp_extract(F.trim(ln), "^[^:]*:(.*)$", 1)), "^\\*+|\\*+$", "")))


__all__ = ["build_prompt", "build_feature_prompt", "build_followup_context", "narrate",
           "faithfulness", "mentioned_not_in_top", "usefulness", "parse_features", "FEATURE_LABELS"]

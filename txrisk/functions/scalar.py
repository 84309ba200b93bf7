"""Column-level functions (ops 19-36a): every one is a built-in Catalyst
expression, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for equal results.
# ---------------------------------------------------------------------------
AGE_ORDINAL = {"<20": 1, "20-29": 2, "30-39": 3, "40+": 4}
SESSION_NIGHT = "Night (22–05)"
SESSION_BUSINESS = "Business (06–21)"
RISK_BAND_HIGH = 0.7
RISK_BAND_MEDIUM = 0.4
FEATURE_LABELS = {
    "amount": "transaction amount",
    "hour": "hour of day",
    "day_of_week": "day of week",
    "month": "month",
    "merchant_risk_score": "merchant risk score",
    "composite_risk": "composite risk score",
    "age_numeric": "customer age",
}
LEAKY_OR_REDUNDANT = [
    "hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos",
    "amount_rounded", "fraud_technique",
]
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pdiv(a, b) -> Column:
    """IEEE / pandas division: x/0 -> +-inf, 0/0 -> NaN (ANSI mode would raise)."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    zero = (F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
            .otherwise(F.lit(float("nan"))))
    return F.when(b == 0, zero).otherwise(a / b)


def _map_lit(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


# op 19
def ts_parts(ts) -> dict[str, Column]:
    ts = _c(ts)
    return {
        "hour": F.hour(ts).cast("int"),
        "day_of_week": F.weekday(ts).cast("int"),  # Monday = 0
        "month": F.month(ts).cast("int"),
    }


# op 20
def is_weekend(day_of_week) -> Column:
    return _c(day_of_week) >= 5


def is_peak_hour(hour, start: int = 9, end: int = 17) -> Column:
    h = _c(hour)
    return (h >= start) & (h <= end)


# op 21
def cyclical(x, period: int, digits: int = 9) -> tuple[Column, Column]:
    angle = F.lit(2.0 * math.pi) * _c(x).cast("double") / F.lit(float(period))
    return F.round(F.sin(angle), digits), F.round(F.cos(angle), digits)


# op 22
def amount_log(amount) -> Column:
    return F.ln(_c(amount))


def amount_rounded(amount) -> Column:
    return F.round(_c(amount), 0).cast("int")


# op 23
def is_night(hour) -> Column:
    h = _c(hour)
    return (h >= 22) | (h < 6)


def session_bucket(hour) -> Column:
    return F.when(is_night(hour), F.lit(SESSION_NIGHT)).otherwise(F.lit(SESSION_BUSINESS))


# op 24
def age_ordinal(age_group) -> Column:
    return _map_lit(AGE_ORDINAL)[_c(age_group)]


# op 25
def drop_if_present(df: DataFrame, cols=LEAKY_OR_REDUNDANT) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


# op 33
def risk_band(p) -> Column:
    p = _c(p)
    return (F.when(p >= RISK_BAND_HIGH, "High")
            .when(p >= RISK_BAND_MEDIUM, "Medium").otherwise("Low"))


# op 34
def case_outcome(actual, predicted) -> Column:
    a, p = _c(actual), _c(predicted)
    return (F.when((a == 1) & (p == 1), "Caught")
            .when((a == 1) & (p == 0), "Missed")
            .when((a == 0) & (p == 1), "False alarm")
            .otherwise("Correct pass"))


# op 35
def format_naira(amount) -> Column:
    # thousands separators, no decimals, half-even: ₦12,345
    return F.concat(F.lit("₦"), F.format_number(_c(amount), 0))


def format_hour(hour) -> Column:
    h = _c(hour)
    h12 = F.when(h % 12 == 0, 12).otherwise(h % 12)
    return F.concat(h12.cast("string"), F.when(h < 12, " AM").otherwise(" PM"))


def format_pct(p, digits: int = 0) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", _c(p) * 100), F.lit("%"))


# op 36
def feature_label(name) -> Column:
    n = _c(name)
    mapped = _map_lit(FEATURE_LABELS)[n]
    bank = F.concat(F.lit("bank ("), F.substring(n, 6, 1 << 20), F.lit(")"))
    return (F.when(mapped.isNotNull(), mapped)
            .when(n.startswith("bank_"), bank)
            .otherwise(F.regexp_replace(n, "_", " ")))


def capitalize_first(s) -> Column:
    s = _c(s)
    # Python str.capitalize: first char upper, the rest lower
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 20)))


# op 36a: signed share of the largest |v| in the same group
def share_of_max_abs(v, max_abs, floor_pct: float = 0.0) -> Column:
    v, m = _c(v), _c(max_abs)
    pct = F.when(m > 0, F.abs(v) / m * 100).otherwise(F.lit(0.0))
    if floor_pct:
        pct = F.greatest(pct, F.lit(float(floor_pct)))
    return F.when(v < 0, -pct).otherwise(pct)

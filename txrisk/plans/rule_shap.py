"""Registered queries: TreeSHAP and its summaries over a forest of given rules.

The forest's splits are parameters, its covers and leaf values come from the
table.  So SQL can state every value from the tables alone: the twin enumerates
all subsets of the features and takes conditional expectations leaf by leaf, which
shares nothing with the path tables of ``operators/shap.py``.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.functions import scalar as S
from txrisk.operators import shap as SH
from txrisk.operators.forest import fit_rules, leaf_paths
from txrisk.plans.common import finish
from txrisk.registry import query
from txrisk.sources import fixtures as fx

FEATURES = ["amount", "hour", "age_numeric"]

#: (feature, threshold, rows at most the threshold, rows above it); None is a leaf.
RULES = [
    ("amount", 100.0, ("hour", 5.0, None, None), ("age_numeric", 2.0, None, ("hour", 21.0, None, None))),
    ("hour", 21.0, ("amount", 50.0, None, ("amount", 300.0, ("hour", 5.0, None, None), None)), ("amount", 100.0, None, None)),
    ("age_numeric", 1.0, ("amount", 150.0, None, None), ("hour", 6.0, ("amount", 100.0, None, None), None)),
]


def _sql() -> str:
    """CTEs up to ``shap`` (transaction_id, the features, base_value, shap_...) by subset enumeration."""
    meets = lambda c: f"{c[0]} {'<=' if c[2] else '>'} {c[1]}"
    counts, expected, base = [], {}, []
    for i, rule in enumerate(RULES):
        paths = leaf_paths(rule)
        for j, p in enumerate(paths):
            cond = " AND ".join(meets(c) for c in p)
            counts += [f"count(*) FILTER ({cond}) + 1.0 AS n{i}_{j}", f"count(*) FILTER ({cond} AND is_fraud = 1) + 0.5 AS p{i}_{j}"]
        cover = lambda prefix: "(" + " + ".join(f"n{i}_{j}" for j, p in enumerate(paths) if p[:len(prefix)] == prefix) + ")"  # noqa: E731, B023
        for known in itertools.chain.from_iterable(itertools.combinations(FEATURES, k) for k in range(len(FEATURES) + 1)):
            leaves = []
            for j, p in enumerate(paths):
                factors = [f"CASE WHEN {meets(c)} THEN 1.0 ELSE 0.0 END" if c[0] in known else f"{cover(p[:k + 1])} / {cover(p[:k])}"
                           for k, c in enumerate(p)]
                leaves.append(f"p{i}_{j} / n{i}_{j} * " + " * ".join(factors))
            expected.setdefault(known, []).append("(" + " + ".join(leaves) + ")")
    e = {k: f"e{i}" for i, k in enumerate(expected)}
    columns = ", ".join(f"({' + '.join(v)}) / {len(RULES)} AS {e[k]}" for k, v in expected.items())
    m = len(FEATURES)
    values = []
    for f in FEATURES:
        others = [x for x in FEATURES if x != f]
        parts = []
        for k in range(m):
            weight = math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
            for s in itertools.combinations(others, k):
                with_f = tuple(x for x in FEATURES if x in s or x == f)
                parts.append(f"{weight!r} * ({e[with_f]} - {e[s]})")
        values.append(f"{' + '.join(parts)} AS shap_{f}")
    return f"""WITH feats AS (SELECT transaction_id, is_fraud, amount, CAST(hour AS DOUBLE) AS hour,
  CASE age_group WHEN '<20' THEN 1.0 WHEN '20-29' THEN 2.0 WHEN '30-39' THEN 3.0 WHEN '40+' THEN 4.0 END::DOUBLE AS age_numeric
  FROM tx),
counts AS (SELECT {', '.join(counts)} FROM feats),
expected AS (SELECT feats.*, {columns} FROM feats, counts),
shap AS (SELECT transaction_id, amount, hour, age_numeric, {e[()]} AS base_value, {e[tuple(FEATURES)]} AS shap_prediction,
  {', '.join(values)} FROM expected),
long AS (SELECT transaction_id, base_value, unnest({FEATURES}) AS feature,
  unnest([{', '.join('shap_' + f for f in FEATURES)}]) AS shap FROM shap)
"""


_SQL = _sql()


def rows(spark, d) -> DataFrame:
    return fx.tx(spark, d).select("transaction_id", "is_fraud", "amount", F.col("hour").cast("double").alias("hour"),
                                  S.age_ordinal("age_group").cast("double").alias("age_numeric"))


def shap(spark, d) -> DataFrame:
    t = rows(spark, d)
    return SH.shap_of_trees(t, fit_rules(t, RULES, FEATURES, "is_fraud"), FEATURES, "transaction_id")


@query("rule_shap", _SQL + "SELECT transaction_id, round(base_value, 6) AS base_value, round(shap_prediction, 6) AS shap_prediction, "
       + ", ".join(f"round(shap_{f}, 6) AS shap_{f}" for f in FEATURES) + " FROM shap")
def q_rule_shap(spark, d):
    return finish(shap(spark, d))


_GLOBAL = "g AS (SELECT feature, avg(abs(shap)) AS v FROM long GROUP BY feature)"


@query("rule_shap_global", _SQL + f""", {_GLOBAL}
SELECT feature, round(v, 6) AS mean_abs_shap, CAST(row_number() OVER (ORDER BY v DESC, feature) AS INT) AS rank,
  round(v / sum(v) OVER (), 6) AS share FROM g""")
def q_rule_shap_global(spark, d):
    return finish(SH.shap_global(shap(spark, d), FEATURES))


@query("rule_shap_dependence", _SQL + """, j AS (SELECT *, min(amount) OVER () AS lo, max(amount) OVER () AS hi FROM shap)
SELECT CAST(CASE WHEN hi > lo THEN least(floor((amount - lo) / (hi - lo) * 10), 9) ELSE 0 END AS INT) AS bin, count(*) AS n,
  round(avg(amount), 6) AS mean_value, round(avg(shap_amount), 6) AS mean_shap, round(avg(hour), 6) AS mean_interacting
FROM j GROUP BY 1""")
def q_rule_shap_dependence(spark, d):
    return finish(SH.shap_dependence(shap(spark, d), rows(spark, d), "transaction_id", "amount", "hour"))


@query("rule_shap_waterfall", _SQL + """
SELECT transaction_id, feature, round(shap, 6) AS shap, CAST(row_number() OVER w AS INT) AS step,
  round(base_value + sum(shap) OVER w, 6) AS cumulative
FROM long WINDOW w AS (PARTITION BY transaction_id ORDER BY abs(shap) DESC, feature)""")
def q_rule_shap_waterfall(spark, d):
    return finish(SH.shap_waterfall(shap(spark, d), FEATURES, "transaction_id"))


@query("rule_importance_agreement", _SQL + f""", {_GLOBAL},
given AS (SELECT unnest({FEATURES}) AS feature, unnest([0.2, 0.5, 0.3]) AS importance),
r AS (SELECT feature, row_number() OVER (ORDER BY importance DESC, feature) AS gini_rank,
  row_number() OVER (ORDER BY v DESC, feature) AS shap_rank FROM g JOIN given USING (feature))
SELECT feature, CAST(gini_rank AS INT) AS gini_rank, CAST(shap_rank AS INT) AS shap_rank,
  gini_rank <= 5 AND shap_rank <= 5 AS both_top_k, CAST(gini_rank - shap_rank AS INT) AS rank_diff FROM r""")
def q_rule_importance_agreement(spark, d):
    """Ranks of given importances against those of the table's mean |SHAP|."""
    given = spark.createDataFrame(list(zip(FEATURES, [0.2, 0.5, 0.3], strict=True)), "feature string, importance double")
    return SH.importance_agreement(given, SH.shap_global(shap(spark, d), FEATURES))

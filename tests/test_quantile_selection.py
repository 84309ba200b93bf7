"""Exact quantiles by selection: narrowing rounds, ties, infinities, near-unique columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.operators import profile

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


def both(df, x, **kw):
    got = profile.exact_quantiles(df, ["x"], PROBS, **kw).first().q0
    assert got == pytest.approx(list(np.quantile(x, PROBS)), abs=1e-9)


def test_narrowing_rounds_keep_the_result(spark, monkeypatch):
    """With a bound of a few values a bracket the rounds run; a near-unique column needs them."""
    rounds = []
    plain = profile._narrowed
    monkeypatch.setattr(profile, "_narrowed", lambda *a: rounds.append(plain(*a)) or rounds[-1])
    df = spark.range(120_000).select((F.col("id") * 7919 % 120_011).cast("double").alias("x"))
    x = np.array([i * 7919 % 120_011 for i in range(120_000)], dtype=float)
    both(df, x, ranked=20)
    assert sum(r is not None for r in rounds) >= 1
    rounds.clear()
    both(df, x)
    assert not rounds  # one sketch and one pass at this size


def test_one_value_on_a_third_of_the_rows(spark):
    n = 30_000
    x = np.array([5.0 if i % 3 == 0 else float(i % 9973) for i in range(n)])
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") % 9973).cast("double")).alias("x"))
    both(df, x)
    both(df, x, ranked=3)


def test_ranked_rows_stay_within_the_bound(spark):
    """What the last pass leaves to one task: the values in the brackets and one row a gap."""
    df = spark.range(200_000).select(F.rand(3).alias("x")).cache()
    q = profile.exact_quantiles(df, ["x"], [0.5], ranked=50)
    assert q.first().q0[0] == pytest.approx(float(np.quantile([r.x for r in df.collect()], 0.5)), abs=1e-12)
    clean = df.select(F.col("x").alias("x0"))
    lo, hi = clean.agg(F.percentile_approx("x0", F.array(F.lit(0.4996), F.lit(0.5004)), profile.SKETCH)).first()[0]
    brackets, ranks = [[(lo, hi)]], [[100_000, 100_001]]
    while less := profile._narrowed(profile._in_cells(clean, brackets), brackets, ranks, 50):
        brackets = less
    held = clean.filter(F.col("x0").between(*brackets[0][0])).count()
    assert held <= 50


def test_infinities_and_several_columns(spark):
    rows = [(float("inf"), 1.0, None), (float("-inf"), 1.0, None), (0.0, 1.0, None), (-0.0, float("nan"), None), (2.0, 3.0, None)]
    q = profile.exact_quantiles(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"], [0.0, 0.5, 1.0]).first()
    assert list(q.q0) == [float("-inf"), 0.0, float("inf")] and list(q.q1) == [1.0, 1.0, 3.0] and list(q.q2) == [None] * 3

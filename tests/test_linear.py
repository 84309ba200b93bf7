"""Logistic regression by Newton steps: against MLlib at a tight tolerance, the optimum's condition, edges."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from txrisk.operators import linear, models as ML

NAMES = ["a", "b", "flag", "still"]


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(3)
    rows = []
    for i in range(4000):
        a, b, c = r.gauss(5, 2), r.expovariate(0.01), r.random() < 0.1
        y = int(r.random() < 1 / (1 + np.exp(4 - 0.5 * a - 0.002 * b + c)))
        rows.append((i, a, b, int(c), 7.0, y))
    return spark.createDataFrame(rows, "id long, a double, b double, flag int, still double, y int").repartition(5).cache()


def test_equals_mllib_at_its_optimum(spark, data):
    model = ML.train_lr(data, NAMES, "y")
    assert model.gradient < linear.TOLERANCE and model.steps < 15
    scaled = data.select("y", *[((F.col(n) - m) / s).alias(n) for n, m, s in
                                zip(NAMES, model.mean, model.scale, strict=True)])
    rows = ML.assemble_features(ML.weighted(scaled, "y"), NAMES)
    found = LogisticRegression(labelCol="y", weightCol="weight", regParam=1.0 / data.count(), standardization=False,
                               maxIter=1000, tol=1e-14).fit(rows)
    assert np.allclose(model.coefficients, found.coefficients.toArray(), atol=1e-6)
    assert model.intercept == pytest.approx(found.intercept, abs=1e-6)
    assert model.coefficients[3] == 0.0 and model.scale[3] == 1.0  # a constant feature carries nothing


def test_gradient_by_numpy(data):
    model = ML.train_lr(data, NAMES, "y", c_param=0.1)
    pdf = data.toPandas()
    z = (pdf[NAMES].to_numpy(float) - model.mean) / model.scale
    y = pdf.y.to_numpy()
    p = 1 / (1 + np.exp(-(z @ model.coefficients + model.intercept)))
    w = len(y) / (2 * np.where(y == 1, y.sum(), len(y) - y.sum()))
    assert np.abs(0.1 * z.T @ (w * (p - y)) + model.coefficients).max() < 1e-6 * len(y)
    assert abs((w * (p - y)).sum()) < 1e-6 * len(y)
    got = ML.score_table(model, data, ["id"]).toPandas().sort_values("id").fraud_probability.to_numpy()
    assert np.allclose(got, p[np.argsort(pdf.id)], atol=1e-12)


def test_scoring_stays_in_generated_code(data):
    plan = ML.score_table(ML.train_lr(data, ["a"], "y"), data, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "UDF" not in plan


def test_rare_class_separable_rows_and_repeats(spark):
    rows = [(float(i % 10), int(i % 10 == 9)) for i in range(300)]
    model = ML.train_lr(spark.createDataFrame(rows, "a double, y int"), ["a"], "y")
    assert np.isfinite(model.coefficients).all() and model.coefficients[0] > 1 and model.gradient < 1e-8


@pytest.mark.parametrize("rows", [[(1.0, 1), (2.0, 1)], [], [(None, 1), (1.0, 0)], [(float("nan"), 1), (1.0, 0)]])
def test_rows_that_cannot_be_fitted(spark, rows):
    with pytest.raises(ValueError):
        ML.train_lr(spark.createDataFrame(rows, "a double, y int"), ["a"], "y")


def test_a_model_is_read_back_as_it_was(spark, data):
    model = ML.train_lr(data, NAMES, "y")
    assert ML.model_persist(model, ML.shared_path(spark, "lr")) == model

"""Model training and scoring with MLlib (ops 8, 90-99).

Training input is written once as the model-ready Parquet table (op 3) in
the shared checkpoint folder and read back, so MLlib's many passes re-read
a short lineage and a lost executor only recomputes Parquet splits.
"""

from __future__ import annotations

import os
import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.operators.grow import WHOLE_ROWS, ForestClassifier
from txrisk.operators.linear import LinearModel, fit_logistic
from txrisk.operators.risk import with_class_weight
from txrisk.session import checkpoint_dir

# Fixed values of the reference's model configuration.
BASE_FEATURES = ["amount", "hour", "day_of_week", "month", "merchant_risk_score",
                 "composite_risk", "age_numeric", "amount_sum_24h", "amount_vs_mean_ratio_safe"]
RF_PARAMS = dict(numTrees=100, maxDepth=10, minInstancesPerNode=50)
VERDICT_DELTA = 0.002
SEED = 42


def shared_path(spark, name: str) -> str:
    """A fresh path under the shared checkpoint folder (never a machine-local tmp)."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


# op 90
def assemble_features(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    """One vector per row.  A null or NaN feature is an error that names the column."""
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="error").transform(df)


# op 91 (DataFrame-native; population std as the reference's scaler)
def scale_features(df: DataFrame, features: list[str], fit_on: DataFrame | None = None,
                   suffix: str = "_scaled") -> DataFrame:
    src = fit_on if fit_on is not None else df
    stats = src.agg(*[F.avg(F.col(c).cast("double")).alias(f"__m_{c}") for c in features],
                    *[F.stddev_pop(F.col(c).cast("double")).alias(f"__s_{c}") for c in features])
    j = df.crossJoin(F.broadcast(stats))  # one row
    return j.select(*df.columns, *[
        ((F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, 1.0)
         .otherwise(F.col(f"__s_{c}"))).alias(f"{c}{suffix}") for c in features])


def weighted(train: DataFrame, label: str) -> DataFrame:
    return with_class_weight(train, label, "weight")


# op 92
def train_lr(train: DataFrame, features: list[str], label: str = "is_fraud", c_param: float = 1.0) -> LinearModel:
    """L2 logistic regression with balanced weights after standard scaling (population deviation), to its optimum."""
    return fit_logistic(train, features, label, c_param)


# op 93
def lr_coefficients(model: LinearModel, features: list[str]) -> DataFrame:
    from pyspark.sql import SparkSession

    df = SparkSession.getActiveSession().createDataFrame(
        list(zip(features, model.coefficients, strict=True)), "feature string, coefficient double")
    return df.select("*", F.abs("coefficient").alias("abs_coefficient")).orderBy(
        F.col("coefficient").desc(), "feature")


def forest_classifier(label: str, max_bins: int = 256, **params) -> ForestClassifier:
    """The forest estimator of the search (many forests); ``params`` are its settings, by MLlib's names and rules."""
    return ForestClassifier(label, maxBins=max_bins, seed=SEED, **{"whole_rows": WHOLE_ROWS} | params)


# op 94
def train_rf(train: DataFrame, features: list[str], label: str = "is_fraud",
             max_bins: int = 256, **params) -> PipelineModel:
    p = dict(RF_PARAMS)
    p.update(params)
    train.sparkSession.sparkContext.setCheckpointDir(checkpoint_dir(train.sparkSession))  # node ids
    # every partition sends the statistics of all nodes, so there are no more than can run at once
    tw = weighted(train, label).coalesce(train.sparkSession.sparkContext.defaultParallelism)
    stages = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error"),
              RandomForestClassifier(**dict(dict(
                  featuresCol="features", labelCol=label, weightCol="weight", seed=SEED, maxBins=max_bins,
                  featureSubsetStrategy="sqrt", maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=10), **p))]
    return Pipeline(stages=stages).fit(tw)


# op 95
def rf_importance(model: PipelineModel, features: list[str], top: int = 15) -> DataFrame:
    from pyspark.sql import SparkSession

    rf = model.stages[-1]
    s = SparkSession.getActiveSession()
    rows = list(zip(features, [float(x) for x in rf.featureImportances.toArray()]))
    return (s.createDataFrame(rows, "feature string, importance double")
            .orderBy(F.col("importance").desc(), "feature").limit(top))


# op 96
def score_table(model: PipelineModel | LinearModel, df: DataFrame, keep: list[str],
                threshold: float = 0.5) -> DataFrame:
    if isinstance(model, LinearModel):
        out, p = df, model.probability()
    else:
        out, p = model.transform(df), vector_to_array(F.col("probability"))[1]
    return out.select(*keep, p.alias("fraud_probability"),
                      (p > threshold).cast("int").alias("predicted"))


# op 8
def model_persist(model: PipelineModel | LinearModel, path: str) -> PipelineModel | LinearModel:
    """The model as read back from ``path``."""
    if isinstance(model, LinearModel):
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        model.save(spark, path)
        return LinearModel.load(spark, path)
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


# op 98
def verdict(auc_delta) -> F.Column:
    d = F.col(auc_delta) if isinstance(auc_delta, str) else auc_delta
    return (F.when(d > VERDICT_DELTA, "IMPROVED")
            .when(F.abs(d) <= VERDICT_DELTA, "NO MEANINGFUL CHANGE").otherwise("WORSE"))

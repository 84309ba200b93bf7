"""Distributed path-dependent TreeSHAP for random forests (ops 118-124).

* The forest's node table is read from the model's saved ``data/`` Parquet
  (``forest.forest_trees``) and broadcast.  Its size is bounded by the model
  parameters: numTrees x (2^(maxDepth+1) - 1) nodes.
* Every leaf is a path of conditions.  Repeated features are merged, so that a
  path has one condition per feature, which a row meets or not, and one share of
  the weight that goes its way.  A row's values depend on a leaf only through the
  bit pattern of the conditions it meets: a table per path, by pattern, holds what
  each feature gets, and rows look their pattern up.  The patterns of all leaves
  come from one walk over the tree that changes one bit per node; small subtrees are
  one table each.
* Shapley weights s!(d-1-s)!/d! are the integrals of t^s (1-t)^(d-1-s) over 0..1.
  So the sum over all subsets of the other features is the integral of a product
  with one factor per feature, a polynomial of degree d - 1, and Gauss-Legendre
  quadrature with ceil(d / 2) points is exact.
* Per-tree values are leaf class-1 shares and covers are the weighted
  ``impurityStats`` sums, so ``base + sum(phi)`` equals MLlib's probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.operators.forest import forest_trees, leaves_of
from txrisk.operators.history import rank_within

#: Conditions up to which a path's table holds every pattern; longer paths get those that occur in a batch.
FULL_TABLE = 10

#: A subtree's patterns are walked instead of the rows if there are this many rows to each of them.
PATTERN_ROWS = 8

#: Rows that share the tables of all paths: they cost as much for one row as for some ten thousand.
ROWS_AT_ONCE = 50_000


def expected_value(trees: list[dict]) -> float:
    ev = []
    for t in trees:
        leaf = t["left"] < 0
        ev.append(float((t["val"][leaf] * t["cov"][leaf]).sum() / t["cov"][0]))
    return float(np.mean(ev))


# ---------------------------------------------------------------- TreeSHAP by path tables
@lru_cache(maxsize=64)
def _quadrature(d: int) -> tuple[np.ndarray, np.ndarray]:
    """Points in 0..1 and weights, exact up to degree d - 1."""
    t, w = np.polynomial.legendre.leggauss((d + 1) // 2)
    return (t + 1) / 2, w / 2


@lru_cache(maxsize=64)
def _all_patterns(d: int) -> np.ndarray:
    return _bits(np.arange(1 << d), d)


def _bits(patterns: np.ndarray, d: int) -> np.ndarray:
    return (patterns[None] >> np.arange(d)[:, None]) & 1 == 1


def path_table(share: np.ndarray, value: float, met: np.ndarray) -> np.ndarray:
    """What each of a path's d features gets (rows) for each pattern of met conditions (``met``: d x patterns).

    ``share`` is the part of the weight that goes the path's way where the feature
    is unknown; ``value`` the leaf's value.
    """
    t, w = _quadrature(len(share))
    share = np.maximum(share, 1e-200)[:, None]
    unmet = share * (1 - t)                      # d x points: a feature's factor, condition not met
    factor = (unmet, unmet + t)
    product = np.broadcast_to(w[:, None], (len(t), met.shape[1]))
    for j in range(len(share)):
        product = product * np.where(met[j], factor[1][j][:, None], factor[0][j][:, None])
    without = [(1 / f) @ product for f in factor]  # d x patterns: the integral without the feature's own factor
    return value * np.where(met, (1 - share) * without[1], -share * without[0])


def tree_shap(X: np.ndarray, t: dict, phi: np.ndarray) -> None:
    """Add one tree's path-dependent SHAP values for all rows of X (n x m) into phi (m x n).

    A subtree that many rows meet is walked once for every pattern of its splits and of the
    path above it, as if the patterns were rows; the rows then look their pattern up once
    instead of once per leaf.
    """
    left, right, feat, thr, val, cov = (t[k] for k in ("left", "right", "feat", "thr", "val", "cov"))
    columns, n = X.T, len(X)

    def splits(node: int) -> list[int]:
        return [] if left[node] < 0 else [node, *splits(left[node]), *splits(right[node])]

    def walk(node: int, place: dict[int, int], share: list[float], pattern: np.ndarray, goes_left, out) -> None:
        d = len(share)
        if left[node] < 0:
            if d and val[node]:
                if d <= FULL_TABLE:
                    met, at = _all_patterns(d), pattern
                else:
                    seen, at = np.unique(pattern, return_inverse=True)
                    met = _bits(seen, d)
                table = path_table(np.array(share), val[node], met)
                for f, j in place.items():
                    out[f] += table[j][at]
            return
        if out is phi and PATTERN_ROWS << (d + sizes[node]) <= n:
            below = splits(node)
            for i, s in enumerate(below, d):
                pattern = pattern | (goes_left(s).astype(np.int64) << i)
            bit = {s: i for i, s in enumerate(below, d)}
            patterns = np.arange(1 << (d + len(below)))
            found = {f: np.zeros(len(patterns)) for f in {*place, *(int(feat[s]) for s in below)}}
            walk(node, place, share, patterns & ((1 << d) - 1), lambda s: (patterns >> bit[s]) & 1 == 1, found)
            for f, v in found.items():
                out[f] += v[pattern]
            return
        f = int(feat[node])
        lefts = goes_left(node)
        j = place.get(f, d)
        b = np.int64(1 << j)
        for child, goes in ((left[node], lefts), (right[node], ~lefts)):
            part = cov[child] / cov[node]
            if j == d:  # a feature that is new to the path
                walk(child, place | {f: j}, [*share, part], pattern | (goes * b), goes_left, out)
            else:       # met only if all of its conditions are
                walk(child, place, [*share[:j], share[j] * part, *share[j + 1:]], np.where(goes, pattern, pattern & ~b), goes_left, out)

    sizes = [0] * len(left)  # splits of each subtree
    for i in range(len(left) - 1, -1, -1):  # parents come first
        if left[i] >= 0:
            sizes[i] = 1 + sizes[left[i]] + sizes[right[i]]
    walk(0, {}, [], np.zeros(n, dtype=np.int64), lambda s: columns[feat[s]] <= thr[s], phi)


def forest_shap(X: np.ndarray, trees: list[dict]) -> np.ndarray:
    """SHAP values (n x m) of the mean over the trees."""
    phi = np.zeros((X.shape[1], X.shape[0]))
    X = np.asfortranarray(X)
    for t in trees:
        tree_shap(X, t, phi)
    return phi.T / len(trees)


def forest_predict(X: np.ndarray, trees: list[dict]) -> np.ndarray:
    return np.mean([t["val"][leaves_of(X, t)] for t in trees], axis=0)


def together(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Batches joined until they have ``least`` rows."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        held.append(pdf)
        if sum(map(len, held)) >= least:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


# op 118
def tree_shap_values(df: DataFrame, rf_model, features: list[str], id_col: str,
                     model_path: str) -> DataFrame:
    """Wide SHAP table: id, base_value, shap_prediction, shap_<feature>..."""
    return shap_of_trees(df, forest_trees(df.sparkSession, rf_model, model_path), features, id_col)


def shap_of_trees(df: DataFrame, trees: list[dict], features: list[str], id_col: str) -> DataFrame:
    """The wide SHAP table of any forest given as trees (``forest.forest_trees``)."""
    base = expected_value(trees)
    shared = df.sparkSession.sparkContext.broadcast(trees)
    schema = (f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, base_value double, shap_prediction double, "
              + ", ".join(f"`shap_{c}` double" for c in features))

    def run(batches):
        for pdf in together(batches, ROWS_AT_ONCE):
            phi = forest_shap(pdf[features].to_numpy(dtype=float), shared.value)
            res = pd.DataFrame({id_col: pdf[id_col].values, "base_value": base,
                                "shap_prediction": base + phi.sum(axis=1)})
            yield res.assign(**{f"shap_{c}": phi[:, j] for j, c in enumerate(features)})

    return df.select(id_col, *features).mapInPandas(run, schema)


def shap_long(wide: DataFrame, features: list[str], id_col: str) -> DataFrame:
    entries = [F.struct(F.lit(c).alias("feature"), F.col(f"shap_{c}").alias("value"))
               for c in features]
    return wide.select(id_col, F.explode(F.array(*entries)).alias("e")).select(
        id_col, "e.feature", F.col("e.value").alias("shap"))


# op 119
def shap_additivity(wide: DataFrame, scores: DataFrame, id_col: str, prob: str = "fraud_probability",
                    tol: float = 1e-6) -> DataFrame:
    j = wide.join(scores.select(id_col, prob), id_col)
    err = F.abs(F.col("shap_prediction") - F.col(prob))
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.max(err).alias("max_abs_error")).select(
        "*", (F.col("max_abs_error") <= tol).alias("additive"))


# op 120
def shap_global(wide: DataFrame, features: list[str], expected_top: list[str] = ()) -> DataFrame:
    one = wide.agg(*[F.avg(F.abs(F.col(f"shap_{c}"))).alias(c) for c in features])
    entries = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean_abs_shap")) for c in features]
    long = one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    w = Window.orderBy(F.col("mean_abs_shap").desc(), "feature")  # one row per feature
    tot = Window.partitionBy()
    out = long.select("*", F.row_number().over(w).alias("rank"),
                      (F.col("mean_abs_shap") / F.sum("mean_abs_shap").over(tot)).alias("share"))
    if expected_top:
        out = out.select("*", ((F.col("rank") > 1) | F.col("feature").isin(list(expected_top)))
                         .alias("top_feature_as_expected"))
    return out


# op 121
def shap_top3(wide: DataFrame, features: list[str], id_col: str, k: int = 3) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"shap_{c}").alias("value"))
                    for c in features])
    return wide.select(id_col, rank_within(arr, k).alias("top_shap_features"))


# op 122
def shap_dependence(wide: DataFrame, values: DataFrame, id_col: str, feature: str,
                    interacting: str, n_bins: int = 10) -> DataFrame:
    j = wide.select(id_col, F.col(f"shap_{feature}").alias("shap")).join(
        values.select(id_col, F.col(feature).alias("x"), F.col(interacting).alias("z")), id_col)
    mm = j.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    b = F.when(F.col("hi") > F.col("lo"),
               F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * n_bins),
                       F.lit(n_bins - 1))).otherwise(F.lit(0)).cast("int")
    return (j.crossJoin(mm).select(b.alias("bin"), "x", "shap", "z").groupBy("bin")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_value"),
                 F.avg("shap").alias("mean_shap"), F.avg("z").alias("mean_interacting")))


# op 123
def shap_waterfall(wide: DataFrame, features: list[str], id_col: str) -> DataFrame:
    """Contributions by size with the running total from the base value: sorted and summed inside the row, no shuffle."""
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"shap_{c}").alias("value")) for c in features])
    steps = wide.select(id_col, "base_value", rank_within(entries, len(features)).alias("__all"))
    steps = steps.select(id_col, "base_value", "__all", F.posexplode("__all").alias("__p", "__e"))
    upto = F.aggregate(F.slice("__all", 1, F.col("__p") + 1), F.lit(0.0), lambda a, e: a + e["value"])
    return steps.select(id_col, F.col("__e.feature").alias("feature"), F.col("__e.value").alias("shap"),
                        (F.col("__p") + 1).alias("step"), (F.col("base_value") + upto).alias("cumulative"))


# op 124
def importance_agreement(gini: DataFrame, shap_rank: DataFrame, k: int = 5) -> DataFrame:
    g = gini.select("feature", F.row_number().over(
        Window.orderBy(F.col("importance").desc(), "feature")).alias("gini_rank"))
    j = g.join(shap_rank.select("feature", F.col("rank").alias("shap_rank")), "feature")
    return j.select("*", ((F.col("gini_rank") <= k) & (F.col("shap_rank") <= k)).alias("both_top_k"),
                    (F.col("gini_rank") - F.col("shap_rank")).alias("rank_diff"))

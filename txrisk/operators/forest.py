"""Node tables of fitted forests as NumPy arrays (used by the search and by TreeSHAP)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from txrisk.operators.grow import GrownForest


def forest_trees(spark, rf_model, path: str) -> list[dict]:
    """The trees of a fitted forest by tree number; MLlib's is saved at ``path`` first.

    Per node: left, right (-1: leaf), feat, thr, val (share of class 1), cov (weight),
    n (rows as drawn), depth.  At most trees x 2^(depth + 1) nodes reach the driver.
    """
    if isinstance(rf_model, GrownForest):
        return rf_model.trees
    rf_model.write().overwrite().save(path)
    node = F.col("nodeData")
    stats = node["impurityStats"]
    total = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", node["id"].alias("id"), total.alias("cov"),
        F.when((total > 0) & (F.size(stats) > 1), stats[1] / total).otherwise(0.0).alias("val"),
        node["rawCount"].alias("n"), node["leftChild"].alias("left"), node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("feat"),
        F.when(node["leftChild"] >= 0, F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)))
        .otherwise(0.0).alias("thr")).toPandas().sort_values(["treeID", "id"])
    trees = []
    for _, g in nodes.groupby("treeID"):
        t = {c: g[c].to_numpy() for c in ("left", "right", "feat", "thr", "val", "cov", "n")}
        t["left"], t["right"] = t["left"].astype(np.int64), t["right"].astype(np.int64)
        depth = np.zeros(len(g), np.int64)
        for i in np.flatnonzero(t["left"] >= 0):  # ids are given parents first
            depth[[t["left"][i], t["right"][i]]] = depth[i] + 1
        trees.append(t | {"depth": depth})
    return trees


def leaves_of(x: np.ndarray, tree: dict) -> np.ndarray:
    """The leaf of every row."""
    left, right, feat, thr = (tree[k] for k in ("left", "right", "feat", "thr"))
    x, inner = np.ascontiguousarray(x), left >= 0
    own = np.arange(len(left))
    sides = np.column_stack([np.where(inner, right, own), np.where(inner, left, own)]).ravel()  # a leaf is its own child
    feat, values, row = np.where(inner, feat, 0), x.ravel(), np.arange(len(x)) * x.shape[1]
    node = np.zeros(len(x), np.int64)
    while inner.take(node).any():
        goes = values.take(row + feat.take(node)) <= thr.take(node)
        node = sides.take(2 * node + goes)
    return node


# ---------------------------------------------------------------- forests of given rules
def leaf_paths(rule, path=()):
    """((feature, threshold, goes left), ...) of every leaf of a nested (feature, threshold, left, right) rule; None is a leaf."""
    if rule is None:
        return [path]
    f, threshold, left, right = rule
    return leaf_paths(left, (*path, (f, threshold, True))) + leaf_paths(right, (*path, (f, threshold, False)))


def fit_rules(df, rules: list, features: list[str], label: str) -> list[dict]:
    """Trees of given splits whose covers and values come from ``df`` in one pass.

    A leaf covers its rows plus one and holds (frauds + 1/2) / (rows + 1), so that empty leaves do no harm.
    """
    paths = [leaf_paths(r) for r in rules]

    def meets(path):
        cond = F.lit(True)
        for f, threshold, goes in path:
            cond &= (F.col(f) <= threshold) if goes else (F.col(f) > threshold)
        return cond
    counts = df.agg(*[agg.alias(f"{kind}{i}_{j}") for i, leaves in enumerate(paths) for j, p in enumerate(leaves)
                      for kind, agg in (("n", F.count_if(meets(p))), ("pos", F.count_if(meets(p) & (F.col(label) == 1))))]).first()
    trees = []
    for i, rule in enumerate(rules):
        nodes, leaves = [], iter(range(len(paths[i])))

        def build(r) -> int:
            at = len(nodes)
            nodes.append(None)
            if r is None:
                j = next(leaves)
                n, pos = counts[f"n{i}_{j}"] + 1, counts[f"pos{i}_{j}"] + 0.5
                nodes[at] = (-1, -1, -1, 0.0, pos / n, n)
            else:
                left, right = build(r[2]), build(r[3])
                n = nodes[left][5] + nodes[right][5]
                nodes[at] = (left, right, features.index(r[0]), r[1], 0.0, n)
            return at
        build(rule)
        trees.append({k: np.array(v, dtype=float if k in ("thr", "val", "cov") else np.int64)
                      for k, v in zip(("left", "right", "feat", "thr", "val", "cov"), zip(*nodes, strict=True), strict=True)})
    return trees

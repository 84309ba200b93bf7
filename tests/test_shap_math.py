"""TreeSHAP path tables vs brute-force Shapley values on random small trees (no Spark)."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from txrisk.operators import shap
from txrisk.operators.shap import expected_value, forest_predict, forest_shap


def random_tree(rng, m, depth):
    left, right, feat, thr, val, cov = [], [], [], [], [], []

    def build(d, c):
        i = len(left)
        left.append(-1); right.append(-1); feat.append(-1); thr.append(0.0)
        val.append(float(rng.random())); cov.append(c)
        if d < depth and rng.random() < 0.85:
            feat[i] = int(rng.integers(m)); thr[i] = float(rng.random())
            share = float(rng.uniform(0.2, 0.8))
            left[i] = build(d + 1, c * share)
            right[i] = build(d + 1, c * (1 - share))
        return i

    build(0, 100.0)
    return {k: np.array(v) for k, v in dict(left=left, right=right, feat=feat, thr=thr,
                                            val=val, cov=cov).items()}


def cond_exp(t, x, s, node=0):
    if t["left"][node] < 0:
        return t["val"][node]
    f = t["feat"][node]
    lc, rc = t["left"][node], t["right"][node]
    if f in s:
        return cond_exp(t, x, s, lc if x[f] <= t["thr"][node] else rc)
    c = t["cov"][node]
    return (t["cov"][lc] * cond_exp(t, x, s, lc) + t["cov"][rc] * cond_exp(t, x, s, rc)) / c


def brute(t, x, m):
    phi = np.zeros(m)
    for i in range(m):
        others = [j for j in range(m) if j != i]
        for k in range(m):
            for s in itertools.combinations(others, k):
                w = math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
                phi[i] += w * (cond_exp(t, x, set(s) | {i}) - cond_exp(t, x, set(s)))
    return phi


@pytest.mark.parametrize("full", [10, 1])
def test_tree_shap_matches_brute_force(monkeypatch, full):
    monkeypatch.setattr(shap, "FULL_TABLE", full)
    rng = np.random.default_rng(7)
    m = 4
    for _ in range(5):
        trees = [random_tree(rng, m, 5) for _ in range(3)]
        X = rng.random((6, m))
        phi = forest_shap(X, trees)
        for r in range(X.shape[0]):
            ref = np.mean([brute(t, X[r], m) for t in trees], axis=0)
            assert np.allclose(phi[r], ref, atol=1e-9), (phi[r], ref)
        # additivity
        pred = forest_predict(X, trees)
        assert np.allclose(expected_value(trees) + phi.sum(axis=1), pred, atol=1e-9)


def test_deep_paths_and_lone_leaves():
    """More conditions than a full table holds; additivity is exact, a tree of one leaf explains nothing."""
    rng = np.random.default_rng(3)
    m = 14
    n = 2 * m + 1  # a chain: one leaf on the left of every node
    chain = dict(left=np.full(n, -1), right=np.full(n, -1), feat=np.zeros(n, int), thr=np.zeros(n),
                 val=rng.random(n), cov=np.ones(n))
    for i in range(m):
        chain["left"][2 * i], chain["right"][2 * i] = 2 * i + 1, 2 * i + 2
        chain["feat"][2 * i], chain["thr"][2 * i] = i, 0.3
    for i in range(m - 1, -1, -1):
        chain["cov"][2 * i] = chain["cov"][2 * i + 1] + chain["cov"][2 * i + 2]
    lone = dict(left=np.array([-1]), right=np.array([-1]), feat=np.array([0]), thr=np.zeros(1), val=np.array([0.4]),
                cov=np.ones(1))
    X = rng.random((200, m))
    phi = forest_shap(X, [chain, lone])
    assert np.allclose(expected_value([chain, lone]) + phi.sum(axis=1), forest_predict(X, [chain, lone]), atol=1e-12)
    assert not forest_shap(X, [lone]).any()


def test_subtrees_of_many_rows_are_looked_up_once():
    """The values of single leaves, from far fewer rows of tables (a path with repeated features included)."""
    r = np.random.default_rng(4)
    nodes = []

    def grow(depth):
        at = len(nodes)
        nodes.append(None)
        if depth == 7 or (depth > 3 and r.random() < 0.2):
            nodes[at] = (-1, -1, -1, 0.0, r.random(), float(r.integers(1, 50)))
        else:
            a, b = grow(depth + 1), grow(depth + 1)
            nodes[at] = (a, b, int(r.integers(0, 5)), r.normal(), 0.0, nodes[a][5] + nodes[b][5])
        return at
    grow(0)
    tree = {k: np.array(v) for k, v in zip(("left", "right", "feat", "thr", "val", "cov"), zip(*nodes, strict=True), strict=True)}
    x = r.normal(size=(30_000, 5))
    x[::7, 2] = np.nan  # meets no condition: goes right
    by_leaf = np.concatenate([shap.forest_shap(part, [tree]) for part in np.array_split(x, 2000)])
    assert np.allclose(shap.forest_shap(x, [tree]), by_leaf, atol=1e-12)


def test_batches_are_joined_until_they_have_enough_rows():
    parts = [pd.DataFrame({"a": range(i * 10, i * 10 + 10)}) for i in range(7)]
    got = list(shap.together(iter(parts), 25))
    assert [len(g) for g in got] == [30, 30, 10] and pd.concat(got)["a"].tolist() == list(range(70))

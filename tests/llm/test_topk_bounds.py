"""The bound of the top-k search: it drops most candidates on the given table and none that belongs to a result."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from conftest import SF_MID
from txrisk.llm import topk_search as S


def _brute(q_ids, q, c_ids, x, k):
    out = []
    for j, i in enumerate(q_ids):
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(q[:, j], x[:, c])), int(c_ids[c]))
                        for c in range(len(c_ids)) if c_ids[c] != i)
        out += [(int(i), c, -s) for s, c in scored[:k]]
    return out


@pytest.mark.parametrize("dims", [1, 15, 16, 17, 64])
def test_each_query_keeps_its_best(dims):
    rng = np.random.default_rng(dims)
    x = np.floor(rng.normal(size=(dims, 300)) * rng.uniform(0, 60, size=300))
    x[:, 50:60] = x[:, 40:41]  # ties
    x[:, 70] = 0
    ids = rng.permutation(1000)[:300].astype(np.int64)
    got = S.search_tile(ids[40:80], x[:, 40:80], ids, x, 5)
    assert got == _brute(ids[40:80], x[:, 40:80], ids, x, 5)
    for n in (1, 3, 6):
        assert S.search_tile(ids[:2], x[:, :2], ids[:n], x[:, :n], 5) == _brute(ids[:2], x[:, :2], ids[:n], x[:, :n], 5)


def test_sums_beyond_double(monkeypatch):
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(40, 120)) * 3e7)
    x[:, 7] = x[:, 3]
    x[5, 7] += 1
    ids = np.arange(120, dtype=np.int64)
    assert S.search_tile(ids[:20], x[:, :20], ids, x, 5) == _brute(ids[:20], x[:, :20], ids, x, 5)


def test_last_block_meets_few_candidates_of_the_given_table():
    t = pq.read_table(f"{SF_MID}/embeddings.parquet").to_pandas()
    t = t[t.embedding.notna()].sort_values("vec_id")
    x = np.ascontiguousarray(S.scaled(np.stack(t.embedding.to_numpy())).T)
    ids = t.vec_id.to_numpy().astype(np.int64)
    asked = ids % 50 == 0
    seen: list = []
    S.search_tile(ids[asked], x[:, asked], ids, x, 5, seen)
    met = np.array(seen).mean(axis=0)
    assert met[0] >= len(ids) - 1 and met[-1] < 0.1 * len(ids)

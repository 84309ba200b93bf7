"""The resumable log under interrupted and concurrent appends; the ROC merge on steep curves."""

import os

import numpy as np
import pytest

from txrisk.operators import metrics as M
from txrisk.sources import sinks

SCHEMA = "row_index long, note string"


def records(spark, ids):
    return spark.createDataFrame([(i, f"n{i}\n\"q\"" if i % 2 else None) for i in ids], SCHEMA)


def held(spark, path):
    return sorted((r["row_index"], r["note"]) for r in sinks.read_jsonl(spark, path, SCHEMA).collect())


def want(ids):
    return sorted((i, f"n{i}\n\"q\"" if i % 2 else None) for i in ids)


@pytest.mark.parametrize("step", ["records", "ids", "entry"])
def test_interrupted_append_loses_and_doubles_nothing(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "log")
    assert held(spark, path) == []
    sinks.sink_jsonl_resume(records(spark, range(20)), path)

    def stop(*a):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        from pyspark.sql.readwriter import DataFrameWriter
        if step == "records":  # half of the batch's files are there, nothing else
            plain = DataFrameWriter.json
            m.setattr(DataFrameWriter, "json", lambda self, p, *a, **k: (plain(self, p, *a, **k), stop()))
        elif step == "ids":
            m.setattr(DataFrameWriter, "parquet", stop)
        else:
            m.setattr(sinks, "_commit", stop)
        with pytest.raises(KeyboardInterrupt):
            sinks.sink_jsonl_resume(records(spark, range(10, 50)), path)
    assert held(spark, path) == want(range(20))  # the batch is not seen
    added = sinks.sink_jsonl_resume(records(spark, range(10, 50)), path)
    assert sorted(r["row_index"] for r in added.collect()) == list(range(20, 50))
    assert held(spark, path) == want(range(50))
    assert sorted(r[0] for r in sinks.logged_ids(spark, path, "row_index long").collect()) == list(range(50))
    assert len(os.listdir(f"{path}/batches")) == 3 and len(sinks.committed(spark, path)) == 2


def test_resume_reads_ids_alone(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.sink_jsonl_resume(records(spark, range(9)), path)
    first = sinks.committed(spark, path)[0]
    for f in os.listdir(f"{path}/batches/{first}/records"):
        if f.endswith(".json"):
            with open(f"{path}/batches/{first}/records/{f}", "w") as out:
                out.write("not json")
    for f in os.listdir(f"{path}/batches/{first}/records"):
        if f.endswith(".crc"):
            os.unlink(f"{path}/batches/{first}/records/{f}")
    added = sinks.sink_jsonl_resume(records(spark, range(12)), path)
    assert sorted(r["row_index"] for r in added.collect()) == [9, 10, 11]


def test_two_writers_from_one_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    plain = sinks._commit

    def overtaken(spark_, p, batch, number):
        monkeypatch.setattr(sinks, "_commit", plain)
        sinks.sink_jsonl_resume(records(spark, range(5, 15)), path)  # the other writer comes first
        plain(spark_, p, batch, number)

    monkeypatch.setattr(sinks, "_commit", overtaken)
    with pytest.raises(sinks.ConcurrentAppend):
        sinks.sink_jsonl_resume(records(spark, range(10)), path)
    assert held(spark, path) == want(range(5, 15))
    sinks.sink_jsonl_resume(records(spark, range(10)), path)
    assert held(spark, path) == want(range(15))


def test_claim_of_a_dead_writer(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    sinks.sink_jsonl_resume(records(spark, range(3)), path)
    assert not sinks.release_claim(spark, path)
    os.makedirs(f"{path}/_commits", exist_ok=True)
    open(f"{path}/_commits/0000000001.claim", "w").close()
    with pytest.raises(sinks.ConcurrentAppend):
        sinks.sink_jsonl_resume(records(spark, range(6)), path)
    assert sinks.release_claim(spark, path)
    sinks.sink_jsonl_resume(records(spark, range(6)), path)
    assert held(spark, path) == want(range(6))


def test_nothing_to_append(spark, tmp_path):
    path = str(tmp_path / "log")
    assert sinks.sink_jsonl_resume(records(spark, []), path).count() == 0
    assert sinks.sink_jsonl_resume(records(spark, [1]), path).count() == 1
    assert sinks.sink_jsonl_resume(records(spark, [1]), path).count() == 0
    assert held(spark, path) == want([1])


# ---------------------------------------------------------------- ROC merge
def curve(spark, x, y):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "fpr double, tpr double")


def steep(n, seed):
    """90 % of the points at fpr 0."""
    rng = np.random.default_rng(seed)
    x = np.sort(np.where(rng.random(n) < 0.9, 0.0, rng.random(n)))
    return x, np.sort(rng.random(n))


@pytest.mark.parametrize("n_ranges", [1, 3, 16])
def test_merge_equals_numpy(spark, n_ranges):
    (xa, ya), (xb, yb) = steep(700, 1), steep(500, 2)
    got = sorted((r["fpr"], r["tpr_b"], r["tpr_a_interp"]) for r in M.roc_interp_join(
        curve(spark, xa, ya), curve(spark, xb, yb), n_ranges).collect())
    assert len(got) == 500
    last = {x: y for x, y in zip(xa, ya)}  # the largest tpr of an fpr
    for x, _, v in got:
        exact = last[x] if x in last else np.interp(x, xa, ya)
        assert abs(v - exact) < 1e-12


def test_steep_curve_is_cut_evenly(spark, monkeypatch):
    seen = []
    plain = M.materialize
    monkeypatch.setattr(M, "materialize", lambda df, path: seen.append(plain(df, path)) or seen[-1])
    (xa, ya), (xb, yb) = steep(4000, 3), steep(4000, 4)
    M.roc_interp_join(curve(spark, xa, ya), curve(spark, xb, yb), 8)
    sizes = [r["count"] for r in seen[-1].groupBy("range").count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 2 * 8000 / 8


def test_ends_and_empty_curves(spark):
    a = curve(spark, [0.4, 0.6], [0.5, 0.7])
    b = curve(spark, [0.0, 0.4, 0.5, 1.0], [0.0, 0.1, 0.2, 1.0])
    got = {r["fpr"]: r["tpr_a_interp"] for r in M.roc_interp_join(a, b, 4).collect()}
    assert got[0.0] == 0.5 and got[0.4] == 0.5 and abs(got[0.5] - 0.6) < 1e-12 and got[1.0] == 0.7
    none = a.limit(0)
    assert [r["tpr_a_interp"] for r in M.roc_interp_join(none, b, 4).collect()] == [None] * 4
    assert M.roc_interp_join(a, none, 4).count() == 0

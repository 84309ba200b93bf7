"""Bounds of what a task holds and what is exchanged, names that clash, and the classifier against plain loops."""

import collections
import datetime
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_MID, SF_SMALL
from test_llm_operators import DOCS, awkward, near_by_brute_force, rows
from txrisk.llm import embed_dedup, minhash, quality, url_filter
from txrisk.llm.common import Scratch, bounded_batches, scratch_scope, table


# -- classifier -----------------------------------------------------------------------------------
def counts_by_loops(text):
    """Term counts of one text, byte by byte and word by word."""
    raw, out = (text or "").encode(), collections.Counter()
    for a, b in zip(raw, raw[1:], strict=False):
        out[int(quality.CLASSES[a]) * quality.KINDS + int(quality.CLASSES[b])] += 1
    words, now = [], b""
    for b in [*raw, 0x20]:
        if b == 0x20 or 9 <= b <= 13:
            if now:
                words.append(now)
            now = b""
        else:
            now += bytes([b])
    shapes = [0] * quality.SHAPES
    for i, w in enumerate(words):
        shapes[0] += i >= 1 and words[i - 1] == w
        shapes[1] += i >= 2 and words[i - 2] == w
        shapes[2] += len(w) > 24
        shapes[3] += sum(65 <= b <= 90 for b in w) > 1
    for i, n in enumerate(shapes):
        out[quality.KINDS ** 2 + i] = quality.SHAPE_WEIGHT * n
    return {t: n for t, n in out.items() if n}


def unit(x):
    norm = math.sqrt(sum(v * v for v in x))
    return [v / norm if norm else 0.0 for v in x]


def test_scores_by_plain_loops(spark):
    """Counts, document frequencies, latent vectors, all cosines and the votes, without the operator's arrays."""
    docs, labels = table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "labels")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    text = dict(rows(docs.select("doc_id", "text")))
    learnt = {}
    for i, y in rows(labels.filter(~quality.is_held_out(F.col("doc_id"))).select("doc_id", "quality")):
        if y in (0, 1) and i in text:
            learnt[i] = min(y, learnt.get(i, 1))
    counts = {i: counts_by_loops(t) for i, t in text.items()}
    frequency = collections.Counter(t for i in learnt for t in counts[i])
    axes = model.axes.astype(float).tolist()

    def latent(c):
        # the length of the weighted vector does not matter: it is projected, then made a unit
        weighted = {t: math.sqrt(n) * (math.log((1 + len(learnt)) / (1 + frequency[t])) + 0.2) for t, n in c.items()}
        return unit([sum(w * axes[t][a] for t, w in weighted.items()) for a in range(len(axes[0]))])

    voters = [(latent(counts[i]), y) for i, y in learnt.items()]
    assert len(voters) == len(model.vectors) > 2 * quality.NEIGHBOURS
    compared = 0
    for i, c in counts.items():
        x = latent(c)
        cosine = sorted(((sum(a * b for a, b in zip(x, v, strict=True)), y) for v, y in voters), reverse=True)
        near = [(max(s, 0.0), y) for s, y in cosine[: quality.NEIGHBOURS]]
        if cosine[quality.NEIGHBOURS - 1][0] - cosine[quality.NEIGHBOURS][0] < 1e-6:
            continue  # a tie for the last vote
        mass = sum(s for s, _ in near)
        want = sum(s * y for s, y in near) / mass if mass > 0 else 0.5
        assert got[i] == pytest.approx(want, abs=1e-4)
        compared += 1
    assert compared > 0.8 * len(counts)


def test_score_column_must_be_new(spark, docs):
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    with pytest.raises(ValueError):
        quality.score_documents(docs.withColumn("SCORE", F.lit(1)), model)


# -- embeddings -----------------------------------------------------------------------------------
def test_only_open_pairs_meet_with_their_components(spark, tmp_path):
    df = table(spark, SF_MID, "embeddings").select(
        "vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    data = [(r.vec_id, r.label, np.array(r.embedding)) for r in df.collect()]
    # copies with noise, cosines from about 0.8 to 1; magnitudes whose squares overflow or vanish
    r = np.random.default_rng(8)
    near = [(10 ** 6 + i, y, v + 0.7 * r.random() * np.linalg.norm(v) * r.normal(size=len(v)) / math.sqrt(len(v)))
            for i, y, v in data[:200]]
    scales = np.where(np.arange(200) % 2, 1e200, 1e-200)
    more = spark.createDataFrame([(i, y, (v * s).tolist()) for (i, y, v), s in zip(near, scales, strict=True)],
                                 "vec_id long, label int, embedding array<double>")
    data += near
    scratch = Scratch(spark, "test")
    pieces = embed_dedup.embedding_links(df.unionByName(more), scratch).toPandas()
    ids, vectors = np.array([d[0] for d in data]), np.stack([d[2] for d in data])
    of = np.array([np.nan if d[1] is None else d[1] for d in data], float)
    u = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    linked = (u @ u.T >= 0.93) & (of[:, None] == of[None, :])
    np.fill_diagonal(linked, False)
    assert linked.sum() > 100
    got = pieces.groupby("vec_id").n_links.sum().to_dict()
    assert got == {i: n for i, n in zip(ids.tolist(), linked.sum(axis=1).tolist(), strict=True) if n}
    made = {name.split("-")[0]: name for name in os.listdir(scratch.root.removeprefix("file:"))}
    first = spark.read.parquet(f"{scratch.root}/{made['bounded']}")
    assert 0 < first.filter("NOT open").count()
    assert first.filter("open").count() < len(data) / 2


def test_what_the_first_exchange_holds():
    pack, schema = embed_dedup._pack(False)
    assert "data" not in schema and "quantised" in schema


def test_bound_decides_as_the_exact_product():
    r = np.random.default_rng(4)
    base = r.normal(size=(8, 24))
    x = np.repeat(base, 30, axis=0) + 0.25 * r.normal(size=(240, 24))
    tile = embed_dedup.tile_of(np.arange(240), x)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    cosine = u @ u.T
    seen = set()
    for i, j, sure in embed_dedup.bounded_pairs(tile, tile, 0.93, True):
        assert (cosine[i[sure], j[sure]] >= 0.93).all()
        seen |= set(zip(i.tolist(), j.tolist(), strict=True))
    assert {(i, j) for i, j in zip(*np.nonzero(cosine >= 0.93), strict=True) if i < j} <= seen


# -- near duplicates ------------------------------------------------------------------------------
def test_groups_are_cut_by_shingles_too(spark, monkeypatch):
    """Few members of many shingles are several blocks; the groups stay the same."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 600)
    import random
    from test_llm_operators import WORDS, prose
    r = random.Random(3)
    base = prose(21, 150).split()
    texts = []
    for _ in range(40):
        w = list(base)
        for _ in range(r.randrange(0, 10)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        texts.append(" ".join(w))
    _, want = near_by_brute_force(list(range(40)), texts, 3, 85)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(rows(minhash.near_duplicates(df, rule=minhash.Similar(3, 85)).select("doc_id", "component_id")))
    assert [got[i] for i in range(40)] == want


# -- lists ----------------------------------------------------------------------------------------
def test_rules_enter_only_months_with_captures(spark):
    day = datetime.date
    df = spark.createDataFrame([(1, "http://a.com/x", day(1, 1, 1)), (2, "http://a.com/x", day(2023, 5, 31)),
                                (3, "http://a.com/x", day(9999, 12, 31)), (4, "http://a.com/x", None)],
                               "page_id long, url string, fetched date")
    log = spark.createDataFrame([("h:a.com", "spam", day(1, 1, 1), "add"), ("h:a.com", "old", day(2023, 5, 31), "remove"),
                                 ("h:a.com", "old", day(2023, 5, 30), "add")],
                                "key string, category string, at date, action string")
    got = url_filter.apply_lists(df, log)
    assert dict(rows(got.select("page_id", "blocked")))[2] is True
    assert dict(rows(got.select("page_id", "category")))[1] == "spam"
    assert dict(rows(got.select("page_id", "category")))[2] == "spam"
    assert dict(rows(got.select("page_id", "blocked")))[4] is False


# -- settings and folders -------------------------------------------------------------------------
def test_batches_are_bounded_by_bytes(spark):
    keys = [f"spark.sql.execution.arrow.max{k}PerBatch" for k in ("Records", "Bytes")]
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.unset(k)
        bounded_batches(spark)
        assert [spark.conf.get(k) for k in keys] == ["1000", "8m"]
        spark.conf.set(keys[0], "10")
        spark.conf.set(keys[1], "1m")
        bounded_batches(spark)
        assert [spark.conf.get(k) for k in keys] == ["10", "1m"]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_scope_deletes_what_was_made_inside_it(spark):
    outer = Scratch(spark, "outer")
    with scratch_scope(spark):
        inner = Scratch(spark, "inner")
        kept = outer.keep(inner.keep(spark.range(5), "a").filter("id > 1"), "b")
        assert os.path.exists(inner.root.removeprefix("file:"))
    assert not os.path.exists(inner.root.removeprefix("file:"))
    assert sorted(r.id for r in kept.collect()) == [2, 3, 4]


# -- pipeline -------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(3).cache()


def test_every_stage_with_clashing_columns(spark, docs):
    """Columns named like those that the stages add; all stages, the quality stage on awkward rows too."""
    names = ["score", "_col_1", "n_removed", "n_bytes", "kept_text", "_copies", "_copy", "_id", "kept", "a.b"]
    wide = docs
    for n in names:
        wide = wide.withColumn(n, F.lit("own"))
    scratch = Scratch(spark, "test")
    good = corpus_pipeline.keep_quality(spark, wide, SF_SMALL)
    assert good.columns == wide.columns
    assert {r.text for r in good.select("text").distinct().collect()} <= {t for _, t, *_ in awkward() if t}
    for df in (wide, wide.limit(0)):
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            df = scratch.keep(stage(spark, df, SF_SMALL), "s")
            assert df.columns == wide.columns
            assert df.filter(" OR ".join(f"`{n}` <> 'own'" for n in names)).count() == 0
        out = corpus_pipeline.tokenise(spark, df, SF_SMALL)
        assert out.count() == df.count()

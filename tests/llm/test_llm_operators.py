"""The training-data operators against brute force, on given tables and on awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from conftest import SF_SMALL
from oracle_compare import compare, duck
from txrisk.llm import (chat_format, embed_dedup, minhash, mixing, quality, sentencepiece_codec, sharding,
                        suffix_dedup, topk_search, url_filter)
from txrisk.llm.components import connected_components
from txrisk.llm.common import Scratch
from txrisk.llm.queries import QUERIES, SQL

WORDS = "alpha beta gamma delta omega sigma kappa theta zeta iota lambda mu nu xi pi rho tau phi chi psi".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, size long, key long"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def awkward():
    long = prose(1, 4000)
    near = long.split()
    near[100] = "changed"
    passage = prose(2, 60)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One two"), (5, "one TWO"), (6, long), (7, " ".join(near)),
            (8, long), (9, prose(3, 50) + " " + passage + " " + prose(4, 50)), (10, prose(5, 20) + " " + passage),
            (11, "x" * 450), (12, "é😀漢" * 60), (13, passage + "\n" + passage), (13, passage + "\n" + passage),
            (None, "one two three four five six"), (None, None), (14, "a\x00b\x00" * 50), (15, prose(3, 50))]
    return [(i, t, None if i == 3 else "en", None if i in (4, 9) else f"s{(i or 0) % 3}", len(t or ""), 1, 2, 3)
            for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet").toPandas().sort_values("doc_id")


def rows(df):
    return [tuple(r) for r in df.collect()]


# -- components, near-duplicates ------------------------------------------------------------------
def groups_of(n, links):
    top = list(range(n))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x
    for a, b in links:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components_of_paths_and_stars(spark):
    r = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + \
            [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    want = groups_of(300, links)
    df = connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"))
    got = dict(rows(df))
    assert all(got.get(i, i) == want[i] for i in range(300))


def shingles(text, width):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return set()
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))}


def near_by_brute_force(ids, texts, width, num):
    sets = [shingles(t, width) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    return sets, [ids[g] for g in groups_of(len(sets), links)]


@pytest.mark.parametrize("width,num", [(3, 85), (5, 80)])
def test_minhash_on_given_documents(spark, given, width, num):
    sets, want = near_by_brute_force(given.doc_id.tolist(), given.text.tolist(), width, num)
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = {r.doc_id: r for r in minhash.near_duplicates(df, rule=minhash.Similar(width, num)).collect()}
    assert len(got) == len(given)
    for i, s, c in zip(given.doc_id, sets, want, strict=True):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), c, i == c)


def test_minhash_near_copy_group_and_blocks(spark, monkeypatch):
    """A chained group of near copies, many around the threshold, over several blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    r = random.Random(9)
    base = prose(11, 120).split()
    texts = []
    for _ in range(90):
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        texts.append(" ".join(w))
    _, want = near_by_brute_force(list(range(90)), texts, 3, 85)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(rows(minhash.near_duplicates(df, rule=minhash.Similar(3, 85)).select("doc_id", "component_id")))
    assert [got[i] for i in range(90)] == want


def test_minhash_on_awkward_rows(docs, empty):
    got = rows(minhash.near_duplicates(docs, rule=minhash.Similar(3, 85)).select("doc_id", "component_id", "kept"))
    assert len(got) == docs.count()
    by = dict((i, (c, k)) for i, c, k in got if i is not None)
    assert by[7] == (6, False) and by[8] == (6, False) and by[5] == (4, False)
    assert by[0] == (0, True) and by[1] == (1, True) and by[2] == (2, True)
    assert [(c, k) for i, c, k in got if i is None] == [(None, True)] * 2
    assert rows(minhash.near_duplicates(empty)) == []


@pytest.mark.parametrize("n", range(8))
def test_minhash_of_a_few_words_alone(spark, n):
    text = " ".join(WORDS[:n])
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").coalesce(1)
    got = rows(minhash.near_duplicates(df).orderBy("doc_id"))
    assert got == [(1, len(shingles(text, 5)), 1, True), (2, 0, 2, True)]


def test_hyperminhash_estimate_is_close():
    r = np.random.default_rng(3)
    pool = r.permutation(np.unique(r.integers(0, 1 << 63, 4000).astype(np.uint64) * np.uint64(2)))
    a, b = np.sort(pool[:3000]), np.sort(pool[500:3500])
    regs = [minhash.registers(x)[None] for x in (a, b)]
    est, used = minhash.estimate(*regs, np.array([3000]), np.array([3000]))
    assert used[0] == minhash.BUCKETS and abs(est[0] - 2500 / 3500) < 0.15


# -- suffix dedup ---------------------------------------------------------------------------------
def cut_by_brute_force(pairs, length=100):
    seen, out = {}, {}
    for doc, text in sorted(pairs, key=lambda p: p[0]):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen.setdefault(b[s:s + length], (doc, s)) != (doc, s):
                gone[s:s + length] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[doc] = (len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("hot,run", [(4096, 50_000), (2, 200)])
def test_suffix_dedup_on_given_documents(spark, given, monkeypatch, hot, run):
    monkeypatch.setattr(suffix_dedup, "LEAST_HOT", hot)
    monkeypatch.setattr(suffix_dedup, "RUN_RECORDS", run)
    want = cut_by_brute_force(zip(given.doc_id, given.text, strict=True))
    got = suffix_dedup.op3_suffix_merge(spark, SF_SMALL).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert sum(r.n_removed for r in got) > 0


def test_suffix_dedup_on_awkward_rows(docs, empty):
    want = cut_by_brute_force([(r[0], r[1]) for r in awkward() if r[0] is not None])
    got = suffix_dedup.cut_repeats(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
        else:
            assert r.n_removed == 0 and r.kept_text == (r.text or "")
    assert rows(suffix_dedup.cut_repeats(empty)) == []


def test_anchor_segments_of_long_documents(monkeypatch, spark):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 300)
    monkeypatch.setattr(suffix_dedup, "SCAN_BYTES", 200)
    text = prose(21, 300)
    pairs = [(1, text), (2, prose(22, 100) + text[500:900] + prose(23, 100)), (3, text[100:700])]
    got = suffix_dedup.cut_repeats(spark.createDataFrame(pairs, "doc_id long, text string")).collect()
    want = cut_by_brute_force(pairs)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_loser_tree_merges_with_common_prefixes():
    r = random.Random(4)
    runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randrange(0, 9))) for _ in range(r.randrange(0, 40)))
            for _ in range(7)]
    order, shared = suffix_dedup.merge_runs(runs, [suffix_dedup.common_prefixes(x, 9).tolist() for x in runs])
    merged = [runs[a][b] for a, b in order]
    assert merged == sorted(x for run in runs for x in run)
    assert shared == suffix_dedup.common_prefixes(merged, 9).tolist()


# -- sharding, mixing -----------------------------------------------------------------------------
def jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2 ** 64
        j = (b + 1) * 2 ** 31 // ((key >> 33) + 1)
    return b


def test_jump_sharding(spark, given):
    got = sharding.op4_jump_sharding(spark, SF_SMALL).collect()
    text = dict(zip(given.doc_id, given.text, strict=True))
    assert len(got) == len(text)
    slots = collections.defaultdict(list)
    for r in got:
        b = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(b) + 1, zlib.crc32(b), "key")
        assert (r.shard, r.grown_shard) == (jump(r.doc_id, 8), jump(r.doc_id, 9)) and r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_jump_shard_of_any_key(spark):
    keys = [0, 1, -1, 2 ** 63 - 1, -2 ** 63, 123456789012345]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 1000):
        got = dict(rows(df.select("k", sharding.jump_shard(F.col("k"), n))))
        assert all(got[k] == jump(k % 2 ** 64, n) for k in keys)


def test_sharding_on_awkward_rows(docs, empty):
    got = sharding.assign_shards(docs, 8).collect()
    assert len(got) == docs.count()
    assert {r.size for r in got if r.doc_id == 0} == {1} and [r.text_crc32 for r in got if r.doc_id == 0] == [None]
    assert rows(sharding.assign_shards(empty, 8)) == []


def test_sainte_lague_gives_the_highest_quotients():
    r = np.random.default_rng(8)
    for _ in range(30):
        w, cap = r.integers(0, 50, 9).astype(float), r.integers(0, 30, 9)
        seats = int(r.integers(0, 60))
        want = np.zeros(9, int)
        for _ in range(seats):
            q = np.where((want < cap) & (w > 0), w / (2 * want + 1), -1)
            if q.max() <= 0:
                break
            want[int(q.argmax())] += 1
        got = mixing.sainte_lague(w, cap, seats)
        assert got.sum() == want.sum() and (got <= cap).all()
        last = [w[i] / (2 * got[i] - 1) for i in range(9) if got[i]]
        free = [w[i] / (2 * got[i] + 1) for i in range(9) if w[i] and got[i] < cap[i]]
        assert not last or not free or min(last) >= max(free) - 1e-9


def check_mix(got, texts, sources):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts.items()}
    names = sorted({s for s in sources.values() if s is not None}) + [None] * (None in sources.values())
    total = {n: sum(size[i] for i in size if sources[i] == n) for n in names}
    weight = {n: (1, 2, 3)[k % 3] for k, n in enumerate(names)}
    target, free, left = {}, set(names), float(sum(size.values()))
    while True:
        share = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        over = [n for n in free if share[n] > 3 * total[n]]
        if not over:
            target |= share
            break
        for n in over:
            target[n] = 3.0 * total[n]
            left -= target[n]
            free.discard(n)
    taken = collections.Counter()
    for r in got:
        n = sources[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == total[n] and abs(r.target - target[n]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[n] += r.taken
    assert all(abs(taken[n] - target[n]) <= 2 * mixing.BLOCK_WORDS for n in names)


def test_mixing(spark, given):
    got = mixing.op10_sainte_lague(spark, SF_SMALL).collect()
    check_mix(got, dict(zip(given.doc_id, given.text, strict=True)), dict(zip(given.doc_id, given.source, strict=True)))
    again = mixing.op10_sainte_lague(spark, SF_SMALL).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mixing_on_awkward_rows(docs, empty):
    unique = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = mixing.mix(unique).collect()
    own = {r[0]: r for r in awkward() if r[0] is not None}
    check_mix(got, {i: r[1] for i, r in own.items()}, {i: r[3] for i, r in own.items()})
    assert len(mixing.mix(docs).collect()) == docs.count()
    assert rows(mixing.mix(empty)) == []
    assert [r.taken for r in mixing.mix(docs.filter("doc_id < 3")).collect()] == [0, 0, 0]


def test_pipeline_mix_meets_its_targets_at_any_number_of_partitions(spark):
    docs = spark.read.parquet(f"{SF_SMALL.replace('0.001', '0.01')}/documents.parquet")
    size = mixing.word_count(F.col("text"))
    aims = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id")
    aims = {r.source: r for r in aims.groupBy("source").agg(F.max("target").alias("target"), F.max("size").alias("most"))
            .collect()}
    was, got = spark.conf.get("spark.sql.shuffle.partitions"), {}
    try:
        for n in (8, 200):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            mixed = corpus_pipeline.mix_sources(spark, docs, "").select("doc_id", "source", size.alias("size")).collect()
            words = collections.Counter()
            for r in mixed:
                words[r.source] += r.size
            for s, aim in aims.items():
                assert abs(words[s] - aim.target) <= aim.most / 2 + 2 * mixing.BLOCK_WORDS, (n, s)
            got[n] = collections.Counter(r.doc_id for r in mixed)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got[8] == got[200]


# -- vectors --------------------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<double>, label int, score double"


def vectors():
    r = np.random.default_rng(6)
    base = r.normal(size=(5, 20))
    out = [(i, (base[i % 5] + 0.1 * r.normal(size=20)).tolist(), None if i % 11 == 0 else i % 2) for i in range(150)]
    out += [(150, None, 0), (151, [float("nan")] * 20, 0), (152, [None] * 20, 1), (153, [0.0] * 20, 1), (154, [], 1),
            (155, [1.0, 2.0], 1), (156, out[7][1], out[7][2]), (157, out[7][1], out[7][2]), (None, out[7][1], 1),
            (158, [float("inf")] + [0.0] * 19, 0), (200, [1e9] * 20, 1)]
    return [(i, v, y, 0.5) for i, v, y in out]


def test_top_k(spark):
    data = vectors()
    df = spark.createDataFrame(data, VECTORS)
    good = {i: [int(np.floor(256 * x)) for x in v] for i, v, _, _ in data
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in good:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(good[q], good[c], strict=True)), c) for c in good
                          if c != q and len(good[c]) == len(good[q]))[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    got = rows(topk_search.top_k(df, F.col("vec_id") % 50 == 0))
    assert sorted(got) == sorted(want)
    assert rows(topk_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0)) == []


def test_embedding_dedup(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "TILE_ROWS", 32)
    data = vectors()
    df = spark.createDataFrame(data, VECTORS)
    good = [(i, np.array(v), y) for i, v, y, _ in data if i is not None and y is not None and v
            and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(a[0], b[0]) for k, a in enumerate(good) for b in good[:k] if a[2] == b[2] and len(a[1]) == len(b[1])
             and a[1] @ b[1] / (np.sqrt(a[1] @ a[1]) * np.sqrt(b[1] @ b[1])) >= 0.93]
    group, count = groups_of(201, links), collections.Counter(x for p in links for x in p)
    got = embed_dedup.embedding_components(df).collect()
    assert len(got) == len(data) and len(links) > 100
    for r in got:
        if r.vec_id is not None:
            assert (r.n_links, r.component_id, r.kept) == (count[r.vec_id], group[r.vec_id], group[r.vec_id] == r.vec_id)
    assert rows(embed_dedup.embedding_components(df.limit(0))) == []


def test_quantisation_bound_holds():
    x = np.random.default_rng(2).normal(size=(60, 30))
    q, s, e = embed_dedup.quantise(x)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None, :]
    assert (np.abs(near - u @ u.T) <= e[:, None] + e[None, :] + e[:, None] * e[None, :] + 1e-12).all()


# -- classifier, tokenizer, chat, lists -----------------------------------------------------------
def test_quality_on_held_out_labels(spark):
    sf = SF_SMALL.replace("0.001", "0.01")
    got = quality.op6_neighbour_voting(spark, sf).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    both = got[got.held_out].merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    rank, good = both.score.rank(), both.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.97


def test_quality_on_awkward_rows(spark, docs, empty):
    labels = spark.createDataFrame([(6, 1, 0), (9, 1, 0), (11, 0, 0), (14, 0, None), (3, None, 0), (None, 1, 0), (6, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (0, 1)} == {0.5}
    assert rows(quality.classify(empty, labels)) == []
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())


def test_encoding_of_random_texts(library):
    codec = sentencepiece_codec.Codec(sentencepiece_codec.read_vocabulary(sentencepiece_codec.default_model()))
    r = random.Random(12)
    letters = " ▁ab\nthe<s>é😀\x00\t0x0AＡ漢字梦"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(30))) for _ in range(3000)]
    texts += [" " * 500, "a" * 2000, "▁" * 37 + "x", "the " * 300, "\n\n \n"]
    for t in texts:
        ids = library.encode(t)
        found, joined, back = codec.run(t)
        assert (joined, back) == (",".join(map(str, ids)), library.decode(ids)), repr(t)
        assert [int(x) for x in found] == ids


def test_encoding_of_documents(spark, docs, empty, given, library):
    got = {r.doc_id: r for r in sentencepiece_codec.op7_sentencepiece(spark, SF_SMALL).collect()}
    for i, t in zip(given.doc_id, given.text, strict=True):
        ids = library.encode(t)
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want
    full = sentencepiece_codec.encode_decode(docs, sentencepiece_codec.default_model(), outputs=("ids", "decoded"))
    text = {r[0]: r[1] for r in awkward()}
    for r in full.collect():
        if r.doc_id is not None:
            assert r.ids == library.encode(text[r.doc_id] or "") and r.decoded == library.decode(r.ids)
    assert rows(sentencepiece_codec.encode_decode(empty, sentencepiece_codec.default_model())) == []


def test_chat_examples(spark):
    said = "a <|im_end|> b \\ <|im_sep|> </s>[INST] <\\s> \n"
    data = [(1, 0, "system", said, 0), (1, 1, "user", None, 0), (1, 2, "assistant", said, 0), (1, 3, "user", "x", 0),
            (1, 4, "assistant", "", 0), (1, 5, "user", "tail", 0), (2, 0, "user", "only", 0), (2, 0, "user", "only", 0),
            (3, None, None, "z", 0), (None, 1, "assistant", "n", 0)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, example long")
    examples = chat_format.expand_prefix_targets(df)
    got = sorted(((r.conv_id or 0), r.example, r.is_last, r.formatted[r.loss_start:r.loss_start + r.loss_len])
                 for r in examples.collect())
    drop = re.compile(r"\\(.)", re.S)
    assert [(c, e, last, drop.sub(r"\1", x)) for c, e, last, x in got] == [
        (0, 1, True, "n"), (1, 3, False, said), (1, 5, False, ""), (1, 6, True, ""), (2, 2, True, ""), (3, 1, True, "")]
    per = {r.conv_id: r for r in chat_format.digest(examples).collect()}
    turns = "".join(f"{r}\n{t or ''}\n" for c, _, r, t, _ in data if c == 1)
    assert per[1].n_turns == 6 and per[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert per[1].loss_chars == len(said) and per[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert rows(chat_format.expand_prefix_targets(df.limit(0))) == []


def test_url_lists(spark):
    day = lambda d: f"2024-01-{d:02d}"
    log = spark.createDataFrame(
        [("host", "Bad.com", "spam", day(5), "add"), ("host", "Bad.com", "spam", day(10), "remove"),
         ("host", "Bad.com", "worse", day(20), "add"), ("path", "ok.org/x/y", "part", day(1), "add"),
         ("url", "http://ok.org/x/y/z", "one", day(1), "add"), ("host", None, "no", day(1), "add"),
         ("host", "ok.org", "no", None, "add"), ("host", "ok.org", "gone", day(2), "remove")],
        "kind string, value string, category string, d string, action string")
    log = log.select(url_filter.rule_key(F.col("kind"), F.col("value")).alias("key"), "category",
                     F.col("d").cast("date").alias("at"), "action")
    seen = [(1, "http://a.bad.com:80/p", day(4)), (2, "http://a.bad.com/p", day(5)), (3, "http://bad.com", day(10)),
            (4, "http://u@BAD.com/?q", day(31)), (5, "http://ok.org/x/yy", day(3)), (6, "http://ok.org/x/y/w", day(3)),
            (7, "http://ok.org/x/y/z", day(3)), (8, None, day(3)), (9, "not a url", day(3)), (10, "http://bad.com", None),
            (2, "http://a.bad.com/p", day(5)), (11, "http://notbad.com", day(6))]
    df = spark.createDataFrame(seen, "page_id long, url string, f string").withColumn("fetched", F.col("f").cast("date"))
    got = url_filter.apply_lists(df, log).select("page_id", "category").collect()
    assert len(got) == len(seen)
    assert {r.page_id: r.category for r in got if r.category} == {2: "spam", 4: "worse", 6: "part", 7: "one"}
    assert rows(url_filter.apply_lists(df.limit(0), log)) == []


def test_url_rule_listed_by_two_categories(spark):
    log = spark.sql("""SELECT 'h:bad.com' AS key, category, CAST(concat('2024-01-', d) AS DATE) AS at, action FROM VALUES
        ('spam', '01', 'add'), ('malware', '02', 'add'), ('spam', '03', 'remove'), ('malware', '06', 'remove'),
        ('adult', '08', 'add'), ('phish', '08', 'add'), ('adult', '09', 'remove') AS t(category, d, action)""")
    seen = spark.sql("""SELECT id AS page_id, 'http://bad.com/' AS url, date_add(DATE '2024-01-01', CAST(id - 1 AS INT))
        AS fetched FROM range(1, 11)""")
    got = dict(rows(url_filter.apply_lists(seen, log).select("page_id", "category")))
    assert got == {1: "spam", 2: "malware", 3: "malware", 4: "malware", 5: "malware", 6: None, 7: None, 8: "adult",
                   9: "phish", 10: "phish"}


@pytest.mark.parametrize("key", sorted(SQL))
def test_sql_twins(spark, key):
    problems, _, _ = compare(spark, duck(SF_SMALL), key, QUERIES[key], SQL[key], SF_SMALL)
    assert not problems, problems


# -- pipeline -------------------------------------------------------------------------------------
def test_pipeline_stages(spark, given, library):
    """Each stage against its operator's brute force, on its own input."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    scratch, outs = Scratch(spark, "test"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, SF_SMALL), "s")
        outs.append(docs.toPandas())
    good, near, cut, mixed, tokens = outs
    for out in outs[:-1]:
        assert list(out.columns) == list(given.columns)
    assert 0.5 < len(good) / len(given) < 1
    good = good.sort_values("doc_id")
    _, groups = near_by_brute_force(good.doc_id.tolist(), good.text.tolist(), 5, 80)
    assert sorted(near.doc_id) == sorted(set(groups))
    want = cut_by_brute_force(zip(near.doc_id, near.text, strict=True))
    was = dict(zip(near.doc_id, near.text, strict=True))
    for i, t, n in zip(cut.doc_id, cut.text, cut.n_chars, strict=True):
        assert want[i][1] == 0 and t == was[i] or n == len(t) and len(t.encode()) <= want[i][0] - want[i][1]
    assert all(want[i][1] == want[i][0] for i in set(near.doc_id) - set(cut.doc_id))
    copies = collections.Counter(mixed.doc_id)
    assert set(copies) <= set(cut.doc_id) and max(copies.values()) <= 3
    text = dict(zip(mixed.doc_id, mixed.text, strict=True))
    assert len(tokens) == len(mixed)
    assert all(list(ids) == library.encode(text[i]) for i, ids in zip(tokens.doc_id, tokens.ids, strict=True))


def test_pipeline_on_awkward_rows(spark, docs, empty, tmp_path):
    for df in (docs, empty):
        for _, stage in corpus_pipeline.STAGES[1:]:
            df = stage(spark, df, SF_SMALL).cache()
            df.count()
    assert isinstance(df.schema, T.StructType)

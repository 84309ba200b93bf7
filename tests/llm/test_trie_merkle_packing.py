"""Prefix trie, Merkle manifest and packing against brute force, on given tables and on awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF_SMALL
from oracle_compare import compare, duck
from txrisk.llm import merkle, packing, prefix_trie
from txrisk.llm.common import Scratch, arrow_batches, number_rows
from txrisk.llm.queries import QUERIES, SQL


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("key", ["op11_prefix_trie", "op12_merkle_windows"])
def test_sql_twins(spark, key):
    problems, n, _ = compare(spark, duck(SF_SMALL), key, QUERIES[key], SQL[key], SF_SMALL)
    assert problems == [] and n > 0


def test_sql_crc32():
    for n in (0, 7, 10, 12345, 2**40):
        assert duck(SF_SMALL).execute(f"SELECT {merkle.sql_crc32('t')} FROM (SELECT '{n}' AS t)").fetchone()[0] == \
            zlib.crc32(str(n).encode())


def test_numbers_are_gapless_in_groups_of_any_size(spark):
    r = random.Random(2)
    data = [(None if i % 7 == 0 else r.choice("aab"), r.randrange(50)) for i in range(700)]
    df = spark.createDataFrame(data, "g string, v int").repartition(5)
    got = rows(number_rows(df, Scratch(spark, "t"), ["g"], [F.col("v")]))
    for g in (None, "a", "b"):
        mine = sorted((p, v) for x, v, p, _ in got if x == g)
        assert [p for p, _ in mine] == list(range(len(mine)))
        assert [v for _, v in mine] == sorted(v for x, v in data if x == g)
        assert {t for x, _, _, t in got if x == g} == {len(mine)}


def test_arrow_limits_are_restored(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), arrow_batches(spark, rows=3):
        assert spark.conf.get(key) == "3"
        raise ZeroDivisionError
    assert spark.conf.get(key) == before


# -- prefix trie ----------------------------------------------------------------------------------
def trie(sequences):
    """Rows of the trie of {conv: [(role, text)]}."""
    members = collections.defaultdict(list)
    for c in sorted(sequences):
        for d in range(len(sequences[c]) + 1):
            members[tuple(sequences[c][:d])].append(c)
    kids = collections.Counter(s[:-1] for s in members if s)
    saved, leaves = collections.Counter(), collections.Counter()
    for s, m in members.items():
        own = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        for d in range(len(s) + 1):
            saved[s[:d]] += own
            leaves[s[:d]] += kids[s] == 0
    ends = {s: ",".join(str(c) for c in m if len(sequences[c]) == len(s)) for s, m in members.items()}
    return sorted((m[0], len(s), members[s[:-1]][0] if s else None, len(m), kids[s], leaves[s], saved[s],
                   hashlib.sha256(ends[s].encode()).hexdigest()) for s, m in members.items())


def rebuilt(turns):
    own = collections.defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            item = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((t is not None, t or 0, item, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[:h[c]] + v[h[c]:] for c, v in own.items()}


def by_operator(spark, turns):
    scratch = Scratch(spark, "t")
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, n int, block int, name string")
    return sorted(rows(prefix_trie.prefix_trie(*prefix_trie.share_heads(prefix_trie.order_turns(df, scratch), scratch),
                                               scratch)))


def test_trie_of_given_conversations(spark):
    given = rows(spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    assert sorted(rows(QUERIES["op11_prefix_trie"](spark, SF_SMALL))) == trie(rebuilt(given))


def test_trie_of_awkward_turns(spark):
    long = "word " * 20000
    turns = [(20, 0, "user", "a b"), (20, 0, "user", "a b"), (20, None, None, None), (21, 1, None, ""), (22, None, None, None),
             (23, 5, "user", long), (23, 6, "user", long), (24, 0, "user", "a b"), (39, 2, "assistant", "é\x00😀"),
             (45, 1, "user", "no first of its family"), (46, 1, "user", "x"), (None, 1, "user", "nobody"), (None, None, None, None)]
    got = by_operator(spark, [(*t, 1, 2, "extra") for t in turns])
    assert got == trie(rebuilt(turns))
    assert by_operator(spark, []) == []


@pytest.mark.parametrize("levels,stretch", [(2, 3), (6, 4096)])
def test_trie_over_many_blocks(spark, monkeypatch, levels, stretch):
    """Long conversations, groups of equal ones and turnless ones, over several recursions."""
    monkeypatch.setattr(prefix_trie, "LEVELS", levels)
    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    r = random.Random(levels)
    base = [("u", "a b"), ("a", "x")] * 100
    sequences = {}
    for c in range(50):
        s = base[:r.choice([0, 1, 3, 4, 5, 8, 16, 17, 30, 64, 65, 70, 130])]
        if s and r.random() < 0.6:
            k = r.randrange(len(s))
            s = s[:k] + [(r.choice("ua"), r.choice(["q w e", "z", ""])) for _ in range(len(s) - k)]
        sequences[c * 7] = s
    turns = [(c, i + 1, len(s), hashlib.sha256(repr(x).encode()).digest(), len(x[1].split()))
             for c, s in sequences.items() for i, x in enumerate(s)]
    got = prefix_trie.prefix_trie(
        spark.createDataFrame(turns, "conv long, pos long, len long, item binary, words long"),
        spark.createDataFrame([(c, len(s)) for c, s in sequences.items()], "conv long, len long"))
    assert sorted(rows(got)) == trie(sequences)


# -- Merkle manifest ------------------------------------------------------------------------------
def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, arity=3):
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, owned = [], []
        for s in range(0, len(nodes), arity):
            run = nodes[s:s + arity]
            for j in range(len(run)):
                for o in owners[s + j]:
                    paths[o].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(sha("".join(run)))
            owned.append(sum(owners[s:s + arity], []))
        nodes, owners = up, owned
    return paths, nodes[0]


def whole_tree(leaves, arity=3):
    """{(group, key, leaf): [(subroot, root, proof)]} of (group, key, leaf) rows."""
    groups = collections.defaultdict(list)
    for g, k, leaf in leaves:
        groups[g].append((k is not None, k or 0, leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [climb([x[2] for x in sorted(groups[g])], arity) for g in order]
    tops, root = climb([t[1] for t in trees], arity)
    out = collections.defaultdict(list)
    for g, (paths, sub), top in zip(order, trees, tops, strict=True):
        for (there, k, leaf), path in zip(sorted(groups[g]), paths, strict=True):
            out[g, k if there else None, leaf].append((sub, root, path + top))
    return out


def check_manifest(spark, data, **options):
    df = spark.createDataFrame(data, "g string, k long, leaf string, pos int, block int, root string").repartition(3)
    got = collections.defaultdict(list)
    for r in merkle.manifest(df, "g", "k", **options).collect():
        got[r.g, r.k, r.leaf].append((r.subroot, r.root, [tuple(x) for x in r.proof]))
        assert r.pos == 7 and r.block == 8
    want = whole_tree([d[:3] for d in data], options.get("arity", 3))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("arity,levels", [(3, 6), (3, 1), (2, 2), (5, 1)])
def test_manifest_of_groups_of_all_sizes(spark, arity, levels):
    sizes = {None: 4, "": 1, "a": 2, "b": 3, "é": 9, "zz": 10, "hot": 100, "😀": 28}
    data = [(g, i * 3, sha(f"{g}{i}"), 7, 8, "clash") for g, n in sizes.items() for i in range(n)]
    data += [("a", None, sha("null key"), 7, 8, "clash"), ("a", 0, sha("same"), 7, 8, ""), ("a", 0, sha("same"), 7, 8, "")]
    check_manifest(spark, data, arity=arity, levels=levels)


def test_manifest_of_next_to_nothing(spark):
    check_manifest(spark, [("a", 1, sha("one"), 7, 8, None)])
    empty = spark.createDataFrame([], "g string, k long, leaf string")
    assert rows(merkle.manifest(empty, "g", "k")) == []


def test_merkle_query_by_brute_force(spark, tmp_path):
    data = [(1, "a\nb", "en", "s", 3), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "x\n" * 5000, "de", "é", 9),
            (5, "5:x", "en", "s", 1), (5, "5:x", "en", "s", 1), (None, "t\n", "en", "s", 2), (10, "a\n", "en", "t", 2)]
    (spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
     .withColumn("leaf", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet"))
    tampered = lambda i, t: t.replace("\n", "") if t and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else t
    leaf = lambda i, t, lang, s, n: sha("".join(map(frame, (i, s, lang, n, t))))
    tree = whole_tree([(s, i, leaf(i, t, lang, s, n)) for i, t, lang, s, n in data])
    want = []
    for i, t, lang, s, n in data:
        mine = leaf(i, t, lang, s, n)
        sub, root, path = tree[s, i, mine].pop()
        node = leaf(i, tampered(i, t), lang, s, n)
        for left, right in path:
            node = sha(left + node + right)
        want.append((i, mine, sub, root, sha("".join(a + b for a, b in path)), node, node == root))
    got = rows(merkle.op12_merkle_windows(spark, str(tmp_path)))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {w[-1] for w in want} == {True, False}


# -- packing --------------------------------------------------------------------------------------
def best_fit(lengths, capacity):
    """Remaining capacities after plain best-fit decreasing, piece by piece."""
    rest = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rest) if r >= n]
        if fits:
            rest[min(fits, key=lambda i: rest[i])] -= n
        else:
            rest.append(capacity - n)
    return sorted(rest)


def test_plan_equals_best_fit_piece_by_piece():
    r = random.Random(1)
    for _ in range(200):
        capacity = r.choice([1, 2, 7, 16, 50, 100, 2048])
        lengths = [r.randint(1, min(capacity, r.choice([3, 20, capacity]))) for _ in range(r.randrange(200))]
        plan = packing.best_fit_decreasing(dict(collections.Counter(lengths)), capacity)
        filled = collections.defaultdict(list)
        for n, count in collections.Counter(lengths).items():
            mine = plan[plan[:, 0] == n]
            for rank in range(count):
                _, since, first, each, offset = mine[np.searchsorted(mine[:, 1], rank, "right") - 1]
                bin_, slot = divmod(rank - since, each)
                filled[first + bin_].append((offset + slot * n, n))
        for parts in filled.values():
            parts.sort()
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sorted(capacity - sum(n for _, n in p) for p in filled.values()) == best_fit(lengths, capacity)


def test_plan_stays_small_whatever_the_counts():
    rng = np.random.default_rng(0)
    counts = {n: int(c) for n, c in zip(range(1, 2049), rng.integers(1, 10**9, 2048), strict=True)}
    assert len(packing.best_fit_decreasing(counts, 2048)) < 3 * 2048 * 11


def test_segment_tree_finds_the_tightest():
    r = random.Random(4)
    tree, there = packing.Capacities(37), set()
    for _ in range(500):
        x = r.randrange(38)
        there.symmetric_difference_update({x})
        tree.mark(x, x in there)
        least = r.randrange(38)
        assert tree.tightest(least) == min((t for t in there if t >= least), default=None)


def check_packing(packed, documents, capacity, with_ids=False):
    """``documents``: (doc_id, text) rows with unique ids.  Returns the number of sequences."""
    tk = Tokenizer.from_file(packing.default_vocabulary()[0])
    want = {}
    for i, text in documents:
        ids = np.array([*tk.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) - (len(ids) - 1) // capacity * capacity
        starts = [0, *range(first, len(ids), capacity)]
        for j, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want[i, j] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    got = packed.collect()
    assert len(got) == len(want) and {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    filled = collections.defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:i]) for i, (o, _) in enumerate(parts))
        assert sum(n for _, n in parts) <= capacity
    assert len(filled) == len(best_fit([r.length for r in got], capacity))
    return len(filled)


def test_packing_of_given_documents(spark):
    docs = rows(spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text"))
    check_packing(packing.op13_best_fit(spark, SF_SMALL), docs, 2048)


AWKWARD = [(1, None), (2, ""), (3, "one"), (4, "<|endoftext|> a <|endoftext|>"), (5, "é😀漢\x00 ​" * 300),
           (6, "word " * 9000), (None, "nobody's"), (7, " " * 3000), (8, "x" * 5000), (9, "one")]


@pytest.mark.parametrize("capacity", [1, 5, 64, 2048])
def test_packing_of_awkward_documents(spark, capacity):
    df = (spark.createDataFrame(AWKWARD, "doc_id long, text string").withColumn("length", F.lit(3))
          .withColumn("offset", F.lit("clash")).withColumn("pos", F.lit(1)).repartition(3))
    check_packing(packing.pack(df, capacity=capacity), AWKWARD, capacity)


def test_packing_of_repeated_rows_and_nothing(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "a b c")], "doc_id long, text string")
    got = packing.pack(df, capacity=6).collect()
    assert len(got) == 3 and len({(r.sequence_id, r.offset) for r in got}) == 3
    assert rows(packing.pack(df.limit(0))) == []


def test_sequences_hold_the_ids(spark):
    tk = Tokenizer.from_file(packing.default_vocabulary()[0])
    packed = packing.pack(spark.createDataFrame(AWKWARD, "doc_id long, text string"), capacity=64, with_ids=True)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    ids = collections.defaultdict(list)
    for r in sorted(packed.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.piece)):
        ids[r.doc_id] += whole[r.sequence_id][r.offset:r.offset + r.length]
    assert ids == {i: [*tk.encode(t or "", add_special_tokens=False).ids, 0] for i, t in AWKWARD}


def test_long_white_space_goes_through_the_slow_reader():
    encoder = packing.Encoder(packing.default_vocabulary())
    text = "a" + " " * 1_200_000 + "b"
    tk = Tokenizer.from_file(packing.default_vocabulary()[0])
    assert encoder.ids(text).tolist() == tk.encode(text, add_special_tokens=False).ids and encoder.slow is not None


def test_readers_agree_on_code_points():
    tk, encoder = Tokenizer.from_file(packing.default_vocabulary()[0]), packing.Encoder(packing.default_vocabulary())
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000][::7]
    for s in range(0, len(points), 256):
        text = "".join(f"a{chr(c)}1 {chr(c)}b  {chr(c)}!\n{chr(c)} {chr(c)}'s" for c in points[s:s + 256])
        assert encoder.ids(text).tolist() == tk.encode(text, add_special_tokens=False).ids

"""Trie of conversation prefixes by van Emde Boas recursion.

Sequences are cut at half depth, again and again.  On the way up the turns of each
half are digested together with those of the half before it; on the way down each
cut prefix is named from the cut above it and the digest of the turns between, so
that all tries of one height, the upper one and the forests below its cuts, are
named at once and a prefix has the same name wherever it occurs.

Cuts ``2 ** LEVELS`` turns apart bound a block; within a block the halves meet at
fixed offsets, so one shuffle by (conversation, block) serves all its levels.  The
blocks' digests are the sequences of the next recursion, whose names come back as
the blocks' roots.  No task holds more of a conversation than a block.

Rows with one name are one node.  Its smallest member represents it, and a
conversation represents a stretch of its own path down to its end.  So what a node
contributes stands in one row, totals are summed inside the blocks, the totals of
the blocks below are grafted onto those above by the same recursion, and a last
sum over the members adds up all paths below a node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txrisk.llm.common import Scratch, number_rows, partitions, table
from txrisk.llm.merkle import sql_crc32
from txrisk.llm.mixing import word_count

#: Halvings inside a block of 2 ** LEVELS turns; rows of one key that a join or a list brings together.
LEVELS, STRETCH = 6, 4096
ROOT = b"root"


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _whole(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long"))


def order_turns(df: DataFrame, scratch: Scratch, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text") -> DataFrame:
    """conv, pos (from 1), n, item (a digest of role and text), words of every turn, by turn (null first).

    Null roles and texts count as empty; equal turns are ordered by their digests;
    repeated rows are turns of their own; rows without a conversation id are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    item = _digest(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "UTF-8"))
    turns = df.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), item.alias("item"), word_count(text).alias("words"))
    placed = number_rows(turns, scratch, ["conv"], [F.col("turn").asc_nulls_first(), F.col("item")])
    return scratch.keep(placed.select("conv", (F.col("pos") + 1).alias("pos"), F.col("total").alias("n"), "item", "words"),
                        "turns")


def share_heads(turns: DataFrame, scratch: Scratch, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, (conv, len)) with the first h turns of each conversation c taken from conversation c - c % family.

    h is the unsigned CRC-32 of c in decimal modulo ``most``; all turns of a shorter
    one, none of an absent one.  A conversation may be left without turns.
    """
    h = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(most))
    convs = scratch.keep(turns.filter("pos = 1").select(
        "conv", "n", h.alias("h"), (F.col("conv") - F.pmod("conv", F.lit(family))).alias("base")), "convs")
    sizes = convs.select(F.col("conv").alias("_base"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = scratch.keep(convs.join(sizes, F.col("base") == F.col("_base"), "left").select(
        "conv", "n", "h", "base", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")),
        "rebuilt")
    heads = (turns.filter(F.col("pos") < most).select(F.col("conv").alias("base"), "pos", "item", "words")
             .join(convs.select("conv", "base", "h", "len"), "base").filter("pos <= h")
             .select("conv", "pos", "len", "item", "words"))
    # a long conversation meets its one row in stretches, so that no key gathers all of its turns
    spread = convs.select(F.col("conv").alias("c"), "h", "taken", "len",
                          F.explode(F.sequence(F.lit(0).cast("long"), _whole(F.col("n"), STRETCH))).alias("stretch"))
    own = (turns.join(spread, (F.col("conv") == F.col("c")) & (_whole(F.col("pos"), STRETCH) == F.col("stretch")))
           .filter("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "len", "item", "words"))
    return scratch.keep(heads.unionByName(own), "sequences"), convs.select("conv", "len")


def name_prefixes(items: DataFrame, convs: DataFrame, scratch: Scratch, height: int = 0) -> DataFrame:
    """conv, pos, name, parent (and the other columns of ``items``) of every prefix, the empty one included.

    ``items`` has conv, pos (from 1, gapless) and item; ``convs`` one row per conversation.
    """
    size = 2 ** LEVELS
    extra = [c for c in items.columns if c not in ("conv", "pos", "item")]
    place = F.pmod(F.col("pos") - 1, F.lit(size)) + 1  # 1 .. size inside the block
    inside = Window.partitionBy("conv", "block").orderBy("pos")
    df = items.withColumn("block", _whole(F.col("pos") - 1, size))
    for k in range(1, LEVELS + 1):  # digests of halves meet: the row of a cut holds the turns since the cut above it
        half = 2 ** (k - 1)
        joined = _digest(F.lit(bytes([height + k])), F.lag("item", half).over(inside), F.col("item"))
        df = df.withColumn("item", F.when(F.pmod(place, F.lit(2 * half)) == 0, joined).otherwise(F.col("item")))
    df = scratch.keep(df, "digests")

    nothing = [F.lit(None).cast(items.schema[c].dataType).alias(c) for c in extra]
    unnamed = F.lit(None).cast("binary").alias("name")
    roots = convs.select("conv", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("block"),
                         F.lit(None).cast("binary").alias("item"), *nothing, F.lit(ROOT).alias("name"))
    rows = df.filter(place < size).select("conv", "pos", "block", "item", *extra, unnamed).unionByName(roots)
    ends = df.filter(place == size)
    if not ends.isEmpty():
        above = ends.select("conv", (F.col("block") + 1).alias("pos"), "item")
        names = name_prefixes(above, above.filter("pos = 1").select("conv"), scratch, height + LEVELS)
        names = scratch.keep(names.filter("pos > 0").select(
            F.col("conv").alias("_conv"), (F.col("pos") - 1).alias("_block"), F.col("name").alias("_name")), "names")
        same = (F.col("conv") == F.col("_conv")) & (F.col("block") == F.col("_block"))
        rows = rows.unionByName(ends.join(names, same).select(
            "conv", "pos", "block", "item", *extra, F.col("_name").alias("name")))
        rows = rows.unionByName(names.select(
            F.col("_conv").alias("conv"), ((F.col("_block") + 1) * size).alias("pos"), (F.col("_block") + 1).alias("block"),
            F.lit(None).cast("binary").alias("item"), *nothing, F.col("_name").alias("name")))
    at = F.col("pos") - F.col("block") * size  # 0: the block's root
    for k in range(LEVELS - 1, -1, -1):  # cuts at half depth are named first, then those between them
        half = 2 ** k
        below = _digest(F.lag("name", half).over(inside), F.col("item"))
        rows = rows.withColumn("name", F.when((F.pmod(at, F.lit(2 * half)) == half) & F.col("name").isNull(), below)
                               .otherwise(F.col("name")))
    rows = rows.withColumn("parent", F.lag("name", 1).over(inside))
    return rows.filter("parent IS NOT NULL OR pos = 0").select("conv", "pos", *extra, "name", "parent")


def sum_below(df: DataFrame, values: list[str], scratch: Scratch) -> DataFrame:
    """``df`` (conv, pos, ...) with each value replaced by its sum over the conversation's rows from here on."""
    size = 2 ** LEVELS
    df = df.withColumn("_block", _whole(F.col("pos"), size))
    inside = (Window.partitionBy("conv", "_block").orderBy("pos")
              .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    local = scratch.keep(df.withColumns({v: F.sum(v).over(inside) for v in values}), "below")
    if local.filter("_block > 0").isEmpty():
        return local.drop("_block")
    heads = local.filter(F.pmod("pos", F.lit(size)) == 0).select("conv", F.col("_block").alias("pos"), *values)
    above = sum_below(heads, values, scratch)
    grafts = above.filter("pos > 0").select(F.col("conv").alias("_c"), (F.col("pos") - 1).alias("_b"),
                                            *[F.col(v).alias(f"_{v}") for v in values])
    return (local.join(grafts, (F.col("conv") == F.col("_c")) & (F.col("_block") == F.col("_b")), "left")
            .withColumns({v: F.col(v) + F.coalesce(F.col(f"_{v}"), F.lit(0)) for v in values}).select(*df.columns[:-1]))


def digest_lists(df: DataFrame, scratch: Scratch) -> DataFrame:
    """name, sha: the digest of each name's conv ids, ascending, decimal, comma-joined.

    Ids are joined in pieces of STRETCH.  A name's pieces then run in order through
    one hash, which is sequential by nature; a task holds one batch of pieces.
    """
    placed = number_rows(df.select("name", "conv"), scratch, ["name"], [F.col("conv")])
    pieces = (placed.withColumn("piece", _whole(F.col("pos"), STRETCH)).groupBy("name", "piece")
              .agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, None
        for pdf in batches:
            done = []
            for key, ids in zip(pdf["name"], pdf["ids"], strict=True):
                if key != name:
                    if state is not None:
                        done.append((name, state.hexdigest()))
                    name, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["name", "sha"])
        if state is not None:
            yield pd.DataFrame([(name, state.hexdigest())], columns=["name", "sha"])

    return (pieces.repartition(partitions(df.sparkSession), "name").sortWithinPartitions("name", "piece")
            .select("name", "ids").mapInPandas(run, "name binary, sha string"))


def prefix_trie(turns: DataFrame, convs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per distinct prefix: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv, pos (from 1, gapless), len, item (equal where turns are
    equal), words; ``convs`` has (conv, len) of every conversation, turnless ones
    included.  No conversation: no row, not even a root.
    """
    scratch = scratch or Scratch(turns.sparkSession, "prefix-trie")
    named = scratch.keep(name_prefixes(turns, convs, scratch).drop("len")
                         .withColumn("words", F.coalesce("words", F.lit(0))), "named")
    lengths = convs.filter("len > 0").select(F.col("conv").alias("c"), F.col("len").alias("p"))
    empty = convs.filter("len = 0").select(F.col("conv").alias("c"), F.lit(0).cast("long").alias("p"))
    last = named.join(lengths.unionByName(empty), (F.col("conv") == F.col("c")) & (F.col("pos") == F.col("p")))
    # a node without a child: all of its members end in it
    ends = scratch.keep(last.select("name", "conv"), "ends")
    over = ends.groupBy("name").agg(F.count(F.lit(1)).alias("n_ends"))
    nodes = named.groupBy("name").agg(F.min("conv").alias("m"), F.count(F.lit(1)).alias("n_convs"), F.min("pos").alias("depth"))
    nodes = scratch.keep(nodes.join(over, "name", "left").select(
        "name", "m", "depth", "n_convs", (F.coalesce("n_ends", F.lit(0)) == F.col("n_convs")).alias("leaf")), "nodes")

    seen = nodes.select("m", "depth", "n_convs", "leaf")
    paths = scratch.keep(
        named.join(seen, (F.col("conv") == F.col("m")) & (F.col("pos") == F.col("depth")), "left").select(
            "conv", "pos", "name", "parent", F.col("m").isNotNull().alias("own"),
            F.coalesce((F.col("n_convs") - 1) * F.col("words"), F.lit(0)).alias("saved"),
            F.coalesce(F.col("leaf").cast("long"), F.lit(0)).alias("leaves")), "paths")
    totals = (sum_below(paths.select("conv", "pos", "name", "saved", "leaves"), ["saved", "leaves"], scratch)
              .groupBy("name").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves")))

    own = paths.filter("own AND pos > 0")
    kids = own.groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    whole = scratch.keep(
        nodes.join(totals, "name").join(kids, "name", "left").join(digest_lists(ends, scratch), "name", "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0))), "whole")
    # the parent of a conversation's first own node belongs to another one; a parent of many is met in stretches
    tops = own.groupBy("conv").agg(F.min("pos").alias("pos"))
    tops = own.join(tops, ["conv", "pos"]).select("conv", "pos", "parent")
    tops = number_rows(tops.select("conv", F.col("pos").alias("top"), "parent"), scratch, ["parent"], [F.col("conv")])
    spread = whole.filter("n_children > 0").select(
        F.col("name").alias("parent"), F.col("m").alias("parent_m"),
        F.explode(F.sequence(F.lit(0).cast("long"), _whole(F.col("n_children"), STRETCH))).alias("stretch"))
    above = (tops.withColumn("stretch", _whole(F.col("pos"), STRETCH)).join(spread, ["parent", "stretch"])
             .select(F.col("conv").alias("c"), F.col("top").alias("p"), "parent_m"))
    return (whole.join(above, (F.col("m") == F.col("c")) & (F.col("depth") == F.col("p")), "left").select(
        F.col("m").alias("conv_id"), "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent_m", "m")).alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "prefix-trie")
    turns = order_turns(table(spark, sf_dir, "conversations"), scratch)
    return prefix_trie(*share_heads(turns, scratch), scratch)


OP11_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
         ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')))
         AS pos FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, {sql_crc32('name')} % 4 AS h
  FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS name FROM turns)),
rebuilt AS (
  SELECT v.conv_id, 0 AS part, t.pos, t.role, t.text FROM convs v JOIN turns t ON t.conv_id = v.base AND t.pos <= v.h
  UNION ALL
  SELECT v.conv_id, 1, t.pos, t.role, t.text FROM convs v JOIN turns t ON t.conv_id = v.conv_id AND t.pos > v.h),
paths AS (
  SELECT conv_id, row_number() OVER w AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER w) AS key
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
nodes AS (SELECT key, min(conv_id) AS conv_id, max(depth) AS depth, max(words) AS words, count(*) AS n FROM paths GROUP BY key),
links AS (SELECT v.key, p.key AS parent FROM nodes v JOIN paths p ON p.conv_id = v.conv_id AND p.depth = v.depth - 1),
kids AS (SELECT parent, count(*) AS n FROM links GROUP BY parent),
below AS (
  SELECT p.key, sum((v.n - 1) * v.words) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM nodes v JOIN paths p ON p.conv_id = v.conv_id AND p.depth <= v.depth LEFT JOIN kids k ON k.parent = v.key
  GROUP BY p.key),
ends AS (SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
         FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS len FROM paths) WHERE depth = len GROUP BY key)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(k.n, 0) AS n_children,
       b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes v LEFT JOIN links l ON l.key = v.key LEFT JOIN nodes u ON u.key = l.parent
LEFT JOIN kids k ON k.parent = v.key JOIN below b ON b.key = v.key LEFT JOIN ends e ON e.key = v.key
"""

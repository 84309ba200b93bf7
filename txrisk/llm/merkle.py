"""Merkle manifest of a table by lag and lead windows.

Rows of a group, in order, are the leaves of a tree: every ``arity`` consecutive
nodes of a level hash to a node of the next (the last run may be shorter) until
one is left, the group's subroot.  The subroots, in the groups' order, form one
more tree up to the root.

A pass climbs ``LEVELS`` levels with one shuffle.  Nodes are cut into blocks of
``arity ** LEVELS``, and a node of level L stands in the row of its first leaf.
So the siblings of a run stand at the fixed offsets of 1 to arity - 1 times
``arity ** L`` rows: lag and lead columns of these offsets, masked by the node's
slot and by the length of its run, supply them, and the rows of first children
hash the parents.  The heads of the blocks are the leaves of the next pass, so no
task holds more of a group than a block.  Proofs are then joined on downwards,
block by block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txrisk.llm.common import Scratch, number_rows, table

#: Children of a node, and levels that a pass climbs (a block holds ARITY ** LEVELS nodes).
ARITY, LEVELS = 3, 6

PROOF = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts end to end."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return digest(*[framed(v) for v in values])


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof (left and right siblings, level by level) come to."""
    return F.aggregate(proof, leaf, lambda node, run: digest(run["left"], node, run["right"]))


def siblings(proof: Column) -> Column:
    """All siblings of a proof end to end, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda run: F.concat(run["left"], run["right"])), "")


def _whole(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long"))


def _climb(nodes: DataFrame, group: list[str], arity: int, levels: int) -> DataFrame:
    """``nodes`` (group, pos, total, node, ...) with block, proof inside the block and, in the block's
    first row, ``node`` as the block's head."""
    size = arity ** levels
    inside = Window.partitionBy(*group, "block").orderBy("pos")
    df = nodes.withColumn("block", _whole(F.col("pos"), size))
    for level in range(levels):
        step = arity ** level
        count = _whole(F.col("total") + (step - 1), step)  # nodes of this level
        place = _whole(F.col("pos"), step)
        slot = F.pmod(place, F.lit(arity))
        run = F.least(F.lit(arity), count - (place - slot))
        here = (F.pmod("pos", F.lit(step)) == 0) & (count > 1)
        left = [F.when(slot >= j, F.lag("node", j * step).over(inside)).otherwise("") for j in range(arity - 1, 0, -1)]
        right = [F.when(slot + j < run, F.lead("node", j * step).over(inside)).otherwise("") for j in range(1, arity)]
        df = df.withColumn(f"_run{level}", F.when(here, F.struct(F.concat(*left).alias("left"),
                                                                 F.concat(*right).alias("right"))))
        df = df.withColumn("node", F.when(count <= 1, F.col("node"))
                           .when(here & (slot == 0), digest(F.col("node"), F.col(f"_run{level}.right"))))
    # a leaf's ancestor of each level stands in the nearest row before it that holds one
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = F.array(*[F.last(f"_run{level}", ignorenulls=True).over(upto) for level in range(levels)])
    return df.select(*nodes.columns[:-1], "node", "block", F.filter(runs, lambda r: r.isNotNull()).cast(PROOF).alias("proof"))


def _tree(nodes: DataFrame, scratch: Scratch, group: list[str], arity: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """(``nodes`` with their whole proofs, (group, node) with the heads of the groups)."""
    passes = []
    while True:
        passes.append(scratch.keep(_climb(nodes, group, arity, levels), "climbed"))
        size = arity ** levels
        nodes = (passes[-1].filter(F.pmod("pos", F.lit(size)) == 0)
                 .select(*group, F.col("block").alias("pos"), _whole(F.col("total") + (size - 1), size).alias("total"),
                         "node"))
        if nodes.filter("total > 1").isEmpty():
            break
    proven = passes[-1]
    for below in reversed(passes[:-1]):
        above = proven.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("pos").alias("_block"),
                              F.col("proof").alias("_above"))
        same = reduce(lambda a, b: a & b, [below[c].eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)],
                      below["block"] == F.col("_block"))
        proven = below.join(above, same).select(*below.columns[:-1], F.concat("proof", "_above").alias("proof"))
    return proven, nodes.select(*group, "node")


def manifest(leaves: DataFrame, group: str, key: str, leaf: str = "leaf", arity: int = ARITY,
             levels: int = LEVELS) -> DataFrame:
    """``leaves`` with subroot, root and proof (one (left, right) of joined siblings for each level).

    Leaves of a group ascend by ``key`` (null first), equal keys by ``leaf``;
    groups ascend bytewise, null first and a group of its own.  A group of one leaf
    has no level of its own; a table of one leaf has an empty proof and the leaf as
    root.  Repeated rows are leaves of their own, an empty table gives an empty
    result.  Other columns are carried along; columns of ``leaves`` named like a
    result are replaced.
    """
    scratch = Scratch(leaves.sparkSession, "merkle")
    carried = [c for c in leaves.columns if c not in ("subroot", "root", "proof")]
    rows = leaves.select(F.struct(*carried).alias("row"), F.col(group).alias("group"), F.col(key).alias("key"),
                         F.col(leaf).alias("node"))
    placed = number_rows(rows, scratch, ["group"], [F.col("key").asc_nulls_first(), F.col("node")])
    proven, heads = _tree(placed.select("row", "group", "pos", "total", "node"), scratch, ["group"], arity, levels)
    tops = number_rows(heads, scratch, [], [F.col("group").asc_nulls_first()])
    above, root = _tree(tops.select("group", F.col("node").alias("subroot"), "pos", "total", "node"), scratch, [],
                        arity, levels)
    above = above.select(F.col("group").alias("_group"), "subroot", F.col("proof").alias("_above"))
    return (proven.join(above, proven["group"].eqNullSafe(F.col("_group")))
            .crossJoin(F.broadcast(root.select(F.col("node").alias("root"))))  # one row
            .select("row.*", "subroot", "root", F.concat("proof", "_above").alias("proof")))


def op12_merkle_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    hashed = Scratch(spark, "merkle").keep(
        docs.select("doc_id", "source", leaf_hash(*fields, F.col("text")).alias("leaf"),
                    leaf_hash(*fields, F.coalesce(tampered, "text")).alias("found")), "leaves")
    proven = manifest(hashed, "source", "doc_id").withColumn("folded_root", fold(F.col("found"), F.col("proof")))
    return proven.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def sql_crc32(text: str) -> str:
    """DuckDB expression of the unsigned CRC-32 of an ASCII text: the polynomial's bit steps folded over its bytes."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END"
    byte = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, y: {step})"
    all_bytes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {all_bytes}), lambda c, b: {byte}), 4294967295::UBIGINT)"


def _sql_leaf(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


def _sql_tree(name: str, leaves: str) -> str:
    return f"""{name}(g, level, pos, n, h) AS (
  {leaves}
  UNION ALL
  SELECT g, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1
  GROUP BY g, level, n, pos // 3)"""


OP12_SQL = f"""
WITH RECURSIVE numbered AS (
  SELECT *, row_number() OVER () AS id, doc_id::VARCHAR AS name, dense_rank() OVER (ORDER BY source NULLS FIRST) AS g
  FROM documents),
hashed AS (
  SELECT id, doc_id, g, {_sql_leaf('text')} AS leaf,
         CASE WHEN {sql_crc32('name')} % 2 = 0 THEN {_sql_leaf("replace(text, chr(10), '')")}
              ELSE {_sql_leaf('text')} END AS found
  FROM numbered),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY g) AS n FROM hashed),
{_sql_tree('inner_tree', 'SELECT g, 0::BIGINT, pos, n, leaf FROM placed')},
heads AS (SELECT g, h FROM inner_tree WHERE n = 1),
{_sql_tree('upper_tree', 'SELECT 0::BIGINT, 0::BIGINT, row_number() OVER (ORDER BY g) - 1, count(*) OVER (), h FROM heads')},
runs AS (
  SELECT p.id, t.level, string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < p.pos // (3 ** t.level)::BIGINT) AS l,
         string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > p.pos // (3 ** t.level)::BIGINT) AS r
  FROM placed p JOIN inner_tree t ON t.g = p.g AND t.n > 1 AND t.pos // 3 = p.pos // (3 ** (t.level + 1))::BIGINT
  GROUP BY p.id, t.level
  UNION ALL
  SELECT p.id, 1000 + t.level,
         string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < (p.g - 1) // (3 ** t.level)::BIGINT),
         string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > (p.g - 1) // (3 ** t.level)::BIGINT)
  FROM placed p JOIN upper_tree t ON t.n > 1 AND t.pos // 3 = (p.g - 1) // (3 ** (t.level + 1))::BIGINT
  GROUP BY p.id, t.level),
steps AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY level) AS i, coalesce(l, '') AS l,
                 coalesce(r, '') AS r FROM runs),
folded(id, i, h) AS (
  SELECT id, 1::BIGINT, found FROM placed
  UNION ALL
  SELECT s.id, s.i + 1, sha256(s.l || f.h || s.r) FROM folded f JOIN steps s ON s.id = f.id AND s.i = f.i),
proofs AS (SELECT id, string_agg(l || r, '' ORDER BY i) AS sib, max(i) AS last FROM steps GROUP BY id),
root AS (SELECT h FROM upper_tree WHERE n = 1)
SELECT p.doc_id, p.leaf, heads.h AS subroot, root.h AS root, sha256(coalesce(q.sib, '')) AS proof_sha256,
       f.h AS folded_root, f.h = root.h AS verified
FROM placed p JOIN heads ON heads.g = p.g LEFT JOIN proofs q ON q.id = p.id
JOIN folded f ON f.id = p.id AND f.i = coalesce(q.last, 0) + 1, root
"""

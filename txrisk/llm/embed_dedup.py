"""Embedding near-dedup by int8 tile products with error bounds.

A unit vector u is stored as s * q (q: int8, s: its scale) with the exact norm e
of what the rounding lost.  For two vectors the product of the stored forms
differs from the cosine by at most e1 + e2 + e1 * e2, so whole tiles of pairs
are decided by small-integer products: linked, not linked, or open.

Vectors are quantised once.  Those of one label are dealt into tiles of bounded
size; a task holds one pair of tiles, and only the int8 forms are sent to it.
The ends of open pairs meet once more, pair of tiles by pair of tiles, with
their original components, and only open pairs are computed in double.  Tasks
return per vector its number of links and one link towards the smallest vector
of its local group, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm.common import Scratch, table
from txrisk.llm.components import connected_components
from txrisk.llm.topk_search import usable

#: Vectors of a tile, and rows of a product computed at a time.
TILE_ROWS, STEP = 2048, 512

_STORED = "id long, label string, dims int, quantised binary, scale double, lost double, data binary"
_LINKS = "label string, left long, right long, dims int, vec_id long, n_links long, towards long, open boolean"


@dataclass
class Tile:
    """Rows of a tile: ids, int8 forms, scales, error norms, and original components (None: not sent)."""

    ids: np.ndarray
    q: np.ndarray
    scale: np.ndarray
    lost: np.ndarray
    x: np.ndarray | None = None


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows of x as int8 rows, scales, and the norms of the rounding errors (rounded up)."""
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = unit - q * scale[:, None]
    return q, scale, np.sqrt((lost * lost).sum(axis=1)) * (1 + 1e-9) + 1e-12


def tile_of(ids: np.ndarray, x: np.ndarray) -> Tile:
    """The tile of the rows of x, components included."""
    return Tile(ids, *quantise(x), x)


def bounded_pairs(x: Tile, y: Tile, threshold: float, same: bool
                  ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row and column numbers of pairs that may reach the threshold, and which of them surely do.

    same: of x with itself, row < column.
    """
    # int8 products add up exactly in float32 up to 2^24, in float64 beyond
    kind = np.float32 if x.q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    fx, fy = x.q.astype(kind), y.q.astype(kind)
    for lo in range(0, len(fx), STEP):
        hi = min(lo + STEP, len(fx))
        near = (fx[lo:hi] @ fy.T).astype(np.float64) * x.scale[lo:hi, None] * y.scale[None, :]
        room = x.lost[lo:hi, None] + y.lost[None, :] + x.lost[lo:hi, None] * y.lost[None, :] + 1e-9
        r, c = np.nonzero(near + room >= threshold)
        sure = (near - room)[r, c] >= threshold
        r += lo
        if same:
            once = r < c
            r, c, sure = r[once], c[once], sure[once]
        yield r, c, sure


def exact_links(x: Tile, y: Tile, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (i, j) have a cosine of the threshold or more in double."""
    out = np.zeros(len(i), bool)
    nx, ny = np.sqrt((x.x * x.x).sum(axis=1)), np.sqrt((y.x * y.x).sum(axis=1))
    for at in range(0, len(i), 1 << 17):
        a, b = i[at: at + (1 << 17)], j[at: at + (1 << 17)]
        out[at: at + (1 << 17)] = np.einsum("ij,ij->i", x.x[a], y.x[b]) / (nx[a] * ny[b]) >= threshold
    return out


def _local_groups(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest position that each of n positions reaches over the pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def link_tile(left: Tile, right: Tile | None, threshold: float) -> pd.DataFrame:
    """(vec_id, n_links, towards, open) of one pair of tiles (right None: of one tile with itself).

    Without original components: the links that the bound makes sure, and a row
    (no links, open) for each end of a pair that it leaves open.  With them: the
    links among these open pairs alone.  The pairs of a step are folded into
    counts and local groups at once.
    """
    same = right is None
    right = left if same else right
    ids = left.ids if same else np.concatenate([left.ids, right.ids])
    shift = 0 if same else len(left.ids)
    order = np.argsort(ids, kind="stable")  # positions by id: the smallest position is the smallest id
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    count = np.zeros(len(ids), np.int64)
    group = np.arange(len(ids))
    unsure = np.zeros(len(ids), bool)
    for i, j, sure in bounded_pairs(left, right, threshold, same):
        if left.x is None:
            unsure[i[~sure]] = unsure[j[~sure] + shift] = True
            i, j = i[sure], j[sure] + shift
        else:
            i, j = i[~sure], j[~sure]
            linked = exact_links(left, right, i, j, threshold)
            i, j = i[linked], j[linked] + shift
        count += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
        group = _local_groups(group[place[i]], group[place[j]], len(ids))[group]
    hit, again = np.flatnonzero(count), np.flatnonzero(unsure)
    return pd.DataFrame({"vec_id": np.concatenate([ids[hit], ids[again]]),
                         "n_links": np.concatenate([count[hit], np.zeros(len(again), np.int64)]),
                         "towards": np.concatenate([ids[order[group[place[hit]]]], ids[again]]),
                         "open": np.repeat([False, True], [len(hit), len(again)])})


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quantises rows (id, label, vector) of one or several lengths."""
    for batch in batches:
        vectors = batch.column("vector")
        dims = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(dims) - dims
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        for d in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == d)
            x = flat[starts[rows][:, None] + np.arange(d)]
            # by a power of two: cosines stay the same, squares neither overflow nor vanish
            x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
            q, scale, lost = quantise(x)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), batch.column("label").take(take), pa.array([d] * len(rows), pa.int32()),
                 pa.array([r.tobytes() for r in q], pa.binary()), pa.array(scale), pa.array(lost),
                 pa.array([r.tobytes() for r in x], pa.binary())],
                names=["id", "label", "dims", "quantised", "scale", "lost", "data"])


_GROUP = ["label", "left", "right", "dims"]


def _pack(exact: bool):
    """Rows of a tile pair's side as blocks: fewer, larger rows for the exchange."""
    parts = {"id": pa.int64(), "quantised": pa.binary(), "scale": pa.float64(), "lost": pa.float64()}
    if exact:
        parts["data"] = pa.binary()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*_GROUP, "side"]
        for batch in batches:
            keys = batch.select(names).to_pandas()
            made: list[tuple] = []
            for group, rows in keys.groupby(names):
                some = batch.take(pa.array(rows.index.to_numpy()))
                made.append((*group, *(b"".join(some.column(p).to_pylist()) if pa.types.is_binary(kind)
                                       else some.column(p).to_numpy().tobytes() for p, kind in parts.items())))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), *([pa.binary()] * len(parts))]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)],
                                                 names=[*names, *parts])
    return work, "label string, left long, right long, dims int, side int, " + ", ".join(f"{p} binary" for p in parts)


def _linked(dealt: DataFrame, threshold: float, exact: bool) -> DataFrame:
    """``link_tile`` for each pair of tiles of rows (label, left, right, dims, side, id, quantised, scale, lost[, data])."""
    def work(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dims, tiles = int(group[3]), []
        for side in (0, 1):
            part = pdf[pdf.side == side]
            if len(part):
                read = lambda c, kind: np.frombuffer(b"".join(part[c]), kind)  # noqa: B023, E731
                tiles.append(Tile(read("id", np.int64), read("quantised", np.int8).reshape(-1, dims),
                                  read("scale", np.float64), read("lost", np.float64),
                                  read("data", np.float64).reshape(-1, dims) if exact else None))
        if group[1] != group[2] and len(tiles) < 2:
            found = pd.DataFrame({"vec_id": [], "n_links": [], "towards": [], "open": []}).astype(
                {"vec_id": "int64", "n_links": "int64", "towards": "int64", "open": "bool"})
        else:
            found = link_tile(tiles[0], tiles[1] if group[1] != group[2] else None, threshold)
        for at, (name, value) in enumerate(zip(_GROUP, group, strict=True)):
            found.insert(at, name, value)
        return found

    pack, schema = _pack(exact)
    return dealt.mapInArrow(pack, schema).groupBy(*_GROUP).applyInPandas(work, _LINKS)


def embedding_links(df: DataFrame, scratch: Scratch, threshold: float = 0.93, key: str = "vec_id",
                    vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, towards) pieces: sum n_links per vector, follow ``towards`` for groups.

    Tiles: as many per label as its rows need; a vector goes to the tile of its
    id's hash, and its int8 form is sent to each tile pair of its label that
    holds its tile.  Its components go only to the pairs that leave it open.
    """
    rows = (df.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & usable(vector))
            .select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
                    F.col(vector).cast("array<double>").alias("vector"))
            .filter(F.exists("vector", lambda x: x != 0)))
    stored = scratch.keep(rows.mapInArrow(_store, _STORED), "stored")
    tiles = stored.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).alias("tiles"))
    own = F.pmod(F.xxhash64("id", F.lit("tile")), F.col("tiles"))
    dealt = (stored.join(tiles, "label").withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
             .select("label", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "dims",
                     (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "quantised", "scale", "lost"))
    first = scratch.keep(_linked(dealt, threshold, False), "bounded")
    # rows that share an id share a tile: all of them meet again, and the same pairs are open as before
    ends = first.filter("open").select(*_GROUP, F.col("vec_id").alias("id")).distinct()
    again = (stored.join(ends, ["label", "dims", "id"]).join(tiles, "label")
             .select(*_GROUP, (own != F.col("left")).cast("int").alias("side"),
                     "id", "quantised", "scale", "lost", "data"))
    pieces = ["vec_id", "n_links", "towards"]
    return first.filter("NOT open").select(*pieces).unionByName(
        scratch.keep(_linked(again, threshold, True), "exact").select(*pieces))


def embedding_components(df: DataFrame, threshold: float = 0.93, key: str = "vec_id",
                         vector: str = "embedding", label: str = "label") -> DataFrame:
    """``key``, n_links, component_id, kept: one row per row of ``df``.

    Only vectors with the same non-null label (and length) link.  Vectors that
    are null, empty, zero or hold null or non-finite components link with
    nothing: no links, their own component, kept.  Rows with a null id: no
    links, null component, kept.  Rows with the same id are one node of the
    graph and compare as separate vectors (a row never links with itself); each
    gets the node's component and links.  Empty table: empty result; other
    columns are not read.
    """
    scratch = Scratch(df.sparkSession, "embed-dedup")
    pieces = embedding_links(df, scratch, threshold, key, vector, label)
    counts = pieces.groupBy("vec_id").agg(F.sum("n_links").alias("n"))
    groups = connected_components(
        pieces.select(F.col("vec_id").alias("a"), F.col("towards").alias("b")).distinct(), scratch)
    found = scratch.keep(
        counts.join(groups, counts["vec_id"] == groups["node"], "left")
        .select("vec_id", "n", F.coalesce("component", "vec_id").alias("c")), "found")
    own = F.col(key).cast("long")
    return (df.select(own.alias("vec"))
            .join(found, F.col("vec") == F.col("vec_id"), "left")
            .select(F.col("vec").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("c", "vec").alias("component_id"),
                    F.coalesce(F.col("c") == F.col("vec"), F.lit(True)).alias("kept")))


def op8_int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))

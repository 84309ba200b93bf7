"""Exact top-k inner-product search by columnar branch and bound.

Vectors lie in vertical layout (one row per dimension).  A query meets a tile of
candidates dimension block by block, its heaviest dimensions first: the inner
products gathered so far, plus or minus the product of the two remaining norms
(Cauchy-Schwarz), bound every final score.  After the first block the candidates
that lead are scored in full, which gives the query's bar; candidates whose upper
bound is below it are compacted away before the next block, for each query
on its own.  Tiles have fixed sizes, and only each tile's k best leave its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txrisk.llm.common import table

#: Rows of a candidate and of a query tile, dimensions of a block, leaders scored in full for each place of the result.
CANDIDATE_ROWS, QUERY_ROWS, BLOCK, PROBES = 4096, 8192, 16, 8
_EXACT = float(1 << 53)

_BLOCKS = "tile_q long, tile_c long, dims int, is_query boolean, ids binary, data binary"
_HITS = "query_id long, vec_id long, score long"


def scaled(vector: np.ndarray) -> np.ndarray:
    """floor(256 * x) of each component, in double."""
    return np.floor(vector.astype(np.float64) * 256.0)


def usable(column: str) -> Column:
    """Neither null nor empty, and every component finite."""
    c = F.col(column)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & ~bad


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs rows (tile_q, tile_c, is_query, id, vector) into binary blocks by tile and length."""
    for batch in batches:
        tiles = pd.DataFrame({n: batch.column(n).to_numpy(zero_copy_only=False)
                              for n in ("tile_q", "tile_c", "is_query", "id")})
        vectors = batch.column("vector")
        tiles["dims"] = vectors.value_lengths().to_numpy(zero_copy_only=False)
        starts = np.cumsum(tiles.dims.to_numpy()) - tiles.dims.to_numpy()
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        out: dict[str, list] = {k: [] for k in ("tile_q", "tile_c", "dims", "is_query", "ids", "data")}
        for (q, c, is_query, dims), rows in tiles.groupby(["tile_q", "tile_c", "is_query", "dims"]):
            at = starts[rows.index.to_numpy()][:, None] + np.arange(dims)
            for name, value in (("tile_q", q), ("tile_c", c), ("dims", dims), ("is_query", is_query),
                                ("ids", rows.id.to_numpy(np.int64).tobytes()),
                                ("data", scaled(flat[at]).tobytes())):
                out[name].append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["tile_q"], pa.int64()), pa.array(out["tile_c"], pa.int64()),
             pa.array(out["dims"], pa.int32()), pa.array(out["is_query"], pa.bool_()),
             pa.array(out["ids"], pa.binary()), pa.array(out["data"], pa.binary())],
            names=list(out))


def _gather(blocks: pd.DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the (dims x rows) matrix of a tile side, rows by id."""
    if not len(blocks):
        return np.zeros(0, np.int64), np.zeros((dims, 0))
    ids = np.concatenate([np.frombuffer(b, np.int64) for b in blocks.ids])
    rows = np.concatenate([np.frombuffer(b, np.float64).reshape(-1, dims) for b in blocks.data])
    order = np.argsort(ids, kind="stable")
    return ids[order], np.ascontiguousarray(rows[order].T)


def _exact_scores(q: np.ndarray, x: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Whole-number inner products beyond double's exact range, limited to a long."""
    out = [sum(int(a) * int(b) for a, b in zip(q, x[:, c], strict=True)) for c in cols]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in out], dtype=np.int64)


def _survivors(q: np.ndarray, x: np.ndarray, mass: np.ndarray, cols: np.ndarray, k: int, exact: bool,
               seen: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
    """The candidates among ``cols`` that can be of the query's k best, and their scores; ``mass``: squared norms."""
    order = np.argsort(-np.abs(q), kind="stable")
    got, x_rest, q_rest, bar = np.zeros(len(cols)), mass[cols], float(q @ q), -np.inf
    for b in range(0, len(q), BLOCK):
        at = order[b: b + BLOCK]
        if seen is not None:
            seen.append(len(cols))
        xb = x[at] if len(cols) == x.shape[1] else x[at[:, None], cols]
        got = got + q[at] @ xb
        x_rest = np.maximum(x_rest - np.einsum("ij,ij->j", xb, xb), 0)
        q_rest = max(q_rest - float(q[at] @ q[at]), 0.0)
        if len(cols) <= k or b + BLOCK >= len(q):
            continue
        if b == 0:
            n = min(PROBES * k, len(cols))
            lead = cols[np.argpartition(-got, n - 1)[:n]]
            score = q @ x[:, lead]
            # sums beyond double's whole numbers are rounded: far below one part in 2^40 of the norms
            score = score if exact else score - np.sqrt(float(q @ q) * mass[lead]) * 2.0 ** -40
            bar = np.partition(score, n - k)[n - k]
        high = got + np.sqrt(x_rest) * (np.sqrt(q_rest) * (1 + 2.0 ** -20)) + 2.0 ** -10
        if not exact:
            high += np.sqrt(float(q @ q) * mass[cols]) * 2.0 ** -40
        alive = np.flatnonzero(~(high < bar))
        cols, got, x_rest = cols[alive], got[alive], x_rest[alive]
    return cols, got


def search_tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, x: np.ndarray, k: int,
                seen: list[list[int]] | None = None) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of each query's k best of this tile; q, x: dims x rows.

    ``seen`` receives, per query, the number of candidates that each dimension block met."""
    if not len(q_ids) or not len(c_ids):
        return []
    mass = (x * x).sum(axis=0)
    exact = float(np.sqrt((q * q).sum(axis=0).max()) * np.sqrt(mass.max())) < _EXACT
    hits = []
    for query, one in zip(q_ids, np.ascontiguousarray(q.T), strict=True):
        met = None if seen is None else []
        cols, got = _survivors(one, x, mass, np.flatnonzero(c_ids != query), k, exact, met)
        score = got.astype(np.int64) if exact else _exact_scores(one, x, cols)
        if len(cols) > k:
            bar = np.partition(score, len(cols) - k)[len(cols) - k]
            cols, score = cols[score >= bar], score[score >= bar]
        best = np.lexsort((c_ids[cols], -score.astype(np.float64) if exact else -score))[:k]
        hits += [(int(query), int(c_ids[cols[i]]), int(score[i])) for i in best]
        if seen is not None:
            seen.append(met)
    return hits


def top_k(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products.

    Ties go to the smaller id.  Rows with a null id, and vectors that are null,
    empty or hold null or non-finite components, take no part.  Rows with the
    same id are one vector (the smallest of them); vectors of different length
    are not compared.  An empty table gives an empty result; other columns are
    not read.  Scores beyond a long are held at its ends.
    """
    spark = df.sparkSession
    rows = (df.filter(F.col(key).isNotNull() & usable(vector))
            .select(F.col(key).cast("long").alias("id"),
                    F.col(vector).cast("array<double>").alias("vector"), is_query.alias("is_query"))
            .groupBy("id").agg(F.min("vector").alias("vector"), F.max("is_query").alias("is_query")))
    sizes = df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    tiles_c = max(1, -(-sizes["n"] // CANDIDATE_ROWS))
    tiles_q = max(1, -(-sizes["q"] // QUERY_ROWS))

    def tile(n: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(n))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    asked = (rows.filter("is_query").select("id", "vector", F.lit(True).alias("is_query"),
                                            tile(tiles_q).alias("tile_q"), every(tiles_c).alias("tile_c")))
    held = rows.select("id", "vector", F.lit(False).alias("is_query"), tile(tiles_c).alias("tile_c"),
                       every(tiles_q).alias("tile_q"))
    blocks = asked.unionByName(held).mapInArrow(_blocks_of, _BLOCKS)

    def search(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dims = int(key_[2])
        asks, holds = pdf[pdf.is_query], pdf[~pdf.is_query]
        hits = search_tile(*_gather(asks, dims), *_gather(holds, dims), k)
        return pd.DataFrame(hits, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = blocks.groupBy("tile_q", "tile_c", "dims").applyInPandas(search, _HITS)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op5_bound_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(
           range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""

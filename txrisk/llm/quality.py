"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

Terms are pairs of neighbouring byte classes plus a few word-shape terms.  A
bounded, seeded sample of labelled rows gives the term weights (inverse
document frequency) and the latent axes (truncated singular vectors).  The
sample's labelled vectors are broadcast; every document gets exact blocked
cosine products with all of them, and its ``neighbours`` nearest vote with
their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.llm.common import WHITE, bounded_batches, chunks, table, text_buffer, word_hashes, words

#: Bound of the labelled sample for each label, latent axes, voting neighbours, accepted score.
SAMPLE_PER_LABEL, AXES, NEIGHBOURS, ACCEPT = 1000, 48, 15, 0.7
#: Documents multiplied with the labelled vectors at a time.
DOCUMENT_BLOCK = 1024


def _classes() -> np.ndarray:
    """Byte class: each small letter, capitals, digits, blank, line ends, marks by kind, UTF-8 heads and tails."""
    c = np.full(256, 47, dtype=np.uint8)  # control and anything else
    c[ord("a"): ord("z") + 1] = np.arange(26)
    c[ord("A"): ord("Z") + 1] = 26
    c[ord("0"): ord("9") + 1] = 27
    c[np.flatnonzero(WHITE)] = 28
    c[ord("\n")] = 29
    kinds = [".", ",", "!", "?", ";:", "'\"`", "|", "*", "#", "$", "%", "&", "@", "-_", "()[]{}<>", "/\\", "+=~^"]
    for i, marks in enumerate(kinds):
        for m in marks:
            c[ord(m)] = 30 + i
    c[0x80:0xC0] = 45
    c[0xC0:] = 46
    return c


CLASSES, KINDS = _classes(), 48
#: Word-shape terms after the class pairs: repeats of the word before, of the one two before, long words,
#: words of capitals; each counted with a weight, since one of them stands for a whole word.
SHAPES, SHAPE_WEIGHT = 4, 4.0
TERMS = KINDS * KINDS + SHAPES


def term_counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Documents x TERMS counts."""
    n = len(offs) - 1
    out = np.zeros((n, TERMS), dtype=np.float32)
    if len(data) > 1:
        kind = CLASSES[data].astype(np.int64)
        pair = kind[:-1] * KINDS + kind[1:]
        inside = np.ones(len(data) + 1, dtype=bool)
        inside[offs] = False  # a pair never crosses documents
        doc = np.repeat(np.arange(n), np.diff(offs))[1:]
        keep = inside[1: len(data)]
        out[:, : KINDS * KINDS] = np.bincount(
            doc[keep] * (KINDS * KINDS) + pair[keep], minlength=n * KINDS * KINDS).reshape(n, -1)
    start, end, doc = words(data, offs)
    if len(start):
        h = word_hashes(data, start, end)
        again = np.zeros((4, len(h)), dtype=bool)
        again[0, 1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        again[1, 2:] = (h[2:] == h[:-2]) & (doc[2:] == doc[:-2])
        again[2] = end - start > 24
        capital = (data >= 65) & (data <= 90)
        caps = np.concatenate([[0], np.cumsum(capital)])
        again[3] = caps[end] - caps[start] > 1
        for i in range(SHAPES):
            out[:, KINDS * KINDS + i] = SHAPE_WEIGHT * np.bincount(doc[again[i]], minlength=n)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows of square-root term frequency times idf (an empty text stays zero)."""
    x = np.sqrt(counts) * idf
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1)[:, None]


@dataclass
class Model:
    """All that scoring needs; its size is fixed by the parameters, not by the data."""

    idf: np.ndarray  # TERMS
    axes: np.ndarray  # TERMS x AXES
    vectors: np.ndarray  # labelled x AXES, unit rows
    labels: np.ndarray  # 0 or 1
    neighbours: int

    def latent(self, counts: np.ndarray) -> np.ndarray:
        x = weighted(counts, self.idf) @ self.axes
        norm = np.sqrt((x * x).sum(axis=1))
        return x / np.where(norm > 0, norm, 1)[:, None]

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors (no similarity: 0.5)."""
        if not len(self.vectors):
            return np.full(len(counts), 0.5)
        k = min(self.neighbours, len(self.vectors))
        out = np.empty(len(counts))
        for lo in range(0, len(counts), DOCUMENT_BLOCK):
            cosine = self.latent(counts[lo: lo + DOCUMENT_BLOCK]) @ self.vectors.T
            near = np.argpartition(cosine, cosine.shape[1] - k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64)
            mass = weight.sum(axis=1)
            out[lo: lo + DOCUMENT_BLOCK] = np.where(
                mass > 0, (weight * self.labels[near]).sum(axis=1) / np.where(mass > 0, mass, 1), 0.5)
        return np.clip(out, 0, 1)


def is_held_out(key: Column) -> Column:
    """crc32 of the id as text modulo 4 is 2 (null id: not)."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
        label: str = "quality", per_label: int = SAMPLE_PER_LABEL, axes: int = AXES,
        neighbours: int = NEIGHBOURS, seed: int = 11) -> Model:
    """Fits on at most ``per_label`` rows of each label, drawn in the order of a seeded hash of the id.

    Held-out rows and rows whose label is null or neither 0 nor 1 are never
    drawn; an id with both labels counts as 0.  Only the drawn rows' term counts
    reach the driver: at most 2 x per_label rows of TERMS numbers.
    """
    bounded_batches(df.sparkSession)
    usable = (labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~is_held_out(F.col(key)))
              .groupBy(F.col(key).alias("id")).agg(F.min(label).cast("int").alias("y")))
    order = [F.xxhash64(F.lit(seed), "id"), F.col("id")]
    drawn = usable.filter("y = 0").orderBy(*order).limit(per_label).unionByName(
        usable.filter("y = 1").orderBy(*order).limit(per_label))
    rows = (df.select(F.col(key).alias("doc"), F.col(text).alias("text"))
            .join(F.broadcast(drawn), F.col("doc") == F.col("id"))  # at most 2 x per_label rows
            .select("id", "y", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                c = term_counts(*text_buffer(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").cast(pa.string()), part.column("y"),
                     pa.array([r.tobytes() for r in c], pa.binary())], names=["id", "y", "counts"])

    # a repeated id is drawn once: its first text by bytes of the counts
    got = (rows.mapInArrow(count, "id string, y int, counts binary")
           .groupBy("id").agg(F.min("y").alias("y"), F.min("counts").alias("counts"))
           .orderBy("id").collect())
    y = np.array([r.y for r in got], dtype=np.float64)
    counts = (np.stack([np.frombuffer(r.counts, np.float32) for r in got]) if got
              else np.zeros((0, TERMS), np.float32))
    idf = np.log((1 + len(got)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.2)
    x = weighted(counts, idf).astype(np.float64)
    if len(got):
        value, vector = np.linalg.eigh(x @ x.T)
        top = np.argsort(-value, kind="stable")[:axes]
        top = top[value[top] > 1e-9]
        basis = (x.T @ vector[:, top] / np.sqrt(value[top])).astype(np.float32)
    else:
        basis = np.zeros((TERMS, 1), np.float32)
    model = Model(idf, basis, np.zeros((0, basis.shape[1]), np.float32), y, neighbours)
    model.vectors = model.latent(counts).astype(np.float32)
    return model


def score_documents(df: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """All columns of ``df`` and ``score``: one pass, no shuffle; null texts score as empty ones.

    ``score`` must not be a column of ``df``.
    """
    if score.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"column exists already: {score}")
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # fixed size: see Model

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                s = shared.value.score(term_counts(*text_buffer(part.column(text))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())],
                                                 names=[*part.schema.names, score])

    return df.mapInArrow(work, T.StructType([*df.schema.fields, T.StructField(score, T.DoubleType())]))


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
             accept: float = ACCEPT) -> DataFrame:
    """``key``, held_out, score, predicted of every row.

    Null and empty texts have no neighbours and score 0.5 (rejected); null and
    repeated ids are rows like any other; without usable labels every score is
    0.5; an empty table gives an empty result.  Labels, languages and sources
    are not inputs; other columns are not read.
    """
    model = fit(df, labels, key, text)
    scored = score_documents(df.select(F.col(key).alias("id"), F.col(text).alias("text")), model)
    return scored.select(F.col("id").alias(key), is_held_out(F.col("id")).alias("held_out"), "score",
                         (F.col("score") >= accept).cast("int").alias("predicted"))


def op6_neighbour_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

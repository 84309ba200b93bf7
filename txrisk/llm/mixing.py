"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source gets a target of words by its weight, at most ``epochs`` times its
size, the excess shared again by weight.  The mix is made of equal blocks of
words.  Sainte-Lague gives the blocks to the sources by the highest quotients
target / (2 * quota + 1), and each source's quota to its shards in the same way
by shard size.  Inside a shard the documents lie in a seeded order, end to end
and round after round; the shard's quota is the first so many blocks of them.
Where whole copies are asked for, the one document that a shard takes in part is
taken or left so that what rounding adds and drops evens out over the source.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txrisk.llm.common import Scratch, table

#: Words of a block, rounds over a source at most, seed of the order, weights in turn.
BLOCK_WORDS, EPOCHS, SEED, WEIGHTS = 16, 3, 17, (1, 2, 3)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sainte_lague(weights: np.ndarray, limits: np.ndarray, seats: int) -> np.ndarray:
    """Seats by the highest quotients weight / (2 * seats + 1), at most ``limits`` each.

    The common divisor is found by bisection, the last seats go one by one to
    the highest quotients (ties: the first).  Seats beyond all limits stay free.
    """
    w, cap = np.asarray(weights, float), np.asarray(limits, np.int64)
    cap = np.where(w > 0, cap, 0)
    seats = int(min(seats, cap.sum()))
    if seats <= 0:
        return np.zeros(len(w), np.int64)

    def given(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(w / divisor + 0.5), cap).astype(np.int64)

    high = 4 * w.max()  # nobody gets a seat
    low = w[w > 0].min() / (2.0 * cap.max() + 2)
    while given(low).sum() < seats:
        low /= 2
    for _ in range(200):
        mid = (low + high) / 2
        if not low < mid < high:
            break
        low, high = (low, mid) if given(mid).sum() <= seats else (mid, high)
    got = given(high)
    while got.sum() < seats:  # ties at the divisor
        got[int(np.argmax(np.where(got < cap, w / (2 * got + 1), -1.0)))] += 1
    return got


def targets(sizes: DataFrame, source: str, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """(source, source_size, target): one row per source, from its (source, source_size).

    min(epochs * size, level * weight), the level filled until the targets are
    all the words: sources in the order of epochs * size / weight are capped
    until the rest's share fits under the next cap.  One row per source enters.
    """
    turn = Window.orderBy(F.col(source).asc_nulls_last())
    up = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("place") % len(weights) + 1)
    rows = (sizes.withColumn("place", F.row_number().over(turn) - 1).withColumn("weight", weight)
            .withColumn("ratio", epochs * F.col("source_size") / F.col("weight"))
            .withColumn("all_words", F.sum("source_size").over(every))
            .withColumn("all_weights", F.sum("weight").over(every))
            .withColumn("capped", F.coalesce(F.sum(epochs * F.col("source_size")).over(before), F.lit(0)))
            .withColumn("free", F.col("all_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
            .withColumn("level", (F.col("all_words") - F.col("capped")) / F.col("free"))
            # capped as long as its own cap is not above the level that it leaves to the rest
            .withColumn("over", F.max(F.when(F.col("ratio") > F.col("level"), 1).otherwise(0)).over(up)))
    rows = rows.withColumn("fill", F.min(F.when(F.col("over") == 1, F.struct("ratio", "place", "level")))
                           .over(every)["level"])
    return rows.select(
        source, "source_size",
        F.when(F.col("over") == 1, F.col("weight") * F.col("fill"))
        .otherwise(F.col("source_size") * epochs).cast("double").alias("target"))


def _laid(df: DataFrame, scratch: Scratch, key: str, text: str, source: str, weights: tuple[int, ...], epochs: int,
          block: int, seed: int) -> DataFrame:
    """(key, source, size, source_size, target, shard, rounds, part): a row's words come ``rounds`` times and ``part`` more.

    A source of n rows has ceil(sqrt(n)) shards, whatever the cluster's settings,
    so that neither a shard's rows nor a source's shards, of which one row each
    enters the apportionment, fill a task.
    """
    sized = scratch.keep(
        df.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
                  F.xxhash64(F.lit(seed), F.col(key)).alias("order")), "sized")
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    aims = scratch.keep(
        targets(per.select("source", "source_size"), "source", weights, epochs)
        .join(per.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s")))
        .select(F.xxhash64("source").alias("id"), F.isnull("source").alias("none"), "source", "source_size",
                "target", "rows"), "targets")
    shards = F.ceil(F.sqrt("rows"))

    def to_sources(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["none", "source"]).reset_index(drop=True)
        limit = -(-pdf.source_size.to_numpy() * epochs // block)
        seats = int(-(-pdf.source_size.sum() // block))
        pdf["quota"] = sainte_lague(pdf.target.to_numpy(), limit, seats)
        return pdf[["source", "quota"]]

    quotas = aims.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(to_sources, "source string, quota long")
    plan = scratch.keep(
        aims.join(quotas.select(F.col("source").alias("s"), "quota"), F.col("source").eqNullSafe(F.col("s")))
        .select("source", "source_size", "target", "quota", shards.alias("shards")), "plan")
    placed = scratch.keep(
        sized.join(plan, sized["source"].eqNullSafe(plan["source"]))
        .select("key", sized["source"], "size", "order", "source_size", "target", "quota",
                F.pmod(F.shiftright("order", 20), F.col("shards")).alias("shard")), "placed")

    def to_shards(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard").reset_index(drop=True)
        size = pdf.shard_size.to_numpy()
        quota = int(pdf.quota.iloc[0])
        got = sainte_lague(size, -(-size * epochs // block), quota)
        given = np.minimum(got * block, size * epochs)
        room = size * epochs - given  # what full shards leave of their last blocks goes to the others
        left = min(quota * block, int(size.sum()) * epochs) - given.sum()
        pdf["words"] = given + np.clip(left - (np.cumsum(room) - room), 0, room)
        return pdf[["source", "shard", "shard_size", "words"]]

    dealt = (placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota"))
             .groupBy("source").applyInPandas(to_shards, "source string, shard long, shard_size long, words long"))
    dealt = scratch.keep(dealt, "quotas")
    earlier = (Window.partitionBy("source", "shard").orderBy("order", F.col("key").asc_nulls_first(), "size")
               .rowsBetween(Window.unboundedPreceding, -1))
    laid = placed.withColumn("at", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    rounds = F.call_function("div", F.col("words"), F.greatest("shard_size", F.lit(1)))
    left = F.col("words") - rounds * F.col("shard_size") - F.col("at")
    return (laid.join(dealt.select(F.col("source").alias("s"), F.col("shard").alias("h"), "shard_size", "words"),
                      F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h")))
            .select("key", "source", "size", "source_size", "target", "shard", rounds.alias("rounds"),
                    F.greatest(F.lit(0), F.least(left, F.col("size"))).alias("part")))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, block: int = BLOCK_WORDS,
        seed: int = SEED) -> DataFrame:
    """``key``, size, source_size, target, taken of every row.

    Sources by code point, null as a source of its own and last, weigh
    ``weights`` in turn.  Null and empty texts have size 0 and nothing is taken;
    rows with equal keys are rows of their own; an empty table gives an empty
    result; a table without words takes nothing.  Other columns are not read.
    The result depends on the rows and the arguments alone.
    """
    laid = _laid(df, Scratch(df.sparkSession, "mixing"), key, text, source, weights, epochs, block, seed)
    return laid.select(F.col("key").alias(key), "size", "source_size", "target",
                       (F.col("rounds") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def mix_whole(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
              weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, block: int = BLOCK_WORDS,
              seed: int = SEED) -> DataFrame:
    """``key``, size, source_size, target, taken as in ``mix``, but each row is taken in whole copies.

    Of the documents that a source's shards take in part (one a shard), the
    largest first, each is taken once more if that brings the words so far nearer
    to what the parts before it and its own come to.  So a source's words differ
    from ``mix`` by at most half of the largest of these documents.
    """
    scratch = Scratch(df.sparkSession, "mixing")
    laid = scratch.keep(_laid(df, scratch, key, text, source, weights, epochs, block, seed), "laid")

    def to_copies(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "shard"], ascending=[False, True]).reset_index(drop=True)
        owed, more = 0, []
        for size, part in zip(pdf["size"].tolist(), pdf["part"].tolist(), strict=True):
            more.append(int(2 * (owed + part) >= size))
            owed += part - more[-1] * size
        pdf["more"] = more
        return pdf[["source", "shard", "more"]]

    parts = (laid.filter("0 < part AND part < size").select("source", "shard", "size", "part").groupBy("source")
             .applyInPandas(to_copies, "source string, shard long, more int"))
    parts = scratch.keep(parts, "parts")
    whole = F.when(F.col("part") < F.col("size"), F.col("more")).otherwise(F.lit(1))
    more = F.when(F.col("part") > 0, whole).otherwise(F.lit(0))
    return (laid.join(parts.select(F.col("source").alias("s"), F.col("shard").alias("h"), "more"),
                      F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h")), "left")
            .select(F.col("key").alias(key), "size", "source_size", "target",
                    ((F.col("rounds") + more) * F.col("size")).cast("long").alias("taken")))


def op10_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))

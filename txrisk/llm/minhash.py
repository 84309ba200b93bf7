"""MinHash near-dedup with HyperMinHash sketches.

A document's shingle hashes fall into buckets; a bucket keeps the leading-zero
count of its smallest hash and the mantissa bits after it: 16 bits instead of
64.  Bands of four such registers make the candidate keys.  A candidate pair's
registers give an estimate of the Jaccard similarity, corrected for registers
that agree by chance; only pairs that may reach the threshold are confirmed, on
their full shingle sets.

Copies (equal sets) are folded into one representative first.  In a bucket of
equal band keys every member is compared with one leader of the bucket, chosen
by a hash that differs from key to key, so a group of near copies costs one
pair per member and key.  Components of the confirmed links then tell which
buckets still hold members of different components.  There all members are
compared across components, block by block inside tasks that return links
only, so no link between different sets is lost to the leaders.  Every
decision uses whole sets; nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm.common import (LOWER, Scratch, bounded_batches, chunks, mix64, partitions, table, text_buffer,
                               word_hashes, words)
from txrisk.llm.components import connected_components

BUCKETS, BAND = 128, 4
BANDS = BUCKETS // BAND
MANTISSA_BITS = 10
#: Chance that one of two unrelated registers equals the other is about this over 2^MANTISSA_BITS
#: (a constant of the HyperMinHash analysis).
CHANCE = 0.169919487159739093975315012348
#: Standard deviations that an estimate may fall below the threshold before its pair is given up.
SIGMAS = 6.0
#: Members of a key that are compared with as many others in one task.
BLOCK = 256
#: Shingles that the sets of a block's members hold on average (a set beyond it is a block's own), 8 bytes each.
BLOCK_SHINGLES = 1 << 22


@dataclass(frozen=True)
class Similar:
    """Shingles of ``width`` words; linked if den * intersection >= num * union."""

    width: int = 5
    num: int = 80
    den: int = 100


def shingle_hashes(data: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each document (fewer words: the whole sequence as one)."""
    n = len(offs) - 1
    data = LOWER[data]
    start, end, doc = words(data, offs)
    h = word_hashes(data, start, end)
    first = np.searchsorted(doc, np.arange(n + 1))
    count = np.diff(first)
    factor = mix64(np.arange(1, width + 1, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
    rolled = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for j in range(width):
        rolled += h[j: j + len(rolled)] * factor[j]
    rolled = mix64(rolled)
    out = []
    for d in range(n):
        a, m = first[d], count[d]
        if m >= width:
            out.append(np.unique(rolled[a: a + m - width + 1]))
        elif m:
            whole = (h[a: a + m] * factor[:m]).sum(dtype=np.uint64) + np.uint64(m)
            out.append(mix64(np.array([whole ^ np.uint64(0x5851F42D4C957F2D)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """BUCKETS 16-bit registers of sorted distinct hashes; 0: no hash fell into the bucket."""
    out = np.zeros(BUCKETS, np.uint16)
    bits = BUCKETS.bit_length() - 1
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    lowest = np.flatnonzero(np.diff(bucket, prepend=-1))  # sorted: the smallest of its bucket
    rest = (hashes[lowest] << np.uint64(bits)).astype(np.float64)
    fraction, exponent = np.frexp(rest)
    zeros = np.minimum(64 - exponent, 62) + 1  # leading zeros, from 1 so that 0 stays for empty
    mantissa = np.minimum((fraction * 2 - 1) * (1 << MANTISSA_BITS), (1 << MANTISSA_BITS) - 1)
    out[bucket[lowest]] = (zeros << MANTISSA_BITS) | np.maximum(mantissa, 0).astype(np.int64)
    return out


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of register rows, and the buckets that either fills."""
    filled = (a > 0) | (b > 0)
    used = filled.sum(axis=1)
    same = ((a == b) & filled).sum(axis=1)
    ratio = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    by_chance = used * CHANCE / (1 << MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2
    room = np.maximum(used - by_chance, 1e-9)
    return np.clip((same - by_chance) / room, 0, 1), used


def may_reach(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs whose estimate is at most SIGMAS standard deviations below the threshold."""
    est, used = estimate(a, b, n, m)
    spread = np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1))
    return est >= threshold - SIGMAS * spread


def sketch(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(doc, n, f1, f2, regs): set size, a 128-bit fingerprint of the set, and its registers."""
    bounded_batches(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = shingle_hashes(*text_buffer(part.column("text")), width)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                    pa.array(np.array([mix64(s ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
                                       for s in sets], np.uint64).view(np.int64)),
                    pa.array([registers(s).tobytes() for s in sets], pa.binary())],
                    names=["doc", "n", "f1", "f2", "regs"])

    return (df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
            .mapInArrow(work, "doc long, n long, f1 long, f2 long, regs binary"))


def full_sets(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(doc, shingles): the sorted distinct shingle hashes as an array of longs."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = shingle_hashes(*text_buffer(part.column("text")), width)
                offs = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))],
                    names=["doc", "shingles"])

    return (df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
            .mapInArrow(work, "doc long, shingles array<long>"))


def _packed(regs: np.ndarray) -> np.ndarray:
    """Rows of BANDS 64-bit band values (0: all registers empty)."""
    return np.ascontiguousarray(regs).view(np.uint64).reshape(len(regs), BANDS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, band, doc, n) of every band that is not empty in all its registers."""
    for batch in batches:
        regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        packed = _packed(regs)
        row, band = np.nonzero(packed)
        keys = mix64(packed[row, band] ^ mix64(band.astype(np.uint64) + np.uint64(1)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), pa.array(band.astype(np.int32)),
             pa.array(batch.column("doc").to_numpy()[row]), pa.array(batch.column("n").to_numpy()[row])],
            names=["key", "band", "doc", "n"])


def _estimated(threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(len(batch), BUCKETS)
                    for c in ("regs_a", "regs_b"))
            ok = may_reach(a, b, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), threshold)
            yield batch.select(["a", "b"]).filter(pa.array(ok))
    return work


def _pairs_of(group: dict[str, np.ndarray], rule: Similar) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Likely pairs (positions) across components of one (key, left, right) group, in their first common band."""
    band = int(group["band"][0])
    one = np.flatnonzero(group["side"] == 0)
    two = one if group["left"][0] == group["right"][0] else np.flatnonzero(group["side"] == 1)
    packed, regs, n, c = _packed(group["regs"]), group["regs"], group["n"], group["c"]
    for lo in range(0, len(one), 64):
        i = one[lo: lo + 64]
        ok = c[i][:, None] != c[two][None, :]
        ok &= rule.den * np.minimum(n[i][:, None], n[two]) >= rule.num * np.maximum(n[i][:, None], n[two])
        if two is one:
            ok &= i[:, None] < two[None, :]
        r, k = np.nonzero(ok)
        a, b = i[r], two[k]
        if len(a) and band:
            earlier = ((packed[a, :band] == packed[b, :band]) & (packed[a, :band] > 0)).any(axis=1)
            a, b = a[~earlier], b[~earlier]
        if len(a):
            ok = may_reach(regs[a], regs[b], n[a], n[b], rule.num / rule.den)
            yield a[ok], b[ok]


def _links_of(group: dict, rule: Similar) -> list[tuple[int, int]]:
    """Confirmed links of a group; components that a link has joined are not compared again."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while top.get(x, x) != x:
            x = top[x]
        return x

    out = []
    doc, sets, c = group["doc"], group["shingles"], group["c"].tolist()
    for a, b in _pairs_of(group, rule):
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = root(c[i]), root(c[j])
            if x == y:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if rule.den * both >= rule.num * (len(sets[i]) + len(sets[j]) - both):
                top[max(x, y)] = min(x, y)
                out.append((int(min(doc[i], doc[j])), int(max(doc[i], doc[j]))))
    return out


def _compare(rule: Similar, confirm: bool):
    """Over rows sorted by (key, left, right): likely members (key, doc), or confirmed links (a, b)."""
    def done(parts: list[pa.RecordBatch]) -> tuple[list, list]:
        rows = pa.Table.from_batches(parts)
        group: dict = {c: rows.column(c).to_numpy() for c in ("band", "left", "right", "side", "doc", "n", "c")}
        if len(np.unique(group["c"])) < 2:
            return [], []
        group["regs"] = np.frombuffer(b"".join(rows.column("regs").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        if confirm:
            group["shingles"] = [np.asarray(x.values).view(np.uint64) for x in rows.column("shingles")]
            pairs = _links_of(group, rule)
            return [a for a, _ in pairs], [b for _, b in pairs]
        hit = [np.concatenate(p) for p in _pairs_of(group, rule)]
        docs = group["doc"][np.unique(np.concatenate(hit))] if hit else np.zeros(0, np.int64)
        return [rows.column("key")[0].as_py()] * len(docs), docs.tolist()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b"] if confirm else ["key", "doc"]
        held: list[pa.RecordBatch] = []
        last = None
        out: tuple[list, list] = ([], [])
        for batch in batches:
            ids = np.stack([batch.column(c).to_numpy() for c in ("key", "left", "right")], axis=1)
            edges = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi == lo:
                    continue
                this = tuple(ids[lo])
                if held and this != last:
                    for have, got in zip(out, done(held), strict=True):
                        have.extend(got)
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = this
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names)
                out = ([], [])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in done(held)], names=names)
    return work


class _Dedup:
    """The tables of one run."""

    def __init__(self, df: DataFrame, key: str, text: str, rule: Similar):
        self.df, self.key, self.text, self.rule = df, key, text, rule
        self.scratch = Scratch(df.sparkSession, "minhash")

    def sets_of(self, docs: DataFrame, name: str) -> DataFrame:
        """(doc, shingles) of the documents in ``docs`` (doc)."""
        own = F.col(self.key).cast("long")
        texts = (self.df.select(own.alias("d"), F.col(self.text).alias("t"))
                 .join(docs, F.col("d") == F.col("doc"), "left_semi"))
        return self.scratch.keep(full_sets(texts, "d", "t", self.rule.width), name)

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b: representatives) that the full sets confirm."""
        keep, rule = self.scratch.keep, self.rule
        regs = self.sets.select("doc", "regs", "n")
        side = lambda c: regs.select(F.col("doc").alias(c), F.col("regs").alias(f"regs_{c}"),
                                     F.col("n").alias(f"n_{c}"))
        likely = keep(pairs.join(side("a"), "a").join(side("b"), "b")
                      .mapInArrow(_estimated(rule.num / rule.den), "a long, b long"), "likely")
        ends = keep(likely.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "ends")
        full = self.sets_of(ends, "full")
        other = full.select(F.col("doc").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb")).cast("long")
        either = F.size("sa") + F.size("sb") - F.col("both")
        return keep(likely.join(full.select(F.col("doc").alias("a"), F.col("shingles").alias("sa")), "a")
                    .join(other, "b").withColumn("both", both)
                    .filter(rule.den * F.col("both") >= rule.num * either).select("a", "b").distinct(), "links")

    def open_rows(self, shared: DataFrame, groups: DataFrame) -> DataFrame:
        """Rows (key, band, doc, n, c: component) of the keys whose members lie in different components."""
        of = groups.select(F.col("node").alias("doc"), F.col("component").alias("c"))
        rows = self.scratch.keep(shared.join(of, "doc", "left")
                                 .select("key", "band", "doc", "n", F.coalesce("c", "doc").alias("c")), "placed")
        mixed = self.scratch.keep(
            rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"),
                                    F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
            .filter("lo < hi").select("key", "blocks"), "mixed")
        return self.scratch.keep(rows.join(mixed, "key"), "open")

    def led(self, shared: DataFrame) -> DataFrame:
        """Pairs (a, b) of each member and its key's leader."""
        lead = self.scratch.keep(
            shared.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "doc").alias("h"), "doc", "n")).alias("l"))
            .select("key", F.col("l.doc").alias("lead"), F.col("l.n").alias("lead_n")), "leads")
        sizes = self.rule.den * F.least("n", "lead_n") >= self.rule.num * F.greatest("n", "lead_n")
        return self.scratch.keep(
            shared.join(lead, "key").filter((F.col("doc") != F.col("lead")) & sizes)
            .select(F.least("doc", "lead").alias("a"), F.greatest("doc", "lead").alias("b")).distinct(), "led")

    def blocks(self, rows: DataFrame) -> DataFrame:
        """Each member with every block of its key: groups (key, left, right) of at most about 2 x BLOCK rows."""
        return (rows.withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")))
                .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
                .withColumn("left", F.least("own", "other")).withColumn("right", F.greatest("own", "other"))
                .withColumn("side", (F.col("own") > F.col("other")).cast("int")).drop("own", "other", "blocks")
                .repartition(partitions(self.df.sparkSession), "key", "left", "right")
                .sortWithinPartitions("key", "left", "right"))

    def across(self, rows: DataFrame) -> DataFrame:
        """Confirmed links (a, b) between different components inside keys, at least one for each two that link.

        First the registers tell which members have a likely partner at all;
        then these meet again with their full sets.  A pair is compared in its
        first common band only, and inside tasks; only links come out.
        """
        keep = self.scratch.keep
        regs = self.sets.select("doc", "regs")
        likely = keep(self.blocks(rows.join(regs, "doc"))
                      .mapInArrow(_compare(self.rule, False), "key long, doc long").distinct(), "likely-members")
        docs = keep(likely.select("doc").distinct(), "likely-docs")
        full = self.sets_of(docs, "likely-sets")
        again = rows.join(likely, ["key", "doc"]).join(regs, "doc").join(full, "doc")
        return keep(self.blocks(again).mapInArrow(_compare(self.rule, True), "a long, b long").distinct(), "across")

    def run(self) -> DataFrame:
        keep, rule = self.scratch.keep, self.rule
        rows = keep(sketch(self.df, self.key, self.text, rule.width), "sketches")
        ids = rows.filter("doc IS NOT NULL AND n > 0")
        self.sets = keep(ids.groupBy("n", "f1", "f2").agg(F.min("doc").alias("doc"), F.first("regs").alias("regs")),
                         "sets")
        bands = self.sets.select("doc", "n", "regs").mapInArrow(_bands, "key long, band int, doc long, n long")
        several = keep(bands.groupBy("key").count().filter("count > 1").select("key"), "keys")
        shared = keep(bands.join(several, "key"), "shared")
        links = self.confirmed(self.led(shared))
        groups = connected_components(links, self.scratch)
        more = self.across(self.open_rows(shared, groups))
        if not more.isEmpty():
            groups = connected_components(links.unionByName(more), self.scratch)
        return self.spread(rows, groups)

    def spread(self, rows: DataFrame, groups: DataFrame) -> DataFrame:
        """Each row's component by way of its set's representative."""
        found = (self.sets.select("n", "f1", "f2", F.col("doc").alias("rep"))
                 .join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left")
                 .select("n", "f1", "f2", F.coalesce("component", "rep").alias("component")))
        found = self.scratch.keep(found, "found")
        out = (rows.drop("regs").join(found, ["n", "f1", "f2"], "left")
               .select("doc", F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id")))
        return out.select(F.col("doc").alias(self.key), "n_shingles", "component_id",
                          F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text",
                    rule: Similar = Similar()) -> DataFrame:
    """``key``, n_shingles, component_id, kept: one row per row of ``df``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; fewer words than a
    shingle make one shingle of them all.  Null, empty and blank texts have no
    shingles, link with nothing and are kept.  Rows with a null id link with
    nothing (component null, kept).  Ids are expected to be unique; rows that
    repeat an id and a text get the same result.  An empty table gives an empty
    result; other columns are not read.
    """
    return _Dedup(df, key, text, rule).run()


def op1_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), rule=Similar(width=3, num=85))

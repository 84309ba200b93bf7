"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents longer than a sequence are cut into whole sequences, the remainder
first.  Pieces are placed by best-fit decreasing: longest first, each into the
open sequence with the least room that still holds it, which a segment tree over
the remaining capacities finds in logarithmic time.

Lengths are whole numbers up to the capacity, and pieces of one length are alike
to best fit.  So the packing depends on the histogram of lengths alone (at most
``capacity`` rows, whatever the table's size), and runs of equally filled
sequences are dealt with together.  A run that is used gives at most three: the
sequences filled as far as the length goes, one filled in part, and the rest; the
room of a filled one falls to less than half, so a run is used at most
log2(capacity) times.  The plan thus has at most about 3 * capacity *
log2(capacity) rows (67,000 for 2,048) and is broadcast; every piece finds its
place from its rank among the pieces of its length.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm.common import Scratch, arrow_batches, number_rows, table

#: Tokens of a sequence, and the id that ends each document.
CAPACITY, END_ID = 2048, 0
#: Fixed value: the vocabulary's special token, one id wherever a text holds it.
SPECIAL = "<|endoftext|>"


def default_vocabulary() -> tuple[str, str]:
    """Paths of the public byte-level vocabulary: as a ``tokenizers`` file and as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of texts, as ``tokenizers`` gives them for the vocabulary's file.

    Both files hold one vocabulary.  The ranks' reader is about four times as fast
    and gives the same ids (tests compare them); where its pattern matcher gives up
    (white space runs of about a million characters) the text goes through
    ``tokenizers`` itself.
    """

    def __init__(self, vocabulary: tuple[str, str]):
        import public_tokenizers
        import tiktoken

        self.file, ranks = vocabulary
        with open(ranks, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                      special_tokens={SPECIAL: len(ranks)})
        self.slow = None

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.file)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def cuts(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of ``n`` tokens: whole sequences, the remainder first."""
    first = n - (n - 1) // capacity * capacity
    return [0, *range(first, n, capacity)]


def pieces(df: DataFrame, key: str, text: str, capacity: int, end_id: int, vocabulary: tuple[str, str],
           with_ids: bool) -> DataFrame:
    """key, piece, start, length, ids_crc32 (and ids) of every piece of every document."""
    schema = "piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                tokens = np.append(encoder.ids(value.as_py() or ""), np.uint32(end_id)).astype("<u4")
                at = cuts(len(tokens), capacity)
                for j, (a, b) in enumerate(zip(at, [*at[1:], len(tokens)], strict=True)):
                    row.append(i)
                    piece.append(j)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(tokens[a:b].tobytes()))
                    if with_ids:
                        ids.append(tokens[a:b].astype(np.int32))
            out = [batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()),
                   pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                out.append(pa.array(ids, pa.list_(pa.int32())))
            names = ["key", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            yield pa.RecordBatch.from_arrays(out, names)

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, {schema}")


class Capacities:
    """Segment tree over the remaining capacities 0 .. ``most``: which of them some open sequence has."""

    def __init__(self, most: int):
        self.base = 1 << most.bit_length()
        self.any = bytearray(2 * self.base)

    def mark(self, room: int, there: bool) -> None:
        node = self.base + room
        self.any[node] = there
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] | self.any[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least ``least`` that some sequence has."""
        node = self.base + least
        if not self.any[node]:
            while node > 1 and (node % 2 or not self.any[node + 1]):
                node //= 2  # nothing to the right below this parent
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node = 2 * node + (not self.any[2 * node])
        return node - self.base


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces per sequence, offset) by length and rank.

    The pieces of a length from that rank on go into consecutive sequences from the
    first one, so many into each, one behind the other from the offset.
    """
    runs: list[deque] = [deque() for _ in range(capacity + 1)]
    tree = Capacities(capacity)
    moves, opened = [], 0

    def push(room: int, first: int, n: int, front: bool = False) -> None:
        if room and n:
            (runs[room].appendleft if front else runs[room].append)((first, n))
            tree.mark(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            else:
                first, n = runs[room].popleft()
                tree.mark(room, bool(runs[room]))
            each = room // length
            moves.append((length, rank, first, each, capacity - room))
            taken = min(left, n * each)
            full, rest = divmod(taken, each)
            push(room - each * length, first, full)
            used = full
            if rest:
                push(room - rest * length, first + full, 1)
                used += 1
            push(room, first + used, n - used, front=True)
            rank, left = rank + taken, left - taken
    moves.sort()
    return np.array(moves, np.int64).reshape(-1, 5)


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
         vocabulary: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """``key``, piece, start, length, ids_crc32, (ids,) sequence_id, offset of every piece.

    Null and empty texts are documents of one token, ``end_id``.  Repeated rows are
    documents of their own; rows with a null key are packed like others.  Equal
    lengths take their places by key (null first), piece and checksum, so reruns
    agree.  An empty table gives an empty result.  Other columns are not read.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = df.sparkSession
    scratch = Scratch(spark, "packing")
    with arrow_batches(spark):
        cut = scratch.keep(pieces(df, key, text, capacity, end_id, vocabulary or default_vocabulary(), with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = spark.sparkContext.broadcast(best_fit_decreasing(counts, capacity))
    ranked = number_rows(cut, scratch, ["length"], [F.col("key").asc_nulls_first(), F.col("piece"), F.col("ids_crc32")])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length, rank, first, each, offset = plan.value.T
        mark = (length << 44) + rank
        for pdf in batches:
            size, at = pdf["length"].to_numpy(), pdf["pos"].to_numpy()
            move = np.searchsorted(mark, (size << 44) + at, "right") - 1
            in_bin, slot = np.divmod(at - rank[move], each[move])
            pdf["sequence_id"] = first[move] + in_bin
            pdf["offset"] = offset[move] + slot * size
            yield pdf.drop(columns=["pos", "total"])

    names = [F.col("key").alias(key), *cut.columns[1:], "sequence_id", "offset"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInPandas(place, schema + ", sequence_id long, offset long").select(*names)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids of every sequence, from pieces packed ``with_ids``; a sequence is a bounded group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
            .select("sequence_id", "n_tokens", F.flatten(F.col("parts.ids")).alias("ids")))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

Every byte covered by a ``length``-byte string that also starts earlier is
removed.  A string's place in the sort is its anchor: of its 64 grams (length
minus 63 bytes each) the one with the smallest hash, the leftmost of equals.
The anchor depends on the string's bytes alone, so equal strings have equal
anchors at equal offsets, and only the suffixes at anchors, about one in 32,
need sorting.

1. Grams.  Each task finds its documents' anchors and sends one row per distinct
   gram hash; grams that occur once in the whole table drop out.
2. Runs.  The suffixes at the other anchors are cut from the texts and sorted.
   Strings that a task has already seen earlier are decided there; the rest go
   out as front-coded sorted runs (common prefix length and tail), range
   partitioned by sampled grams.
3. Merge.  A loser tree merges the runs of a range.  Its comparisons start at the
   prefix lengths known from the runs and from earlier comparisons, and yield the
   common prefix of each suffix with the one before it.
4. Decision.  Strings at offset o of their anchors are equal if their suffixes
   share length - o bytes (from 3) and the bytes before share o (the same for
   reversed contexts).  All but the first in document order are repeats.

A gram that very many places share (a passage in a third of all documents) is
spread over ranges: its strings are sorted as suffixes of their own, by all of
their bytes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm.common import (_BYTE_VALUES, Scratch, bounded_batches, chunks, partitions, powers, table,
                               text_buffer)

#: Offsets that an anchor serves, position bits packed under a gram's hash, bytes of a scanned segment.
OFFSETS, POSITION_BITS, SEGMENT = 64, 26, 1 << 22
#: Anchors held before they are sent, records of a run, documents sampled for the ranges, least hot count.
ANCHORS_HELD, RUN_RECORDS, SAMPLED_DOCUMENTS, LEAST_HOT = 400_000, 50_000, 2000, 4096
SCAN_BYTES = 256 << 10
WHOLE = 1 << 60  # the end of a span that covers a whole document

_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_INVERSE_POWERS = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _INVERSE_POWERS
    if len(_INVERSE_POWERS) < n:
        p = np.full(1 << (n - 1).bit_length(), _INVERSE, dtype=np.uint64)
        p[0] = 1
        _INVERSE_POWERS = np.multiply.accumulate(p)
    return _INVERSE_POWERS[:n]


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each ``size`` bytes of a buffer."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    upto = np.empty(len(data) + 1, np.uint64)
    upto[0] = 0
    np.cumsum(_BYTE_VALUES[data] * powers(len(data)), out=upto[1:])
    h = (upto[size:] - upto[:n]) * _inverse_powers(n)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h


def anchors(data: np.ndarray, offs: np.ndarray, length: int
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, gram hash, lowest and highest offset) of every anchor of the documents in a buffer.

    An anchor at a serves the strings that start at a - highest .. a - lowest.
    """
    empty = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint8))
    if len(data) < length:
        return empty
    h = gram_hashes(data, length - OFFSETS + 1)
    mask = np.uint64((1 << POSITION_BITS) - 1)
    low = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while step < OFFSETS:  # the smallest of 64 neighbours by doubling
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    fits = np.zeros(len(data) + 1, np.int32)  # strings that end inside their document
    first, last = offs[:-1], offs[1:] - length + 1
    some = last > first
    np.add.at(fits, first[some], 1)
    np.add.at(fits, last[some], -1)
    start = np.flatnonzero(np.cumsum(fits[: len(low)]) > 0)
    if not len(start):
        return empty
    at = (low[start] & mask).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(start)) - 1
    at = at[head]
    return at, h[at], (at - start[tail]).astype(np.uint8), (at - start[head]).astype(np.uint8)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed bytes, byte planes apart."""
    n = len(arrays[0])
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(n, -1).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    width = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(width), 0, []
    for k, w in zip(kinds, width, strict=True):
        out.append(np.ascontiguousarray(raw[at: at + n * w].reshape(w, n).T).view(k).reshape(n))
        at += n * w
    return out


def _by_document(doc: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(doc, kind="stable")
    edges = np.flatnonzero(np.diff(doc[order])) + 1
    for rows in np.split(order, edges):
        if len(rows):
            yield int(doc[rows[0]]), [a[rows] for a in arrays]


_SENT = pa.schema([("slot", pa.int64()), ("doc", pa.int64()), ("blob", pa.binary())])
_FOUND = pa.schema([("doc", pa.int64()), ("blob", pa.binary()), ("gram", pa.int64())])
_ANCHOR = (np.int64, np.uint8, np.uint8)  # position, lowest, highest offset
_GRAM = (np.uint64, np.int64, *_ANCHOR, np.uint32)  # hash, document, anchor, places


def _scan(length: int, slots: int):
    """Task side of step 1: rows (slot, null, grams) to count, and (slot, document, anchors) already repeated."""
    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, doc, pos, lo, hi = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h, kind="stable")
        h, doc, pos, lo, hi = h[order], doc[order], pos[order], lo[order], hi[order]
        head = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        places = np.diff(np.append(head, len(h)))
        slot = ((h[head] >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
        rows: list[tuple] = []
        for s, (rep, n) in _by_document(slot, head, places):
            rows.append((s, None, _pack(h[rep], doc[rep], pos[rep], lo[rep], hi[rep], n.astype(np.uint32))))
        again = np.repeat(places > 1, places)
        for d, parts in _by_document(doc[again], pos[again], lo[again], hi[again]):
            rows.append((d % slots, d, _pack(*parts)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)],
                                         schema=_SENT)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in chunks(batch, "text", SCAN_BYTES):
                data, offs = text_buffer(part.column("text"))
                ids = part.column("doc").to_numpy()
                for lo in range(0, max(1, len(data)), SEGMENT):  # a long document goes by overlapping segments
                    cut = offs if len(offs) > 2 else np.array([0, min(len(data) - lo, SEGMENT + length - 1)])
                    seen = data if len(offs) > 2 else data[lo: lo + SEGMENT + length - 1]
                    pos, h, low, high = anchors(seen, cut, length)
                    which = np.searchsorted(cut, pos, "right") - 1
                    held.append((h, ids[which], pos - cut[which] + lo, low, high))
                    n += len(h)
                    if len(offs) > 2:
                        break
                if n >= ANCHORS_HELD:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)
    return work


def _count(hot: int):
    """Receiving side of step 1: anchors of grams that occur elsewhere too, and the hashes of hot grams."""
    def counted(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        h, doc, pos, lo, hi, places = (np.concatenate(x) for x in zip(*(_unpack(b, *_GRAM) for b in blobs), strict=True))
        order = np.argsort(h, kind="stable")
        head = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
        size = np.diff(np.append(head, len(h)))
        total = np.add.reduceat(places[order].astype(np.int64), head)
        rows: list[tuple] = [(None, None, int(x)) for x in h[order][head[total > hot]].view(np.int64)]
        # a place that its task already knew as repeated was sent at once
        take = order[np.repeat(size > 1, size)]
        take = take[places[take] == 1]
        rows += [(d, _pack(*parts), None) for d, parts in _by_document(doc[take], pos[take], lo[take], hi[take])]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held = None, []  # the grams of one slot, which come together: all places of each of them
        for batch in batches:
            docs, blobs, slots = batch.column("doc"), batch.column("blob"), batch.column("slot").to_pylist()
            direct = pa.array([i for i in range(len(batch)) if docs[i].is_valid], pa.int64())
            yield pa.RecordBatch.from_arrays([docs.take(direct), blobs.take(direct), pa.nulls(len(direct), pa.int64())],
                                             schema=_FOUND)
            for i in range(len(batch)):
                if not docs[i].is_valid:
                    if slots[i] != slot and held:
                        done, held = held, []
                        yield from counted(done)
                    slot = slots[i]
                    held.append(blobs[i].as_py())
        if held:
            yield from counted(held)
    return work


class Records:
    """Suffixes at anchors with their contexts, growing; arrays once sorted."""

    def __init__(self):
        self.right: list[bytes] = []  # from the anchor on
        self.left: list[bytes] = []  # before the anchor, reversed
        self.doc: list[int] = []
        self.pos: list[int] = []
        self.mask: list[int] = []  # bit o: the string at offset o is still open

    def __len__(self) -> int:
        return len(self.right)

    def add(self, doc: int, text: bytes, at: int, lo: int, hi: int, length: int, alone: bool) -> None:
        """alone: each string as a suffix of its own."""
        if alone:
            for o in range(lo, hi + 1):
                self._put(text[at - o: at - o + length], b"", doc, at - o, 1)
        else:
            self._put(text[at: at + length - lo], text[at - hi: at][::-1], doc, at,
                      (1 << hi + 1) - (1 << lo))

    def _put(self, right: bytes, left: bytes, doc: int, pos: int, mask: int) -> None:
        self.right.append(right)
        self.left.append(left)
        self.doc.append(doc)
        self.pos.append(pos)
        self.mask.append(mask)


def common_prefixes(strings: list[bytes], width: int) -> np.ndarray:
    """Common prefix length of each string with the one before it (the first: 0)."""
    n = len(strings)
    out = np.zeros(n, np.int64)
    size = np.array([len(s) for s in strings], np.int64)
    for lo in range(0, n, 1 << 15):
        part = strings[max(lo - 1, 0): lo + (1 << 15)]
        m = np.frombuffer(b"".join([s.ljust(width, b"\0") for s in part]), np.uint8).reshape(len(part), width)
        differ = m[1:] != m[:-1]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        at = np.arange(max(lo - 1, 0) + 1, max(lo - 1, 0) + len(part))
        out[at] = np.minimum(same, np.minimum(size[at], size[at - 1]))
    return out


def repeats(shared: np.ndarray, left: list[bytes], doc: np.ndarray, pos: np.ndarray, mask: np.ndarray,
            length: int) -> np.ndarray:
    """Bits of the strings that also start earlier, for records in the order of their right contexts.

    ``shared``: common prefix with the record before.  Rows of one (document,
    position) are one place.
    """
    n = len(doc)
    again = np.zeros(n, np.uint64)
    by_left = sorted(range(n), key=left.__getitem__)
    left_shared = common_prefixes([left[i] for i in by_left], OFFSETS)
    by_left = np.array(by_left, np.int64)
    order = np.lexsort((pos, doc))
    step = np.ones(n, np.int64)
    step[1:] = (doc[order][1:] != doc[order][:-1]) | (pos[order][1:] != pos[order][:-1])
    place = np.empty(n, np.int64)
    place[order] = np.cumsum(step)
    for o in range(OFFSETS):
        bit = np.uint64(1 << o)
        own = order[(mask[order] & bit) > 0]  # in document order
        if len(own) < 2:
            continue
        right_class = np.cumsum(shared < length - o)
        left_class = np.empty(n, np.int64)
        left_class[by_left] = np.cumsum(left_shared < o)
        key = right_class[own] * np.int64(n + 1) + (left_class[own] if o else 0)
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        late = place[own] != place[own[first]][inverse]
        again[own[late]] |= bit
    return again


def _span_rows(doc: np.ndarray, pos: np.ndarray, bits: np.ndarray, length: int) -> Iterator[tuple[int, bytes]]:
    """(document, spans) of repeated strings: [start, end) pairs, joined where they meet."""
    some = bits > 0
    doc, pos, bits = doc[some], pos[some], bits[some]
    starts, ends, whose = [], [], []
    before = bits & ~(bits << np.uint64(1))  # lowest bits of runs of offsets
    after = bits & ~(bits >> np.uint64(1))
    for o in range(OFFSETS):
        for edge, out, add in ((after, starts, 0), (before, ends, length)):
            hit = np.flatnonzero(edge >> np.uint64(o) & np.uint64(1))
            out.append(np.stack([hit, pos[hit] - o + add]))
    if not len(doc):
        return
    s, e = (np.concatenate(x, axis=1) for x in (starts, ends))
    s, e = s[:, np.lexsort((s[1], s[0]))], e[:, np.lexsort((e[1], e[0]))]
    whose = doc[s[0]]
    for d, (a, b) in _by_document(whose, s[1], e[1]):
        yield d, _pack(*join_spans(a, b))


def join_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching [start, end)."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    return start[new], end[np.append(np.flatnonzero(new)[1:], len(start)) - 1]


_RUN = "slot long, doc long, blob binary"


def _encode_run(right: list[bytes], left: list[bytes], shared: np.ndarray, doc: np.ndarray, pos: np.ndarray,
                mask: np.ndarray) -> bytes:
    """A front-coded sorted run."""
    tails = [r[c:] for r, c in zip(right, shared.tolist(), strict=True)]
    head = _pack(doc, pos, mask, shared.astype(np.uint8), np.array([len(t) for t in tails], np.uint8),
                 np.array([len(x) for x in left], np.uint8))
    body = zstandard.ZstdCompressor(level=1).compress(b"".join(tails) + b"".join(left))
    return len(head).to_bytes(8, "little") + head + body


def _decode_run(blob: bytes) -> tuple:
    n = int.from_bytes(blob[:8], "little")
    doc, pos, mask, shared, tail, left = _unpack(blob[8: 8 + n], np.int64, np.int64, np.uint64, np.uint8,
                                                 np.uint8, np.uint8)
    body = zstandard.ZstdDecompressor().decompress(blob[8 + n:])
    right, before, at = [], b"", 0
    for c, t in zip(shared.tolist(), tail.tolist(), strict=True):
        before = before[:c] + body[at: at + t]
        right.append(before)
        at += t
    lefts = []
    for t in left.tolist():
        lefts.append(body[at: at + t])
        at += t
    return right, lefts, shared.tolist(), doc, pos, mask


def merge_runs(runs: list[list[bytes]], shared: list[list[int]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Loser tree over sorted runs: (run, place) in order, and each one's common prefix with the one before.

    A head's ``known`` is its common prefix with the last winner.  Of two heads
    the one with more in common with it is smaller, and the other's length stays;
    only heads with equal lengths are compared, from that length on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    place = [0] * k
    head: list[bytes | None] = [r[0] if r else None for r in runs] + [None] * (k - len(runs))
    known = [0] * k
    losers = [0] * k

    def beats(a: int, b: int) -> bool:
        """Does head a come before head b?  Leaves the loser's length towards the winner."""
        x, y = head[a], head[b]
        if y is None:
            return True
        if x is None:
            return False
        h, g = known[a], known[b]
        if h != g:
            return h > g
        n = min(len(x), len(y))
        while h + 16 <= n and x[h: h + 16] == y[h: h + 16]:
            h += 16
        while h < n and x[h] == y[h]:
            h += 1
        if h == len(x) or (h < n and x[h] < y[h]):
            known[b] = h
            return True
        known[a] = h
        return False

    winners = [0] * (2 * k)
    for i in range(k):
        winners[k + i] = i
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        if beats(a, b):
            winners[node], losers[node] = a, b
        else:
            winners[node], losers[node] = b, a
    best = winners[1] if k > 1 else 0
    order, lengths = [], []
    while head[best] is not None:
        order.append((best, place[best]))
        lengths.append(known[best])
        place[best] += 1
        i = place[best]
        if i < len(runs[best]):
            head[best], known[best] = runs[best][i], shared[best][i]
        else:
            head[best] = None
        node = (k + best) >> 1
        while node:
            other = losers[node]
            if not beats(best, other):
                losers[node], best = best, other
            node >>= 1
    return order, lengths


def _make_runs(length: int, splitters: list[bytes], hot: frozenset[int], slots: int):
    """Task side of step 2: (slot, document, spans) decided here, and (range, null, front-coded run)."""
    size = length - OFFSETS + 1

    def flush(r: Records) -> Iterator[tuple]:
        order = sorted(range(len(r)), key=r.right.__getitem__)
        right, left = [r.right[i] for i in order], [r.left[i] for i in order]
        doc, pos = (np.array(x, np.int64)[order] for x in (r.doc, r.pos))
        mask = np.array(r.mask, np.uint64)[order]
        again = repeats(common_prefixes(right, length), left, doc, pos, mask, length)
        for d, blob in _span_rows(doc, pos, again, length):
            yield d % slots, d, blob
        mask &= ~again
        keep = np.flatnonzero(mask)
        # a normal suffix goes by its gram, so that equal grams meet; one string by all its bytes
        to = np.array([bisect_right(splitters, right[i] if not left[i] and len(right[i]) == length and mask[i] == 1
                                    and _is_hot(right[i], size, hot, length) else right[i][:size])
                       for i in keep.tolist()], np.int64)
        for s, (rows,) in _by_document(to, keep):
            some = rows.tolist()
            rs = [right[i] for i in some]
            yield s, None, _encode_run(rs, [left[i] for i in some], common_prefixes(rs, length), doc[rows],
                                       pos[rows], mask[rows])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = Records()

        def sent(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)

        for batch in batches:
            for row in range(len(batch)):
                text = batch.column("text")[row].as_py().encode("utf-8")
                doc = batch.column("doc")[row].as_py()
                raw = np.frombuffer(text, np.uint8)
                for blob in batch.column("blobs")[row].as_py():
                    at, lo, hi = _unpack(blob, *_ANCHOR)
                    alone = np.zeros(len(at), bool)
                    if hot:
                        grams = raw[at[:, None] + np.arange(size)]
                        alone = np.isin(_gram_values(grams), np.array(sorted(hot), np.int64))
                    for a, low, high, own in zip(at.tolist(), lo.tolist(), hi.tolist(), alone.tolist(), strict=True):
                        records.add(doc, text, a, low, high, length, own)
                    if len(records) >= RUN_RECORDS:
                        if rows := list(flush(records)):
                            yield sent(rows)
                        records = Records()
        if len(records) and (rows := list(flush(records))):
            yield sent(rows)
    return work


def _gram_values(grams: np.ndarray) -> np.ndarray:
    """Hashes of gram rows, as ``gram_hashes`` gives them, as signed longs."""
    n, size = grams.shape
    if not n:
        return np.zeros(0, np.int64)
    return np.concatenate([gram_hashes(g, size) for g in grams]).view(np.int64)


def _is_hot(string: bytes, size: int, hot: frozenset[int], length: int) -> bool:
    """Is the anchor of a whole string a hot gram?"""
    if not hot:
        return False
    _, h, _, _ = anchors(np.frombuffer(string, np.uint8), np.array([0, length]), length)
    return int(h.view(np.int64)[0]) in hot


def _merge(length: int):
    """Receiving side of steps 2 to 4: spans decided by the senders, and those of the merged ranges."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "blob"]
        slot, held = None, []  # the runs of one range, which come together

        def merged(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            runs = [_decode_run(b) for b in blobs]
            order, shared = merge_runs([r[0] for r in runs], [r[2] for r in runs])
            base = np.cumsum([0, *(len(r[0]) for r in runs)])
            at = np.array([base[r] + i for r, i in order], np.int64)
            left = [x for r in runs for x in r[1]]
            doc, pos, mask = (np.concatenate([r[c] for r in runs])[at] for c in (3, 4, 5))
            del runs, order
            again = repeats(np.array(shared, np.int64), [left[i] for i in at.tolist()], doc, pos, mask, length)
            rows = list(_span_rows(doc, pos, again, length))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()),
                                                  pa.array([b for _, b in rows], pa.binary())], names=names)

        for batch in batches:
            docs, blobs, slots = batch.column("doc"), batch.column("blob"), batch.column("slot").to_pylist()
            direct = pa.array([i for i in range(len(batch)) if docs[i].is_valid], pa.int64())
            yield pa.RecordBatch.from_arrays([docs.take(direct), blobs.take(direct)], names=names)
            for i in range(len(batch)):
                if not docs[i].is_valid:
                    if slots[i] != slot and held:
                        done, held = held, []
                        yield from merged(done)
                    slot = slots[i]
                    held.append(blobs[i].as_py())
        if held:
            yield from merged(held)
    return work


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """(doc, spans: array of blobs) of every document that loses bytes; see ``cut_repeats``."""
    if not OFFSETS + 16 <= length <= 255:
        raise ValueError(f"length must lie between {OFFSETS + 16} and 255")
    spark = df.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "suffix")
    docs = df.filter(F.col(key).isNotNull() & (F.octet_length(F.col(text)) >= length)).select(
        F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    # copies of a whole earlier document are covered from end to end
    sums = scratch.keep(docs.select("doc", F.octet_length("text").cast("long").alias("n"),
                                    F.sha2("text", 256).alias("sha")), "sums")
    firsts = scratch.keep(sums.groupBy("sha", "n").agg(F.min("doc").alias("first")), "firsts")
    copies = scratch.keep(sums.join(firsts, ["sha", "n"]).filter("doc > first").select("doc").distinct(), "copies")
    known = sums.agg(F.sum("n").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    parts = partitions(spark)
    slots = 4 * parts
    hot_count = max(LEAST_HOT, (known["bytes"] or 0) // 32 // (4 * parts))

    found = scratch.keep(
        docs.mapInArrow(_scan(length, slots), "slot long, doc long, blob binary")
        .repartition(parts, "slot").sortWithinPartitions("slot")
        .mapInArrow(_count(hot_count), "doc long, blob binary, gram long"), "found")
    # at most one gram per hot_count anchors, so at most about 4 per partition
    hot = frozenset(r.gram for r in found.filter("gram IS NOT NULL").select("gram").collect())
    anchors_of = scratch.keep(
        found.filter("doc IS NOT NULL").join(copies, "doc", "left_anti")
        .groupBy("doc").agg(F.collect_list("blob").alias("blobs")), "anchors")
    splitters = _splitters(docs, anchors_of, known["n"], parts, length)
    runs = (docs.join(anchors_of, "doc").select("doc", "text", "blobs")
            .mapInArrow(_make_runs(length, splitters, hot, slots), _RUN))
    # sorted by range (above: by slot), so that a task holds the runs of one at a time
    spans = scratch.keep(runs.repartition(parts, "slot").sortWithinPartitions("slot")
                         .mapInArrow(_merge(length), "doc long, blob binary"), "spans")
    whole = copies.select("doc", F.lit(_pack(np.array([0], np.int64), np.array([WHOLE], np.int64))).alias("blob"))
    return scratch.keep(spans.unionByName(whole).groupBy("doc").agg(F.collect_list("blob").alias("spans")), "cuts")


def _splitters(docs: DataFrame, anchors_of: DataFrame, n: int, parts: int, length: int) -> list[bytes]:
    """At most parts - 1 range bounds: quantiles of the grams of a bounded sample of documents.

    They balance the ranges; results do not depend on them.
    """
    share = max(1, (n or 0) // SAMPLED_DOCUMENTS)
    size = length - OFFSETS + 1

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(len(batch)):
                text = batch.column("text")[row].as_py().encode("utf-8")
                at = np.concatenate([_unpack(b, *_ANCHOR)[0] for b in batch.column("blobs")[row].as_py()])
                out += [text[a: a + size] for a in at[:: max(1, len(at) // 32)].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["gram"])

    sample = lambda d: d.filter(F.pmod(F.xxhash64("doc", F.lit("sample")), F.lit(share)) == 0)
    # about SAMPLED_DOCUMENTS documents, at most 63 grams each
    # a gram counts once, as a run holds equal strings once
    got = sorted({bytes(r.gram) for r in sample(docs).join(sample(anchors_of), "doc").select("text", "blobs")
                 .mapInArrow(grams, "gram binary").collect()})
    return sorted({got[len(got) * i // parts] for i in range(1, parts)}) if got else []


def spans_of(blobs: list[bytes] | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs of a document of n bytes."""
    if not blobs:
        z = np.zeros(0, np.int64)
        return z, z
    parts = [_unpack(b, np.int64, np.int64) for b in blobs]
    start, end = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    return join_spans(start, np.minimum(end, n))


def cut_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100,
                kept: str = "kept_text") -> DataFrame:
    """All columns of ``df``, and n_bytes, n_removed, n_spans, kept_sha256, ``kept``.

    A text's UTF-8 bytes covered by a ``length``-byte string that also starts
    earlier (smaller id, or the same document and an earlier start) are removed;
    strings never cross documents and are judged on the input.  ``kept`` is what
    is left as text, without the pieces of cut characters; the digest covers the
    remaining bytes themselves.  Null texts count as empty.  Rows with a null id
    take no part and stay whole.  Ids are expected to be unique; rows that repeat
    id and text are one document.  An empty table gives an empty result.  New
    columns must not clash with those of ``df``.
    """
    fields = df.schema.fields
    if clash := {"n_bytes", "n_removed", "n_spans", "kept_sha256", kept, "_cut_doc", "_cut"} & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    bounded_batches(df.sparkSession)
    cuts = repeated_spans(df, key, text, length).select(F.col("doc").alias("_cut_doc"), F.col("spans").alias("_cut"))
    joined = df.join(cuts, F.col(key).cast("long") == F.col("_cut_doc"), "left").drop("_cut_doc")
    names = [f.name for f in fields]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for value, blobs in zip(batch.column(text), batch.column("_cut"), strict=True):
                raw = (value.as_py() or "").encode("utf-8")
                start, end = spans_of(blobs.as_py(), len(raw))
                edges = [0, *np.stack([start, end], axis=1).ravel().tolist(), len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if len(start) else raw
                out.append((len(raw), len(raw) - len(left), len(start), hashlib.sha256(left).hexdigest(),
                            left.decode("utf-8", "ignore")))
            n, removed, spans, sha, back = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())],
                names=[*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", kept])

    schema = df.schema
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"),
                       (kept, "string")):
        schema = type(schema)([*schema.fields]).add(name, kind)
    return joined.mapInArrow(work, schema)


def op3_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cut_repeats(docs).drop("text", "kept_text")

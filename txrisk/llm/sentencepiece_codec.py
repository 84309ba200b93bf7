"""SentencePiece BPE encoding and decoding by a prefix table.

The merge-type encoding of a text's prefix never changes when the text goes
on, as long as it ends at a token boundary of that prefix; so every prefix
has one last token.  A left-to-right table stores it: an automaton finds all
pieces that end at a position, and the one whose predecessor (the last token
of the prefix before it) stays unmerged next to it is the one.  Reading the
table backwards gives the ids.

Two pieces stay unmerged next to each other exactly if encoding their joined
text alone gives the same two pieces (merges inside a part never depend on what
lies beyond an unmerged boundary).  Pairs are tested once and remembered.

A piece never holds the space mark after another character and none holds a
line feed, so texts are cut at these places first; each cut part is encoded
on its own, and a bounded table remembers parts already encoded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from txrisk.llm.common import bounded_batches, table

MARK = "▁"
#: Entries that a Python worker remembers, at most: encoded parts and tested pairs.
PART_ENTRIES, PAIR_ENTRIES, PART_LENGTH = 300_000, 600_000, 48


def read_vocabulary(path: str) -> dict:
    """Pieces, scores and byte ids of a BPE model file (read on the driver)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.vocab_size())
    pieces = [sp.id_to_piece(i) for i in ids]
    normal = {pieces[i]: (i, sp.get_score(i)) for i in ids
              if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))}
    as_bytes = {int(pieces[i][3:-1], 16): i for i in ids if sp.is_byte(i)}
    if len(as_bytes) != 256:
        raise ValueError("the model needs byte pieces for characters outside its vocabulary")
    if any(MARK in p.lstrip(MARK) or "\n" in p for p in normal):
        raise ValueError("a piece crosses a space mark or a line feed")
    return {"normal": normal, "bytes": as_bytes, "size": len(pieces)}


class Codec:
    """Encoder and decoder of one vocabulary, kept by a Python worker."""

    def __init__(self, vocabulary: dict):
        import ahocorasick

        self.pieces: dict[str, tuple[int, float]] = vocabulary["normal"]
        self.byte_ids: dict[int, int] = vocabulary["bytes"]
        self.id_bytes = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.id_piece = {i: p for p, (i, _) in self.pieces.items()}
        self.automaton = ahocorasick.Automaton()
        for piece, (i, _) in self.pieces.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.parts: dict[str, str] = {}
        # by the id as text; marks are spaces, bytes below 0x80 are characters
        self.texts = {str(i): p.replace(MARK, " ") for i, p in self.id_piece.items()}
        self.texts |= {str(i): chr(b) for b, i in self.byte_ids.items() if b < 0x80}

    # -- pair compatibility ------------------------------------------------
    def _merged(self, text: str) -> list[str]:
        """Merge-type encoding of a short text: best score first, then leftmost."""
        parts = list(text)
        pieces = self.pieces
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                found = pieces.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found[1] > best):
                    best, where = found[1], i
            if where < 0:
                break
            parts[where: where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def _stay_apart(self, left: int, right: int) -> bool:
        """left: an id, or -1 for the start of the text."""
        b = self.id_piece[right]
        if left < 0:
            return self._merged(b) == [b]
        a = self.id_piece[left]
        return self._merged(a + b) == [a, b]

    # -- encoding ----------------------------------------------------------
    def encode_part(self, text: str) -> list[int]:
        """Ids of a text that holds the marks already."""
        n = len(text)
        last: list[int] = [-1] + [-2] * n  # the last token of each prefix; -2: a character outside
        size = [0] + [1] * n
        pairs = self.pairs
        if len(pairs) > PAIR_ENTRIES:
            pairs.clear()
        done = 0
        for end, (length, i) in self.automaton.iter(text):
            end += 1
            if end <= done:  # this prefix has its token
                continue
            left = last[end - length]
            if left == -2:  # nothing merges across a character outside the vocabulary
                left = -1
            key = (left + 1) << 32 | i
            fits = pairs.get(key)
            if fits is None:
                fits = pairs[key] = self._stay_apart(left, i)
            if fits:
                last[end], size[end], done = i, length, end
        out: list[int] = []
        at = n
        while at:
            i = last[at]
            if i == -2:
                out.extend(self.byte_ids[b] for b in reversed(text[at - 1].encode("utf-8")))
            else:
                out.append(i)
            at -= size[at]
        out.reverse()
        return out

    def decode(self, ids: list[str]) -> str:
        """Text of ids (as decimal texts), without the space before the first word.

        Runs of byte ids are read as UTF-8, broken ones give U+FFFD.
        """
        texts = self.texts
        try:
            out = "".join([texts[i] for i in ids])
        except KeyError:  # bytes of longer characters
            raw = b"".join([self.id_bytes[int(i)] if int(i) in self.id_bytes else texts[i].encode("utf-8")
                            for i in ids])
            out = raw.decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out

    def _part(self, text: str) -> str:
        found = ",".join(map(str, self.encode_part(text)))
        if len(text) <= PART_LENGTH:
            if len(self.parts) >= PART_ENTRIES:
                self.parts.clear()
            self.parts[text] = found
        return found

    def forget(self) -> None:
        """Drops what was remembered: a reused worker keeps no memory from task to task."""
        self.parts.clear()
        self.pairs.clear()

    def cut(self, text: str) -> list[str]:
        """The parts of a text that are encoded on their own, marks and line feeds included."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return _CUTS.findall(marked)

    def run(self, text: str) -> tuple[list[str], str, str]:
        """(ids as decimal texts, the same joined by commas, decoded text) of a whole text."""
        known = self.parts
        joined = ",".join([known.get(p) or self._part(p) for p in self.cut(text)])
        ids = joined.split(",") if joined else []
        return ids, joined, self.decode(ids)


#: Parts: a line feed alone, or marks and what follows up to the next mark or line feed.
_CUTS = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")

_CODECS: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    """This worker's codec of a broadcast vocabulary (kept between tasks)."""
    name, vocabulary = shared.value
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = Codec(vocabulary)
    return _CODECS[name]


def _shared_vocabulary(spark: SparkSession, model: str):
    """Broadcast of the vocabulary: as many entries as the model has pieces, whatever the data."""
    vocabulary = read_vocabulary(model)
    name = hashlib.sha256(repr(sorted(vocabulary["normal"].items())).encode()).hexdigest()
    return spark.sparkContext.broadcast((name, vocabulary))


def encode_decode(df: DataFrame, model: str, key: str = "doc_id", text: str = "text",
                  outputs: tuple[str, ...] = ()) -> DataFrame:
    """``key``, n_tokens, ids_sha256, decoded_sha256 and ``outputs`` (ids, decoded) of every row.

    Encodes whole texts without begin and end ids and decodes the ids again.
    Null and empty texts have no ids and decode to the empty text; keys may be
    null or repeat, each row has its own result; an empty table gives an empty
    result.  Other columns are not read.  One pass, no shuffle.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    shared = _shared_vocabulary(spark, model)
    fields = [T.StructField(key, df.schema[key].dataType), T.StructField("n_tokens", T.LongType()),
              T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    kinds = {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}
    fields += [T.StructField(name, kinds[name]) for name in outputs]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            n, sha_ids, sha_back = [], [], []
            more: dict[str, list] = {name: [] for name in outputs}
            for value in batch.column(1):
                found, joined, decoded = codec.run(value.as_py() or "")
                n.append(len(found))
                sha_ids.append(hashlib.sha256(joined.encode()).hexdigest())
                sha_back.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                if "ids" in more:
                    more["ids"].append([int(x) for x in found])
                if "decoded" in more:
                    more["decoded"].append(decoded)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(sha_ids, pa.string()),
                       pa.array(sha_back, pa.string())]
            columns += [pa.array(v, pa.list_(pa.int32()) if name == "ids" else pa.string())
                        for name, v in more.items()]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
        codec.forget()

    return df.select(key, text).mapInArrow(work, T.StructType(fields))


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), default_model())

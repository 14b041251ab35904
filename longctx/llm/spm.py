"""Operator 3: SentencePiece encoding and decoding by a streaming Viterbi search.

The pieces, their scores, the byte pieces and the normaliser flags are read from a SentencePiece
model file.  A text becomes symbols (a leading dummy space if the model asks for it, space as
U+2581); its ids are those of the segmentation with the greatest sum of piece scores.  A symbol
that no piece covers costs ``min score - 10`` and is written as byte pieces (or as ``unk``).

Streaming: scores are needed only for the next ``max_len`` boundaries.  Whenever the back pointers of
all boundaries that can still be extended lead to one common boundary, the ids up to it are
final: they are written out and forgotten.  A boundary that no piece can cross
(before a word start, if all pieces begin with the space mark or do not hold it) is such a point
by itself, so texts are cut there first and the ids of repeated words are remembered in a
table of bounded size.  Memory therefore follows the longest undecided stretch, not the text.

Decoding joins the pieces, turns byte pieces back into UTF-8 and removes the dummy space.  The
round trip gives the text back exactly; a U+2581 of the text itself is written as bytes.

Nulls and edge cases: null text gives null ids and null decoded text; an empty text has no ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import chain
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longctx.llm.words import pieces

SPACE = "▁"
UNK_PENALTY = 10
CACHE_WORDS = 120_000


def _fields(b: bytes):
    """(field number, value) of a protocol buffer message; bytes for length-delimited fields."""
    at, end = 0, len(b)

    def varint():
        nonlocal at
        n = shift = 0
        while True:
            x = b[at]
            at += 1
            n |= (x & 127) << shift
            shift += 7
            if x < 128:
                return n

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, b[at:at + size]
            at += size


class Pieces:
    """Vocabulary of a SentencePiece model file, with encoder and decoder."""

    NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6  # fixed values of the file format

    def __init__(self, model: bytes):
        import struct
        self.text, self.kind = [], []
        self.score, self.byte_id, self.dummy = {}, {}, True
        self.unk = 0
        for field, value in _fields(model):
            if field == 1:
                p = dict(_fields(value))
                piece, kind = p[1].decode(), p.get(3, self.NORMAL)
                if kind in (self.NORMAL, self.USER):
                    self.score[piece] = (struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], len(self.text))
                elif kind == self.BYTE:
                    self.byte_id[int(piece[3:5], 16)] = len(self.text)
                elif kind == self.UNKNOWN:
                    self.unk = len(self.text)
                self.text.append(piece)
                self.kind.append(kind)
            elif field == 3:
                self.dummy = bool(dict(_fields(value)).get(3, 1))
        self.max_len = max(map(len, self.score), default=1)
        self.bad = min((s for s, _ in self.score.values()), default=0.0) - UNK_PENALTY
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.score)
        #: Every prefix of a piece; with (score, id) where it is a piece itself.
        self.prefix = {p[:n]: None for p in self.score for n in range(1, len(p))} | self.score
        raw = {i: bytes([x]) for x, i in self.byte_id.items()}
        shown = {self.UNKNOWN: " ⁇ ", self.CONTROL: ""}
        self.bytes_of = [raw.get(i) or shown.get(k, t.replace(SPACE, " ")).encode()
                         for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True))]
        self.tree: dict = {}
        self.memo: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.word = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def _spell(self, symbol: str) -> list[int]:
        return [self.byte_id[x] for x in symbol.encode()] if self.byte_id else [self.unk]

    def _extend(self, buf: str, at: int, i: int, best: dict, back: dict) -> None:
        """Follow all pieces that start at boundary ``i``, which is ``buf[at]``; the earlier start wins ties."""
        have, prefix, single = best.pop(i), self.prefix, False
        for n in range(1, min(self.max_len, len(buf) - at) + 1):
            piece = prefix.get(buf[at:at + n], self)
            if piece is self:
                break
            if piece is not None:
                single = single or n == 1
                total = have + piece[0]
                if total > best.get(i + n, -inf):
                    best[i + n], back[i + n] = total, (i, piece[1])
        if not single and have + self.bad > best.get(i + 1, -inf):
            best[i + 1], back[i + 1] = have + self.bad, (i, buf[at])

    def stream(self, chunks: Iterable[str]):
        """Yield the ids of a text that arrives in chunks, as soon as they are decided.

        Held at any time: the next ``max_len`` symbols, the scores of the boundaries they reach, and
        the back pointers after the last boundary that all surviving paths share.
        """
        size = self.max_len
        best, back = {0: 0.0}, {}
        buf, start, i, done = "", 0, 0, 0  # buf begins at boundary start
        for chunk in chain(chunks, [None]):
            if chunk is not None:
                buf += chunk
            while i - start < len(buf) and (chunk is None or i - start + size <= len(buf)):
                self._extend(buf, i - start, i, best, back)
                i += 1
                if i % size == 0:
                    common = self._meet(best, back, done)
                    if common > done:
                        yield from self._trace(back, done, common)
                        low = min(best.values())
                        for k in best:
                            best[k] -= low  # sums stay small, so that adding stays exact
                        done = common
            buf, start = buf[i - start:], i
        yield from self._trace(back, done, i)

    @staticmethod
    def _meet(best, back, done) -> int:
        """The last boundary on the paths to all boundaries that can still be extended."""
        live = set(best)
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(max(back[last][0], done))
        return live.pop()

    def _trace(self, back, start, end):
        """Ids of the path from ``start`` to ``end``; its back pointers and older ones are forgotten."""
        path, at = [], end
        while at > start:
            at, piece = back[at]
            path.append(piece)
        for k in range(start + 1, end + 1):
            back.pop(k, None)
        for piece in reversed(path):
            if isinstance(piece, str):
                yield from self._spell(piece)
            else:
                yield piece

    def _word(self, s: str) -> list[int]:
        """The search of ``stream`` over a stretch so short that it needs no window."""
        n, bad, root = len(s), self.bad, self._trie()
        best, back, ids = [-inf] * (n + 1), [0] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            have, node, j = best[i], root, i
            for c in s[i:]:
                node = node.get(c)
                if node is None:
                    break
                j += 1
                piece = node.get("")
                if piece is not None and have + piece[0] > best[j]:
                    best[j], back[j], ids[j] = have + piece[0], i, piece[1]
            if s[i] not in self.score and have + bad > best[i + 1]:
                best[i + 1], back[i + 1], ids[i + 1] = have + bad, i, None
        path = []
        while n:
            at = back[n]
            if ids[n] is None:
                path += reversed(self._spell(s[at]))
            else:
                path.append(ids[n])
            n = at
        return path[::-1]

    def _trie(self) -> dict:
        """The pieces by character; the entry of a piece stands under the empty string."""
        if not self.tree:
            for piece, entry in self.score.items():
                node = self.tree
                for c in piece:
                    node = node.setdefault(c, {})
                node[""] = entry
        return self.tree

    def _stretch(self, text: str) -> list[int]:
        """Ids of a stretch without the mark in its text; spaces are marks already."""
        if not self.by_word:
            return list(self.stream(text[k:k + 4096] for k in range(0, len(text), 4096)))
        out, memo = [], self.memo
        for word in self.word.findall(text):
            ids = memo.get(word)
            if ids is None:
                if len(word) > 64:
                    ids = list(self.stream(word[k:k + 4096] for k in range(0, len(word), 4096)))
                else:
                    ids = self.older.get(word) or self._word(word)
                    if len(memo) >= CACHE_WORDS:  # the words of this generation stay for one more
                        self.older, self.memo = memo, {}
                        memo = self.memo
                    memo[word] = ids
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        parts = text.split(SPACE)  # a mark in the text itself is no space: spelled in bytes, and no piece crosses it
        out = self._stretch(((" " if self.dummy else "") + parts[0]).replace(" ", SPACE))
        for part in parts[1:]:
            out = out + self._spell(SPACE) + self._stretch(part.replace(" ", SPACE))
        return out

    def decode(self, ids: list[int]) -> str:
        table = self.bytes_of
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.dummy and text[:1] == " " else text


def load(spark, path: str) -> bytes:
    """The model file's bytes, through Spark's readers (any store that Spark reads)."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def _mapper(model, decode: bool):
    def run(batches):
        vocab = Pieces(model.value)
        for batch in pieces(batches, 128):
            row = batch.column("row")
            text = batch.column("text") if "text" in batch.schema.names else row.field(row.type.get_field_index("text"))
            texts = text.to_pylist()
            ids = [None if t is None else vocab.encode(t) for t in texts]
            cols = [batch.column("row"), pa.array(ids, pa.list_(pa.int32()))]
            if decode:
                cols.append(pa.array([None if x is None else vocab.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["row", "ids", "decoded"][:len(cols)])
    return run


def encode(docs: DataFrame, model_path: str, decode: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) of ``docs`` in struct ``row``, with ``ids`` of ``text`` and,
    if asked, the text ``decoded`` from them.  The model (under 1 MB) is broadcast."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(load(spark, model_path))
    kept = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*kept).alias("row"), F.col("text").cast("string").alias("text"))
    if "text" in kept and docs.schema["text"].dataType == T.StringType():
        rows = rows.drop("text")  # the row has it; wide texts cross to Python once
    schema = T.StructType([rows.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))]
                          + [T.StructField("decoded", T.StringType())] * decode)
    return rows.mapInArrow(_mapper(model, decode), schema)


def _demapper(model):
    def run(batches):
        vocab = Pieces(model.value)
        for batch in pieces(batches, 128):
            text = [None if x is None else vocab.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(text, pa.string())], names=["row", "text"])
    return run


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``row`` and the ``text`` of each ``ids`` array."""
    model = encoded.sparkSession.sparkContext.broadcast(load(encoded.sparkSession, model_path))
    schema = T.StructType([encoded.schema["row"], T.StructField("text", T.StringType())])
    return encoded.select("row", "ids").mapInArrow(_demapper(model), schema)

"""Operator 11: importance resampling towards a target distribution, over hashed word n-grams.

A word is a maximal run of bytes that are digits, letters a-z (after A-Z lower-casing) or not ASCII; all
other bytes delimit.  Features of a text are its runs of 1 to ``n`` consecutive words joined by one
space, repeats counted; a feature's bucket is the unsigned CRC-32 of its UTF-8 bytes modulo ``buckets``.

Method: an Aho-Corasick automaton holds distinct words bounded by delimiters on both sides; the
payload of each is its CRC and its length.  One scan over a block of texts emits the payloads in order.
The CRC of a longer feature is composed from payloads that follow each other: the CRC of the left part is carried
over a space and over as many zero bytes as the next word is long (a linear map of 32 bits, from tables), and
the next word's CRC is added.  No feature is ever written out as text.  The dictionary belongs to a task:
it starts empty, words that a scan left uncovered get their payload in place and are entered
for the next blocks, up to ``MAX_WORDS`` words of at most ``MAX_BYTES`` bytes.  Results do not depend on what it holds.

Two scans: the first adds up bucket counts (a vector of ``buckets`` per task, summed by Spark), the second
scores each text by the broadcast table of ``buckets`` gains.  Gain of a bucket: floor(1000 ln((t+1)(S+buckets) /
((s+1)(T+buckets)))), s of S features in the documents and t of T in the target.  A document's weight is the floored mean of
its features' gains; score = weight + floor of 1000 times a Gumbel value keyed by seed and id; the
highest scores of documents with ``min_words`` words or more are drawn.

Nulls and edge cases: null and empty texts have no features, weight 0, and are never drawn with ``min_words`` > 0; a null
id is keyed as the empty string; ties go to the smaller id (null first), equal rows take ranks after each other in
any order; an empty target or corpus counts as zeros; further columns ride along in ``row``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longctx.llm.words import byte_rows, pieces
from longctx.operators.ordinal import ordinal_within
from longctx.session import cut_lineage

BUCKETS = 10_000
MAX_WORDS = 1 << 16
MAX_BYTES = 64
BLOCK = 1 << 20
_FIRST = 1 << 16
_U = np.uint32

_FOLD = np.arange(256, dtype=np.uint8)  # A-Z lowered, every delimiter a space
_FOLD[:0x80] = 0x20
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x61:0x7B] = _FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def _byte_table() -> np.ndarray:
    """CRC register after one byte, by its low byte (reflected polynomial 0xEDB88320)."""
    t = np.arange(256, dtype=_U)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ _U(0xEDB88320), t >> 1).astype(_U)
    return t


_STEP = _byte_table()


def _zero_byte(c: np.ndarray) -> np.ndarray:
    return _STEP[c & 0xFF] ^ (c >> _U(8))


def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The linear map of ``table`` (4 x 256) on every register."""
    return table[0][c & 0xFF] ^ table[1][(c >> 8) & 0xFF] ^ table[2][(c >> 16) & 0xFF] ^ table[3][c >> 24]


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """Maps of 0 to MAX_BYTES zero bytes, and of 2**k zero bytes."""
    one = (np.arange(256, dtype=_U)[None, :] << (np.arange(4, dtype=_U) * 8)[:, None]).astype(_U)
    short = [one]
    for _ in range(MAX_BYTES):
        short.append(_zero_byte(short[-1]))
    powers = [short[1]]
    for _ in range(39):
        powers.append(_apply(powers[-1], powers[-1]))
    return np.stack(short), np.stack(powers)


_SHORT, _POWERS = _shift_tables()
_FLAT = np.ascontiguousarray(_SHORT.transpose(1, 0, 2)).reshape(4, -1)


def append(crc: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC of each left part followed by a right part of CRC ``other`` and ``length`` bytes."""
    at = np.minimum(length, MAX_BYTES) * 256
    out = (_FLAT[0][at + (crc & 0xFF)] ^ _FLAT[1][at + ((crc >> 8) & 0xFF)]
           ^ _FLAT[2][at + ((crc >> 16) & 0xFF)] ^ _FLAT[3][at + (crc >> 24)])
    for k in np.flatnonzero(length > MAX_BYTES):
        c, rest = crc[k:k + 1], int(length[k])
        for bit in range(rest.bit_length()):
            if rest >> bit & 1:
                c = _apply(_POWERS[bit], c)
        out[k] = c[0]
    return out ^ other


def add_space(crc: np.ndarray) -> np.ndarray:
    """CRC of each part followed by one space."""
    c = ~crc
    return ~(_STEP[(c ^ _U(0x20)) & 0xFF] ^ (c >> _U(8)))


class Dictionary:
    """Distinct words, bounded by delimiters, each with a payload (CRC, length)."""

    def __init__(self):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.met: set[bytes] = set()  # met once
        self.new: set[bytes] = set()  # met again, not entered yet
        self.crc, self.size = np.zeros(0, _U), np.zeros(0, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        """Enter words that are met again, once they make the dictionary an eighth larger."""
        known = len(self.crc)
        for w in words:
            if w in self.met:
                self.new.add(w)
            elif len(w) <= MAX_BYTES:
                self.met.add(w)
        if known < MAX_WORDS and len(self.new) > max(256, known // 8):
            new = list(self.new)[:MAX_WORDS - known]
            for k, w in enumerate(new, known):
                self.automaton.add_word(f" {w.decode('latin-1')} ", k)
            self.automaton.make_automaton()
            self.crc = np.concatenate([self.crc, np.fromiter(map(zlib.crc32, new), _U, len(new))])
            self.size = np.concatenate([self.size, np.fromiter(map(len, new), np.int64, len(new))])
            self.new = set()
        if len(self.met) > 2 * MAX_WORDS:
            self.met = set()
        if len(self.new) > MAX_WORDS:
            self.new = set()

    def scan(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """End offset, CRC and length of every word of a folded block that begins and ends with a space."""
        raw = block.tobytes()
        if len(self.crc):
            found = np.fromiter(chain.from_iterable(self.automaton.iter(raw.decode("latin-1"))), np.int64)
            end, at = found[::2], found[1::2]
        else:
            end = at = np.zeros(0, np.int64)
        crc, size = self.crc[at], self.size[at]
        inside = block != 0x20
        if int(size.sum()) < int(np.count_nonzero(inside)):
            edge = np.zeros(len(block) + 1, np.int8)
            edge[end - size] = 1
            edge[end] -= 1
            left = inside & (np.cumsum(edge[:-1], dtype=np.int8) == 0)
            step = np.diff(left.view(np.int8), prepend=0)
            starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            words = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            crc = np.concatenate([crc, np.fromiter(map(zlib.crc32, words), _U, len(words))])
            size = np.concatenate([size, ends - starts])
            end = np.concatenate([end, ends])
            order = np.argsort(end, kind="stable")
            end, crc, size = end[order], crc[order], size[order]
            self._learn(words)
        return end, crc, size


def _segments(rows: Iterable[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, folded bytes) in order; a long text in several parts cut at a delimiter."""
    for k, b in enumerate(rows):
        at = 0
        while len(b) - at > BLOCK:
            stop = at + BLOCK
            while stop < len(b):  # the next delimiter, sought block by block
                hit = np.flatnonzero(_FOLD[b[stop:stop + BLOCK]] == 0x20)
                if len(hit):
                    stop += int(hit[0])
                    break
                stop = min(len(b), stop + BLOCK)
            yield k, _FOLD[b[at:stop]]
            at = stop
        if at < len(b):
            yield k, _FOLD[b[at:]]


def _blocks(rows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, list[int], list[int]]]:
    """Blocks of folded texts set apart by spaces, with the rows and the offset at which each begins."""
    space = np.full(1, 0x20, np.uint8)
    parts, owners, starts, size = [space], [], [], 1
    for k, b in _segments(rows):
        owners.append(k)
        starts.append(size)
        parts += [b, space]
        size += len(b) + 1
        if size >= BLOCK or (len(parts) == 3 and size >= _FIRST):
            yield np.concatenate(parts), owners, starts
            parts, owners, starts, size = [space], [], [], 1
    if owners:
        yield np.concatenate(parts), owners, starts


def features(rows: list[np.ndarray], words: Dictionary, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each word, row of each feature, CRC of each feature), block by block."""
    kept = (np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64))
    for block, owners, starts in _blocks(rows):
        end, crc, size = words.scan(block)
        row = np.asarray(owners)[np.searchsorted(starts, end, "right") - 1] if len(end) else np.zeros(0, np.int64)
        fresh, old = row, len(kept[0])
        row, crc, size = (np.concatenate(x) for x in zip(kept, (row, crc, size), strict=True))
        owner, codes, run = [fresh], [crc[old:]], crc
        for k in range(1, n):  # run[i]: CRC of words i-k+1 .. i, composed with word i+1
            if len(crc) <= k:
                break
            run = append(add_space(run[:-1]), crc[k:], size[k:])
            last = np.arange(k, len(crc))
            mine = (row[k:] == row[:-k]) & (last >= old)
            owner.append(row[k:][mine])
            codes.append(run[mine])
        kept = tuple(x[max(0, len(row) - n + 1):] for x in (row, crc, size)) if n > 1 else kept
        yield fresh, np.concatenate(owner), np.concatenate(codes)


def bucket_counts(texts: DataFrame, text: str = "text", n: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that has any."""
    def run(batches):
        words, total = Dictionary(), np.zeros(buckets, np.int64)
        for batch in pieces(batches):
            for _, _, codes in features(byte_rows(batch.column(0)), words, n):
                total += np.bincount(codes % _U(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    part = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return part.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket from the two tables of counts."""
    spark = source.sparkSession
    whole = spark.range(buckets).select(F.col("id").alias("bucket"))
    sums = source.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s_all")).crossJoin(
        target.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t_all")))  # one row
    rows = (whole.join(source.withColumnRenamed("n", "s"), "bucket", "left")
            .join(target.withColumnRenamed("n", "t"), "bucket", "left").crossJoin(F.broadcast(sums)))
    s, t, s_all, t_all = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("s", "t", "s_all", "t_all"))
    share = (t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets))
    return rows.select("bucket", F.floor(1000 * F.log(share)).cast("long").alias("gain"))


def weigh(docs: DataFrame, gains: DataFrame, keep: list[str] | None = None, text: str = "text", n: int = 2,
          buckets: int = BUCKETS) -> DataFrame:
    """Columns ``keep`` in struct ``row``, with ``n_words``, ``n_features`` and ``weight``.

    The gains (one row a bucket, ``buckets`` in all) are broadcast.
    """
    spark = docs.sparkSession
    got = gains.toPandas()
    table = np.zeros(buckets, np.int64)
    table[got["bucket"].to_numpy()] = got["gain"].to_numpy()
    shared = spark.sparkContext.broadcast(table)
    rows = docs.select(F.struct(*(docs.columns if keep is None else keep)).alias("row"),
                       F.col(text).cast("string").alias("text"))

    def run(batches):
        words, gain = Dictionary(), shared.value
        for batch in pieces(batches):
            k = batch.num_rows
            n_words, n_features, total = (np.zeros(k, np.int64) for _ in range(3))
            for row, owner, codes in features(byte_rows(batch.column(1)), words, n):
                n_words += np.bincount(row, minlength=k)
                n_features += np.bincount(owner, minlength=k)
                np.add.at(total, owner, gain[codes % _U(buckets)])
            mean = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)  # // goes down
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_features, mean))],
                                             names=["row", "n_words", "n_features", "weight"])

    schema = T.StructType([rows.schema["row"]] + [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")])
    return rows.mapInArrow(run, schema)


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))), u from the first 8 hex digits of sha256("seed:id")."""
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), "utf-8"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def resample(docs: DataFrame, target: DataFrame, keep: list[str] | None = None, doc_id: str = "doc_id",
             text: str = "text", percent: int = 25, seed: int = 7, min_words: int = 20, n: int = 2,
             buckets: int = BUCKETS) -> DataFrame:
    """Struct ``row`` of the columns ``keep`` (default all but the text), ``n_words, n_features, weight, score, rank``.

    ``rank`` counts 1, 2, 3, ... over the drawn documents: floor(percent * N / 100) of the N with ``min_words``
    words or more, by falling score, then rising id; others have a null rank.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    # both tables are made of `buckets` rows; the scan behind them runs once
    source = cut_lineage(bucket_counts(docs, text, n, buckets))
    gains = bucket_gains(source, cut_lineage(bucket_counts(target, text, n, buckets)), buckets)
    ided = docs.select(F.struct(*keep).alias("kept"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    weighed = weigh(ided, gains, ["kept", "id"], "text", n, buckets)
    scored = cut_lineage(weighed.select(
        F.col("row.kept").alias("row"), F.col("row.id").alias("id"), "n_words", "n_features", "weight",
        (F.col("weight") + noise(F.col("row.id"), seed)).alias("score")))
    fit = F.col("n_words") >= min_words
    drawn = scored.where(fit).count() * percent // 100
    ranked = ordinal_within(scored.where(fit).withColumn("falling", -F.col("score")), [], ["falling", "id"], "rank", carry=True)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    rest = scored.where(~fit).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*rest.columns).unionAll(rest).drop("id")

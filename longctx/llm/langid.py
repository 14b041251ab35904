"""Operator 1: language identification by multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of 1 to ``ORDER`` characters (lower-cased, everything but letters
folded to one space) of all training texts in ``BUCKETS`` hash buckets per language: one partial
count table per task and language, summed by Spark.  The driver gets the log-probability matrix,
``BUCKETS`` floats a language, and broadcasts it: its size follows the number of languages, never
the corpus.  Scoring turns a whole text into sparse bucket counts and multiplies them with the matrix.

Nulls and edge cases: a text that is null or has no letter is ``und`` with score 0.  Equal scores
go to the least language name.  Without any training row every text is ``und`` with score 0.
Repeated rows and further columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longctx.llm.words import pieces

ORDER, BUCKETS, SMOOTHING = 3, 1 << 15, 0.5
#: Count tables a training task holds at once (256 KB each); beyond it writes them out and goes on.
TABLES = 64
_SHIFT = np.uint32(32 - BUCKETS.bit_length() + 1)
_MUL = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
_letters: list[np.ndarray] = []


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, runs of other characters than letters as one 32; empty without letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000))
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters[0][np.minimum(c, 0xFFFF)]
    far = c > 0xFFFF
    if far.any():
        letter[far] = [chr(x).isalpha() for x in c[far]]
    if not letter.any():
        return c[:0]
    c = np.where(letter, c, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.concatenate([[np.uint32(32)], c[keep], [np.uint32(32)]]).astype(np.uint32)


def text_buckets(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of the n-grams of a text."""
    c = _codes(text or "")
    parts, h = [], np.zeros(len(c), np.uint32)
    for k in range(min(ORDER, len(c))):
        h = (h[:len(c) - k] ^ (c[k:] + np.uint32(k))) * _MUL[k]
        h ^= h >> np.uint32(15)
        parts.append((h * _MUL[0]) >> _SHIFT)
    if not parts:
        return c, c
    all_ = np.concatenate(parts)
    if len(all_) < 1500:
        return np.unique(all_, return_counts=True)
    n = np.bincount(all_, minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at]


def _count(batches):
    tables: dict[str, np.ndarray] = {}

    def out():
        for lang, t in tables.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                              pa.array(t[at])], names=["lang", "bucket", "n"])
        tables.clear()

    for batch in pieces(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if lang not in tables:
                if len(tables) >= TABLES:
                    yield from out()
                tables[lang] = np.zeros(BUCKETS + 1, np.int64)
            at, n = text_buckets(text)
            tables[lang][at] += n
            tables[lang][BUCKETS] += 1  # documents
    yield from out()


def train(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages in order, log-probability matrix, log priors) from all rows of ``rows(lang, text)``."""
    counts = rows.where("lang is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast(
        "string").alias("text")).mapInArrow(_count, "lang string, bucket int, n long")
    summed = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    tables: dict[str, np.ndarray] = {}
    got = summed.toArrow()
    names = got.column("lang").combine_chunks().dictionary_encode()
    which, bucket, n = (x.to_numpy(zero_copy_only=False) for x in (
        names.indices, got.column("bucket").combine_chunks(), got.column("n").combine_chunks()))
    for k, lang in enumerate(names.dictionary.to_pylist()):
        tables[lang] = np.bincount(bucket[which == k], weights=n[which == k], minlength=BUCKETS + 1)
    langs = sorted(tables)
    if not langs:
        return [], np.zeros((0, BUCKETS), np.float32), np.zeros(0)
    all_ = np.stack([tables[x] for x in langs])
    docs, grams = all_[:, BUCKETS] + 1, all_[:, :BUCKETS] + SMOOTHING
    return langs, np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32), np.log(docs / docs.sum())


def _scorer(model):
    def run(batches):
        langs, logs, prior = model.value
        for batch in pieces(batches):
            best, score = [], []
            for text in batch.column("text").to_pylist():
                at, n = text_buckets(text)
                if not len(at) or not langs:
                    best.append("und")
                    score.append(0.0)
                    continue
                s = logs[:, at].astype(np.float64) @ n + prior
                k = int(s.argmax())
                best.append(langs[k])
                score.append(float(1 / np.exp(s - s[k]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(best, pa.string()), pa.array(
                score, pa.float64())], names=["row", "lang_pred", "score"])
    return run


def predict(docs: DataFrame, model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` in struct ``row``, with ``lang_pred`` and ``score`` of ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*keep).alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_scorer(shared), schema)

"""Operator 9: quality classifier, naive Bayes support vectors.

Features are indicators of n-grams, hashed to ``BUCKETS`` buckets: words, word pairs, 4-byte
strings, and runs of three repetition codes (how far back the same word stood last, up to 3).
Their class log-count ratios are counted over all training rows.  A linear hinge-loss model on
the indicators times these ratios (scaled to unit length) is fitted by dual coordinate descent on
at most ``SAMPLE`` training rows, those with the least hash of the id, in one task.  The weights
(``BUCKETS`` floats) are broadcast and every whole text is scored in numpy.  The score is a
logistic function of the margin, fitted to the sample.

Nulls and edge cases: null and empty texts have no n-gram and get the score of margin b.  A
training id with several labels counts as 1 if any is 1; null labels and ids do not train.  With
fewer than one row of each class the score is the smoothed share of label 1 for every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longctx.llm.prefilter import key_bitmap, may_match
from longctx.llm.words import byte_rows, mix, pieces, word_hashes, word_spans

BUCKETS, SAMPLE, SMOOTHING = 1 << 17, 6000, 1.0
COST, EPOCHS = 1.0, 15
_SHIFT = np.uint64(64 - 17)


def text_features(b: np.ndarray) -> np.ndarray:
    """Sorted buckets of the n-grams of a text."""
    seen = np.zeros(BUCKETS, bool)
    s, e = word_spans(b)
    w = word_hashes(b, s, e)
    if not len(w):
        return np.zeros(0, np.int64)
    grams = [w, w[:-1] * np.uint64(3) + w[1:] * np.uint64(0x9E3779B97F4A7C15)]
    code = np.zeros(len(w), np.uint64)
    for back in (3, 2, 1):
        code[back:][w[back:] == w[:-back]] = back
    if len(w) >= 3:
        grams.append(code[:-2] * np.uint64(16) + code[1:-1] * np.uint64(4) + code[2:] + np.uint64(7 << 40))
    if len(b) >= 4:
        c = b.astype(np.uint64)
        grams.append(c[:-3] | c[1:-2] << np.uint64(8) | c[2:-1] << np.uint64(16) | c[3:] << np.uint64(24))
    for g in grams:
        seen[mix(g) >> _SHIFT] = True
    return np.flatnonzero(seen)


def _count(batches):
    pos, neg, n = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64), 0
    for batch in pieces(batches):
        for b, y in zip(byte_rows(batch.column("text")), batch.column("label").to_pylist(), strict=True):
            t = pos if y else neg
            t[text_features(b)] += 1
            t[BUCKETS] += 1
            n += 1
    at = np.flatnonzero(pos + neg)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(pos[at]), pa.array(neg[at])],
                                     names=["bucket", "pos", "neg"])


def ratios(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    p, q = pos[:BUCKETS] + SMOOTHING, neg[:BUCKETS] + SMOOTHING
    return np.log(p / p.sum()) - np.log(q / q.sum())


def _vector(at: np.ndarray, r: np.ndarray) -> np.ndarray:
    v = r[at]
    size = np.sqrt(v @ v)
    return v / size if size else v


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, float]:
    """Hinge-loss weights and bias (a constant feature) by dual coordinate descent; classes weigh alike."""
    w, bias = np.zeros(BUCKETS), 0.0
    alpha = np.zeros(len(rows))
    share = np.array([(y < 0).mean(), (y > 0).mean()])
    cost = np.where(y > 0, COST / (2 * share[1]), COST / (2 * share[0]))
    vectors = [_vector(at, r) for at in rows]
    square = np.array([v @ v + 1 for v in vectors])
    order = np.random.default_rng(9)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in order.permutation(len(rows)):
            at, v = rows[i], vectors[i]
            slope = y[i] * (w[at] @ v + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if step := new - alpha[i]:
                alpha[i] = new
                w[at] += step * y[i] * v
                bias += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a m + b))), least smoothed log loss by Newton steps."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, t = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        t = t - np.clip(np.linalg.solve(hess, x.T @ (p - target)), -2, 2)
    return float(t[0]), float(t[1])


def _fitter(counts):
    def run(batches):
        r = ratios(*counts.value)
        rows, y = [], []
        for batch in pieces(batches):
            rows += [text_features(b) for b in byte_rows(batch.column("text"))]
            y += batch.column("label").to_pylist()
        order = np.argsort([x.tobytes()[:64] for x in rows], kind="stable") if rows else []
        rows, y = [rows[i] for i in order], np.array([1.0 if y[i] else -1.0 for i in order])
        if not len(y) or abs(y.sum()) == len(y):
            return
        w, bias = descend(rows, y, r)
        a, b = logistic(np.array([w[at] @ _vector(at, r) + bias for at in rows]), y)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f8").tobytes()], pa.binary()), pa.array([bias]),
                                          pa.array([a]), pa.array([b])], names=["w", "bias", "a", "b"])
    return run


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Model from all rows of ``docs(doc_id, text)`` that ``labels(doc_id, label)`` names."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null")
    labels = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    # labels grow with the corpus, so they are joined by shuffle at any size; only texts that may have one move
    labelled = may_match(docs, "doc_id", key_bitmap(labels, "doc_id")).join(labels.hint("merge"), "doc_id").select(
        "text", "label")
    counts = labelled.mapInArrow(_count, "bucket int, pos long, neg long").groupBy("bucket").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    got = counts.toArrow()  # at most BUCKETS + 1 rows
    pos, neg = (np.bincount(got.column("bucket").to_numpy(), weights=got.column(c).to_numpy(), minlength=BUCKETS + 1)
                for c in ("pos", "neg"))
    model = {"share": float((pos[BUCKETS] + 1) / (pos[BUCKETS] + neg[BUCKETS] + 2)), "w": None}
    if not pos[BUCKETS] or not neg[BUCKETS]:
        return model
    spark = docs.sparkSession
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    sample = docs.join(F.broadcast(chosen), "doc_id").select("text", "label").repartition(1)
    fit = sample.mapInArrow(_fitter(spark.sparkContext.broadcast((pos, neg))), "w binary, bias double, a double, b double").first()
    if fit:
        r = ratios(pos, neg)
        model |= {"w": np.frombuffer(fit["w"], "<f8") * r, "r2": r * r, "bias": fit["bias"], "a": fit["a"], "b": fit["b"]}
    return model


def score_text(b: np.ndarray, m: dict) -> float:
    if m["w"] is None:
        return m["share"]
    at = text_features(b)
    size = np.sqrt(m["r2"][at].sum())
    margin = (m["w"][at].sum() / size if size else 0.0) + m["bias"]
    return float(1 / (1 + np.exp(-np.clip(m["a"] * margin + m["b"], -30, 30))))


def _scorer(model):
    def run(batches):
        for batch in pieces(batches):
            s = [score_text(b, model.value) for b in byte_rows(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(s, pa.float64())], names=["row", "score"])
    return run


def score(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` in struct ``row``, with the ``score`` of ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*keep).alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_scorer(shared), schema)

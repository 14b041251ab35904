"""Operator 7: quality rules by robust multivariate outliers.

Each text gives word statistics and from them a vector of five transformed ratios (``VECTOR``).
Per language and source the minimum-covariance-determinant estimate of centre and scatter is found
by concentration steps: from medians and median deviations, take the ``SUBSET`` share of the rows
with the least distances, compute their mean and covariance, measure again, ``STEPS`` times.
Each step is two aggregates over all rows of all groups at once (quantiles and moments, both
combined map-side), so a source with a third of all rows costs no more than many small ones.
A text is rejected if its squared Mahalanobis distance exceeds ``CUTOFF``, or by the base rules.

Groups under ``MIN_GROUP`` rows are pooled by language, then all together; a pool that is still
smaller rejects nothing.  ``FLOOR`` is added to the deviations, since most ratios are nearly
constant among good texts, and the distance of a short text is shrunk by n / (n + ``SHRINK``),
since its ratios are noisy.  Null language or source is a group value like any other.

Nulls and edge cases: null and blank texts have zero counts, fail the base rule and take no part in
the estimates.  Rows are judged one by one, so repeated rows and ids, null ids and further columns
do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longctx.llm.words import byte_rows, pieces, shingle_hashes, word_hashes, word_spans
from longctx.session import cut_lineage

MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"  # fixed value: the characters counted by n_symbols
VECTOR = {
    "v0": "ln(word_chars / n_words)",
    "v1": "sqrt(n_marks / word_chars)",
    "v2": "sqrt(n_upper / word_chars)",
    "v3": "sqrt(n_repeat_words / n_words)",
    "v4": "sqrt(n_dup_lines / n_lines)",
}
FLOOR = (0.10, 0.08, 0.08, 0.12, 0.20)
SUBSET, STEPS, MIN_GROUP, SHRINK = 0.75, 4, 100, 30
#: Groups (some 300 bytes each) up to which the estimates are broadcast; more are joined by shuffle.
BROADCAST_GROUPS = 20_000
CONSISTENCY = 1.41  # SUBSET / P(chi2_7 <= chi2_5 quantile of SUBSET): the half with least distances understates scatter
CUTOFF = 30.86  # chi2 with 5 degrees of freedom exceeds this once in 100,000

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_upper", "n_lines")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_BLANK = b" \t\n\x0b\x0c\r"


def repeat_words(words: np.ndarray, width: int = REPEAT_WINDOW) -> int:
    """Words inside windows of ``width`` words that occur at least twice."""
    if len(words) <= width:
        return 0
    _, where, times = np.unique(shingle_hashes(words, width), return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[where] > 1)
    if not len(again):
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    cover[again] += 1
    cover[again + width] -= 1
    return int((np.cumsum(cover) > 0).sum())


def text_counts(b: np.ndarray) -> tuple[int, ...]:
    """The values of ``_COUNTS`` for the bytes of one text."""
    s, e = word_spans(b)
    if not len(s):
        return (0,) * len(_COUNTS)
    points = int(((b & 0xC0) != 0x80).sum())
    blanks = len(b) - int((e - s).sum())
    lines = [x for x in b.tobytes().split(b"\n") if x.strip(_BLANK)]
    return (len(s), points - blanks, int(_SYMBOL[b].sum()), len(lines) - len(set(lines)),
            repeat_words(word_hashes(b, s, e)), int(_MARK[b].sum()), int(((b >= 65) & (b <= 90)).sum()), len(lines))


def _count(batches):
    for batch in pieces(batches):
        row = batch.column("row")
        text = batch.column("text") if "text" in batch.schema.names else row.field(row.type.get_field_index("text"))
        rows = np.array([text_counts(b) for b in byte_rows(text)], np.int64).reshape(-1, len(_COUNTS))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("grp"), *[pa.array(rows[:, k]) for k in range(len(_COUNTS))]],
            names=["row", "grp", *_COUNTS])


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Struct ``row`` of the columns ``keep``, ``grp`` (lang, source) and the counts and vector of each text."""
    rows = docs.select(F.struct(*keep).alias("row"), F.struct(F.col("lang").cast("string").alias("lang"), F.col(
        "source").cast("string").alias("source")).alias("grp"), F.col("text").cast("string").alias("text"))
    if "text" in keep and docs.schema["text"].dataType == T.StringType():
        rows = rows.drop("text")  # the row has it; wide texts cross to Python once
    schema = T.StructType([rows.schema["row"], rows.schema["grp"], *[T.StructField(c, T.LongType()) for c in _COUNTS]])
    counted = rows.mapInArrow(_count, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return counted.select("*", failed.alias("base_failed"), *[
        F.when(F.col("n_words") > 0, F.expr(x)).alias(v) for v, x in VECTOR.items()])


def _pools(vectors: DataFrame) -> DataFrame:
    """(lang, source, pool): the pool a group is estimated in; no row for groups without one."""
    sizes = vectors.groupBy("grp.lang", "grp.source").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("small", F.col("n") < MIN_GROUP)
    by_lang = sizes.where("small").groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("m"))
    rest = by_lang.where(F.col("m") < MIN_GROUP).agg(F.sum("m").alias("rest"))
    got = sizes.join(by_lang, F.col("lang").eqNullSafe(F.col("of")), "left").join(rest, how="left")
    pool = (F.when(~F.col("small"), F.to_json(F.struct("lang", "source")))
            .when(F.col("m") >= MIN_GROUP, F.to_json(F.struct("lang"))).when(F.col("rest") >= MIN_GROUP, F.lit("all")))
    return got.select("lang", "source", pool.alias("pool")).where("pool is not null")


def _distance(centre: list[Column], inverse: Column) -> Column:
    p = len(VECTOR)
    dev = [F.col(f"v{i}") - centre[i] for i in range(p)]
    return sum((dev[i] * dev[j] * inverse[i * p + j] for i in range(p) for j in range(p)), F.lit(0.0))


def _invert(frames):
    """Mean and inverse of the regularised covariance from the moments of each pool."""
    p = len(VECTOR)
    for f in frames:
        s = f[[f"s{i}" for i in range(p)]].to_numpy()
        q = f[[f"q{i}_{j}" for i in range(p) for j in range(p)]].to_numpy().reshape(-1, p, p)
        n = f["n"].to_numpy()[:, None]
        mean = s / n
        cov = CONSISTENCY * (q / n[..., None] - mean[:, :, None] * mean[:, None, :]) + np.diag(np.square(FLOOR))
        f = f[["pool"]].copy()
        f["mean"] = list(mean)
        f["inverse"] = list(np.linalg.inv(cov).reshape(-1, p * p))
        yield f


def robust_estimates(vectors: DataFrame) -> DataFrame:
    """(pool, mean, inverse): the minimum-covariance-determinant estimate of every pool.

    ``vectors(pool, v0 ..)`` is read once per step; pass a checkpointed frame.
    """
    p = len(VECTOR)
    medians = cut_lineage(vectors.groupBy("pool").agg(*[F.percentile_approx(f"v{i}", 0.5).alias(f"m{i}") for i in range(p)]))
    spread = cut_lineage(vectors.join(medians, "pool").groupBy("pool").agg(*[
        F.percentile_approx(F.abs(F.col(f"v{i}") - F.col(f"m{i}")), 0.5).alias(f"d{i}") for i in range(p)]))
    diagonal = F.array(*[(1 / (F.pow(1.4826 * F.col(f"d{i}"), 2) + FLOOR[i] ** 2)) if i == j else F.lit(0.0)
                         for i in range(p) for j in range(p)])
    now = medians.join(spread, "pool").select("pool", F.array(*[f"m{i}" for i in range(p)]).alias("mean"),
                                              diagonal.alias("inverse"))
    for _ in range(STEPS):
        measured = vectors.join(now, "pool").withColumn("d", _distance([F.col("mean")[i] for i in range(p)], F.col("inverse")))
        limit = measured.groupBy("pool").agg(F.percentile_approx("d", SUBSET).alias("most"))
        near = measured.join(limit, "pool").where("d <= most")
        sums = near.groupBy("pool").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(f"v{i}").alias(f"s{i}") for i in range(p)],
            *[F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"q{i}_{j}") for i in range(p) for j in range(p)])
        now = cut_lineage(sums.mapInPandas(_invert, "pool string, mean array<double>, inverse array<double>"))
    return now


def judge(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Struct ``row`` of the columns ``keep`` of every row of ``docs(text, lang, source, ...)``, the counts,
    ``base_failed``, ``distance`` (squared; null where nothing could be estimated) and ``kept``."""
    narrow = cut_lineage(with_counts(docs, ["lang"]).where("n_words > 0 and not base_failed").select("grp", *VECTOR))
    pools = cut_lineage(_pools(narrow))
    same = F.col("lang").eqNullSafe(F.col("grp.lang")) & F.col("source").eqNullSafe(F.col("grp.source"))
    vectors = cut_lineage(narrow.join(pools, same).select("pool", *VECTOR))
    found = cut_lineage(pools.join(robust_estimates(vectors), "pool").select("lang", "source", "mean", "inverse"))
    if found.count() <= BROADCAST_GROUPS:
        found = F.broadcast(found)
    rows = with_counts(docs, keep)
    rows = rows.join(found, same, "left")
    shrink = F.col("n_words") / (F.col("n_words") + SHRINK)
    d = shrink * _distance([F.col("mean")[i] for i in range(len(VECTOR))], F.col("inverse"))
    return rows.select("row", *_COUNTS, "base_failed", d.alias("distance"),
                       (~F.col("base_failed") & F.coalesce(d <= CUTOFF, F.lit(True))).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    return judge(docs, docs.columns).where("kept").select("row.*")

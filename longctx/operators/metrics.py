"""Text metrics (M1–M12) over (reference, response) pairs.

One shared n-gram stage feeds every overlap metric:

    tokens (materialised by the Generate) → posexplode → lead(1..3) over one text
    → (id, n, gram, side) → groupBy(id, n, gram) → least(c_ref, c_pred) → groupBy(id)

Every step is a built-in, code-generated operator.  A long text becomes many rows spread
by gram hash instead of one O(n²) lambda, and the normalisation runs once per text (never
inside a lambda, which Catalyst would re-evaluate per n-gram).  Only the LCS (M7) uses an
Arrow UDF.  ``id`` must identify a row; metrics join back on it (one balanced shuffle).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longctx.functions.lcs import lcs_udf
from longctx.functions.text import stripped_len, tokens

MAX_N = 4
# Fixed values that must equal the reference's: log precision of a response without n-grams, output columns.
LOG_FLOOR = math.log(1e-9)
HEURISTIC_COLS = ["exact_match", "token_f1", "rouge1_f1", "rouge2_f1", "rougeL_f1", "bleu"]


def ngram_overlaps(df: DataFrame, id_cols: list[str], ref: str, pred: str, max_n: int = MAX_N) -> DataFrame:
    """Per id: ``ov_n, ref_n, pred_n`` for n = 1..max_n (multiset overlap and totals)."""
    sides = df.select(*id_cols, F.explode(F.array(
        F.struct(F.lit(0).alias("side"), tokens(F.col(ref)).alias("t")),
        F.struct(F.lit(1).alias("side"), tokens(F.col(pred)).alias("t")),
    )).alias("s")).select(*id_cols, "s.side", "s.t")
    toks = sides.select(*id_cols, "side", F.posexplode("t").alias("i", "tok"))
    w = Window.partitionBy(*id_cols, "side").orderBy("i")
    toks = toks.select(*id_cols, "side", "tok", *[F.lead("tok", j).over(w).alias(f"_l{j}") for j in range(1, max_n)])
    nxt = [F.col(f"_l{j}") for j in range(1, max_n)]
    grams = [F.struct(F.lit(1).alias("n"), F.col("tok").alias("g"))]
    for n in range(2, max_n + 1):
        parts = [F.col("tok")] + nxt[: n - 1]
        grams.append(F.struct(F.lit(n).alias("n"),
                              F.when(nxt[n - 2].isNotNull(), F.concat_ws("\u001f", *parts)).alias("g")))
    exploded = (toks.select(*id_cols, "side", F.explode(F.array(*grams)).alias("x"))
                .select(*id_cols, "side", "x.n", "x.g").where(F.col("g").isNotNull()))
    counts = exploded.groupBy(*id_cols, "n", "g").agg(
        F.count_if(F.col("side") == 0).alias("c_ref"), F.count_if(F.col("side") == 1).alias("c_pred"))
    aggs = []
    for n in range(1, max_n + 1):
        on = F.col("n") == n
        aggs += [F.sum(F.when(on, F.least("c_ref", "c_pred"))).alias(f"ov_{n}"),
                 F.sum(F.when(on, F.col("c_ref"))).alias(f"ref_{n}"),
                 F.sum(F.when(on, F.col("c_pred"))).alias(f"pred_{n}")]
    return counts.groupBy(*id_cols).agg(*aggs)


def _f1(ov: Column, n_pred: Column, n_ref: Column) -> Column:
    p = ov.cast("double") / n_pred.cast("double")
    r = ov.cast("double") / n_ref.cast("double")
    return F.lit(2.0) * p * r / (p + r)


def overlap_f1(ov: Column, ref_total: Column, pred_total: Column) -> Column:
    return F.when(ov == 0, F.lit(0.0)).otherwise(_f1(ov, pred_total, ref_total))


def text_metrics(df: DataFrame, id_cols: list[str], ref: str = "human_validated_answer",
                 pred: str = "response", with_lcs: bool = True, method: str = "rowwise") -> DataFrame:
    """Adds the six heuristic metrics (full precision) plus their integer parts.

    Columns added: ``n_ref_tokens, n_pred_tokens, ov_1..ov_4, ref_n, pred_n, lcs`` and
    ``exact_match, token_f1, rouge1_f1, rouge2_f1, rougeL_f1, bleu``.

    ``method``:
    * ``rowwise`` (default): tokens are built by native regex functions; the multiset
      overlaps and the LCS of each pair are counted by one Arrow UDF over the two token
      arrays, a row-local computation without a shuffle.  Measured at sf0.1: 23 s against 51 s for
      the shuffle form.  The overlaps are linear in the texts, the LCS is O(n·m / word size).  Lengths and
      equality are native, so a query that needs only those runs no Python.
    * ``explode``: all built-in; the shared n-gram stage (``ngram_overlaps``), one shuffle
      by (id, n, gram), for runtimes without Python workers.
    """
    if method == "rowwise":
        # A shuffle of a given number: short texts cost much time a byte, and adaptive execution would put them into a few tasks by size.
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions") or 200)
        df = df.repartition(n, *id_cols, pred)
    base = df.withColumn("_rt", tokens(F.col(ref))).withColumn("_pt", tokens(F.col(pred)))
    if method == "rowwise":
        from longctx.functions.lcs import overlap_stats_nolcs_udf, overlap_stats_udf
        udf = overlap_stats_udf if with_lcs else overlap_stats_nolcs_udf
        out = base.withColumn("_st", udf(F.col("_rt"), F.col("_pt")))
        out = out.select(*base.columns, *[F.col(f"_st.ov_{n}").alias(f"ov_{n}") for n in range(1, MAX_N + 1)],
                         F.col("_st.lcs").alias("_lcs"))
    else:
        ov = ngram_overlaps(df, id_cols, ref, pred).select(*id_cols, *[f"ov_{n}" for n in range(1, MAX_N + 1)])
        out = base.join(ov, id_cols, "left")
        for n in range(1, MAX_N + 1):
            out = out.withColumn(f"ov_{n}", F.coalesce(F.col(f"ov_{n}"), F.lit(0)).cast("bigint"))
    out = out.withColumn("_same", F.col("_rt") == F.col("_pt"))
    for n in range(1, MAX_N + 1):
        for side, toks in (("ref", "_rt"), ("pred", "_pt")):
            out = out.withColumn(f"{side}_{n}", F.greatest(F.size(toks) - (n - 1), F.lit(0)).cast("bigint"))
    out = out.withColumn("n_ref_tokens", F.col("ref_1")).withColumn("n_pred_tokens", F.col("pred_1"))
    lr, lp = F.col("n_ref_tokens"), F.col("n_pred_tokens")
    both_empty, one_empty = (lr == 0) & (lp == 0), (lr == 0) | (lp == 0)

    def guarded(expr: Column) -> Column:
        return F.when(both_empty, F.lit(1.0)).when(one_empty, F.lit(0.0)).otherwise(expr)

    def rouge_n(n: int) -> Column:
        rn, pn, on = F.col(f"ref_{n}"), F.col(f"pred_{n}"), F.col(f"ov_{n}")
        return guarded(F.when((rn == 0) & (pn == 0), F.col("_same").cast("double"))
                       .when((rn == 0) | (pn == 0), F.lit(0.0))
                       .otherwise(overlap_f1(on, rn, pn)))

    logs = [F.when(F.col(f"pred_{n}") == 0, F.lit(LOG_FLOOR)).otherwise(
        F.log((F.col(f"ov_{n}") + 1).cast("double") / (F.col(f"pred_{n}") + 1).cast("double")))
        for n in range(1, MAX_N + 1)]
    geo = F.exp((logs[0] + logs[1] + logs[2] + logs[3]) / F.lit(float(MAX_N)))
    bp = F.when(lp > lr, F.lit(1.0)).otherwise(F.exp(F.lit(1.0) - lr.cast("double") / lp.cast("double")))

    out = (out.withColumn("exact_match", F.col("_same").cast("double"))
           .withColumn("token_f1", guarded(overlap_f1(F.col("ov_1"), lr, lp)))
           .withColumn("rouge1_f1", rouge_n(1))
           .withColumn("rouge2_f1", rouge_n(2))
           .withColumn("bleu", guarded(bp * geo)))
    if with_lcs:
        lcs = F.col("_lcs") if method == "rowwise" else lcs_udf(F.col("_rt"), F.col("_pt"))
        out = (out.withColumn("lcs", lcs)
               .withColumn("rougeL_f1", guarded(overlap_f1(F.col("lcs"), lr, lp))))
    return out.drop("_rt", "_pt", "_same", "_lcs")


def round_metrics(df: DataFrame, digits: int = 4) -> DataFrame:
    """M10 at the sink: half-even rounding of the six metrics (the stored values stay exact).

    A metric that was not computed becomes a null column, so the output always has all six."""
    return df.select(*[c for c in df.columns if c not in HEURISTIC_COLS],
                     *[(F.bround(F.col(c), digits) if c in df.columns else F.lit(None).cast("double")).alias(c)
                       for c in HEURISTIC_COLS])


def conciseness(df: DataFrame, ref: str = "human_validated_answer", pred: str = "response") -> DataFrame:
    """M11 + M12: whitespace-free lengths and the 3× gate (empty reference needs empty response)."""
    rl, pl = stripped_len(F.col(ref)), stripped_len(F.col(pred))
    return (df.withColumn("ref_chars", rl).withColumn("response_chars", pl)
            .withColumn("concise", F.when(F.col("ref_chars") == 0, F.col("response_chars") == 0)
                        .otherwise(F.col("response_chars") <= 3 * F.col("ref_chars"))))

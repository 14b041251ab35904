"""Pass-rate reports (A9, A10; sinks K12).

Documented but absent in the reference; our definition: ``pass_rate`` = mean of the
non-null ``judge_correct``, with ``n`` rows, ``n_scored`` (non-null verdicts) and
``n_undetermined``.  Grouping sets give the subtotals in one aggregation pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _measures():
    jc = F.col("judge_correct")
    return [F.count(F.lit(1)).alias("n"), F.count(jc).alias("n_scored"),
            F.count_if(jc.isNull()).alias("n_undetermined"), F.sum(jc).cast("bigint").alias("n_pass"),
            F.avg(jc.cast("double")).alias("pass_rate")]


def pass_rate(scored: DataFrame, dims: list[str]) -> DataFrame:
    """Pass rate per ``dims`` with rollup subtotals (``grouping_id`` tells levels apart)."""
    return scored.rollup(*dims).agg(*_measures(), F.grouping_id(*dims).alias("level"))


def pass_rate_sets(scored: DataFrame, sets: list[list[str]]) -> DataFrame:
    """A10: pass rate over explicit grouping sets (e.g. by difficulty within model)."""
    dims = sorted({d for s in sets for d in s})
    grouping = [[F.col(d) for d in s] for s in sets]
    return scored.groupingSets(grouping, *dims).agg(*_measures(), F.grouping_id(*dims).alias("level"))

"""Skew-safe dense ordinal: ``row_number() OVER (PARTITION BY keys ORDER BY order) - 1``.

A window partitioned by a case or pool key puts the whole group into one task.  When one
group holds a third of the data that task is the job.  Here the rows are range-partitioned
on ``keys + order`` instead, so a hot group is split over many partitions; each partition
ranks its slice locally, and a per-(partition, key) count table (at most
``partitions + groups`` rows) supplies the number of rows of the same group that sit in
earlier partitions.

Cost: one range shuffle and one checkpoint of the narrow key rows, one hash shuffle for the
local window, a small join; wide rows are joined back once (or carried when narrow).

Requirements: ``keys + order`` identifies a row, sort is ascending with nulls first (Spark's
default, which is also what the window form uses).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longctx.session import cut_lineage

_PID, _LOCAL, _CARRY, _N = "_lc_pid", "_lc_local", "_lc_carry", "_lc_n"


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions") or 200)


def ordinal_within(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    out_col: str = "ordinal",
    num_partitions: int | None = None,
    carry: bool | None = None,
) -> DataFrame:
    """Add ``out_col`` (0-based, BIGINT) = rank of the row inside its ``keys`` group by ``order``.

    ``carry`` decides whether the non-key columns ride through the range shuffle (narrow
    rows) or whether only the key columns are ranked and joined back (wide rows such as
    page text, which then cross the network once).  Default: carry when every other column
    is a fixed-width type.
    """
    cols = list(keys) + list(order)
    payload = [c for c in df.columns if c not in cols]
    if carry is None:
        wide_types = ("string", "binary", "array", "map", "struct")
        dtypes = dict(df.dtypes)
        carry = not any(dtypes[c].startswith(wide_types) for c in payload)

    base = df if carry else df.select(*cols)
    n = _partitions(df, num_partitions)
    ranged = base.repartitionByRange(n, *cols).withColumn(_PID, F.spark_partition_id())
    # Range bounds come from a sample whose outcome depends on input order.  Both consumers
    # below (local ranks, per-partition counts) must see the same bounds, so the partition id
    # is frozen once, in the shared checkpoint folder, before either reads it.
    ranged = cut_lineage(ranged)
    local = ranged.withColumn(
        _LOCAL, F.row_number().over(Window.partitionBy(_PID, *keys).orderBy(*order)) - 1
    )
    counts = ranged.groupBy(_PID, *keys).agg(F.count(F.lit(1)).alias(_N))
    before = Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    carries = counts.select(_PID, *keys, F.coalesce(F.sum(_N).over(before), F.lit(0)).alias(_CARRY))
    ranked = (
        local.join(carries, [_PID, *keys])
        .withColumn(out_col, (F.col(_LOCAL) + F.col(_CARRY)).cast("bigint"))
        .drop(_PID, _LOCAL, _CARRY)
    )
    if carry:
        return ranked
    return df.join(ranked, cols)


def ordinal_window(df: DataFrame, keys: list[str], order: list[str], out_col: str = "ordinal") -> DataFrame:
    """Plain window form, for groups that are bounded by construction (e.g. one conversation)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out_col, (F.row_number().over(w) - 1).cast("bigint"))

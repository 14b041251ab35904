"""Fixed-size bitmap of keys: drops most rows that cannot match before they are shuffled.

A bitmap of ``BITS`` bits (4 MB, whatever the input) is built by Spark's bitmap aggregates and
broadcast.  A row whose key's bit is not set matches no key; the others still go through the exact
join.  When very many keys fill the bitmap, it only drops fewer rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 25


def _place(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS)) + 1


def key_bitmap(keys: DataFrame, key: str) -> DataFrame:
    """(bucket, bits): at most ``BITS`` bits in rows of 32768."""
    at = _place(key)
    return keys.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))


def _marked(rows: DataFrame, key: str, bitmap: DataFrame) -> DataFrame:
    """``rows`` with ``_hit``: whether the bit of the key is set; null keys and absent buckets give null."""
    at = _place(key)
    known = F.when(F.col(key).isNotNull(), F.bitmap_bucket_number(at))
    marked = rows.withColumn("_bucket", known).join(F.broadcast(bitmap), "_bucket", "left")
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return marked.withColumn("_hit", F.getbit(byte, (place % 8).cast("int")) == 1).drop("_bucket", "_bits")


def may_match(rows: DataFrame, key: str, bitmap: DataFrame) -> DataFrame:
    """Rows whose key may be among the bitmap's keys (all that are, few that are not)."""
    return _marked(rows, key, bitmap).where("_hit").drop("_hit")


def without(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose ``key`` is not among ``keys(key)`` or is null; only the few that may match are shuffled."""
    columns = rows.columns
    bitmap = key_bitmap(keys, key)
    maybe = _marked(rows, key, bitmap)
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    clear = maybe.where(~hit).select(*columns)
    return clear.unionAll(maybe.where(hit).select(*columns).join(keys, key, "left_anti").select(*columns))

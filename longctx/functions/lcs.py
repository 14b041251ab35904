"""M7: longest-common-subsequence length of two token lists, as an Arrow pandas UDF.

No native Spark expression computes an LCS.  The kernel is the bit-parallel algorithm of
Hyyrö (2004): a bit vector over the first list, updated once per token of the second.  The
vector is worked in blocks of ``BLOCK`` bits: a block needs masks only of its own tokens (those that the other text
has too), and passes one carry bit per token of the second list on to the next block.  Time
is O(n·m / word size), memory O(n + m + BLOCK²/8 bytes).
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


BLOCK = 1 << 13


def _block(part: list[int], other: list[int], carry: bytearray) -> int:
    """LCS tokens that end in ``part``, given the carries of the blocks before; ``carry`` becomes those for the next."""
    masks: dict[int, int] = {}
    for i, tok in enumerate(part):
        masks[tok] = masks.get(tok, 0) | 1 << i
    size = len(part)
    full = (1 << size) - 1
    v = full
    for j, tok in enumerate(other):
        mask = masks.get(tok)
        if mask is None:
            if carry[j]:
                total = v + 1
                carry[j] = total >> size
                v |= total & full
            continue
        kept = v & mask
        total = v + kept + carry[j]
        carry[j] = total >> size
        v = (total & full) | (v & ~mask)
    return size - v.bit_count()


def lcs_length(a, b) -> int:
    """Bit-parallel LCS length (exact)."""
    if a is None or b is None or len(a) == 0 or len(b) == 0:
        return 0
    codes = {tok: k for k, tok in enumerate(set(a) & set(b))}  # other tokens are in no common subsequence
    x, y = ([codes[t] for t in side if t in codes] for side in (a, b))
    if len(x) < len(y):
        x, y = y, x
    carry = bytearray(len(y))
    return sum(_block(x[at:at + BLOCK], y, carry) for at in range(0, len(x), BLOCK)) if y else 0


@F.pandas_udf(LongType())
def lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(x, y) for x, y in zip(a, b)], dtype="int64")


def _grams(t: list, n: int) -> Counter:
    return Counter(zip(*[t[i:] for i in range(n)])) if len(t) >= n else Counter()


def overlap_stats_row(a, b, max_n: int = 4, with_lcs: bool = True) -> dict:
    """Multiset overlaps (and LCS) of one (reference, response) token pair."""
    x = list(a) if a is not None else []
    y = list(b) if b is not None else []
    rec = {f"ov_{n}": sum((_grams(x, n) & _grams(y, n)).values()) for n in range(1, max_n + 1)}
    rec["lcs"] = lcs_length(x, y) if with_lcs else None
    return rec


STATS_FIELDS = [f"ov_{n}" for n in range(1, 5)] + ["lcs"]
STATS_SCHEMA = StructType([StructField(f, LongType()) for f in STATS_FIELDS])


def _stats_frame(a: pd.Series, b: pd.Series, with_lcs: bool) -> pd.DataFrame:
    out = pd.DataFrame([overlap_stats_row(x, y, with_lcs=with_lcs) for x, y in zip(a, b)], columns=STATS_FIELDS)
    return out.astype("Int64")


@F.pandas_udf(STATS_SCHEMA)
def overlap_stats_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """M4–M9 integer parts (+ LCS) per row, Arrow-batched; no shuffle."""
    return _stats_frame(a, b, True)


@F.pandas_udf(STATS_SCHEMA)
def overlap_stats_nolcs_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return _stats_frame(a, b, False)

"""Operator 12: shards by a minimax contiguous partition of ordered atomic groups.

Equal texts are one group and stay together (null and empty texts are one group too).  A row's size is its
UTF-8 bytes (null: none) plus 8.  Groups are ordered by a 63-bit digest of their text (texts that share it, about one
pair in 2**63, count as equal).  A shard is a contiguous run of groups, and its capacity is as small as it can be; a
group above that capacity has a shard of its own, so the largest shard is as small as any contiguous partition allows
and one large group does not leave the others uneven.

Method: binary search for the smallest feasible capacity; a capacity is checked greedily: fill a shard until the next
group would exceed it, cut there, go on.  The shards are the greedy cuts at that capacity.  The driver never sees the groups.
A round sums sizes by ranges of digests (about ``CELLS`` rows); range borders are group borders, and a range whose least
and greatest digest agree is one group.  Groups inside other ranges are unknown, so the check is run twice: cutting
at known borders only (what is feasible there is feasible), and as if a cut were possible anywhere in an unknown range
(what is infeasible there is infeasible).  The two answers enclose the optimum, and two greedy runs enclose every cut.  The next
round splits only the ranges that those intervals touch, hundreds of times finer; when none is left, the known
borders decide alone and the result is exact.  A round reads the narrow rows (id, size, digest), never the texts.

Each row finds its shard by comparing its own digest with the cut digests: no join on texts, so a group that
holds a third of all rows stays spread over tasks as its rows are.  ``slot`` is the rank inside the shard by
(id, digest), from a range partition (``ordinal_within``).

Nulls and edge cases: null ids come first in a shard; equal rows take slots after each other; an empty table gives no
rows; with fewer groups than shards the last shards stay empty.  Further columns, whatever their names, ride along in ``row``.
"""

from __future__ import annotations

import bisect
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longctx.operators.ordinal import ordinal_within
from longctx.session import cut_lineage

OVERHEAD = 8
CELLS = 1 << 16
_BITS = 63


def _body(text: str) -> Column:
    return F.coalesce(F.encode(F.col(text).cast("string"), "utf-8"), F.lit(b""))


def text_digest(text: str) -> Column:
    """The first 63 bits of the text's md5 as a non-negative long."""
    hexed = F.md5(_body(text))
    return (F.shiftleft(F.conv(F.substring(hexed, 1, 15), 16, 10).cast("long"), 3)
            + F.shiftright(F.conv(F.substring(hexed, 16, 1), 16, 10).cast("int"), 1))


def row_size(text: str) -> Column:
    return F.octet_length(_body(text)).cast("long") + OVERHEAD


class Ranges:
    """The order of groups as far as it is known: ranges of digests (first, last, bytes), in order.

    A range is one group if its first and last digest agree.
    """

    def __init__(self, ranges: list[tuple[int, int, int]]):
        self.ranges = sorted(ranges)
        self.ends, self.total = [], 0
        for _, _, size in self.ranges:
            self.total += size
            self.ends.append(self.total)

    def _step(self, at: int, capacity: int, hopeful: bool) -> int:
        """End of a shard that begins at byte ``at``: at known borders only, or (``hopeful``) as far as
        unknown groups may allow."""
        if at >= self.total:
            return at
        here = bisect.bisect_right(self.ends, at)
        first, last, _ = self.ranges[here]
        if self.ends[here] > at + capacity and (hopeful or first == last):
            return self.ends[here]  # a group above the capacity has a shard of its own
        k = bisect.bisect_right(self.ends, at + capacity)
        if hopeful and k < len(self.ranges) and self.ranges[k][0] != self.ranges[k][1]:
            return at + capacity
        return max(at, self.ends[k - 1]) if k else at

    def cuts(self, capacity: int, shards: int, hopeful: bool = False) -> list[int]:
        """Ends of the shards that the greedy run makes; the last is ``total`` if the capacity is enough."""
        out, at = [], 0
        for _ in range(shards):
            at = self._step(at, capacity, hopeful)
            out.append(at)
        return out

    def least(self, shards: int, hopeful: bool = False) -> int:
        """Binary search for the smallest capacity with which the greedy run reaches the end."""
        lo, hi = 0, self.total
        while lo < hi:
            mid = (lo + hi) // 2
            if self.cuts(mid, shards, hopeful)[-1] >= self.total:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def open_ranges(self, shards: int) -> list[tuple[int, int, int]]:
        """Ranges of several groups in which a cut of the best partition may lie."""
        low, high = self.least(shards, hopeful=True), self.least(shards)
        found = set()
        for a, b in zip(self.cuts(low, shards), self.cuts(high, shards, hopeful=True), strict=True):
            k = bisect.bisect_right(self.ends, a)
            while k < len(self.ranges) and self.ends[k] - self.ranges[k][2] < b:
                if self.ranges[k][0] != self.ranges[k][1]:
                    found.add(self.ranges[k])
                k += 1
        return sorted(found)

    def borders(self, shards: int) -> list[int]:
        """The digest at which each shard but the first begins; shards beyond the last group have none."""
        starts = [bisect.bisect_right(self.ends, at) for at in self.cuts(self.least(shards), shards)]
        return [self.ranges[k][0] for k in starts if k < len(self.ranges)]


def cut_digests(sized: DataFrame, shards: int, cells: int = CELLS) -> list[int]:
    """The ``shards - 1`` digests (or fewer) that begin a shard; ``sized`` has (digest, size) and is read a few times."""
    bits, known, cell = max(1, cells.bit_length() - 1), None, None
    rows = sized
    while True:
        where = F.shiftright(F.col("digest"), _BITS - bits)
        found = rows.groupBy(where.alias("cell")).agg(
            F.min("digest").alias("first"), F.max("digest").alias("last"), F.sum("size").alias("size"))
        new = [(r["first"], r["last"], r["size"]) for r in found.toLocalIterator()]
        if known is not None:
            gone = set(cell)
            new += [r for r in known.ranges if r not in gone]
        known = Ranges(new)
        cell = known.open_ranges(shards)
        if not cell:
            return known.borders(shards)
        prefixes = sorted({r[0] >> (_BITS - bits) for r in cell})
        rows = sized.where(where.isin(prefixes))
        bits = min(_BITS, bits + max(1, (cells // len(prefixes)).bit_length() - 1))


def shard_of(digest: Column, borders: list[int]) -> Column:
    return reduce(add, [(digest >= F.lit(b)).cast("int") for b in borders], F.lit(0))


def assign(docs: DataFrame, shards: int = 24, keep: list[str] | None = None, doc_id: str = "doc_id", text: str = "text",
           cells: int = CELLS) -> DataFrame:
    """Struct ``row`` of the columns ``keep`` (default all but the text), ``size, text_crc32, shard, slot``."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    sized = cut_lineage(docs.select(F.struct(*keep).alias("row"), F.col(doc_id).alias("id"), row_size(text).alias("size"),
                                    F.crc32(_body(text)).alias("text_crc32"), text_digest(text).alias("digest")))
    borders = cut_digests(sized.select("digest", "size"), shards, cells)
    dealt = sized.withColumn("shard", shard_of(F.col("digest"), borders))
    return ordinal_within(dealt, ["shard"], ["id", "digest"], "slot", carry=True).select(
        "row", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 24, doc_id: str = "doc_id", text: str = "text",
                 files: int | None = None) -> None:
    """Write ``docs`` as Parquet in one folder a shard (``shard=K``), rows in the order of their slots.

    The texts are shuffled once, by (shard, id, digest) ranges, so a shard is written by many tasks.
    A column of ``docs`` named ``shard`` is refused by Spark's writer.
    """
    sized = cut_lineage(docs.select(row_size(text).alias("size"), text_digest(text).alias("digest")))
    borders = cut_digests(sized, shards)
    key = text_digest(text)
    ranged = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("id"), key.alias("digest"))
    order = [shard_of(F.col("digest"), borders).alias("shard"), F.col("id"), F.col("digest")]
    n = files or max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions") or 200))
    placed = ranged.select("row", *order)
    (placed.repartitionByRange(n, "shard", "id", "digest").sortWithinPartitions("shard", "id", "digest")
     .select("row.*", "shard").write.partitionBy("shard").parquet(path))

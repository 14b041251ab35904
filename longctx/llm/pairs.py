"""Exact checks of candidate pairs against whole texts, split so that no hub fills one task."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longctx.llm.prefilter import key_bitmap, may_match
from longctx.session import cut_lineage

#: Members of one hub that meet its text in one group.
GROUP = 64


def check_against_hubs(pairs: DataFrame, texts: DataFrame, check: Callable[[pa.Table, pa.Table], pa.Table],
                       schema: str, keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """Run ``check(members, hub)`` on every group of at most about ``GROUP`` members of one hub.

    ``pairs(hub, mem, ...)``, a frame whose lineage is cut, has one row per pair; ``texts(id, text)`` one row
    per text.  ``check`` gets tables (hub, mem, salt, text, ...) and (id, part, hub_text), where id
    is the hub.  A hub with very many members is dealt to several groups by the hash of the member;
    its own text is sent once per group, each member's text once per pair.  Texts that occur in no
    pair are dropped by a fixed-size bitmap before they would be shuffled.  ``keep`` cuts the lineage of the dealt pairs.
    """
    counts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("_groups"))
    salted = keep(pairs.join(counts, "hub").withColumn(
        "salt", F.pmod(F.xxhash64("mem"), F.col("_groups"))).drop("_groups"))
    mine, theirs = (may_match(texts, "id", key_bitmap(salted.select(F.col(c).alias("id")), "id"))
                    for c in ("mem", "hub"))
    members = salted.join(mine.select(F.col("id").alias("mem"), "text"), "mem")
    hubs = salted.select(F.col("hub").alias("id"), F.col("salt").alias("part")).distinct().join(
        theirs.select("id", F.col("text").alias("hub_text")), "id").select("id", "part", "hub_text")
    return members.groupBy("hub", "salt").cogroup(hubs.groupBy("id", "part")).applyInArrow(check, schema)

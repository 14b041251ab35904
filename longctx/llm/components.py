"""Connected components by alternating large-star and small-star (Kiveris et al., 2014).

Edges stay a DataFrame.  Each star is one ``min`` aggregate per node (combined map-side, so a
node with a third of all edges sends one partial row per task) and one join of the edges with
those minima, which AQE splits when a node is hot.  Every round is written to the shared
folder and the one before it removed.  A round changes nothing exactly when the edges form stars around component minima.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longctx.session import cut_lineage, drop_shared, free_shuffles, shared_table


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of u to the least of u and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _oriented(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link u and its smaller neighbours to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _oriented(moved.union(least.select("a", F.col("m").alias("b"))))


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]


def connected_components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)`` for every node that has an edge to another node.

    ``component`` is the least node reachable.  Self loops, repeated edges and either direction
    are allowed; null ends are ignored; no edges give no rows.  ``keep`` cuts the lineage of the result.
    """
    spark = edges.sparkSession
    cur, path = shared_table(_oriented(edges.where("a is not null and b is not null")), "edges")
    seen = _state(cur)
    while seen[0]:
        cur, at = shared_table(_small_star(_large_star(cur)), "edges")
        drop_shared(spark, path)
        path, before, seen = at, seen, _state(cur)
        if seen == before:
            break
    tops = cur.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    out = keep(cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops))
    drop_shared(spark, path)
    free_shuffles(spark)
    return out

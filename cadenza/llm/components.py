"""Connected components of an edge table by alternating large-star and small-star steps.

Each step points the neighbours of a vertex at the smallest vertex it knows; the steps stop when the edges no
longer change, after a number of rounds that grows with the logarithm of the longest path. A vertex with very
many neighbours is never gathered in one task: its smallest neighbour is an aggregate with map-side partial
results, the vertices with the most edges (at most 2 * HEAVY_SHARE of them, by counting) are joined by
broadcast, and all others by a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.scratch import discard, materialize

#: A vertex with more than 1/HEAVY_SHARE of all edge ends is joined by broadcast; there are at most HEAVY_SHARE of them.
HEAVY_SHARE = 1000


def _with_least(arcs: DataFrame, n_arcs: int) -> DataFrame:
    """`arcs` (u, v) with `m`, the smallest of u and its neighbours v."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    least = materialize(least.withColumn("m", F.least("u", "m")), "least")
    limit = max(1000, n_arcs // HEAVY_SHARE)
    heavy = F.broadcast(least.where(F.col("n") > limit).select("u", F.col("m").alias("heavy_m")))
    marked = arcs.join(heavy, "u", "left")
    common = least.where(F.col("n") <= limit).select("u", "m")
    return marked.where("heavy_m IS NOT NULL").select("u", "v", F.col("heavy_m").alias("m")).unionByName(
        marked.where("heavy_m IS NULL").select("u", "v").join(common, "u").select("u", "v", "m")
    )


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component): the smallest vertex that each vertex is connected with.

    `edges` has the columns u and v of one orderable type. Rows with a null end and loops are ignored; vertices
    without another one do not appear. Repeated edges count once. No edges: no rows.
    """
    edges = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "edges")
    before = _fingerprint(edges)
    while before[0]:  # every round that changes an edge points it at a smaller vertex, so this ends
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "large")
        small = _with_least(large, before[0])
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        small = materialize(small, "small")
        discard(large)
        discard(edges)
        after, edges = _fingerprint(small), small
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    )

"""Connected components by alternating large and small stars, on any number of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwatch.runtime import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge; root is the smallest node it reaches.

    `edges` holds two columns of longs, in any direction, repeats allowed. Each
    round joins edges with the smallest neighbour of their end, which is
    aggregated map-side, so that a hub is never gathered in one task; the
    rounds grow with the logarithm of the longest path. Each round is stored,
    so a lost executor repeats one round at most. The joins are merges on the
    shuffle of their aggregate: the driver builds no table to broadcast, however
    many rounds there are.
    """
    a, b = (F.col(c) for c in edges.columns)
    stars = materialize(
        edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    seen = None
    while (now := _signature(stars)) != seen:
        seen = now
        if now[0] == 0:
            break
        stars = materialize(_small_star(_large_star(stars)), "stars")
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _signature(stars: DataFrame) -> tuple:
    row = stars.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))
    ).first()
    return tuple(row)


def _large_star(stars: DataFrame) -> DataFrame:
    both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    # Of both directions only (small, large) is moved: large hangs on the smallest neighbour of small.
    low = stars.select(F.col("v").alias("u"), F.col("u").alias("far"))
    return low.join(least.hint("merge"), "u").select(F.col("far").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    least = stars.groupBy("u").agg(F.min("v").alias("m"))
    pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
    return stars.join(least.hint("merge"), "u").select(F.inline(pairs)).where("u <> v").distinct()

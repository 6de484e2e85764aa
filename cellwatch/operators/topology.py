"""Neighbours by shared edges and corners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwatch.functions import geometry as geo

# Coordinates that agree to so many digits are one point: a tenth of a millimetre of latitude.
DIGITS = 9


def _point(p: Column, digits: int) -> Column:
    """A vertex by its rounded coordinates; adding 0.0 turns a negative zero into zero."""
    return F.struct((F.round(p[0], digits) + F.lit(0.0)).alias("x"), (F.round(p[1], digits) + F.lit(0.0)).alias("y"))


def cell_edges(cells: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(grid_id, edge): the sides of each cell once, each by its ordered end points."""
    sides = F.flatten(
        F.transform(
            F.flatten(F.col("geometry")),
            lambda ring: F.transform(
                F.slice(ring, 2, F.size(ring)),
                lambda p, i: F.struct(F.least(_point(p, digits), _point(ring[i], digits)).alias("low"), F.greatest(_point(p, digits), _point(ring[i], digits)).alias("high")),
            ),
        )
    )
    return cells.select("grid_id", F.explode(F.array_distinct(sides)).alias("edge")).where(F.col("edge.low") != F.col("edge.high"))


def cell_corners(cells: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(grid_id, corner): the vertices of each cell once."""
    corners = F.array_distinct(F.transform(geo.points(F.col("geometry")), lambda p: _point(p, digits)))
    return cells.select("grid_id", F.explode(corners).alias("corner"))


def _pairs(keyed: DataFrame, key: str) -> DataFrame:
    """Both directions of the pairs of different cells under one key.

    In a partition of the plane few cells share a side or a corner, so a hash
    join on the key has no group of many rows.
    """
    other = keyed.select(F.col("grid_id").alias("neighbour_id"), key)
    return keyed.join(other, key).where("grid_id <> neighbour_id").select("grid_id", "neighbour_id").distinct()


def topological_neighbours(cells: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(grid_id, neighbour_id, contact): cells that share an edge, or only a corner."""
    edges = _pairs(cell_edges(cells, digits), "edge").withColumn("contact", F.lit("edge"))
    corners = _pairs(cell_corners(cells, digits), "corner").withColumn("contact", F.lit("corner"))
    return edges.unionByName(corners).groupBy("grid_id", "neighbour_id").agg(F.max("contact").alias("contact"))


def order_two(neighbours: DataFrame) -> DataFrame:
    """(grid_id, neighbour_id): cells two steps over edges away, those one step away left out."""
    step = neighbours.where("contact = 'edge'").select("grid_id", "neighbour_id")
    onward = step.select(F.col("grid_id").alias("neighbour_id"), F.col("neighbour_id").alias("far_id"))
    far = step.join(onward, "neighbour_id").where("grid_id <> far_id").select("grid_id", F.col("far_id").alias("neighbour_id")).distinct()
    return far.join(step, ["grid_id", "neighbour_id"], "left_anti")

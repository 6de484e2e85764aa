"""Geometry as column expressions over nested coordinate arrays.

Every geometry is held as `array<array<array<array<double>>>>`: polygons, each
a list of rings, each a list of (longitude, latitude) points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<array<array<double>>>"
PARTS = "array<array<array<array<double>>>>"


def parts(kind: Column, coordinates: Column) -> Column:
    """Parsed coordinates: a Polygon becomes a one-part MultiPolygon."""
    return F.when(kind == "Polygon", F.array(F.from_json(coordinates, RING))).when(
        kind == "MultiPolygon", F.from_json(coordinates, PARTS)
    )


def points(geometry: Column) -> Column:
    """All vertices of all rings."""
    return F.flatten(F.flatten(geometry))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def vertex_mean(geometry: Column, axis: int) -> Column:
    """Plain mean of one coordinate over all vertices, closing vertex included."""
    values = F.transform(points(geometry), lambda p: p[axis])
    return F.when(F.size(values) > 0, _sum(values) / F.size(values))


def _shifted(ring: Column, axis: int) -> Column:
    origin = ring[0][axis]
    return F.transform(ring, lambda p: p[axis] - origin)


def ring_moments(ring: Column) -> Column:
    """Signed area and first moments of a ring, relative to its first vertex."""
    x, y = _shifted(ring, 0), _shifted(ring, 1)
    steps = F.zip_with(
        F.arrays_zip(x.alias("x"), y.alias("y")),
        F.arrays_zip(
            F.slice(x, 2, F.size(x)).alias("x"),
            F.slice(y, 2, F.size(y)).alias("y"),
        ),
        lambda a, b: F.struct(
            (a["x"] * b["y"] - b["x"] * a["y"]).alias("cross"),
            (a["x"] + b["x"]).alias("sx"),
            (a["y"] + b["y"]).alias("sy"),
        ),
    )
    steps = F.filter(steps, lambda s: s["cross"].isNotNull())
    return F.struct(
        (_sum(F.transform(steps, lambda s: s["cross"])) / 2).alias("area"),
        (_sum(F.transform(steps, lambda s: s["cross"] * s["sx"])) / 6).alias("mx"),
        (_sum(F.transform(steps, lambda s: s["cross"] * s["sy"])) / 6).alias("my"),
        ring[0][0].alias("x0"),
        ring[0][1].alias("y0"),
    )


def _weighted(geometry: Column) -> Column:
    """Per ring: area counted positive for shells and negative for holes."""
    per_polygon = F.transform(
        geometry,
        lambda polygon: F.transform(
            polygon,
            lambda ring, i: F.struct(
                ring_moments(ring).alias("m"),
                F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("sign"),
            ),
        ),
    )
    return F.flatten(per_polygon)


def area(geometry: Column) -> Column:
    return _sum(F.transform(_weighted(geometry), lambda r: r["sign"] * F.abs(r["m"]["area"])))


def area_centroid(geometry: Column, axis: int) -> Column:
    """Area-weighted centroid coordinate of all polygons, holes subtracted."""
    rings = _weighted(geometry)
    moment, origin = ("mx", "x0") if axis == 0 else ("my", "y0")
    base = geometry[0][0][0][axis]
    weighted = F.transform(
        rings,
        lambda r: r["sign"]
        * F.signum(r["m"]["area"])
        * (r["m"][moment] + r["m"]["area"] * (r["m"][origin] - base)),
    )
    return base + _sum(weighted) / F.nullif(area(geometry), F.lit(0.0))


def bounds(geometry: Column) -> Column:
    """Smallest and largest longitude and latitude."""
    lon = F.transform(points(geometry), lambda p: p[0])
    lat = F.transform(points(geometry), lambda p: p[1])
    return F.struct(
        F.array_min(lon).alias("min_lon"),
        F.array_max(lon).alias("max_lon"),
        F.array_min(lat).alias("min_lat"),
        F.array_max(lat).alias("max_lat"),
    )


def rings_closed(geometry: Column) -> Column:
    """Every ring has four points or more and ends where it starts."""
    return F.forall(
        F.flatten(geometry),
        lambda ring: (F.size(ring) >= 4)
        & (ring[0][0] == F.element_at(ring, -1)[0])
        & (ring[0][1] == F.element_at(ring, -1)[1]),
    )

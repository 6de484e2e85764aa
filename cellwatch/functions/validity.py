"""Validity of polygons as column expressions, without a shuffle or a UDF.

The segments of a geometry are swept in the order of their least longitude; a
segment is compared only with those that still reach it. Rings must be simple,
holes lie in their shell and apart from each other, and the parts of a
MultiPolygon must not overlap. Rings may touch in one point.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"


def _cross(ax, ay, bx, by, px, py) -> Column:
    """Positive where p lies left of the line from a to b, zero on it."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def _within(s: Column, px: Column, py: Column) -> Column:
    """A point of the segment's line lies between its ends."""
    return px.between(F.least(s["x1"], s["x2"]), F.greatest(s["x1"], s["x2"])) & py.between(F.least(s["y1"], s["y2"]), F.greatest(s["y1"], s["y2"]))


def _on(s: Column, px: Column, py: Column) -> Column:
    return (_cross(s["x1"], s["y1"], s["x2"], s["y2"], px, py) == 0) & _within(s, px, py)


def segments(geometry: Column) -> Column:
    """Segments of all rings with part, ring, place in the ring and number of the ring's segments; those of no length are left out.

    Sorted by their least longitude.
    """

    def of_ring(ring: Column, part: Column, number: Column) -> Column:
        points = F.filter(ring, lambda p, i: (i == 0) | (p[0] != ring[i - 1][0]) | (p[1] != ring[i - 1][1]))
        return F.transform(
            F.slice(points, 2, F.size(points)),
            lambda p, i: F.struct(
                F.least(p[0], points[i][0]).alias("low"),
                F.greatest(p[0], points[i][0]).alias("high"),
                part.alias("part"),
                number.alias("ring"),
                i.alias("at"),
                (F.size(points) - 1).alias("n"),
                points[i][0].alias("x1"),
                points[i][1].alias("y1"),
                p[0].alias("x2"),
                p[1].alias("y2"),
            ),
        )

    rings = F.transform(geometry, lambda polygon, part: F.flatten(F.transform(polygon, lambda ring, number: of_ring(ring, part, number))))
    return F.array_sort(F.flatten(rings))


def _meeting(a: Column, b: Column) -> Column:
    """How two segments meet: 'cross', 'overlap' along a length, 'touch' in one point, or NULL."""
    b1, b2 = (_cross(a["x1"], a["y1"], a["x2"], a["y2"], b[f"x{i}"], b[f"y{i}"]) for i in (1, 2))
    a1, a2 = (_cross(b["x1"], b["y1"], b["x2"], b["y2"], a[f"x{i}"], a[f"y{i}"]) for i in (1, 2))
    level = (b1 == 0) & (b2 == 0)
    # On one line, they share more than a point if their shadows do on the wider axis.
    width = F.least(a["high"], b["high"]) - F.greatest(a["low"], b["low"])
    low_y = F.greatest(F.least(a["y1"], a["y2"]), F.least(b["y1"], b["y2"]))
    high_y = F.least(F.greatest(a["y1"], a["y2"]), F.greatest(b["y1"], b["y2"]))
    height = high_y - low_y
    touches = ((b1 == 0) & _within(a, b["x1"], b["y1"])) | ((b2 == 0) & _within(a, b["x2"], b["y2"])) | ((a1 == 0) & _within(b, a["x1"], a["y1"])) | ((a2 == 0) & _within(b, a["x2"], a["y2"]))
    apart = (F.signum(b1) * F.signum(b2) < 0) & (F.signum(a1) * F.signum(a2) < 0)
    return F.when(level & (width >= 0) & (height >= 0) & ((width > 0) | (height > 0)), "overlap").when(apart, "cross").when(touches, "touch")


def _touch_point(a: Column, b: Column) -> Column:
    """The end of one segment that lies on the other."""
    ends = [(a, b["x1"], b["y1"]), (a, b["x2"], b["y2"]), (b, a["x1"], a["y1"]), (b, a["x2"], a["y2"])]
    point = F.lit(None).cast(POINT)
    for s, x, y in reversed(ends):
        point = F.when(_on(s, x, y), F.struct(x.alias("x"), y.alias("y"))).otherwise(point)
    return point


def contacts(geometry: Column) -> Column:
    """Faults among segments: an array of structs (kind, a, b, point).

    `kind` is 'self' for two segments of one ring that meet elsewhere than in
    the vertex between neighbours, 'cross' and 'overlap' for those of two
    rings, and 'touch' for a point in which two rings meet; `a` and `b` name
    the rings as part * 1e6 + ring.
    """
    found_type = f"array<struct<kind:string,a:bigint,b:bigint,point:{POINT}>>"
    swept = segments(geometry)
    state = F.struct(F.filter(swept, lambda s: F.lit(False)).alias("open"), F.array().cast(found_type).alias("found"))

    def name(s: Column) -> Column:
        return s["part"].cast("bigint") * 1_000_000 + s["ring"]

    def compare(old: Column, now: Column) -> Column:
        how = _meeting(old, now)
        same = (old["part"] == now["part"]) & (old["ring"] == now["ring"])
        step = F.abs(old["at"] - now["at"])
        neighbours = (step == 1) | (step == now["n"] - 1)
        kind = F.when(same, F.when((how == "overlap") | ~neighbours | (how == "cross"), "self")).otherwise(how)
        return F.struct(
            F.when(how.isNotNull(), kind).alias("kind"), F.least(name(old), name(now)).alias("a"), F.greatest(name(old), name(now)).alias("b"), _touch_point(old, now).alias("point")
        )

    def step(acc: Column, now: Column) -> Column:
        reach = F.filter(acc["open"], lambda s: s["high"] >= now["low"])
        hits = F.filter(F.transform(reach, lambda old: compare(old, now)), lambda c: c["kind"].isNotNull())
        return F.struct(F.concat(reach, F.array(now)).alias("open"), F.concat(acc["found"], hits).cast(found_type).alias("found"))

    return F.aggregate(swept, state, step, lambda acc: acc["found"])


def place_in_ring(ring: Column, x: Column, y: Column) -> Column:
    """1 inside a closed ring, 0 on it, -1 outside, by counting crossings of a ray."""
    edges = F.transform(F.slice(ring, 2, F.size(ring)), lambda p, i: F.struct(ring[i][0].alias("x1"), ring[i][1].alias("y1"), p[0].alias("x2"), p[1].alias("y2")))
    straddles = F.filter(edges, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & ((_cross(e["x1"], e["y1"], e["x2"], e["y2"], x, y) > 0) == (e["y2"] > e["y1"])))
    return F.when(F.exists(edges, lambda e: _on(e, x, y)), 0).when(F.size(straddles) % 2 == 1, 1).otherwise(-1)


def _samples(ring: Column) -> Column:
    """Vertices and middles of the segments of a ring."""
    vertices = F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    middles = F.transform(F.slice(ring, 2, F.size(ring)), lambda p, i: F.struct(((p[0] + ring[i][0]) / 2).alias("x"), ((p[1] + ring[i][1]) / 2).alias("y")))
    return F.concat(vertices, middles)


def _strictly_inside(inner: Column, outer: Column) -> Column:
    return F.exists(_samples(inner), lambda p: place_in_ring(outer, p["x"], p["y"]) == 1)


def _partly_outside(inner: Column, outer: Column) -> Column:
    return F.exists(_samples(inner), lambda p: place_in_ring(outer, p["x"], p["y"]) == -1)


def _holes(polygon: Column) -> Column:
    return F.slice(polygon, 2, F.size(polygon))


def holes_outside(geometry: Column) -> Column:
    """A hole reaches out of its shell or holds a piece of it."""
    return F.exists(geometry, lambda polygon: F.exists(_holes(polygon), lambda hole: _partly_outside(hole, polygon[0]) | _strictly_inside(polygon[0], hole)))


def nested_holes(geometry: Column) -> Column:
    """A hole has points inside another hole of its polygon."""
    return F.exists(
        geometry,
        lambda polygon: F.exists(F.transform(_holes(polygon), lambda hole, i: F.exists(F.filter(_holes(polygon), lambda other, j: j != i), lambda other: _strictly_inside(hole, other))), lambda bad: bad),
    )


def overlapping_parts(geometry: Column) -> Column:
    """A part has points inside another part, its holes left out."""

    def inside(polygon: Column, other: Column) -> Column:
        return F.exists(
            _samples(polygon[0]),
            lambda p: (place_in_ring(other[0], p["x"], p["y"]) == 1) & F.forall(_holes(other), lambda hole: place_in_ring(hole, p["x"], p["y"]) == -1),
        )

    return F.exists(F.transform(geometry, lambda polygon, i: F.exists(F.filter(geometry, lambda other, j: j != i), lambda other: inside(polygon, other))), lambda bad: bad)


def disconnected(found: Column) -> Column:
    """Two rings of one polygon touch in more than one point, which parts its inside."""
    touches = F.filter(found, lambda c: (c["kind"] == "touch") & (F.floor(c["a"] / 1_000_000) == F.floor(c["b"] / 1_000_000)))
    distinct = F.array_distinct(F.transform(touches, lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b"), c["point"].alias("point"))))
    return F.exists(distinct, lambda c: F.size(F.filter(distinct, lambda d: (d["a"] == c["a"]) & (d["b"] == c["b"]))) > 1)


def fault(geometry: Column, found: Column, closed: Column) -> Column:
    """First fault of a geometry, NULL for a valid one; `found` are its `contacts`."""
    return (
        F.when(geometry.isNull() | (F.size(geometry) == 0), "EMPTY")
        .when(~F.coalesce(closed, F.lit(False)), "OPEN_RING")
        .when(F.exists(found, lambda c: c["kind"] == "self"), "SELF_INTERSECTION")
        .when(F.exists(found, lambda c: c["kind"].isin("cross", "overlap")), "RINGS_CROSS")
        .when(holes_outside(geometry), "HOLE_OUTSIDE_SHELL")
        .when(nested_holes(geometry), "NESTED_HOLES")
        .when(overlapping_parts(geometry), "OVERLAPPING_PARTS")
        .when(disconnected(found), "DISCONNECTED_INTERIOR")
    )

"""Valid and faulty polygons, and neighbours by shared edges."""

import random

import pytest
from pyspark.sql import functions as F

from cellwatch.functions import geometry as geo
from cellwatch.functions import validity
from cellwatch.operators import quality, topology
from helpers import rows_of

SQUARE = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]


def box(x, y, w, h=None):
    h = w if h is None else h
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]


def cells(spark, shapes):
    rows = [(i, "Polygon", [[[[float(a), float(b)] for a, b in ring] for ring in polygon] for polygon in shape] if shape is not None else None) for i, shape in enumerate(shapes)]
    return spark.createDataFrame(rows, "grid_id int, geometry_type string, geometry array<array<array<array<double>>>>")


def faults(spark, shapes):
    found = {r.grid_id: r.fault for r in quality.geometry_faults(cells(spark, shapes)).collect()}
    return [found.get(i) for i in range(len(shapes))]


CASES = [
    ([[SQUARE]], None),
    ([[list(reversed(SQUARE))]], None),
    ([[[[0, 0], [10, 10], [10, 0], [0, 10], [0, 0]]]], "SELF_INTERSECTION"),
    # A spike, a ring that touches itself, a ring run through twice, a repeated vertex.
    ([[[[0, 0], [10, 0], [15, 0], [10, 0], [10, 10], [0, 0]]]], "SELF_INTERSECTION"),
    ([[[[0, 0], [10, 0], [5, 5], [10, 10], [0, 10], [5, 5], [0, 0]]]], "SELF_INTERSECTION"),
    ([[SQUARE[:-1] + SQUARE]], "SELF_INTERSECTION"),
    ([[[[0, 0], [10, 0], [10, 0], [10, 10], [0, 10], [0, 0]]]], None),
    # A vertex in the middle of a straight side.
    ([[[[0, 0], [5, 0], [10, 0], [10, 10], [0, 10], [0, 0]]]], None),
    ([[SQUARE[:-1]]], "OPEN_RING"),
    ([], "EMPTY"),
    (None, "EMPTY"),
    ([[SQUARE, box(2, 2, 3)]], None),
    ([[SQUARE, [[0, 5], [5, 4], [5, 6], [0, 5]]]], None),
    ([[SQUARE, [[0, 5], [5, 4], [10, 5], [5, 6], [0, 5]]]], "DISCONNECTED_INTERIOR"),
    ([[SQUARE, box(8, 2, 5)]], "RINGS_CROSS"),
    ([[SQUARE, box(0, 2, 3)]], "RINGS_CROSS"),
    ([[SQUARE, box(20, 2, 3)]], "HOLE_OUTSIDE_SHELL"),
    ([[box(2, 2, 3), SQUARE]], "HOLE_OUTSIDE_SHELL"),
    # A hole that leaves the shell through a vertex of it.
    ([[[[0, 0], [10, 0], [5, 5], [10, 10], [0, 10], [0, 0]], [[2, 4.5], [5, 5], [8, 5], [5, 5.5], [2, 4.5]]]], "RINGS_CROSS"),
    ([[SQUARE, box(1, 1, 8), box(3, 3, 2)]], "NESTED_HOLES"),
    ([[SQUARE, box(1, 1, 2), box(3, 3, 2)]], None),
    ([[SQUARE], [box(20, 0, 5)]], None),
    ([[SQUARE], [box(10, 10, 5)]], None),
    ([[SQUARE], [box(10, 0, 5)]], "RINGS_CROSS"),
    ([[SQUARE], [box(2, 2, 3)]], "OVERLAPPING_PARTS"),
    # A part in a hole of another one.
    ([[SQUARE, box(1, 1, 8)], [box(3, 3, 2)]], None),
]


def test_faults_of_known_shapes(spark):
    assert faults(spark, [shape for shape, _ in CASES]) == [fault for _, fault in CASES]


def crosses(p, q, r, s):
    def side(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    return side(p, q, r) * side(p, q, s) < 0 and side(r, s, p) * side(r, s, q) < 0


def test_random_rings_against_all_pairs(spark):
    rng = random.Random(5)
    rings = []
    for _ in range(60):
        ring = [(rng.random(), rng.random()) for _ in range(rng.randint(4, 9))]
        rings.append([*ring, ring[0]])
    want = []
    for ring in rings:
        sides = list(zip(ring, ring[1:]))
        want.append(any(crosses(*sides[i], *sides[j]) for i in range(len(sides)) for j in range(i)))
    assert [f == "SELF_INTERSECTION" for f in faults(spark, [[[r]] for r in rings])] == want
    assert 5 < sum(want) < 60


def test_points_in_a_ring(spark):
    ring = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in [[0, 0], [4, 0], [4, 4], [2, 2], [0, 4], [0, 0]]])
    rows = spark.createDataFrame([(1.0, 1.0, 1), (2.0, 2.0, 0), (2.0, 3.0, -1), (0.0, 2.0, 0), (4.0, 4.0, 0), (5.0, 2.0, -1), (3.5, 3.0, 1), (-1.0, 0.0, -1)], "x double, y double, want int")
    assert rows.where(validity.place_in_ring(ring, F.col("x"), F.col("y")) != F.col("want")).count() == 0


def test_sweep_takes_a_ring_of_many_vertices(spark):
    from math import cos, pi, sin

    ring = [[cos(2 * pi * i / 3000), sin(2 * pi * i / 3000)] for i in range(3000)]
    ring.append(ring[0])
    star = [[cos(2 * pi * i * 7 / 31), sin(2 * pi * i * 7 / 31)] for i in range(31)]
    star.append(star[0])
    assert faults(spark, [[[ring]], [[star]]]) == [None, "SELF_INTERSECTION"]


def grid(spark, gap=(), moved=(), side=4):
    shapes = []
    for at in range(side * side):
        d = 0.3 if at + 1 in moved else 0.0
        shapes.append((at + 1, [[box(at % side + d, at // side + d, 1)]]))
    rows = [(i, [[[[float(a), float(b)] for a, b in ring] for ring in polygon] for polygon in shape]) for i, shape in shapes if i not in gap]
    return spark.createDataFrame(rows, "grid_id int, geometry array<array<array<array<double>>>>")


def test_neighbours_share_an_edge_or_a_corner(spark):
    found = rows_of(topology.topological_neighbours(grid(spark)).where("grid_id = 6"), "neighbour_id", "contact")
    assert found == [(1, "corner"), (2, "edge"), (3, "corner"), (5, "edge"), (7, "edge"), (9, "corner"), (10, "edge"), (11, "corner")]
    assert rows_of(topology.order_two(topology.topological_neighbours(grid(spark))).where("grid_id = 1"), "neighbour_id") == [(3,), (6,), (9,)]


def test_gap_and_moved_cell_show(spark):
    whole = quality.dq_shared_edges(grid(spark), 4).collect()[0].asDict()
    assert whole == {"promised_pairs": 24, "gaps": 0, "edge_pairs": 24, "corner_pairs": 18, "isolated_cells": 0}
    broken = quality.dq_shared_edges(grid(spark, gap=(6,), moved=(16,)), 4).collect()[0].asDict()
    assert (broken["promised_pairs"], broken["gaps"], broken["isolated_cells"]) == (20, 2, 1)
    assert quality.dq_shared_edges(grid(spark, side=0), 4).collect()[0]["edge_pairs"] == 0


@pytest.mark.parametrize("digits, pairs", [(9, 2), (13, 0)])
def test_rounding_joins_ends_that_differ_by_noise(spark, digits, pairs):
    noise = 1e-12
    shapes = [[[box(0, 0, 1)]], [[[[1 + noise, 0], [2, 0], [2, 1], [1 + noise, 1], [1 + noise, 0]]]]]
    assert topology.topological_neighbours(cells(spark, shapes), digits).count() == pairs
    assert cells(spark, shapes).where(geo.rings_closed(F.col("geometry"))).count() == 2

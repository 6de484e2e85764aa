import json
import random
import re

import pytest

from cellwatch.functions import geometry as geom
from cellwatch.operators import geo, quality, star
from cellwatch.sources import reference
from helpers import hourly, rows_of
from pyspark.sql import functions as F

SQUARE = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]


def feature(cell, coordinates, kind="Polygon"):
    geometry = None if coordinates is None else {"type": kind, "coordinates": coordinates}
    return {"type": "Feature", "properties": {"cellId": cell} if cell is not None else {}, "geometry": geometry}


def features(spark, tmp_path, found):
    (tmp_path / "grid.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": found}, indent=1))
    return reference.read_features(spark, str(tmp_path / "grid.geojson"))


def centroid(spark, tmp_path, coordinates, kind="Polygon", of=geo.area_centroids):
    row = of(reference.grid_reference(features(spark, tmp_path, [feature(1, coordinates, kind)]))).collect()[0]
    return row.centroid_longitude, row.centroid_latitude


def test_area_centroid_of_an_l_shape_far_from_the_origin(spark, tmp_path):
    ring = [[9 + x, 45 + y] for x, y in [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2), (0, 0)]]
    assert centroid(spark, tmp_path, [ring]) == pytest.approx((9 + 5 / 6, 45 + 5 / 6))
    assert centroid(spark, tmp_path, [ring[::-1]]) == pytest.approx((9 + 5 / 6, 45 + 5 / 6))


def test_hole_and_parts(spark, tmp_path):
    hole = [[1, 0], [2, 0], [2, 2], [1, 2], [1, 0]]
    assert centroid(spark, tmp_path, [SQUARE, hole]) == pytest.approx((0.5, 1.0))
    far = [[x + 10, y] for x, y in SQUARE]
    assert centroid(spark, tmp_path, [[SQUARE], [far]], "MultiPolygon") == pytest.approx((6.0, 1.0))


def test_vertex_mean_counts_the_closing_vertex(spark, tmp_path):
    assert centroid(spark, tmp_path, [SQUARE], of=geo.vertex_centroids) == pytest.approx((0.8, 0.8))
    repeated = [SQUARE[0], *SQUARE]
    assert centroid(spark, tmp_path, [repeated], of=geo.vertex_centroids) == pytest.approx((4 / 6, 4 / 6))
    assert centroid(spark, tmp_path, [repeated]) == pytest.approx((1.0, 1.0))


def test_unusable_features_are_set_aside(spark, tmp_path):
    found = features(
        spark, tmp_path,
        [feature(1, [SQUARE]), feature(None, [SQUARE]), feature(3, None), feature(4, [1, 2], "Point"), feature(5, [[SQUARE]], "MultiPolygon")],
    )
    assert rows_of(reference.grid_reference(found), "grid_id", "geometry_type") == [(1, "Polygon"), (5, "MultiPolygon")]
    reasons = sorted(r.reject_reason for r in reference.rejected_features(found).collect())
    assert reasons == ["MISSING_CELL_ID", "MISSING_GEOMETRY", "UNSUPPORTED_GEOMETRY"]


def test_last_duplicate_feature_wins_and_keys_run_by_cell(spark, tmp_path):
    shifted = [[x + 4, y] for x, y in SQUARE]
    found = reference.grid_reference(features(spark, tmp_path, [feature(9000, [SQUARE]), feature(7, [SQUARE]), feature(7, [shifted])]))
    grids = star.dim_grid(found, "grid.geojson")
    assert rows_of(grids, "grid_key", "grid_id") == [(1, "7"), (2, "9000")]
    assert grids.where("grid_id = '7'").collect()[0].centroid_longitude == pytest.approx(4.8)
    checks = quality.dq_grid_reference(found).collect()[0]
    assert (checks.feature_count, checks.distinct_grids, checks.duplicate_grids) == (3, 2, 1)


def test_geometry_checks(spark, tmp_path):
    open_ring = SQUARE[:-1] + [[0, 1]]
    flat = [[0, 0], [1, 0], [2, 0], [0, 0]]
    outside = [[x + 179, y] for x, y in SQUARE]
    row = quality.dq_geometry(reference.grid_reference(features(
        spark, tmp_path, [feature(1, [SQUARE]), feature(2, [open_ring]), feature(3, [flat]), feature(4, [outside])]
    ))).collect()[0]
    assert (row.polygons, row.open_rings, row.empty_areas, row.out_of_bounds, row.max_longitude) == (4, 1, 1, 1, 181.0)


def brute_force(points, k):
    found = set()
    for g, x, y in points:
        others = sorted((round((y2 - y) ** 2 + (x2 - x) ** 2, 12), g2) for g2, x2, y2 in points if g2 != g)
        found |= {(g, g2, rank) for rank, (_, g2) in enumerate(others[:k], start=1)}
    return found


def _points(kind):
    rng = random.Random(11)
    if kind == "grid":
        return [(i + 1, 9 + 0.003 * (i % 12), 45 + 0.002 * (i // 12)) for i in range(144)]
    if kind == "cluster and outliers":
        dense = [(i, rng.gauss(9, 1e-4), rng.gauss(45, 1e-4)) for i in range(1, 151)]
        return dense + [(200 + i, rng.uniform(8, 10), rng.uniform(44, 46)) for i in range(40)]
    if kind == "one spot":
        return [(i, 9.0, 45.0) for i in range(1, 60)] + [(99, 9.5, 45.5), (100, 9.5, 45.4)]
    return [(i, 9.0 + i, 45.0) for i in range(1, 4)]


@pytest.mark.parametrize("k", [1, 8])
@pytest.mark.parametrize("kind", ["grid", "cluster and outliers", "one spot", "too few"])
def test_nearest_cells_match_brute_force(spark, kind, k):
    points = _points(kind)
    cells = spark.createDataFrame(points, "grid_id int, centroid_longitude double, centroid_latitude double")
    got = {(r.grid_id, r.neighbour_id, r["rank"]) for r in geo.grid_neighbours(cells, k).collect()}
    assert got == brute_force(points, k)


def test_nearest_cells_are_searched_by_as_many_tasks_as_cells_ask_for(spark, monkeypatch):
    monkeypatch.setattr(geo, "SEARCH_CELLS", 16)
    points = _points("cluster and outliers")
    cells = spark.createDataFrame(points, "grid_id int, centroid_longitude double, centroid_latitude double").coalesce(1)
    found = geo.grid_neighbours(cells, 8)
    assert {(r.grid_id, r.neighbour_id, r["rank"]) for r in found.collect()} == brute_force(points, 8)
    deals = re.findall(r"hashpartitioning\(.*?, (\d+)\), REPARTITION_BY_NUM", found._jdf.queryExecution().toString())
    assert set(deals) == {str(-(-len(points) // 16))}


def test_neighbour_activity_keeps_cells_without_neighbours(spark):
    rows = hourly(spark, [(1, 0, 4), (2, 0, 6), (3, 0, 10), (1, 1, 5)])
    near = spark.createDataFrame([(1, 2), (1, 3)], "grid_id int, neighbour_id int")
    found = {(r.grid_id, r.timestamp.hour): (r.neighbour_mean, r.neighbours_seen) for r in geo.neighbour_activity(rows, near).collect()}
    assert found == {(1, 0): (8.0, 2), (2, 0): (None, 0), (3, 0): (None, 0), (1, 1): (None, 0)}


def test_neighbour_activity_is_the_same_for_any_tiles(spark):
    import random

    rng = random.Random(7)
    cells = spark.createDataFrame([(i + 1, float(i % 9), float(i // 9)) for i in range(81)], "grid_id int, centroid_longitude double, centroid_latitude double")
    # Cells 82 and 83 have no neighbours; some hours are missing; cell 81 has no hours.
    values = {(g, h): float(rng.randint(0, 9)) for g in [*range(1, 81), 82, 83] for h in range(5) if rng.random() < 0.9}
    rows = hourly(spark, [(g, h, t) for (g, h), t in values.items()])
    near = geo.grid_neighbours(cells, 5)
    around = {}
    for r in near.collect():
        around.setdefault(r.grid_id, []).append(r.neighbour_id)
    want = {}
    for (g, h), t in values.items():
        seen = [values[n, h] for n in around.get(g, []) if (n, h) in values]
        mean = sum(seen) / len(seen) if seen else None
        want[g, h] = (t, mean, len(seen), t / mean if mean else None)
    alone = cells.select("grid_id", F.col("grid_id").alias("tile"))
    for tiles in (None, geo.spatial_tiles(cells, 7), alone, cells.select("grid_id", F.lit(1).alias("tile"))):
        found = {(r.grid_id, r.timestamp.hour): (r.total_activity, r.neighbour_mean, r.neighbours_seen, r.ratio_to_neighbours) for r in geo.neighbour_activity(rows, near, tiles).collect()}
        assert found == want


def test_tiles_hold_close_cells_and_about_as_many_as_asked(spark):
    cells = spark.createDataFrame([(i + 1, float(i % 16), float(i // 16)) for i in range(256)], "grid_id int, centroid_longitude double, centroid_latitude double")
    tiles = geo.spatial_tiles(cells, 16)
    sizes = [r["count"] for r in tiles.groupBy("tile").count().collect()]
    assert sum(sizes) == 256 and 12 <= len(sizes) <= 16 and max(sizes) <= 32
    spread = cells.join(tiles, "grid_id").groupBy("tile").agg((F.max("centroid_longitude") - F.min("centroid_longitude")).alias("w"))
    assert spread.agg(F.avg("w")).first()[0] < 8


def test_enrichment_and_coverage(spark, tmp_path):
    rows = hourly(spark, [(1, 0, 4), (2, 0, 6), (2, 1, 6)])
    cells = geo.area_centroids(reference.grid_reference(features(spark, tmp_path, [feature(1, [SQUARE]), feature(8, [SQUARE])])))
    enriched = geo.enrich_geo(rows, cells)
    checks = quality.dq_enrichment(rows, enriched).collect()[0]
    assert (checks.rows_preserved, checks.located_rows, checks.coverage_pct) == (True, 1, 33.3333)
    assert rows_of(geo.grid_set_difference(rows, cells), "grid_id", "found_in") == [(2, "source"), (8, "reference")]
    covered = geo.reference_coverage(rows, cells).collect()[0]
    assert (covered.missing_in_reference, covered.missing_in_source, covered.coverage_pct) == (1, 1, 50.0)


def test_adjacency(spark):
    cells = spark.createDataFrame([(1, 9.0, 45.0), (2, 9.003, 45.0), (3, 9.003, 45.0), (4, 10.0, 45.0), (100, 9.0, 45.0), (101, 50.0, 45.0)], "grid_id int, centroid_longitude double, centroid_latitude double")
    row = quality.dq_adjacency(cells).collect()[0]
    # Cell 100 ends a grid row, so 100 and 101 are no pair.
    assert (row.pairs, row.coincident, row.too_far) == (3, 1, 1)


def test_bounds_expression(spark):
    df = spark.createDataFrame([(json.dumps([SQUARE]),)], "c string").select(geom.parts(F.lit("Polygon"), F.col("c")).alias("g"))
    assert tuple(df.select(geom.bounds(F.col("g"))).collect()[0][0]) == (0.0, 2.0, 0.0, 2.0)


def test_neighbours_of_a_tight_cluster_with_a_far_outlier(spark):
    rows = [(i, 9.0 + (i % 20) * 1e-5, 45.0 + (i // 20) * 1e-5) for i in range(400)] + [(1000, 5000.0, 45.0)]
    cells = spark.createDataFrame(rows, "grid_id int, centroid_longitude double, centroid_latitude double")
    found = geo.grid_neighbours(cells, 2).where("grid_id = 210").collect()
    assert {r["neighbour_id"] for r in found} <= {190, 209, 211, 230} and len(found) == 2
    assert geo.grid_neighbours(cells, 2).where("grid_id = 1000").count() == 2

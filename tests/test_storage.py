"""Split GeoJSON, clustered files and daily sketches."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cellwatch.functions.morton import morton
from cellwatch.operators import rollup
from cellwatch.schemas import MEASURES
from cellwatch.sources import reference, sinks
from helpers import hour, hourly, rows_of

SQUARE = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]


def write(path, features, indent=None, **more):
    path.write_text(json.dumps({"type": "FeatureCollection", **more, "features": features}, indent=indent))
    return str(path)


def feature(cell, kind="Polygon", coordinates=None, **properties):
    return {"type": "Feature", "properties": {"cellId": cell, **properties}, "geometry": {"type": kind, "coordinates": coordinates or [SQUARE]}}


@pytest.mark.parametrize("indent", [None, 2])
def test_split_documents_give_the_features_of_whole_ones(spark, tmp_path, indent):
    rows = [feature(i, coordinates=[[[x + i, y] for x, y in SQUARE]], note="a }, { b") for i in range(300)]
    rows[7]["geometry"] = None
    rows[9]["properties"] = {}
    rows[11] = feature(11, "MultiPolygon", [[SQUARE], [SQUARE]])
    path = write(tmp_path / "a.geojson", rows, indent, name="grid")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("3000", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            split = reference.read_split_features(spark, path)
            assert (reference.split_records(spark, path).select("block").distinct().count() > 5) == (size == "3000")
            columns = ("source_file", "grid_id", "geometry_type", "coordinates")
            whole = reference.read_features(spark, path).withColumn("coordinates", F.regexp_replace("coordinates", r"\s", ""))
            squeezed = split.withColumn("coordinates", F.regexp_replace("coordinates", r"\s", ""))
            assert sorted(map(str, squeezed.select(*columns).collect())) == sorted(map(str, whole.select(*columns).collect()))
            in_order = [r.grid_id for r in split.where("grid_id is not null").orderBy("position").collect()]
            assert in_order == [i for i in range(300) if i != 9]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_empty_documents_and_odd_features(spark, tmp_path):
    assert reference.read_split_features(spark, write(tmp_path / "none.geojson", [])).count() == 0
    odd = [{"properties": {"cellId": 1}, "geometry": {"type": "Polygon", "coordinates": [SQUARE]}, "type": "Feature"}] * 2
    with pytest.raises(Exception, match="not a feature that begins with its type"):
        reference.read_split_features(spark, write(tmp_path / "odd.geojson", odd)).collect()
    several = [write(tmp_path / f"{n}.json", [feature(n)]) for n in (1, 2)]
    assert rows_of(reference.read_split_features(spark, several), "source_file", "grid_id") == [("1.json", 1), ("2.json", 2)]


def scan_rows(df):
    """Rows that the scan of an executed plan put out."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().get("numOutputRows").get().value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_one_cell_or_one_hour_reads_few_rows(spark, tmp_path):
    rows = hourly(spark, [(g, h, g + h) for g in range(1, 129) for h in range(96)])
    path = str(tmp_path / "hours")
    sinks.write_clustered(rows, path, rows_per_file=400)
    table = spark.read.parquet(path)
    assert table.count() == 128 * 96
    now = (F.col("date") == hour(50).date()) & (F.col("hour") == 2)
    for test, want in ((F.col("grid_id") == 77, 96), (now, 128), ((F.col("grid_id") == 77) & now, 1)):
        found = table.where(test)
        assert found.count() == want
        assert scan_rows(found.select("total_activity")) <= 0.4 * 128 * 96
    sinks.write_clustered(rows.where("grid_id < 0"), str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0


def test_bloom_filter_skips_a_cell_that_ranges_span(spark, tmp_path):
    rows = hourly(spark, [(g, h, 1) for g in range(0, 2000, 2) for h in range(2)])
    path = str(tmp_path / "hours")
    sinks.write_clustered(rows, path)
    assert scan_rows(spark.read.parquet(path).where("grid_id = 777").select("total_activity")) == 0
    assert scan_rows(spark.read.parquet(path).where("grid_id = 776").select("total_activity")) > 0


def test_morton_codes_interleave(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(1 << 20), rng.randrange(1 << 20)) for _ in range(50)]
    want = [sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(20)) for x, y in pairs]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, x int, y int")
    assert [r.m for r in df.select("i", morton(F.col("x"), F.col("y"), 20).alias("m")).orderBy("i").collect()] == want
    with pytest.raises(ValueError):
        morton(F.col("x"), F.col("y"), 32)


def test_sketches_of_loads_and_dates_merge(spark):
    rows = spark.range(60_000).select(
        (F.lit(hour(0)) + F.make_dt_interval(hours=(F.col("id") % 72).cast("int"))).alias("timestamp"),
        (F.col("id") % 9000).cast("int").alias("grid_id"),
        (F.col("id") % 50).cast("int").alias("country_code"),
        *[F.lit(1.0).alias(m) for m in MEASURES],
        "id",
    )
    states = [rollup.daily_sketches(rows.where(F.col("id") % 3 == k)) for k in range(3)]
    merged = states[0].unionByName(states[1]).unionByName(states[2])
    found = rollup.sketched_kpi(merged).collect()[0]
    assert (found.records, found.total_activity) == (60_000, 60_000 * len(MEASURES))
    for got, want in ((found.active_grids, 9000), (found.country_codes, 50), (found.timestamps, 72)):
        assert abs(got - want) <= max(0.5, rollup.sketch_error() * want)
    by_day = rollup.sketched_kpi(merged, ["date"]).collect()
    assert len(by_day) == 3 and all(abs(r.timestamps - 24) < 1 for r in by_day)

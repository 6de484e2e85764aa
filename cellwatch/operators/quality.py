"""Data-quality checks as one-row or per-violation DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwatch.functions import geometry as geo
from cellwatch.functions import validity
from cellwatch.functions.columns import finite
from cellwatch.operators import topology
from cellwatch.schemas import FEATURES_24H, GRAIN, GRID_ID_MAX, GRID_ID_MIN


def _any(tests: list[Column]) -> Column:
    result = tests[0]
    for test in tests[1:]:
        result = result | test
    return result


def _grain_counts(df: DataFrame, keys: list[str], extra: list[Column]) -> DataFrame:
    """Rows per key first, then rows, distinct keys and duplicate groups."""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("_n"), *extra)
    )


def dq_grain(rolled: DataFrame, source: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Unique keys after roll-up and fewer rows than the source had."""
    per_key = _grain_counts(rolled, keys or GRAIN, [])
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.count("*").alias("distinct_keys"),
        F.count_if(F.col("_n") > 1).alias("duplicate_groups"),
    ).withColumn("source_rows", source.agg(F.count("*")).scalar()).withColumns(
        {
            "unique_grain": F.col("duplicate_groups") == 0,
            "reduced": F.col("row_count") <= F.col("source_rows"),
        }
    )


def grain_violations(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or GRAIN
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def dq_grid_reference(features: DataFrame, grid_id_max: int = GRID_ID_MAX) -> DataFrame:
    """Feature ids: unique, in range, with geometry."""
    per_id = features.groupBy("grid_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("geometry").isNull()).alias("bare")
    )
    in_range = F.col("grid_id").between(GRID_ID_MIN, grid_id_max)
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("feature_count"),
        F.count("grid_id").alias("distinct_grids"),
        F.count_if((F.col("n") > 1) & F.col("grid_id").isNotNull()).alias("duplicate_grids"),
        F.coalesce(F.sum("bare"), F.lit(0)).alias("null_geometries"),
        F.count_if(~in_range).alias("out_of_range_grids"),
    )


def dq_geometry(reference: DataFrame) -> DataFrame:
    """Geometry types, coordinate bounds, closed rings and positive area."""
    box = geo.bounds(F.col("geometry"))
    checked = reference.select("geometry_type", box.alias("box"), geo.rings_closed(F.col("geometry")).alias("closed"), geo.area(F.col("geometry")).alias("area"))
    return checked.agg(
        F.count_if(F.col("geometry_type") == "Polygon").alias("polygons"),
        F.count_if(F.col("geometry_type") == "MultiPolygon").alias("multipolygons"),
        F.min("box.min_lon").alias("min_longitude"),
        F.max("box.max_lon").alias("max_longitude"),
        F.min("box.min_lat").alias("min_latitude"),
        F.max("box.max_lat").alias("max_latitude"),
        F.count_if(
            (F.col("box.min_lon") < -180) | (F.col("box.max_lon") > 180) | (F.col("box.min_lat") < -90) | (F.col("box.max_lat") > 90)
        ).alias("out_of_bounds"),
        F.count_if(~F.col("closed")).alias("open_rings"),
        F.count_if(F.coalesce(F.col("area") <= 0, F.lit(True))).alias("empty_areas"),
    )


def geometry_faults(reference: DataFrame) -> DataFrame:
    """Cells whose geometry is not valid, with the first fault; see `functions.validity`.

    No shuffle: each geometry is judged where it is read.
    """
    shape = F.col("geometry")
    return (
        reference.withColumn("_found", validity.contacts(shape))
        .withColumn("fault", validity.fault(shape, F.col("_found"), geo.rings_closed(shape)))
        .where("fault IS NOT NULL")
        .select("grid_id", "geometry_type", "fault")
    )


def dq_shared_edges(cells: DataFrame, row_length: int = 100) -> DataFrame:
    """Adjacency by the edges and corners that cells share, against the neighbours their ids promise.

    A cell's right and upper neighbours by id, where they exist, must share an
    edge with it; `gaps` counts those that don't.
    """
    pairs = topology.topological_neighbours(cells).where(F.col("grid_id") < F.col("neighbour_id"))
    ids = cells.select("grid_id").distinct()
    beside = ids.where(F.col("grid_id") % row_length != 0).select("grid_id", (F.col("grid_id") + 1).alias("neighbour_id"))
    above = ids.select("grid_id", (F.col("grid_id") + row_length).alias("neighbour_id"))
    promised = beside.unionByName(above).join(ids.withColumnRenamed("grid_id", "neighbour_id"), "neighbour_id", "left_semi")
    edges = pairs.where("contact = 'edge'").select("grid_id", "neighbour_id", F.lit(True).alias("shared"))
    touching = pairs.select(F.explode(F.array("grid_id", "neighbour_id")).alias("grid_id")).distinct()
    kept = promised.join(edges, ["grid_id", "neighbour_id"], "left").agg(
        F.count("*").alias("promised_pairs"), F.count_if(F.col("shared").isNull()).alias("gaps")
    )
    found = pairs.agg(F.count_if(F.col("contact") == "edge").alias("edge_pairs"), F.count_if(F.col("contact") == "corner").alias("corner_pairs"))
    return kept.withColumns(
        {
            "edge_pairs": found.select("edge_pairs").scalar(),
            "corner_pairs": found.select("corner_pairs").scalar(),
            "isolated_cells": ids.join(touching, "grid_id", "left_anti").agg(F.count("*")).scalar(),
        }
    )


def dq_adjacency(cells: DataFrame, max_degrees: float = 0.01, row_length: int = 100) -> DataFrame:
    """Consecutive cells of a grid row: distinct centroids, close together."""
    here = cells.select("grid_id", F.col("centroid_longitude").alias("lon"), F.col("centroid_latitude").alias("lat"))
    after = here.select((F.col("grid_id") - 1).alias("grid_id"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    pairs = here.where(F.col("grid_id") % row_length != 0).join(after, "grid_id")
    gap = F.sqrt(F.pow(F.col("lon2") - F.col("lon"), 2) + F.pow(F.col("lat2") - F.col("lat"), 2))
    return pairs.withColumn("gap", gap).agg(
        F.count("*").alias("pairs"),
        F.count_if(F.col("gap") == 0).alias("coincident"),
        F.count_if(F.col("gap") >= max_degrees).alias("too_far"),
        F.max("gap").alias("largest_gap"),
    )


def dq_enrichment(hourly: DataFrame, enriched: DataFrame) -> DataFrame:
    """Rows and cells kept by the geography join and the share of rows located."""

    def sizes(df: DataFrame, *more: Column) -> DataFrame:
        return df.groupBy("grid_id").agg(F.count("*").alias("n"), *more)

    before = sizes(hourly).agg(F.struct(F.sum("n").alias("rows"), F.count("*").alias("grids"))).scalar()
    located = F.count_if(F.col("geometry").isNotNull()).alias("located")
    return (
        sizes(enriched, located)
        .agg(F.sum("n").alias("rows_after"), F.count("*").alias("grids_after"), F.sum("located").alias("located_rows"))
        .withColumn("_before", before)
        .select(
            F.col("_before.rows").alias("rows_before"),
            "rows_after",
            F.col("_before.grids").alias("grids_before"),
            "grids_after",
            "located_rows",
            F.round(100.0 * F.col("located_rows") / F.nullif(F.col("rows_after"), F.lit(0)), 4).alias("coverage_pct"),
            (F.col("_before.rows") == F.col("rows_after")).alias("rows_preserved"),
            (F.col("_before.grids") == F.col("grids_after")).alias("grids_preserved"),
        )
    )


def checksum(df: DataFrame) -> DataFrame:
    """Order-free fingerprint: row count and the exact sum of row hashes."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(20,0)")
    return df.agg(F.struct(F.count("*").alias("rows"), F.sum(row).alias("checksum")))


def dq_round_trip(written: DataFrame, reread: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts, schema, content, key uniqueness and absence of geometry after a reread."""
    keys = keys or GRAIN
    same_schema = sorted(written.dtypes) == sorted(reread.dtypes)
    plain = not any(c.lower() in ("geometry", "centroid") for c in reread.columns)
    columns = sorted(written.columns)
    duplicates = grain_violations(reread, keys).agg(F.count("*")).scalar()
    return (
        written.sparkSession.range(1)
        .select(
            checksum(written).scalar().alias("a"),
            checksum(reread.select(*columns) if same_schema else reread).scalar().alias("b"),
            duplicates.alias("duplicate_groups"),
        )
        .select(
            F.col("a.rows").alias("rows_written"),
            F.col("b.rows").alias("rows_read"),
            F.lit(same_schema).alias("schema_matches"),
            (F.col("a.checksum") == F.col("b.checksum")).alias("content_matches"),
            "duplicate_groups",
            F.lit(plain).alias("geometry_free"),
        )
    )


def dq_partitions(reread: DataFrame) -> DataFrame:
    """Dates present in a date-partitioned table with their row counts."""
    return reread.groupBy("date").agg(F.count("*").alias("rows"))


def dq_alerts(alerts: DataFrame, hourly: DataFrame) -> DataFrame:
    """Alerts of unknown cells, without reason or with missing values."""
    unknown = (
        alerts.groupBy("grid_id").agg(F.count("*").alias("n"))
        .join(hourly.select("grid_id").distinct(), "grid_id", "left_anti")
        .agg(F.coalesce(F.sum("n"), F.lit(0)))
        .scalar()
    )
    no_reason = F.coalesce(F.length("reason") == 0, F.lit(True))
    missing = F.col("current_activity").isNull() | F.col("baseline_activity").isNull()
    return alerts.agg(
        F.count("*").alias("alerts"),
        F.count_if(no_reason).alias("without_reason"),
        F.count_if(missing).alias("missing_values"),
    ).withColumn("unknown_grids", unknown)


def dq_source(hourly: DataFrame) -> DataFrame:
    """NULLs, duplicate keys and negatives before features are built."""
    nulls = _any([F.col(c).isNull() for c in GRAIN + ["total_activity", "internet_activity"]])
    return (
        _grain_counts(
            hourly,
            GRAIN,
            [
                F.count_if(nulls).alias("_nulls"),
                F.count_if(F.col("total_activity") < 0).alias("_neg_total"),
                F.count_if(F.col("internet_activity") < 0).alias("_neg_internet"),
            ],
        )
        .agg(
            F.sum("_n").alias("row_count"),
            F.sum("_nulls").alias("rows_with_nulls"),
            F.sum(F.col("_n") - 1).alias("duplicate_rows"),
            F.sum("_neg_total").alias("negative_total"),
            F.sum("_neg_internet").alias("negative_internet"),
        )
    )


def dq_features(features: DataFrame) -> DataFrame:
    """Missing or infinite values, duplicates and values out of range."""
    bad = _any([~finite(F.col(c).cast("double")) for c in FEATURES_24H])
    return (
        _grain_counts(
            features,
            ["grid_id", "feature_timestamp"],
            [
                F.count_if(bad).alias("_bad"),
                F.count_if(~F.col("active_hours").between(0, 24)).alias("_hours"),
                F.count_if(~F.col("internet_share").between(0.0, 1.0)).alias("_share"),
            ],
        )
        .agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum("_bad"), F.lit(0)).alias("non_finite_rows"),
            F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
            F.coalesce(F.sum("_hours"), F.lit(0)).alias("active_hours_out_of_range"),
            F.coalesce(F.sum("_share"), F.lit(0)).alias("internet_share_out_of_range"),
        )
    )


def dq_risk_scores(scores: DataFrame, expected_rows: Column) -> DataFrame:
    """Row count, duplicates, range, levels, versions and NULLs of scores."""
    nulls = _any([F.col(c).isNull() for c in ("grid_id", "timestamp", "risk_score", "risk_level", "model_version")])
    return (
        _grain_counts(
            scores,
            GRAIN,
            [
                F.count_if(nulls).alias("_nulls"),
                F.count_if(~F.col("risk_score").between(0.0, 1.0)).alias("_range"),
                F.count_if(~F.col("risk_level").isin("LOW", "MEDIUM", "HIGH")).alias("_levels"),
                F.min("risk_score").alias("_min"),
                F.max("risk_score").alias("_max"),
                F.min("model_version").alias("_v1"),
                F.max("model_version").alias("_v2"),
            ],
        )
        .agg(
            F.sum("_n").alias("row_count"),
            F.sum(F.col("_n") - 1).alias("duplicate_rows"),
            F.sum("_nulls").alias("rows_with_nulls"),
            F.sum("_range").alias("score_out_of_range"),
            F.sum("_levels").alias("unknown_levels"),
            (F.min("_v1") == F.max("_v2")).alias("single_version"),
            F.min("_min").alias("min_score"),
            F.max("_max").alias("max_score"),
        )
        .withColumn("expected_rows", expected_rows)
    )


def dq_foreign_keys(fact: DataFrame, times: DataFrame, grids: DataFrame, source: DataFrame) -> DataFrame:
    """Fact keys without a dimension row, dimension uniqueness, rows against source.

    The fact is reduced to its distinct keys before either anti join.
    """

    def orphans(key: str, dim: DataFrame) -> Column:
        used = fact.groupBy(key).agg(F.count("*").alias("n"))
        return used.join(dim, key, "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()

    def repeated(dim: DataFrame, key: str) -> Column:
        return grain_violations(dim, [key]).agg(F.count("*")).scalar()

    return fact.agg(F.count("*").alias("fact_rows")).withColumns(
        {
            "source_rows": source.agg(F.count("*")).scalar(),
            "orphan_time_keys": orphans("time_key", times),
            "orphan_grid_keys": orphans("grid_key", grids),
            "duplicate_timestamps": repeated(times, "timestamp"),
            "duplicate_grids": repeated(grids, "grid_id"),
        }
    )


def dq_publish(fact: DataFrame, times: DataFrame, features: DataFrame, scores: DataFrame) -> DataFrame:
    """Publication gate: rows, unique keys, an `as_of`, features and scores."""
    duplicates = grain_violations(fact, ["time_key", "grid_key"]).agg(F.count("*")).scalar()
    return (
        fact.agg(F.count("*").alias("rows_published"))
        .withColumns(
            {
                "duplicate_facts": duplicates,
                "as_of": times.agg(F.max("timestamp")).scalar(),
                "feature_rows": features.agg(F.count("*")).scalar(),
                "risk_rows": scores.agg(F.count("*")).scalar(),
            }
        )
        .withColumn(
            "publishable",
            (F.col("rows_published") > 0)
            & (F.col("duplicate_facts") == 0)
            & F.col("as_of").isNotNull()
            & (F.col("feature_rows") > 0)
            & (F.col("risk_rows") > 0),
        )
    )

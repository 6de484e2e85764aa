"""Cell geometry: centroids, enrichment, coverage and nearest cells.

Joins carry no broadcast hints: Spark broadcasts the cell side from its
measured size and falls back to a shuffled, skew-split join beyond it.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellwatch.functions import geometry as geo
from cellwatch.functions.morton import cell_of, morton
from cellwatch.operators.cleaning import filter_date_window
from cellwatch.runtime import materialize
from cellwatch.sources.reference import one_per_cell

# Finest bin level of the nearest-cell search: 2^16 bins a side.
# Bin levels to try as the finest; beyond the last, doubles no longer tell bins apart.
FIRST_LEVEL, LAST_LEVEL = 8, 48
# A finest bin holds at most so many times the cells a search needs.
BIN_CROWD = 8
# Cells of which one task of the search compares the bins around, some hundred pairs each.
SEARCH_CELLS = 4096
# Cells of a tile: with a rim of one cell, a square of 64 meets 36 foreign ones.
TILE_CELLS = 64


def area_centroids(reference: DataFrame) -> DataFrame:
    """Area centroid of each cell polygon."""
    return reference.withColumns(
        {
            "centroid_longitude": geo.area_centroid(F.col("geometry"), 0),
            "centroid_latitude": geo.area_centroid(F.col("geometry"), 1),
        }
    )


def vertex_centroids(reference: DataFrame) -> DataFrame:
    """Mean of all ring vertices, the closing vertex counted again."""
    return reference.withColumns(
        {
            "centroid_longitude": geo.vertex_mean(F.col("geometry"), 0),
            "centroid_latitude": geo.vertex_mean(F.col("geometry"), 1),
        }
    )


def enrich_geo(hourly: DataFrame, cells: DataFrame) -> DataFrame:
    """Hourly rows with geometry and centroid; rows without a cell stay, and of repeated cells the last counts."""
    shapes = one_per_cell(cells).select("grid_id", "geometry", "centroid_longitude", "centroid_latitude")
    return hourly.join(shapes, "grid_id", "left")


def grid_set_difference(source: DataFrame, reference: DataFrame) -> DataFrame:
    """Cells on one side only, with the side they are on."""
    a, b = source.select("grid_id").distinct(), reference.select("grid_id").distinct()
    return (
        a.subtract(b).withColumn("found_in", F.lit("source"))
        .unionByName(b.subtract(a).withColumn("found_in", F.lit("reference")))
    )


def reference_coverage(source: DataFrame, reference: DataFrame) -> DataFrame:
    """Cells in source, in reference, on one side only, and share covered."""
    a = source.select("grid_id").distinct().withColumn("s", F.lit(1))
    b = reference.select("grid_id").distinct().withColumn("r", F.lit(1))
    return (
        a.join(b, "grid_id", "full")
        .agg(
            F.count("s").alias("source_grids"),
            F.count("r").alias("reference_grids"),
            F.count_if(F.col("r").isNull()).alias("missing_in_reference"),
            F.count_if(F.col("s").isNull()).alias("missing_in_source"),
        )
        .withColumn(
            "coverage_pct",
            F.round(
                100.0 * (F.col("source_grids") - F.col("missing_in_reference"))
                / F.nullif(F.col("source_grids"), F.lit(0)),
                4,
            ),
        )
    )


def top_activity_grids(
    hourly: DataFrame, cells: DataFrame, start: str | date | None = None, end: str | date | None = None, limit: int = 10
) -> DataFrame:
    """Busiest cells of a date window with geometry; geometry joins after the cut."""
    top = (
        filter_date_window(hourly, start, end)
        .groupBy("grid_id")
        .agg(F.sum("total_activity").alias("total_activity"))
        .orderBy(F.round("total_activity", 6).desc(), "grid_id")
        .limit(limit)
    )
    # No hint: Spark sends the few cells left from their measured size.
    matched = one_per_cell(cells.join(top.select("grid_id"), "grid_id", "left_semi"))
    return top.join(matched.select("grid_id", "geometry", "centroid_longitude", "centroid_latitude"), "grid_id", "left")


def grid_location(cells: DataFrame, grid_id: int | None = None) -> DataFrame:
    """Centroid and reference of one cell or all cells."""
    rows = cells.select("grid_id", "centroid_latitude", "centroid_longitude", "geometry_reference")
    return rows if grid_id is None else rows.where(F.col("grid_id") == grid_id)


def _bins(extent: Column, level: Column) -> dict[str, Column]:
    """Bin of a point at a level; the far edge belongs to the last bin."""
    per_side = F.pow(F.lit(2.0), level)

    def bin_of(axis: str, low: Column) -> Column:
        return F.least(F.floor((F.col(axis) - low) / extent["span"] * per_side), per_side - 1).cast("bigint")

    return {
        "bx": bin_of("centroid_longitude", extent["min_lon"]),
        "by": bin_of("centroid_latitude", extent["min_lat"]),
    }


def _finest_level(candidates: DataFrame, crowd: int) -> int:
    """The first level of every fourth at which no bin holds more than `crowd` cells."""
    for level in range(FIRST_LEVEL, LAST_LEVEL + 1, 4):
        bins = candidates.withColumns(_bins(F.col("_extent"), F.lit(level))).groupBy("bx", "by").count()
        if (bins.agg(F.max("count")).first()[0] or 0) <= crowd:
            return level
    return LAST_LEVEL


def grid_neighbours(cells: DataFrame, k: int = 8) -> DataFrame:
    """The `k` nearest other cells of every cell by squared degree distance.

    Exact without comparing all pairs. Each cell takes the finest bin level at
    which its own bin holds k+1 cells. Its k-th neighbour is then within one
    bin diagonal, so the bins two steps around hold the answer, and pairs
    further apart are dropped as they meet. Dense areas use small bins, sparse
    ones large bins; levels are added until the finest bins hold few cells, so a
    far outlier does not crowd the rest. The bins to look at are dealt to as
    many tasks as the number of cells asks for. Distances equal to twelve
    decimals fall by cell id.
    """
    if not 1 <= k <= 100:
        raise ValueError("k must be between 1 and 100")
    points = cells.select("grid_id", "centroid_longitude", "centroid_latitude").where(
        F.col("centroid_longitude").isNotNull() & F.col("centroid_latitude").isNotNull()
    )
    span = F.greatest(
        F.max("centroid_longitude") - F.min("centroid_longitude"),
        F.max("centroid_latitude") - F.min("centroid_latitude"),
    )
    extent = points.agg(
        F.struct(
            F.min("centroid_longitude").alias("min_lon"),
            F.min("centroid_latitude").alias("min_lat"),
            F.when(span > 0, span).otherwise(1.0).alias("span"),
        )
    ).scalar()
    # Of cells with one and the same centroid only the k+1 smallest ids can be
    # anyone's neighbours.
    same_spot = W.partitionBy("centroid_longitude", "centroid_latitude").orderBy("grid_id")
    candidates = points.withColumn("_r", F.row_number().over(same_spot)).where(F.col("_r") <= k + 1).drop("_r")

    def binned(df: DataFrame) -> DataFrame:
        # The extent is attached before the level explode, once per cell.
        placed = df.withColumn("_extent", extent).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(finest))))
        return placed.withColumns(_bins(F.col("_extent"), F.col("level"))).drop("_extent")

    place = ["level", "bx", "by"]
    finest = _finest_level(candidates.withColumn("_extent", extent), BIN_CROWD * (k + 1))
    held = binned(candidates)
    full = held.groupBy(*place).agg(F.count("*").alias("_n")).where(F.col("_n") > k)
    own = binned(points).join(full.select(*place), place, "left_semi").groupBy("grid_id").agg(
        F.max(F.struct(*place)).alias("own")
    )
    step = F.array(*[F.lit(i) for i in range(-2, 3)])
    origins = (
        points.join(own, "grid_id", "left")
        .select(
            F.col("grid_id").alias("origin_id"),
            F.col("centroid_longitude").alias("_lon"),
            F.col("centroid_latitude").alias("_lat"),
            F.coalesce("own.level", F.lit(0)).alias("level"),
            F.coalesce("own.bx", F.lit(0)).alias("_x"),
            F.coalesce("own.by", F.lit(0)).alias("_y"),
        )
        .withColumn("_extent", extent)
        .withColumn("_reach", 2 * F.pow(F.col("_extent")["span"] / F.pow(F.lit(2.0), F.col("level")), F.lit(2.0)) * (1 + 1e-9) + 2e-12)
        .drop("_extent")
        .withColumn("bx", F.explode(F.transform(step, lambda d: F.col("_x") + d)))
        .withColumn("by", F.explode(F.transform(step, lambda d: F.col("_y") + d)))
        .drop("_x", "_y")
        .repartition(max(1, -(-points.count() // SEARCH_CELLS)), *place)
    )
    lon, lat = F.col("centroid_longitude") - F.col("_lon"), F.col("centroid_latitude") - F.col("_lat")
    distance = lat * lat + lon * lon
    nearest = W.partitionBy("origin_id").orderBy(F.round("distance", 12), "neighbour_id")
    return (
        origins.join(held, place)
        .where((F.col("grid_id") != F.col("origin_id")) & ((distance <= F.col("_reach")) | F.isnan(distance)))
        .select(
            "origin_id",
            F.col("grid_id").alias("neighbour_id"),
            "centroid_latitude",
            "centroid_longitude",
            distance.alias("distance"),
        )
        .withColumn("rank", F.row_number().over(nearest))
        .where(F.col("rank") <= k)
        .withColumnRenamed("origin_id", "grid_id")
    )


def spatial_tiles(places: DataFrame, per_tile: int = TILE_CELLS) -> DataFrame:
    """(grid_id, tile): cells dealt to tiles of about `per_tile` neighbours each, by ranges of their Z-order.

    Stored, as the ranges come from a sample.
    """
    known = places.select("grid_id", "centroid_longitude", "centroid_latitude").dropDuplicates(["grid_id"])
    box = known.agg(
        F.struct(
            F.count("*").alias("n"),
            F.min("centroid_longitude").alias("x"),
            F.min("centroid_latitude").alias("y"),
            (F.max("centroid_longitude") - F.min("centroid_longitude")).alias("w"),
            (F.max("centroid_latitude") - F.min("centroid_latitude")).alias("h"),
        ).alias("b")
    ).first()["b"]
    code = morton(cell_of(F.col("centroid_longitude"), F.lit(box["x"]), F.lit(box["w"])), cell_of(F.col("centroid_latitude"), F.lit(box["y"]), F.lit(box["h"])))
    coded = known.select("grid_id", F.coalesce(code, F.lit(0)).alias("code"))
    dealt = coded.repartitionByRange(max(1, -(-box["n"] // per_tile)), "code", "grid_id")
    return materialize(dealt.select("grid_id", F.spark_partition_id().alias("tile")), "tiles")


def neighbour_activity(hourly: DataFrame, neighbours: DataFrame, tiles: DataFrame | None = None) -> DataFrame:
    """Activity of each cell and hour against its neighbours' mean that hour.

    Cells are dealt to tiles, and each tile has a rim: the foreign cells that
    its own cells have as neighbours. An hour of a tile with its rim meets in
    one group, where the neighbours are looked up; so a row crosses a shuffle
    once for its tile and once for each tile that has its cell in the rim, not
    once for each neighbour. `tiles` defaults to `spatial_tiles` of the
    neighbours' places, or to ranges of ids where these are not given; any
    dealing gives the same rows.
    """
    neighbours = materialize(neighbours, "neighbours")
    pairs = neighbours.select("grid_id", "neighbour_id")
    if tiles is None and "centroid_longitude" not in neighbours.columns:
        tiles = pairs.select("grid_id").distinct().withColumn("tile", F.floor(F.col("grid_id") / TILE_CELLS))
    elif tiles is None:
        tiles = spatial_tiles(neighbours.select(F.col("neighbour_id").alias("grid_id"), "centroid_longitude", "centroid_latitude"))
    # Cells that are no one's neighbour make up a tile of their own id.
    own = pairs.groupBy("grid_id").agg(F.collect_list("neighbour_id").alias("near"))
    seated = own.join(tiles, "grid_id", "left").withColumn("tile", F.coalesce(F.col("tile").cast("bigint"), -F.col("grid_id").cast("bigint") - 1))
    rims = (
        seated.select("tile", F.explode("near").alias("grid_id"))
        .distinct()
        .join(seated.select("grid_id", F.col("tile").alias("home")), "grid_id", "left")
        .where(~F.col("home").eqNullSafe(F.col("tile")))
        .groupBy("grid_id")
        .agg(F.collect_list("tile").alias("rims"))
    )
    cells = seated.join(rims, "grid_id", "full")
    seats = F.concat(
        F.when(F.col("tile").isNotNull(), F.array(F.struct(F.col("tile").alias("tile"), F.col("near").alias("near")))).otherwise(F.array()),
        F.transform(F.coalesce("rims", F.array()), lambda t: F.struct(t.alias("tile"), F.lit(None).cast(near_type(neighbours)).alias("near"))),
    )
    placed = materialize(cells.select("grid_id", seats.alias("seats")), "seats")
    rows = hourly.select("grid_id", "timestamp", "total_activity").join(placed, "grid_id", "left")
    # A cell without neighbours meets no one.
    alone = F.array(F.struct((-F.col("grid_id").cast("bigint") - 1).alias("tile"), F.array().cast(near_type(neighbours)).alias("near")))
    seated_rows = rows.withColumn("seats", F.when(F.exists(F.coalesce("seats", F.array()), lambda s: s["near"].isNotNull()), F.col("seats")).otherwise(F.concat(alone, F.coalesce("seats", F.array()))))
    met = (
        seated_rows.select("grid_id", "timestamp", "total_activity", F.inline("seats"))
        .groupBy("tile", "timestamp")
        .agg(F.collect_list(F.struct("grid_id", "total_activity", "near")).alias("rows"))
    )
    values = F.map_from_entries(F.array_distinct(F.transform("rows", lambda r: F.struct(r["grid_id"], r["total_activity"]))))
    seen = F.filter(F.transform("near", lambda n: F.try_element_at("values", n)), lambda x: x.isNotNull())
    mean = F.aggregate("seen", F.lit(0.0), lambda total, x: total + x) / F.nullif(F.size("seen"), F.lit(0))
    return (
        met.withColumn("values", values)
        .select("timestamp", "values", F.inline(F.filter("rows", lambda r: r["near"].isNotNull())))
        .withColumn("seen", seen)
        .select("grid_id", "timestamp", "total_activity", mean.alias("neighbour_mean"), F.size("seen").cast("bigint").alias("neighbours_seen"))
        .withColumn("ratio_to_neighbours", F.col("total_activity") / F.nullif(F.col("neighbour_mean"), F.lit(0.0)))
    )


def near_type(neighbours: DataFrame) -> str:
    return f"array<{dict(neighbours.dtypes)['neighbour_id']}>"

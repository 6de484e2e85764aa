"""GeoJSON cell reference and run-status records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwatch.functions import geometry as geo
from cellwatch.schemas import GEOJSON_SCHEMA, STATUS_SCHEMA


def read_features(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """One row per feature of one or many FeatureCollection documents."""
    documents = spark.read.schema(GEOJSON_SCHEMA).option("multiLine", multiline).json(path)
    return documents.select(
        F.col("_metadata.file_name").alias("source_file"), F.posexplode("features").alias("position", "feature")
    ).select(
        "source_file",
        "position",
        F.col("feature.properties.cellId").alias("grid_id"),
        F.col("feature.geometry.type").alias("geometry_type"),
        F.col("feature.geometry.coordinates").alias("coordinates"),
    )


FEATURE_MARK = '"Feature"'


def split_records(spark: SparkSession, path: str) -> DataFrame:
    """Text of documents between the types of their features, with file, split offset and id."""
    return spark.read.option("lineSep", FEATURE_MARK).text(path).select(
        "value", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")
    )


def read_split_features(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature, as `read_features`, of documents of any size that are read in many splits.

    Records end where the next `"Feature"` begins, so a split starts at its
    first feature and no document is a single task. The type must be the first
    member of each feature, as writers put it; a document in which that is not
    so raises. Positions rise along a document but are not consecutive.
    """
    records = split_records(spark, path)
    # A record is the rest of a feature and the beginning of the next, or what stands before the first or after the last.
    body = F.regexp_replace("value", r"\s*,\s*\{\s*\"type\"\s*:\s*$", "")
    whole = F.concat(F.lit('{"type":' + FEATURE_MARK), body)
    feature = T.StructType([T.StructField("type", T.StringType()), *GEOJSON_SCHEMA["features"].dataType.elementType.fields])
    parsed = records.where(~F.col("value").contains('"FeatureCollection"') | F.col("value").rlike(r"^\s*,")).withColumn("feature", F.from_json(whole, feature))
    odd = F.col("feature.type").isNull() | (F.col("feature.properties").isNull() & F.col("feature.geometry").isNull())
    checked = F.when(odd, F.raise_error(F.concat(F.lit("not a feature that begins with its type, in "), F.col("source_file")))).otherwise(F.col("feature"))
    first = F.min("id").over(Window.partitionBy("source_file", "block"))
    return parsed.select(
        "source_file", (F.col("block") + F.col("id") - first).alias("position"), checked.alias("feature")
    ).select(
        "source_file",
        "position",
        F.col("feature.properties.cellId").alias("grid_id"),
        F.col("feature.geometry.type").alias("geometry_type"),
        F.col("feature.geometry.coordinates").alias("coordinates"),
    )


def grid_reference(features: DataFrame) -> DataFrame:
    """Usable features only: cell id present, Polygon or MultiPolygon geometry.

    `geometry` holds the parsed polygons.
    """
    return (
        features.where(
            F.col("grid_id").isNotNull()
            & F.col("geometry_type").isin("Polygon", "MultiPolygon")
            & F.col("coordinates").isNotNull()
        )
        .withColumn("geometry", geo.parts(F.col("geometry_type"), F.col("coordinates")))
        .drop("coordinates")
    )


def one_per_cell(reference: DataFrame) -> DataFrame:
    """Of features that repeat a cell the last by file and position, so that joins keep their rows."""
    whole = F.struct(*[F.col(c) for c in reference.columns])
    order = [c for c in ("source_file", "position", "centroid_longitude", "centroid_latitude") if c in reference.columns]
    last = reference.groupBy("grid_id").agg(F.max_by(whole, F.struct(*order)).alias("_last"))
    return last.select("_last.*")


def rejected_features(features: DataFrame) -> DataFrame:
    """Features `grid_reference` leaves out, with the reason."""
    return features.withColumn(
        "reject_reason",
        F.when(F.col("grid_id").isNull(), "MISSING_CELL_ID")
        .when(F.col("geometry_type").isNull() | F.col("coordinates").isNull(), "MISSING_GEOMETRY")
        .when(~F.col("geometry_type").isin("Polygon", "MultiPolygon"), "UNSUPPORTED_GEOMETRY"),
    ).where(F.col("reject_reason").isNotNull())


def read_status(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Run-status records with the per-task map."""
    return spark.read.schema(STATUS_SCHEMA).option("multiLine", multiline).json(path)


def write_status(record: DataFrame, path: str) -> None:
    record.write.mode("append").json(path)

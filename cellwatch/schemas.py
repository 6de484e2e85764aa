"""Fixed column names, schemas and key tuples of the telemetry model."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw file layout, canonical names, domain limits.
RAW_TO_CANONICAL = {
    "datetime": "timestamp",
    "CellID": "grid_id",
    "countrycode": "country_code",
    "smsin": "sms_in",
    "smsout": "sms_out",
    "callin": "call_in",
    "callout": "call_out",
    "internet": "internet_activity",
}
RAW_COLUMNS = list(RAW_TO_CANONICAL)
RAW_MEASURES = ["smsin", "smsout", "callin", "callout", "internet"]
MEASURES = ["sms_in", "sms_out", "call_in", "call_out", "internet_activity"]
TOTALS = ["total_sms", "total_calls", "total_activity"]
GRAIN = ["grid_id", "timestamp"]
GEOMETRY_COLUMNS = ["geometry", "centroid", "centroid_longitude", "centroid_latitude"]
GRID_ID_MIN = 1
GRID_ID_MAX = 10000  # of the default grid; checks take another as a parameter
LANDING_PATTERN = "sms-call-internet-mi-*.csv"

RAW_CSV_SCHEMA = T.StructType(
    [
        T.StructField("datetime", T.TimestampNTZType()),
        T.StructField("CellID", T.IntegerType()),
        T.StructField("countrycode", T.IntegerType()),
        *[T.StructField(name, T.DoubleType()) for name in RAW_MEASURES],
    ]
)

CANONICAL_TYPES = {
    "timestamp": "timestamp_ntz",
    "grid_id": "int",
    "country_code": "int",
    **{name: "double" for name in MEASURES},
}

# Polygon rings and MultiPolygon parts nest to different depths, so
# coordinates are read as text and parsed per geometry type.
GEOJSON_SCHEMA = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField(
            "features",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "properties",
                            T.StructType(
                                [
                                    T.StructField("cellId", T.IntegerType()),
                                ]
                            ),
                        ),
                        T.StructField(
                            "geometry",
                            T.StructType(
                                [
                                    T.StructField("type", T.StringType()),
                                    T.StructField("coordinates", T.StringType()),
                                ]
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)

STATUS_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("run_timestamp", T.TimestampNTZType()),
        T.StructField("status", T.StringType()),
        T.StructField("per_task_status", T.MapType(T.StringType(), T.StringType())),
        T.StructField("rows_in", T.LongType()),
        T.StructField("rows_rejected", T.LongType()),
        T.StructField("nulls_handled", T.LongType()),
        T.StructField("rows_published", T.LongType()),
        T.StructField("AS_OF", T.TimestampNTZType()),
    ]
)

FEATURES_24H = [
    "avg_activity",
    "activity_growth",
    "active_hours",
    "peak_ratio",
    "variability",
    "internet_share",
]
FEATURES_EXTRA = [
    "recent_6h_mean",
    "recent_6h_std",
    "recent_6h_peak_ratio",
    "hour_sin",
    "hour_cos",
    "day_sin",
    "day_cos",
]
MODEL_FEATURES = FEATURES_24H + FEATURES_EXTRA

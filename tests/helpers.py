"""Small literal inputs."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

START = datetime(2024, 1, 1)


def hour(n: int) -> datetime:
    return START + timedelta(hours=n)


def hourly(spark, rows):
    """Hourly rows from (grid_id, hour number, total[, internet])."""
    full = [(g, hour(h), float(t), float(rest[0]) if rest else float(t) / 2) for g, h, t, *rest in rows]
    df = spark.createDataFrame(full, "grid_id int, timestamp timestamp_ntz, total_activity double, internet_activity double")
    return df.withColumn("date", F.to_date("timestamp")).withColumn("hour", F.hour("timestamp"))


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())

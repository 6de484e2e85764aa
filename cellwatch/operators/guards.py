"""Checks that raise: each runs one small aggregate or look-up."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwatch.schemas import GRID_ID_MAX, GRID_ID_MIN


def require_as_of(hourly: DataFrame, requested: datetime | str | None = None) -> Column:
    """`as_of` as a literal; a requested hour the data lacks is an error."""
    rows = hourly.select("timestamp")
    if requested is not None:
        rows = rows.where(F.col("timestamp") == F.lit(requested).cast("timestamp_ntz"))
    found = rows.agg(F.max("timestamp")).first()[0]
    if found is None and requested is not None:
        raise ValueError(f"as_of is not represented in the data: {requested}")
    if found is None:
        raise RuntimeError("the data contains no timestamps")
    return F.lit(found).cast("timestamp_ntz")


def require_grid(cells: DataFrame, grid_id: int, grid_id_max: int = GRID_ID_MAX) -> int:
    """The id, if it is in range and a known cell with a centroid."""
    known = cells.where(F.col("grid_id").cast("int") == grid_id)
    row = known.select("centroid_latitude", "centroid_longitude").first() if GRID_ID_MIN <= grid_id <= grid_id_max else None
    if row is None:
        raise LookupError(f"unknown grid_id: {grid_id}")
    if None in tuple(row):
        raise RuntimeError(f"centroid is unavailable for grid_id: {grid_id}")
    return grid_id


def require_passed(checks: DataFrame, zero: tuple[str, ...] = (), true: tuple[str, ...] = ()) -> DataFrame:
    """A one-row check result, if the named counts are zero and flags true."""
    row = checks.first()
    failed = [f"{n}={row[n]}" for n in zero if row[n] != 0] + [f"{n}={row[n]}" for n in true if row[n] is not True]
    if failed:
        raise AssertionError("checks failed: " + ", ".join(failed))
    return checks


def require_none(violations: DataFrame, what: str, shown: int = 5) -> None:
    """Nothing, if there are no violations; the error shows the first few."""
    rows = violations.limit(shown).collect()
    if rows:
        raise AssertionError(f"{what}: " + "; ".join(str(tuple(r)) for r in rows))

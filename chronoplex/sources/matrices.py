"""Sensor matrices: wide readings, adjacency, locations, and the free-flow baseline."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.temporal import micros
from ..plans.positions import exact_percentiles

#: Hours that count as free flow, and the percentile taken there.
FREE_FLOW_HOURS, FREE_FLOW_SHARE = (22, 23, 0, 1, 2, 3, 4), 0.95


def wide_to_measurements(wide: DataFrame, step_column: str, variable: str, origin, step=dt.timedelta(minutes=5), digits: int = 2) -> DataFrame:
    """One column per sensor and one row per time step to long rows; NaN and 0 are skipped."""
    sensors = [c for c in wide.columns if c != step_column]
    long_ = wide.unpivot([step_column], [F.col(f"`{c}`").cast("double").alias(c) for c in sensors], "sensor", "value")
    kept = long_.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") != 0))
    size = step // dt.timedelta(microseconds=1)
    return kept.select(
        F.concat(F.lit(f"ts_{variable}_"), "sensor").alias("ts_id"), F.lit(variable).alias("variable"),
        F.timestamp_micros(F.lit(micros(origin)) + F.col(step_column).cast("long") * size).alias("ts"), F.round("value", digits).alias("value"))


def adjacency_to_edges(matrix: DataFrame, row_column: str, known: DataFrame | None = None, label: str = "road_segment") -> DataFrame:
    """Positive weights off the diagonal as edges; with ``known`` (``uid``) both ends must be in it."""
    others = [c for c in matrix.columns if c != row_column]
    cells = matrix.unpivot([row_column], [F.col(f"`{c}`").cast("double").alias(c) for c in others], "dst", "weight")
    edges = cells.select(F.col(row_column).cast("string").alias("src"), "dst", "weight").filter((F.col("weight") > 0) & (F.col("src") != F.col("dst")))
    if known is not None:
        from ..operators.scans import edges_among

        edges = edges_among(edges, known)
    return edges.withColumns({"uid": F.concat_ws("_", F.lit(label), "src", "dst"), "label": F.lit(label)})


def with_locations(sensors: DataFrame, locations: DataFrame) -> DataFrame:
    """Latitude and longitude by sensor; unknown sensors are at (0, 0)."""
    places = locations.select(F.col("sensor_id").cast("string").alias("uid"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return sensors.join(places, "uid", "left").fillna(0.0, ["lat", "lon"])


def free_flow(m: DataFrame, hours=FREE_FLOW_HOURS, share: float = FREE_FLOW_SHARE) -> DataFrame:
    """Exact percentile over the quiet hours without zeros; over all hours where there are none."""
    seen = m.filter(F.col("value") != 0)
    quiet = exact_percentiles(seen.filter(F.hour("ts").isin(*hours)), ["ts_id"], "value", {"_quiet": share})
    everything = exact_percentiles(seen, ["ts_id"], "value", {"_all": share})
    return everything.join(quiet, "ts_id", "left").select("ts_id", F.coalesce("_quiet", "_all").alias("free_flow"))

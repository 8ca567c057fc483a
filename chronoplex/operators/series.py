"""Aggregates, lookups and descriptors per series, over long measurement rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions.python_aggregates import python_aggregate
from ..functions.values import guarded_corr
from ..plans.positions import exact_percentiles, with_position
from .temporal import bucket_start, interval, time_column, within


def series_aggregates(m: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Named aggregates per group in one pass; order statistics join in from their own plan."""
    names = list(dict.fromkeys(A.aggregate_name(n) for n in names))
    plain = [n for n in names if n in A.AGGREGATES]
    v, t = F.col("value"), F.col("ts")
    parts = []
    if plain:
        parts.append(m.groupBy(*keys).agg(*[A.aggregate_column(n, v, t).alias(n) for n in plain]))
    ordered = {n: A.ORDER_STATISTICS[n] for n in names if n in A.ORDER_STATISTICS}
    if ordered:
        parts.append(exact_percentiles(m, keys, "value", ordered))
    parts += [python_aggregate(m, keys, A.PYTHON_AGGREGATES[n], n) for n in names if n in A.PYTHON_AGGREGATES]
    return reduce(lambda a, b: a.join(b, keys), parts)


def percentiles(m: DataFrame, shares: dict[str, float], keys: list[str] = ("ts_id",)) -> DataFrame:
    return exact_percentiles(m, list(keys), "value", shares)


def summary(m: DataFrame, keys: list[str] = ("ts_id",)) -> DataFrame:
    return series_aggregates(m, list(keys), ["mean", "min", "max", "std", "count", "first", "last", "range", "change"])


def changes(m: DataFrame, stable_below: float = 0.1) -> DataFrame:
    """Range, change, percent change, variation and the three trend flags of each series."""
    s = series_aggregates(m, ["ts_id"], ["range", "change", "change_percent", "cv", "first", "last"])
    return s.withColumns({
        "increasing": F.col("last") > F.col("first"),
        "decreasing": F.col("last") < F.col("first"),
        "stable": F.col("cv") < stable_below,
    })


def thresholds(m: DataFrame, limit: float) -> DataFrame:
    v = F.col("value")
    return m.groupBy("ts_id").agg(
        A.count_above(v, limit).alias("n_above"), A.count_below(v, limit).alias("n_below"),
        A.fraction_above(v, limit).alias("share_above"), A.fraction_below(v, limit).alias("share_below"),
    )


def value_at(m: DataFrame, at) -> DataFrame:
    return m.filter(F.col("ts") == time_column(at)).select("ts_id", "variable", "value")


def value_nearest(m: DataFrame, at) -> DataFrame:
    return m.groupBy("ts_id").agg(A.value_nearest(F.col("value"), F.col("ts"), time_column(at)).alias("value"))


def value_as_of(m: DataFrame, at) -> DataFrame:
    """Last value at or before a moment; series without one are absent."""
    return within(m, end=at).groupBy("ts_id").agg(F.max_by("value", "ts").alias("value"))


def value_at_index(m: DataFrame, index: int) -> DataFrame:
    """Value by position; negative positions count from the end."""
    numbered = with_position(m, ["ts_id"], "ts")
    wanted = F.lit(index) if index >= 0 else F.col("n") + index
    return numbered.filter(F.col("idx") == wanted).select("ts_id", "idx", "ts", "value")


def time_span(m: DataFrame) -> DataFrame:
    return m.groupBy("ts_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"),
    ).withColumn("span_seconds", (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 1e6)


def thin(m: DataFrame, every: int) -> DataFrame:
    """Every n-th sample of each series, starting with the first."""
    return with_position(m, ["ts_id"], "ts").filter(F.col("idx") % every == 0).drop("n")


def merge_series(tables: list[DataFrame]) -> DataFrame:
    """Union of series; on equal times the earlier table of the list wins."""
    ranked = [t.withColumn("_order", F.lit(i)) for i, t in enumerate(tables)]
    rows = reduce(lambda a, b: a.unionByName(b), ranked)
    return rows.groupBy("ts_id", "variable", "ts").agg(F.min_by("value", "_order").alias("value"))


def from_results(df: DataFrame, ts_id: str, variable: str, ts: str = "snap_ts", value: str = "value") -> DataFrame:
    """Measurement rows from ``(ts, value)`` results; a missing value is 0."""
    return df.select(F.lit(ts_id).alias("ts_id"), F.lit(variable).alias("variable"), F.col(ts).alias("ts"),
                     F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value"))


def bucketed(m: DataFrame, width, agg: str = "avg", origin=None, keys: list[str] = ("ts_id",)) -> DataFrame:
    keyed = m.withColumn("bucket", bucket_start(F.col("ts"), interval(width), origin))
    name = A.aggregate_name(agg)
    return series_aggregates(keyed, [*keys, "bucket"], [name]).withColumnRenamed(name, "value")


def trends(m: DataFrame, keys: list[str] = ("ts_id",)) -> DataFrame:
    """Slope of the value over its position, and the class of the trend."""
    keys = list(keys)
    rows = with_position(m, keys, "ts")
    s = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        slope_column(F.col("value"), F.col("idx")).alias("slope"),
    )
    return s.withColumn("trend", A.trend_class(F.col("count"), F.col("mean"), F.col("std"), F.col("slope")))


def slope_column(y: Column, x: Column) -> Column:
    """Least-squares slope; 0 under two points."""
    return F.when(F.count(y) >= 2, F.regr_slope(y, x.cast("double"))).otherwise(0.0)


def aligned_pairs(m: DataFrame, pairs: DataFrame, shift: int = 0) -> DataFrame:
    """Samples of the series of each pair side by side, by position.

    ``pairs`` has ``left_ts`` and ``right_ts``; row i of the left meets row i + ``shift`` of the
    right, and both sides stop with the shorter series.
    """
    rows = with_position(m, ["ts_id"], "ts").select("ts_id", "idx", "n", "value")
    left = rows.select(F.col("ts_id").alias("left_ts"), "idx", F.col("n").alias("left_n"), F.col("value").alias("x"))
    right = rows.select(F.col("ts_id").alias("right_ts"), (F.col("idx") - shift).alias("idx"),
                        F.col("n").alias("right_n"), F.col("value").alias("y"))
    common = F.least("left_n", "right_n")
    return pairs.join(left, "left_ts").join(right, ["right_ts", "idx"]).filter(F.col("idx") + max(shift, 0) < common)


def pair_correlations(m: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pearson correlation by position over the common length."""
    return (
        aligned_pairs(m, pairs.select("left_ts", "right_ts").distinct())
        .groupBy("left_ts", "right_ts").agg(guarded_corr(F.col("x"), F.col("y")).alias("corr"))
    )


def catalogue(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every series with its property name and the element that owns it."""
    def owned(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.col("uid").alias("owner"), F.lit(kind).alias("owner_kind"), "label",
                         F.explode("ts_ids").alias("property", "ts_id"))

    return owned(nodes, "node").unionByName(owned(edges, "edge"))


def catalogue_with(g, columns: dict[str, Column]) -> DataFrame:
    """The catalogue of a graph with more columns computed from each owner."""
    def owned(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.col("uid").alias("owner"), F.lit(kind).alias("owner_kind"), *[c.alias(n) for n, c in columns.items()],
                         F.explode("ts_ids").alias("property", "ts_id"))

    return owned(g.nodes, "node").unionByName(owned(g.edges, "edge"))


def entity_series(elements: DataFrame, m: DataFrame, prop: str | None = None, start=None, end=None) -> DataFrame:
    """Samples of the series of elements, with a closed time range."""
    owners = elements.select("uid", F.explode("ts_ids").alias("property", "ts_id"))
    if prop:
        owners = owners.filter(F.col("property") == prop)
    return owners.join(within(m, start, end), "ts_id").select("uid", "property", "ts_id", "ts", "value")


def select_measurements(m: DataFrame, ids: DataFrame | list[str] | None = None, variables: list[str] | None = None,
                        start=None, end=None, limit: int | None = None, ordered: bool = False) -> DataFrame:
    if isinstance(ids, list):
        m = m.filter(F.col("ts_id").isin(ids))
    elif ids is not None:
        m = m.join(ids.select("ts_id"), "ts_id", "left_semi")
    if variables:
        m = m.filter(F.col("variable").isin(variables))
    m = within(m, start, end)
    if ordered or limit:
        m = m.orderBy("ts_id", "variable", "ts")
    return m.limit(limit) if limit else m


def variables(m: DataFrame) -> DataFrame:
    return m.select("ts_id", "variable").distinct()


def measurement_stats(m: DataFrame) -> DataFrame:
    return m.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("ts_id").alias("n_series"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )

"""Validity intervals, time grids, buckets and as-of lookups."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UTC = dt.timezone.utc

#: Step labels of snapshot sequences; anything else means one day.
GRANULARITIES = {
    "1H": dt.timedelta(hours=1), "6H": dt.timedelta(hours=6), "12H": dt.timedelta(hours=12),
    "1D": dt.timedelta(days=1), "7D": dt.timedelta(days=7), "30D": dt.timedelta(days=30),
    "1M": dt.timedelta(days=30),
}


def granularity(label: str) -> dt.timedelta:
    return GRANULARITIES.get(label, dt.timedelta(days=1))


def granularity_label(step: dt.timedelta) -> str:
    """The largest whole unit of weeks, days, hours, minutes or seconds."""
    seconds = int(step.total_seconds())
    for unit, size in (("W", 604800), ("D", 86400), ("H", 3600), ("M", 60)):
        if seconds >= size and seconds % size == 0:
            return f"{seconds // size}{unit}"
    return f"{seconds}S"


def moment(value) -> dt.datetime:
    """A datetime or ISO text as an aware UTC datetime."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
    return value.replace(tzinfo=UTC) if value.tzinfo is None else value.astimezone(UTC)


def micros(value) -> int:
    delta = moment(value) - dt.datetime(1970, 1, 1, tzinfo=UTC)
    return (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds


def time_column(value) -> Column:
    return value if isinstance(value, Column) else F.timestamp_micros(F.lit(micros(value)))


def is_valid_at(at) -> Column:
    """Valid at a moment: both ends are closed and NULL is open."""
    t = time_column(at)
    started = F.col("start_time").isNull() | (F.col("start_time") <= t)
    return started & (F.col("end_time").isNull() | (F.col("end_time") >= t))


def meets(start, end) -> Column:
    """Valid somewhere in a closed interval."""
    a, b = time_column(start), time_column(end)
    started = F.col("start_time").isNull() | (F.col("start_time") <= b)
    return started & (F.col("end_time").isNull() | (F.col("end_time") >= a))


def valid_at(df: DataFrame, at) -> DataFrame:
    return df.filter(is_valid_at(at))


def overlapping(df: DataFrame, start, end) -> DataFrame:
    return df.filter(meets(start, end))


def within(df: DataFrame, start=None, end=None, column: str = "ts", closed_end: bool = True) -> DataFrame:
    """Rows of a time range; a ``day`` partition column of samples prunes whole folders."""
    if column == "ts" and "day" in df.columns:
        if start is not None:
            df = df.filter(F.col("day") >= F.to_date(time_column(start)))
        if end is not None:
            df = df.filter(F.col("day") <= F.to_date(time_column(end)))
    if start is not None:
        df = df.filter(F.col(column) >= time_column(start))
    if end is not None:
        bound = time_column(end)
        df = df.filter(F.col(column) <= bound if closed_end else F.col(column) < bound)
    return df


def intersection(df: DataFrame, other_start: Column, other_end: Column) -> DataFrame:
    """Clip validity to another interval and drop what does not meet it; NULL stays open."""
    return (
        df.withColumns({
            "start_time": F.greatest(F.col("start_time"), other_start),
            "end_time": F.least(F.col("end_time"), other_end),
        })
        .filter(F.col("start_time").isNull() | F.col("end_time").isNull()
                | (F.col("start_time") <= F.col("end_time")))
    )


def intervals_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    starts_in_time = s1.isNull() | e2.isNull() | (s1 <= e2)
    ends_in_time = e1.isNull() | s2.isNull() | (e1 >= s2)
    return starts_in_time & ends_in_time


def intersect_validity(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join two tables with validity and keep the common part of each pair of intervals."""
    other = right.withColumnsRenamed({"start_time": "_start", "end_time": "_end"})
    joined = left.join(other, keys)
    return intersection(joined, F.col("_start"), F.col("_end")).drop("_start", "_end")


def _floor_steps(x: Column, step: int) -> Column:
    return ((x - F.pmod(x, F.lit(step))) / step).cast("long")


@dataclass(frozen=True)
class Grid:
    """A regular series of moments ``start, start + every, …``; steps are numbered from 0.

    Intervals meet a regular grid by arithmetic, so no range join is needed anywhere.
    """

    start: dt.datetime
    end: dt.datetime
    every: dt.timedelta
    closed_end: bool = False

    def __post_init__(self):
        object.__setattr__(self, "start", moment(self.start))
        object.__setattr__(self, "end", moment(self.end))
        if self.every <= dt.timedelta(0):
            raise ValueError("the step of a grid must be positive")
        if self.end < self.start:
            raise ValueError("the end of a grid lies before its start")

    @property
    def step(self) -> int:
        return self.every // dt.timedelta(microseconds=1)

    @property
    def size(self) -> int:
        span = micros(self.end) - micros(self.start)
        return span // self.step + 1 if self.closed_end else -(-span // self.step)

    def time(self, idx: Column) -> Column:
        return F.timestamp_micros(F.lit(micros(self.start)) + idx * F.lit(self.step))

    def frame(self, spark: SparkSession) -> DataFrame:
        """Columns ``step`` and ``snap_ts``."""
        return spark.range(self.size).select(F.col("id").alias("step"), self.time(F.col("id")).alias("snap_ts"))

    def last_step_at(self, ts: Column) -> Column:
        """Number of the last grid moment at or before ``ts`` (may be negative)."""
        return _floor_steps(F.unix_micros(ts) - micros(self.start), self.step)

    def first_step_at(self, ts: Column) -> Column:
        return -_floor_steps(F.lit(micros(self.start)) - F.unix_micros(ts), self.step)

    def on_grid(self, ts: Column) -> Column:
        offset = F.unix_micros(ts) - micros(self.start)
        return (F.pmod(offset, F.lit(self.step)) == 0) & (offset >= 0) & (offset <= (self.size - 1) * self.step)

    def clamp(self, df: DataFrame) -> DataFrame:
        """Add ``_lo`` and ``_hi``, the first and last step inside the validity; others are dropped."""
        low = F.greatest(F.lit(0), F.coalesce(self.first_step_at(F.col("start_time")), F.lit(0)))
        high = F.least(F.lit(self.size - 1), F.coalesce(self.last_step_at(F.col("end_time")), F.lit(self.size - 1)))
        return df.withColumns({"_lo": low.cast("long"), "_hi": high.cast("long")}).filter(F.col("_lo") <= F.col("_hi"))

    def expand(self, df: DataFrame) -> DataFrame:
        """One row per element and step at which it is valid (column ``step``)."""
        return self.clamp(df).withColumn("step", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")

    def running_totals(self, df: DataFrame, amounts: dict[str, Column], keys: list[str] = ()) -> DataFrame:
        """Sums over the elements valid at each step, without a row per element and step.

        Each element adds its amounts at its first step and takes them back after its last one; the
        sums per step are few, and their running total is the result. Steps without elements stay.
        """
        keys, names = list(keys), list(amounts)
        clamped = self.clamp(df.withColumns({f"_{n}": a for n, a in amounts.items()}))
        mark = lambda step, sign: F.struct(step.alias("step"), *[(sign * F.col(f"_{n}")).alias(n) for n in names])
        marks = (
            clamped.select(*keys, F.explode(F.array(mark(F.col("_lo"), 1), mark(F.col("_hi") + 1, -1))).alias("m"))
            .groupBy(*keys, "m.step").agg(*[F.sum(f"m.{n}").alias(n) for n in names])
        )
        grid = self.frame(df.sparkSession)
        if keys:
            grid = marks.select(*keys).distinct().crossJoin(grid)  # every key gets a row per step
        order = Window.partitionBy(*keys, F.lit(0)).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # one row per step
        totals = {n: F.sum(F.coalesce(n, F.lit(0))).over(order) for n in names}
        return grid.join(marks, [*keys, "step"], "left").withColumns(totals)

    def running_count(self, df: DataFrame, keys: list[str] = (), name: str = "n") -> DataFrame:
        return self.running_totals(df, {name: F.lit(1)}, keys)


def bucket_start(ts: Column, width: dt.timedelta, origin=None) -> Column:
    """Start of the fixed-width bucket of a time; buckets are counted from ``origin``.

    The default origin is Monday 2000-01-03, a fixed value, so that weeks start on Mondays.
    """
    zero = micros(origin or dt.datetime(2000, 1, 3))
    size = width // dt.timedelta(microseconds=1)
    return F.timestamp_micros(F.unix_micros(ts) - F.pmod(F.unix_micros(ts) - zero, F.lit(size)))


#: Interval texts understood by bucketed filters, e.g. ``1 day`` or ``5 minutes``.
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def interval(value) -> dt.timedelta:
    if isinstance(value, dt.timedelta):
        return value
    amount, unit = value.split()
    return dt.timedelta(seconds=float(amount) * _UNITS[unit.rstrip("s")])


def as_of_grid(measurements: DataFrame, grid: Grid, key: str = "ts_id") -> DataFrame:
    """The last value at or before every grid moment: ``key, step, value``.

    A sample serves the first grid moment at or after it; the last sample of each such step is an
    ordinary aggregate, and what remains to fill is at most one row per series and step.
    """
    served = F.greatest(F.lit(0), grid.first_step_at(F.col("ts"))).cast("long")
    latest = (
        measurements.withColumn("step", served).filter(F.col("step") < grid.size)
        .groupBy(key, "step").agg(F.max_by("value", "ts").alias("value"))
    )
    following = F.lead("step").over(Window.partitionBy(key).orderBy("step"))
    return (
        latest.withColumn("_until", F.coalesce(following - 1, F.lit(grid.size - 1)))
        .withColumn("step", F.explode(F.sequence("step", "_until")))
        .drop("_until")
    )

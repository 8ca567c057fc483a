"""Aggregates over the samples of one series, as Column factories.

Every factory takes the value column and the time column of long measurement rows, so that one
``groupBy`` can carry any number of them and Spark combines them before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import safe_divide

Factory = Callable[[Column, Column], Column]


def first_value(v: Column, t: Column) -> Column:
    return F.min_by(v, t)


def last_value(v: Column, t: Column) -> Column:
    return F.max_by(v, t)


def change_percent(first: Column, last: Column) -> Column:
    """(last - first) / |first| in percent; from zero it is infinity upwards and 0 otherwise."""
    from_zero = F.when(last > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    return F.when(first == 0, from_zero).otherwise(safe_divide(last - first, F.abs(first)) * 100)


def coefficient_of_variation(std: Column, mean: Column) -> Column:
    return F.when(mean == 0, F.lit(0.0)).otherwise(safe_divide(std, F.abs(mean)))


#: Named aggregates; a user's own factory is added with ``register_aggregate``.
AGGREGATES: dict[str, Factory] = {
    "mean": lambda v, t: F.avg(v),
    "min": lambda v, t: F.min(v),
    "max": lambda v, t: F.max(v),
    "std": lambda v, t: F.stddev_pop(v),
    "sum": lambda v, t: F.sum(v),
    "count": lambda v, t: F.count(v).cast("double"),
    "range": lambda v, t: F.max(v) - F.min(v),
    "first": first_value,
    "last": last_value,
    "change": lambda v, t: last_value(v, t) - first_value(v, t),
    "change_percent": lambda v, t: change_percent(first_value(v, t), last_value(v, t)),
    "cv": lambda v, t: coefficient_of_variation(F.stddev_pop(v), F.avg(v)),
}
AGGREGATE_ALIASES = {"avg": "mean", "average": "mean", "stddev": "std", "coefficient_of_variation": "cv"}

#: Aggregates that need the order statistics of a group; see ``operators.series``.
ORDER_STATISTICS = {"median": 0.5}


#: A user's own aggregates in Python, added with ``register_python_aggregate``.
PYTHON_AGGREGATES: dict = {}


def aggregate_name(name: str) -> str:
    name = AGGREGATE_ALIASES.get(name, name)
    if name not in AGGREGATES and name not in ORDER_STATISTICS and name not in PYTHON_AGGREGATES:
        raise ValueError(f"unknown aggregate {name!r}")
    return name


def register_aggregate(name: str, factory: Factory) -> None:
    AGGREGATES[name] = factory


def register_python_aggregate(name: str, aggregate) -> None:
    """``aggregate``: a ``PythonAggregate``; its name then serves wherever series are aggregated by name."""
    PYTHON_AGGREGATES[name] = aggregate


def aggregate_column(name: str, v: Column, t: Column) -> Column:
    return AGGREGATES[aggregate_name(name)](v, t)


def count_above(v: Column, limit: float) -> Column:
    return F.count_if(v > limit)


def count_below(v: Column, limit: float) -> Column:
    return F.count_if(v < limit)


def fraction_above(v: Column, limit: float) -> Column:
    return F.avg((v > limit).cast("double"))


def fraction_below(v: Column, limit: float) -> Column:
    return F.avg((v < limit).cast("double"))


def value_nearest(v: Column, t: Column, at: Column) -> Column:
    """The value at the sample nearest to a time; the earlier sample wins a tie."""
    gap = F.abs(F.unix_micros(t) - F.unix_micros(at))
    return F.min_by(v, F.struct(gap, t))


def value_as_of(v: Column, t: Column, at: Column) -> Column:
    return F.max_by(F.when(t <= at, v), F.when(t <= at, t))


#: Fixed values of the trend classes.
VOLATILE_CV, SLOPE_SHARE = 0.5, 0.1


def trend_class(n: Column, mean: Column, std: Column, slope: Column) -> Column:
    cv = std / (F.abs(mean) + 1e-9)
    return (
        F.when(n < 2, "unknown")
        .when(cv > VOLATILE_CV, "volatile")
        .when(slope > SLOPE_SHARE * std, "increasing")
        .when(slope < -SLOPE_SHARE * std, "decreasing")
        .otherwise("stable")
    )


def shape_test(name: str, s: Callable[[str], Column]) -> Column:
    """Named shapes over ready aggregates; ``s(name)`` gives the aggregate column."""
    if name == "increasing":
        return s("change") > 0
    if name == "decreasing":
        return s("change") < 0
    if name == "stable":
        return s("cv") < 0.1
    if name == "spike":
        return (s("max") - s("mean")) > 2 * s("std")
    if name == "drop":
        return (s("mean") - s("min")) > 2 * s("std")
    if name.startswith("drop_by_"):
        return s("range") >= float(name.removeprefix("drop_by_"))
    if name.startswith("increase_by_"):
        return s("change") >= float(name.removeprefix("increase_by_"))
    raise ValueError(f"unknown shape {name!r}")


def shape_needs(name: str) -> list[str]:
    """The aggregates that :func:`shape_test` reads for a shape."""
    seen: list[str] = []

    def record(agg: str) -> Column:
        seen.append(agg)
        return F.lit(0.0)

    shape_test(name, record)
    return sorted(set(seen))

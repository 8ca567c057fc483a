"""Fluent queries over nodes or edges: static filters, series filters, order, limit.

A query only composes DataFrames: series conditions of one property and time range share one
aggregation and one join, and nothing runs before an action.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions.templates import template as template_values
from ..functions.values import compare_numbers, compare_property, property_column, property_number
from ..model import TemporalGraph
from . import scans
from .series import series_aggregates, value_as_of, value_nearest
from .subgraph import subgraph
from .temporal import overlapping, valid_at, within

_COLUMNS_OF_ENTITY = ("uid", "label", "src", "dst")


class QueryStart:
    def __init__(self, graph: TemporalGraph):
        self.graph = graph

    def nodes(self, label: str | None = None) -> "ElementQuery":
        return ElementQuery(self.graph, "node", scans.with_label(self.graph.nodes, label))

    def edges(self, label: str | None = None) -> "ElementQuery":
        return ElementQuery(self.graph, "edge", scans.with_label(self.graph.edges, label))


@dataclass(frozen=True)
class SeriesTest:
    """One condition on the aggregates of a series."""

    property: str
    needs: tuple[str, ...]
    test: object  # callable: (name -> Column) -> Column
    start: object = None
    end: object = None


@dataclass(frozen=True)
class ElementQuery:
    graph: TemporalGraph
    kind: str
    frame: DataFrame
    tests: tuple[SeriesTest, ...] = ()
    order: tuple[Column, ...] = ()
    top: int | None = None
    extra: tuple[DataFrame, ...] = field(default=())

    def _with(self, **changes) -> "ElementQuery":
        values = {f: getattr(self, f) for f in self.__dataclass_fields__} | changes
        return ElementQuery(**values)

    # static conditions ---------------------------------------------------------------------------
    def where(self, condition: Column | None = None, **equal) -> "ElementQuery":
        """A Column condition and equalities; an equality names a core column or a property."""
        df = self.frame if condition is None else self.frame.filter(condition)
        for name, value in equal.items():
            df = df.filter(compare_property(df, name, "=", value, self._operand(df, name)))
        return self._with(frame=df)

    def where_static(self, name: str, op: str, value) -> "ElementQuery":
        return self._with(frame=self.frame.filter(compare_property(self.frame, name, op, value, self._operand(self.frame, name))))

    @staticmethod
    def _operand(df: DataFrame, name: str) -> Column:
        return F.col(name) if name in _COLUMNS_OF_ENTITY else property_column(df, name)

    def where_python(self, predicate, columns: list[str]) -> "ElementQuery":
        """A Python predicate over the named columns or properties, in Arrow batches.

        The predicate gets pandas Series and returns booleans; rows on which it raises do not match. A batch on which it
        raises is halved until the failing rows stand alone.
        """
        @F.pandas_udf("boolean")
        def batch(*series):
            import pandas as pd

            def halved(parts):
                try:
                    return [pd.Series(predicate(*parts)).fillna(False).astype(bool)]
                except Exception:
                    n = len(parts[0])
                    if n == 1:
                        return [pd.Series([False])]
                    cuts = (slice(0, n // 2), slice(n // 2, n))
                    return [r for cut in cuts for r in halved([p.iloc[cut].reset_index(drop=True) for p in parts])]

            return pd.concat(halved(series), ignore_index=True)

        args = [self._operand(self.frame, c) for c in columns]
        return self._with(frame=self.frame.filter(batch(*args)))

    def at(self, t) -> "ElementQuery":
        return self._with(frame=valid_at(self.frame, t))

    def between(self, start, end) -> "ElementQuery":
        return self._with(frame=overlapping(self.frame, start, end))

    def source(self, uid: str) -> "ElementQuery":
        return self._with(frame=scans.edges_where(self.frame, source=uid))

    def target(self, uid: str) -> "ElementQuery":
        return self._with(frame=scans.edges_where(self.frame, target=uid))

    def id_contains(self, text: str) -> "ElementQuery":
        return self._with(frame=scans.id_contains(self.frame, text))

    def uid_in(self, ids: DataFrame) -> "ElementQuery":
        return self._with(frame=self.frame.join(ids.select("uid").distinct(), "uid", "left_semi"))

    # series conditions ---------------------------------------------------------------------------
    def _test(self, prop, needs, test, start=None, end=None) -> "ElementQuery":
        return self._with(tests=(*self.tests, SeriesTest(prop, tuple(needs), test, start, end)))

    def where_ts(self, prop: str, needs: list[str], test, start=None, end=None) -> "ElementQuery":
        """Any condition on named aggregates: ``where_ts('speed', ['max'], lambda s: s('max') > 9)``."""
        return self._test(prop, needs, test, start, end)

    def where_ts_agg(self, prop: str, agg: str, op: str, value: float, start=None, end=None) -> "ElementQuery":
        name = A.aggregate_name(agg)
        return self._test(prop, [name], lambda s: compare_numbers(s(name), op, value), start, end)

    def where_ts_compare(self, right: str, right_agg: str, op: str, left: str, left_agg: str) -> "ElementQuery":
        """``right_agg(right) op left_agg(left)``; elements without both series do not match."""
        sides = [(right, A.aggregate_name(right_agg)), (left, A.aggregate_name(left_agg))]
        if all(name in A.AGGREGATES for _, name in sides):
            owners = self.frame.select("uid", F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col("ts_ids").getItem(p).alias("ts_id"))
                                                                  for k, (p, _) in enumerate(sides)))).alias("s"))
            samples = self.graph.samples_of(right, left).join(owners.select("uid", "s.side", "s.ts_id"), "ts_id")
            of = lambda k, c: F.when(F.col("side") == k, F.col(c))
            both = samples.groupBy("uid").agg(
                *(A.aggregate_column(name, of(k, "value"), of(k, "ts")).alias(f"_{k}") for k, (_, name) in enumerate(sides)),
                F.bool_or(F.col("side") == 0).alias("_has_0"), F.bool_or(F.col("side") == 1).alias("_has_1")).filter("_has_0 AND _has_1")
        else:  # an order statistic has a plan of its own
            both = self._series(right, [right_agg]).toDF("uid", "_0").join(self._series(left, [left_agg]).toDF("uid", "_1"), "uid")
        passing = both.filter(compare_numbers(F.col("_0"), op, F.col("_1")))
        return self._with(extra=(*self.extra, passing.select("uid")))

    def where_ts_bucketed(self, prop: str, width, agg: str, condition: str, op: str, value: float,
                          start=None, end=None, origin=None) -> "ElementQuery":
        """All, any, the majority or the average of a series' time buckets satisfy a comparison."""
        from .series import bucketed

        owners = self._owners(prop)
        buckets = bucketed(self._samples(prop, owners, start, end), width, agg, origin)
        hit = compare_numbers(F.col("value"), op, value)
        verdict = {
            "all": F.bool_and(hit), "any": F.bool_or(hit), "majority": F.avg(hit.cast("double")) > 0.5,
            "avg": compare_numbers(F.avg("value"), op, value),
        }[condition]
        passing = buckets.groupBy("ts_id").agg(verdict.alias("_ok")).filter("_ok")
        return self._with(extra=(*self.extra, owners.join(passing, "ts_id").select("uid")))

    def where_ts_pattern(self, prop: str, pattern, threshold: float | None = None, normalize: bool = True) -> "ElementQuery":
        from .subsequence import contains_pattern

        owners = self._owners(prop)
        values = template_values(pattern) if isinstance(pattern, str) else list(pattern)
        found = contains_pattern(self._samples(prop, owners), values, threshold, normalize)
        return self._with(extra=(*self.extra, owners.join(found, "ts_id").select("uid")))

    def where_ts_similar(self, prop: str, reference: DataFrame | None = None, features: dict | None = None,
                         shape: str | None = None, tolerance: dict | float | None = None) -> "ElementQuery":
        """Similar to a reference series, to given features, or to a named shape."""
        if shape is not None:
            return self._test(prop, A.shape_needs(shape), lambda s: A.shape_test(shape, s))
        tol = tolerance if isinstance(tolerance, dict) else {}
        default = tolerance if isinstance(tolerance, (int, float)) else 0.1
        if features is not None:
            def near(s):
                ok = F.lit(True)
                for name, expected in features.items():
                    gap = F.abs(s(name) - expected)
                    ok = ok & ((gap if expected == 0 else gap / abs(expected)) <= tol.get(name, default))
                return ok
            return self._test(prop, list(features), near)
        target = reference.agg(F.avg("value").alias("_rm"), F.stddev_pop("value").alias("_rs"))  # one row
        mine = self._series(prop, ["mean", "std"])
        rel = lambda x, y: F.when(y != 0, F.abs(x - y) / F.abs(y)).otherwise(F.abs(x - y))
        passing = mine.crossJoin(F.broadcast(target)).filter(
            (rel(F.col("mean"), F.col("_rm")) <= tol.get("mean", default))
            & (rel(F.col("std"), F.col("_rs")) <= tol.get("std", default)))
        return self._with(extra=(*self.extra, passing.select("uid")))

    def where_value_at(self, prop: str, at, op: str, value: float) -> "ElementQuery":
        """Comparison with the sample nearest to a moment."""
        owners = self._owners(prop)
        near = value_nearest(self._samples(prop, owners), at).filter(compare_numbers(F.col("value"), op, value))
        return self._with(extra=(*self.extra, owners.join(near, "ts_id").select("uid")))

    def where_value_as_of(self, prop: str, at, op: str, value: float) -> "ElementQuery":
        owners = self._owners(prop)
        last = value_as_of(self._samples(prop, owners), at).filter(compare_numbers(F.col("value"), op, value))
        return self._with(extra=(*self.extra, owners.join(last, "ts_id").select("uid")))

    def constrain(self, **c) -> "ElementQuery":
        """A series condition given as plain data; ``type`` selects the kind."""
        kind, prop = c["type"], c["property"]
        op, value = c.get("operator", ">"), c.get("value")
        single = {"aggregation": c.get("aggregation"), "first": "first", "last": "last", "range": "range",
                  "change": "change", "volatility": "cv"}
        if kind in single:
            return self.where_ts_agg(prop, single[kind], op, value)
        if kind == "value_at":
            return self.where_value_at(prop, c["timestamp"], op, value)
        if kind == "trend":
            shape = {1: "increasing", -1: "decreasing"}.get(value, "stable")
            return self.where_ts_similar(prop, shape=shape)
        if kind == "pattern":
            return self.where_ts_pattern(prop, c["template"], c.get("threshold"))
        if kind == "similar_reference":
            return self.where_ts_similar(prop, reference=c["reference"], tolerance=c.get("tolerance"))
        if kind in ("similar_template", "similar"):
            shape = c.get("template") or (None if c.get("features") else "stable")
            return self.where_ts_similar(prop, shape=shape, features=c.get("features"), tolerance=c.get("tolerance"))
        if kind == "bucketed":
            return self.where_ts_bucketed(prop, c["interval"], c.get("aggregation") or "avg",
                                          c.get("condition") or "all", op, value)
        if kind in ("count_above", "count_below", "percent_above", "percent_below"):
            return self._where_share(prop, kind, value, c.get("threshold") or 0.5)
        raise ValueError(f"unknown series condition {kind!r}")

    def _where_share(self, prop: str, kind: str, limit: float, share: float) -> "ElementQuery":
        owners = self._owners(prop)
        v = F.col("value")
        verdict = {
            "count_above": A.count_above(v, limit) > 0, "count_below": A.count_below(v, limit) > 0,
            "percent_above": A.fraction_above(v, limit) >= share, "percent_below": A.fraction_below(v, limit) >= share,
        }[kind]
        passing = self._samples(prop, owners).groupBy("ts_id").agg(verdict.alias("_ok")).filter("_ok")
        return self._with(extra=(*self.extra, owners.join(passing, "ts_id").select("uid")))

    def _owners(self, prop: str) -> DataFrame:
        """``uid, ts_id`` of the elements that have this series."""
        return self.frame.select("uid", F.col("ts_ids").getItem(prop).alias("ts_id")).filter(F.col("ts_id").isNotNull())

    def _samples(self, prop: str, owners: DataFrame, start=None, end=None) -> DataFrame:
        """The samples of the owners' series only: the property and the range reach the scan, the ids are a semi join."""
        return within(self.graph.samples_of(prop), start, end).join(owners.select("ts_id"), "ts_id", "left_semi")

    def _series(self, prop: str, aggs: list[str], start=None, end=None) -> DataFrame:
        owners = self._owners(prop)
        stats = series_aggregates(self._samples(prop, owners, start, end), ["ts_id"], aggs)
        return owners.join(stats, "ts_id").drop("ts_id")

    # result --------------------------------------------------------------------------------------
    def order_by(self, key, descending: bool = False) -> "ElementQuery":
        """Order by a Column, a core column or a property; a missing property counts as 0."""
        if isinstance(key, Column):
            column = key
        elif key in self.frame.columns:
            column = F.col(key)
        else:
            column = F.coalesce(property_number(self.frame, key), F.lit(0.0))
        return self._with(order=(column.desc() if descending else column.asc(),))

    def limit(self, n: int) -> "ElementQuery":
        return self._with(top=n)

    def execute(self) -> DataFrame:
        """Filter, then order, then limit."""
        df = self.frame
        groups: dict[tuple, list[SeriesTest]] = {}
        for t in self.tests:
            groups.setdefault((t.property, t.start, t.end), []).append(t)
        for (prop, start, end), tests in groups.items():
            stats = self._series(prop, [n for t in tests for n in t.needs], start, end)
            for t in tests:
                stats = stats.filter(F.coalesce(t.test(F.col), F.lit(False)))
            df = df.join(stats.select("uid"), "uid", "left_semi")
        for passing in self.extra:
            df = df.join(passing, "uid", "left_semi")
        if self.order:
            df = df.orderBy(*self.order, F.col("uid"))
        return df.limit(self.top) if self.top is not None else df

    def count(self) -> int:
        return self.execute().count()

    def exists(self) -> bool:
        return not self.execute().isEmpty()

    def first(self) -> DataFrame:
        return self.limit(1).execute()

    def ids(self) -> DataFrame:
        return self.execute().select("uid")

    def as_subgraph(self) -> TemporalGraph:
        if self.kind != "node":
            raise ValueError("a subgraph is made from nodes")
        return subgraph(self.graph, self.ids())

    def series(self, prop: str | None = None, start=None, end=None) -> DataFrame:
        from .series import entity_series

        return entity_series(self.execute(), self.graph.measurements, prop, start, end)

    def aggregates(self, prop: str, aggs: list[str], start=None, end=None) -> DataFrame:
        return self._with(frame=self.execute(), tests=(), extra=())._series(prop, aggs, start, end)

    def pattern_matches(self, prop: str, pattern, **options) -> DataFrame:
        from .subsequence import find_pattern

        q = self._with(frame=self.execute(), tests=(), extra=())
        owners = q._owners(prop)
        samples = q._samples(prop, owners)
        return owners.join(find_pattern(samples, pattern, **options), "ts_id")

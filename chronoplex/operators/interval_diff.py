"""Difference of two intervals: structure, and a comparison of the series in both."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions.values import compare_numbers, guarded_corr, safe_divide
from ..model import TemporalGraph
from ..plans.lineage import cut
from ..plans.positions import with_position
from .diff import DiffQuery, PERSISTENT, changes_within, degree_changes_within, overall_similarity
from .series import slope_column
from .temporal import meets, time_column

DTW_BLOCK = 2048


def in_periods(m: DataFrame, first: tuple, second: tuple, closed_end: bool = True) -> DataFrame:
    """Samples of either period with ``period`` 1 or 2; a sample in both appears for each."""
    def inside(start, end) -> Column:
        upper = F.col("ts") <= time_column(end) if closed_end else F.col("ts") < time_column(end)
        return (F.col("ts") >= time_column(start)) & upper

    one, two = inside(*first), inside(*second)
    periods = F.filter(F.array(F.when(one, 1), F.when(two, 2)), lambda p: p.isNotNull())
    return m.filter(one | two).withColumn("period", F.explode(periods))


def resampled_correlation(rows: DataFrame) -> DataFrame:
    """Correlation of period 1 and 2 of each uid, the shorter one stretched linearly to the longer.

    ``rows`` has ``uid, period, idx, n, value``; sides with under two samples give no row.
    """
    one = rows.filter("period = 1")
    two = rows.filter("period = 2")
    sizes = one.filter("idx = 0").select("uid", F.col("n").alias("n1")).join(
        two.filter("idx = 0").select("uid", F.col("n").alias("n2")), "uid").filter("n1 >= 2 AND n2 >= 2")
    # both directions go through the same plan: base is the longer side, ties count as period 1
    sized = rows.select("uid", "period", "idx", "value").join(sizes, "uid")
    longer = F.when(F.col("n1") >= F.col("n2"), 1).otherwise(2)
    base = sized.filter(F.col("period") == longer)
    other = sized.filter(F.col("period") != longer).select("uid", F.col("idx").alias("at"), F.col("value").alias("v"))
    short, long_ = F.least("n1", "n2"), F.greatest("n1", "n2")
    place = F.col("idx") * (short - 1) / (long_ - 1)
    at = F.least(F.floor(place), short - 2)
    spots = base.select("uid", F.col("value").alias("x"), at.alias("at"), (place - at).alias("part"))
    upper = other.select("uid", (F.col("at") - 1).alias("at"), F.col("v").alias("v_next"))
    joined = spots.join(other, ["uid", "at"]).join(upper, ["uid", "at"])
    y = F.col("v") + (F.col("v_next") - F.col("v")) * F.col("part")
    return joined.groupBy("uid").agg(guarded_corr(F.col("x"), y).alias("correlation"))


def dtw_distance(rows: DataFrame, block: int = DTW_BLOCK) -> DataFrame:
    """Dynamic time warping distance over (n1 + n2), exact for any length.

    The cost table is cut into blocks; a block needs only the last row and column of the blocks
    before it. All blocks of one anti-diagonal are solved in one job, for all entities at once:
    series up to ``block`` samples take a single round.
    """
    def side(period: int, name: str) -> DataFrame:
        return (rows.filter(F.col("period") == period).groupBy("uid", F.floor(F.col("idx") / block).alias(f"b{name}"))
                .agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("s"), F.max("n").alias(f"n{name}"))  # at most ``block`` rows
                .select("uid", f"b{name}", f"n{name}", F.col("s.value").alias(f"v{name}")))

    one, two = cut(side(1, "i")), cut(side(2, "j"))

    @F.pandas_udf("struct<below:array<double>,right:array<double>>")
    def solve(vi: pd.Series, vj: pd.Series, top: pd.Series, left: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, t, l in zip(vi, vj, top, left):
            a, b = np.asarray(a, float), np.asarray(b, float)
            table = np.full((len(a) + 1, len(b) + 1), np.inf)
            if t is not None:
                table[0, :] = t
            if l is not None:
                table[1:, 0] = l
            if t is None and l is None:
                table[0, 0] = 0.0
            for k in range(len(a) + len(b) - 1):
                i = np.arange(max(0, k - len(b) + 1), min(len(a), k + 1))
                j = k - i
                before = np.minimum(np.minimum(table[i, j + 1], table[i + 1, j]), table[i, j])
                table[i + 1, j + 1] = np.abs(a[i] - b[j]) + before
            out.append((table[-1, :], table[1:, -1]))
        return pd.DataFrame({"below": [o[0] for o in out], "right": [o[1] for o in out]})

    none = F.lit(None).cast("array<double>")
    todo = one.filter("bi = 0").join(two.filter("bj = 0"), "uid").withColumns({"top": none, "left": none})
    finished = []
    last = lambda n: F.floor((F.col(n) - 1) / block)
    while True:
        solved = todo.withColumn("r", solve("vi", "vj", "top", "left"))
        solved = cut(solved.select("uid", "bi", "bj", "ni", "nj", "r.below", "r.right"))
        at_end = (F.col("bi") == last("ni")) & (F.col("bj") == last("nj"))
        finished.append(solved.filter(at_end).select(
            "uid", (F.element_at("below", -1) / (F.col("ni") + F.col("nj"))).alias("dtw")))
        open_ = solved.filter(~at_end)
        if open_.isEmpty():
            break
        down = open_.filter(F.col("bi") < last("ni")).select("uid", (F.col("bi") + 1).alias("bi"), "bj", F.col("below").alias("top"))
        across = open_.filter(F.col("bj") < last("nj")).select("uid", "bi", (F.col("bj") + 1).alias("bj"), F.col("right").alias("left"))
        todo = (down.join(across, ["uid", "bi", "bj"], "full_outer").join(one, ["uid", "bi"]).join(two, ["uid", "bj"]))
    result = finished[0]
    for part in finished[1:]:
        result = result.unionByName(part)
    return result


def series_comparison(samples: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Both periods of each uid side by side; ``samples`` has ``uid, period, ts, value``.

    Positions are numbered per uid and period, then one grouped aggregate carries all columns.
    """
    rows = with_position(samples, ["uid", "period"], "ts")
    v, t, p = F.col("value"), F.col("ts"), F.col("period")
    aggs = []
    for k in (1, 2):
        x = F.when(p == k, v)
        aggs += [F.count(x).alias(f"n_{k}"), F.avg(x).alias(f"mean_{k}"), F.stddev_pop(x).alias(f"std_{k}"),
                 F.min(x).alias(f"min_{k}"), F.max(x).alias(f"max_{k}"), F.sum(x).alias(f"sum_{k}"),
                 F.min(F.when(p == k, t)).alias(f"start_{k}"), F.max(F.when(p == k, t)).alias(f"end_{k}"),
                 slope_column(x, F.when(p == k, F.col("idx"))).alias(f"slope_{k}")]
    s = rows.groupBy("uid").agg(*aggs)
    col = F.col
    for k in (1, 2):
        trend = A.trend_class(col(f"n_{k}"), col(f"mean_{k}"), col(f"std_{k}"), col(f"slope_{k}"))
        s = s.withColumn(f"trend_{k}", F.when(col(f"n_{k}") > 0, trend))
    s = s.withColumns({f"{m}_diff": col(f"{m}_2") - col(f"{m}_1") for m in ("mean", "std", "min", "max", "sum")})
    percent = F.when(F.abs(col("mean_1")) > 1e-9, safe_divide(col("mean_diff"), F.abs(col("mean_1"))) * 100)
    s = s.withColumn("mean_diff_percent", percent)
    return s.withColumns({
        "trend_changed": col("trend_1") != col("trend_2"),
        "significant": F.coalesce(F.abs(col("mean_diff_percent")) > threshold * 100, F.lit(False)),
        "magnitude": F.abs(col("mean_diff_percent")) / 100,
    })


def with_shape(comparison: DataFrame, samples: DataFrame, dtw: bool = False) -> DataFrame:
    """Add correlation after resampling and shape similarity, and on request the warping distance."""
    rows = with_position(samples, ["uid", "period"], "ts")
    out = comparison.join(resampled_correlation(rows), "uid", "left")
    out = out.withColumn("shape_similarity", (F.col("correlation") + 1) / 2)
    if dtw:
        enough = rows.join(comparison.filter("n_1 >= 2 AND n_2 >= 2").select("uid"), "uid", "left_semi")
        out = out.join(dtw_distance(enough), "uid", "left")
    return out


class IntervalDiff:
    """Two intervals ``(start, end)`` of one graph."""

    def __init__(self, graph: TemporalGraph, first: tuple, second: tuple):
        self.graph, self.first, self.second = graph, first, second
        self.nodes = changes_within(graph.nodes, meets(*first), meets(*second))
        self.edges = changes_within(graph.edges, meets(*first), meets(*second))

    def changes(self, kind: str) -> DataFrame:
        return self.nodes if kind == "node" else self.edges

    def metrics(self, **weights) -> DataFrame:
        return overall_similarity(self.nodes, self.edges, **weights)

    def samples(self, prop: str, kind: str = "node", only_persistent: bool = True) -> DataFrame:
        df = self.changes(kind)
        if only_persistent:
            df = df.filter(F.col("change_type") == PERSISTENT)
        owners = df.select("uid", F.coalesce(F.col("ts_ids_1").getItem(prop), F.col("ts_ids_2").getItem(prop)).alias("ts_id"))
        return owners.filter(F.col("ts_id").isNotNull()).join(
            in_periods(self.graph.measurements, self.first, self.second), "ts_id").select("uid", "period", "ts", "value")

    def comparison(self, prop: str, kind: str = "node", only_persistent: bool = True, threshold: float = 0.1,
                   shape: bool = True, dtw: bool = False) -> DataFrame:
        samples = self.samples(prop, kind, only_persistent)
        table = series_comparison(samples, threshold)
        return with_shape(table, samples, dtw) if shape else table

    def significant_changes(self, prop: str, threshold: float = 0.1) -> DataFrame:
        return self.comparison(prop, threshold=threshold, shape=False).filter("significant")

    def trend_changes(self, prop: str) -> DataFrame:
        return self.comparison(prop, shape=False).filter("trend_changed")

    def anti_correlated(self, prop: str, below: float = -0.5) -> DataFrame:
        return self.comparison(prop).filter(F.col("correlation") < below)

    def summary(self, prop: str) -> DataFrame:
        c = self.comparison(prop)
        stats = lambda name, fs: [f(name).alias(f"{name}_{n}") for n, f in fs]
        basic = [("avg", F.avg), ("min", F.min), ("max", F.max)]
        return c.agg(
            F.count(F.lit(1)).alias("n_nodes"), F.count_if("significant").alias("n_significant"),
            F.count_if("trend_changed").alias("n_trend_changes"),
            F.count_if(F.col("correlation") < -0.5).alias("n_anti_correlated"),
            *stats("mean_diff", [*basic, ("std", F.stddev_pop)]), *stats("std_diff", basic), *stats("correlation", basic))

    def degree_changes(self, direction: str = "both") -> DataFrame:
        return degree_changes_within(self.graph.nodes, self.graph.edges, meets(*self.first), meets(*self.second), direction)

    def query(self) -> "IntervalDiffQuery":
        return IntervalDiffQuery(self)


class IntervalDiffQuery(DiffQuery):
    """Selection by what a series did between the intervals."""

    def with_series(self, prop: str, **options) -> "IntervalDiffQuery":
        """Attach the comparison columns of a series; elements without it drop out."""
        table = self.diff.comparison(prop, self.kind, only_persistent=False, **options)
        return self._new(self.frame.join(table, "uid"))

    def _compare(self, prop: str, column: str, op: str, value: float, **options) -> "IntervalDiffQuery":
        return self._with_value(self.diff.comparison(prop, self.kind, only_persistent=False, **options), column, op, value, f"{prop}_{column}")

    def where_mean_diff(self, prop: str, op: str, value: float):
        return self._compare(prop, "mean_diff", op, value, shape=False)

    def where_std_diff(self, prop: str, op: str, value: float):
        return self._compare(prop, "std_diff", op, value, shape=False)

    def where_correlation(self, prop: str, op: str, value: float):
        return self._compare(prop, "correlation", op, value)

    def where_trend_changed(self, prop: str):
        table = self.diff.comparison(prop, self.kind, only_persistent=False, shape=False)
        return self._new(self.frame.join(table.filter("trend_changed").select("uid", "trend_1", "trend_2"), "uid"))

    def where_significant(self, prop: str, threshold: float = 0.1):
        table = self.diff.comparison(prop, self.kind, only_persistent=False, shape=False, threshold=threshold)
        return self._new(self.frame.join(table.filter("significant").select("uid", "mean_diff_percent"), "uid"))

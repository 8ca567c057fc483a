"""Series describing an induced graph: structure and member values at its change steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .induced import InducedGraph
from .metrics import density_column
from .series import series_aggregates
from .temporal import within

#: Metrics computed when none are named.
DEFAULT_METRICS = ("density", "component_count", "largest_component")
STRUCTURE_METRICS = (*DEFAULT_METRICS, "node_count", "edge_count", "avg_degree")


def structure(induced: InducedGraph) -> DataFrame:
    """All structural metrics per change step, one row each."""
    steps = induced.change_steps().select("step")
    n = induced.members_at_changes().groupBy("step").agg(F.count(F.lit(1)).alias("node_count"))
    m = induced.edges().groupBy("step").agg(F.count(F.lit(1)).alias("edge_count"))
    c = induced.components().groupBy("step", "comp").agg(F.count(F.lit(1)).alias("size")).groupBy("step").agg(
        F.count(F.lit(1)).alias("component_count"), F.max("size").alias("largest_component"))
    rows = steps.join(n, "step", "left").join(m, "step", "left").join(c, "step", "left").fillna(0)
    return rows.withColumns({
        "density": density_column(F.col("node_count"), F.col("edge_count")),
        "avg_degree": F.when(F.col("node_count") > 0, F.try_divide(2.0 * F.col("edge_count"), F.col("node_count"))).otherwise(0.0),
        "snap_ts": induced.grid.time(F.col("step")),
    })


def largest_component_members(induced: InducedGraph) -> DataFrame:
    """Members of the largest component of each change step; the smallest name wins a tie."""
    sizes = induced.components().groupBy("step", "comp").agg(F.count(F.lit(1)).alias("size"))
    best = sizes.groupBy("step").agg(F.min_by("comp", F.struct(-F.col("size"), F.col("comp"))).alias("comp"))
    return induced.components().join(best, ["step", "comp"], "left_semi").select("step", "uid")


def member_signal(induced: InducedGraph, series: str, agg: str = "mean", scope: str = "all") -> DataFrame:
    """Aggregate of the members' values at each change step; nothing to aggregate is 0."""
    members = induced.members_at_changes().select("step", "uid") if scope == "all" else largest_component_members(induced)
    owners = induced.nodes().select("uid", F.col("ts_ids").getItem(series).alias("ts_id"))
    samples = within(induced.graph.samples_of(series), induced.grid.start, induced.grid.end).filter(induced.grid.on_grid(F.col("ts")))
    if induced.zero_is_missing:
        samples = samples.filter(F.col("value") != 0)
    values = (samples.withColumn("step", induced.grid.last_step_at(F.col("ts"))).join(owners, "ts_id")
              .join(members, ["uid", "step"], "left_semi"))
    stats = series_aggregates(values.select("step", "ts", "value"), ["step"], [agg]).toDF("step", "value")
    return (induced.change_steps().select("step").join(stats, "step", "left")
            .select("step", induced.grid.time(F.col("step")).alias("snap_ts"), F.coalesce("value", F.lit(0.0)).alias("value")))


def signals(induced: InducedGraph, metrics: list = DEFAULT_METRICS, start=None, end=None) -> DataFrame:
    """Long rows ``metric, snap_ts, value`` in a closed time range.

    A metric is a structural name, or ``(series, aggregate)`` or ``(series, aggregate, "largest")``.
    """
    parts = []
    named = [m for m in metrics if isinstance(m, str)]
    if named:
        wide = structure(induced).select("snap_ts", *[F.col(m).cast("double").alias(m) for m in named])
        parts.append(wide.unpivot(["snap_ts"], named, "metric", "value").select("metric", "snap_ts", "value"))
    for m in metrics:
        if not isinstance(m, str):
            series, agg, *scope = m
            name = "_".join((*scope, agg, series))
            parts.append(member_signal(induced, series, agg, *scope).select(F.lit(name).alias("metric"), "snap_ts", "value"))
    return within(reduce(lambda a, b: a.unionByName(b), parts), start, end, column="snap_ts")


def as_measurements(values: DataFrame, owner: str) -> DataFrame:
    """Signals as measurement rows of an element: series ``ts_<metric>_<owner>``."""
    return values.select(F.concat(F.lit("ts_"), "metric", F.lit(f"_{owner}")).alias("ts_id"), F.col("metric").alias("variable"),
                         F.col("snap_ts").alias("ts"), "value")

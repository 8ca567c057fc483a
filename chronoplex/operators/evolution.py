"""Series generated from a snapshot sequence: one value per step.

Counts of a step come from running totals of starts and ends of validity. Sums, averages, minima and maxima come from dyadic ranges of
steps; degrees first become runs in which a node's degree does not change. Weak components are contracted from long ranges to short ones. Only strong
components and the degrees of single nodes have rows per step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import property_number
from .metrics import component_summary, components, density_column
from .scans import edge_ends, edges_among, with_label
from .series import from_results
from .temporal import intersect_validity

_AGGREGATES = {"avg": F.avg, "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


def request_name(scope: str, entity: str, metric: str, aggregation: str = "avg", label: str | None = None, direction: str = "both",
                 weight: str | None = None, prop: str | None = None, uid: str | None = None, other: str | None = None) -> str:
    """The name of a requested series. The forms are fixed values."""
    if scope == "entity":
        return f"degree_{uid}_{direction}" if metric == "degree" else "_".join(["edges", uid or "", other or "", *([aggregation, prop or ""] if metric == "property" else ["count"])])
    if metric == "degree":
        return f"{aggregation}_weighted_degree_{weight}_{direction}" if weight else f"{aggregation}_degree_{direction}"
    if metric == "property":
        return f"{aggregation}_{prop}"
    if metric == "count":
        return "_".join([{"nodes": "node", "edges": "edge"}[entity], "count", *([label] if label else [])])
    return metric


def _over_steps(df: DataFrame, grid, amounts: dict) -> DataFrame:
    from ..plans.dyadic import over_steps

    return over_steps(df, grid, amounts)


def metric_name(entity: str, metric: str, agg: str | None = None, label: str | None = None) -> str:
    return "_".join(str(p) for p in (entity, metric, agg, label) if p)


class Evolution:
    """Every method returns ``step, snap_ts, value``; steps without anything have the value 0."""

    def __init__(self, sequence):
        self.sequence = sequence
        self.graph, self.grid = sequence.graph, sequence.grid

    def window(self, start, end) -> "Evolution":
        return Evolution(self.sequence.window(start, end))

    def _filled(self, df: DataFrame) -> DataFrame:
        value = F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value")
        if "snap_ts" in df.columns:  # already one row per step
            return df.select("step", "snap_ts", value)
        return self.sequence.steps.join(df.select("step", "value"), "step", "left").select("step", "snap_ts", value)

    # counts --------------------------------------------------------------------------------------
    def node_count(self, label: str | None = None) -> DataFrame:
        return self._filled(self.grid.running_count(with_label(self.graph.nodes, label), name="value"))

    def edge_count(self, label: str | None = None) -> DataFrame:
        return self._filled(self.grid.running_count(with_label(self.graph.edges, label), name="value"))

    def _among(self, label: str | None) -> DataFrame:
        """Edges, with a label those whose ends both have it."""
        return self.graph.edges if label is None else edges_among(self.graph.edges, with_label(self.graph.nodes, label))

    def density(self, directed: bool = True, label: str | None = None) -> DataFrame:
        n = self.node_count(label)
        m = self._filled(self.grid.running_count(self._among(label), name="value")).withColumnRenamed("value", "m").drop("snap_ts")
        joined = n.join(m, "step")
        return joined.select("step", "snap_ts", density_column(F.col("value"), F.col("m"), directed).alias("value"))

    # degrees -------------------------------------------------------------------------------------
    def _ends(self, direction: str, label: str | None, weight: str | None, self_loop: int,
              edge_label: str | None = None) -> DataFrame:
        """Edge ends clipped to the time in which edge and (labelled) node are both valid."""
        edges = with_label(self.graph.edges, edge_label)
        amount = F.lit(1) if weight is None else F.coalesce(property_number(edges, weight), F.lit(0.0))
        ends = edge_ends(edges.withColumn("w", amount), direction, self_loop).select(
            F.col("node").alias("uid"), "start_time", "end_time", "w")
        nodes = with_label(self.graph.nodes, label).select("uid", "start_time", "end_time")
        return intersect_validity(ends, nodes, ["uid"])

    def _runs(self, ends: DataFrame) -> DataFrame:
        """``uid, degree, _lo, _hi``: the runs of steps in which a node has edges and its degree does not change.

        What starts and ends at a step is added up first, so a node has one row per step at most, however many edges it has.
        """
        mark = lambda step, sign: F.struct(step.alias("_lo"), (sign * F.col("w")).alias("w"), F.lit(sign).alias("k"))
        marks = (
            self.grid.clamp(ends).select("uid", F.explode(F.array(mark(F.col("_lo"), 1), mark(F.col("_hi") + 1, -1))).alias("m"))
            .groupBy("uid", "m._lo").agg(F.sum("m.w").alias("w"), F.sum("m.k").alias("k"))
        )
        order = Window.partitionBy("uid").orderBy("_lo")
        until = order.rowsBetween(Window.unboundedPreceding, 0)
        runs = marks.select("uid", "_lo", F.coalesce(F.lead("_lo").over(order) - 1, F.lit(self.grid.size - 1)).alias("_hi"),
                            F.sum("w").over(until).alias("degree"), F.sum("k").over(until).alias("k"))
        return runs.filter((F.col("k") > 0) & (F.col("_lo") <= F.col("_hi"))).drop("k")

    def degree_stats(self, direction: str = "both", label: str | None = None, weight: str | None = None) -> DataFrame:
        """``n_nodes, sum, avg, min, max`` of the degree per step, all in one pass; a self loop counts once."""
        ends = self._ends(direction, label, weight, self_loop=1)
        n = self.grid.running_count(with_label(self.graph.nodes, label), name="n_nodes")
        stats = _over_steps(self._runs(ends), self.grid, {
            "total": ("sum", F.col("degree")), "low": ("min", F.col("degree")), "high": ("max", F.col("degree")), "linked": ("count", F.col("degree"))})
        unlinked = F.coalesce("linked", F.lit(0)) < F.col("n_nodes")
        low = F.when(unlinked, F.least(F.coalesce("low", F.lit(0)), F.lit(0))).otherwise(F.col("low"))
        high = F.when(unlinked, F.greatest(F.coalesce("high", F.lit(0)), F.lit(0))).otherwise(F.col("high"))
        total = F.coalesce("total", F.lit(0))
        return n.join(stats, "step", "left").select(
            "step", "snap_ts", "n_nodes", total.alias("sum"), F.try_divide(total.cast("double"), F.col("n_nodes")).alias("avg"),
            low.alias("min"), high.alias("max"))

    def degree(self, agg: str = "avg", direction: str = "both", label: str | None = None,
               weight: str | None = None) -> DataFrame:
        """Degree over all nodes of a step (label picks nodes, not edges); a self loop counts once."""
        agg = "avg" if agg == "mean" else agg
        if agg not in ("sum", "avg") or weight is not None:
            return self._filled(self.degree_stats(direction, label, weight).withColumn("value", F.col(agg)))
        ends = self._ends(direction, label, weight, self_loop=1)
        n = self.grid.running_count(with_label(self.graph.nodes, label), name="n_nodes")
        total = self.grid.running_count(ends, name="value").drop("snap_ts")
        value = F.col("value") if agg == "sum" else F.try_divide(F.col("value").cast("double"), F.col("n_nodes"))
        return self._filled(n.join(total, "step").withColumn("value", value))

    def entity_degree(self, uid: str | None = None, direction: str = "both", label: str | None = None,
                      weight: str | None = None) -> DataFrame:
        """Degree per node and step (``uid`` column); ``label`` keeps edges among nodes of that label.

        One node gives a full series with zeros; all nodes give the steps at which they are valid.
        """
        nodes = with_label(self.graph.nodes, label)
        ends = self._ends(direction, label, weight, self_loop=2)
        if label is not None:
            others = edge_ends(self.graph.edges, direction).select(
                F.col("node").alias("uid"), "other", "start_time", "end_time",
                (F.lit(1) if weight is None else F.coalesce(property_number(self.graph.edges, weight), F.lit(0.0))).alias("w"))
            far = nodes.select(F.col("uid").alias("other"), "start_time", "end_time")
            ends = intersect_validity(intersect_validity(others, far, ["other"]), nodes.select("uid", "start_time", "end_time"), ["uid"])
        if uid is not None:
            ends = ends.filter(F.col("uid") == uid)
            per_step = self.grid.expand(ends).groupBy("step").agg(F.sum("w").alias("value"))
            return self._filled(per_step).withColumn("uid", F.lit(uid))
        per_node = self.grid.expand(ends).groupBy("step", "uid").agg(F.sum("w").alias("value"))
        valid = self.sequence._timed(self.grid.expand(nodes.select("uid", "start_time", "end_time")))
        return (valid.join(per_node, ["step", "uid"], "left")
                .select("uid", "step", "snap_ts", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value")))

    # properties ----------------------------------------------------------------------------------
    def _property(self, df: DataFrame, name: str, agg: str) -> DataFrame:
        numbers = df.select("start_time", "end_time", property_number(df, name).alias("x")).filter(F.col("x").isNotNull())
        kinds = {"avg": ("sum", "count"), "mean": ("sum", "count")}.get(agg, (agg,))
        held = _over_steps(self.grid.clamp(numbers), self.grid, {k: (k, F.col("x")) for k in kinds})
        return self._filled(held.withColumn("value", F.col("sum") / F.col("count") if len(kinds) == 2 else F.col(agg)))

    def node_property(self, name: str, agg: str = "avg", label: str | None = None, source: str = "static") -> DataFrame:
        if source == "temporal":
            return self._temporal("node", name, agg, label)
        return self._property(with_label(self.graph.nodes, label), name, agg)

    def edge_property(self, name: str, agg: str = "avg", label: str | None = None, source: str = "static") -> DataFrame:
        if source == "temporal":
            return self._temporal("edge", name, agg, label)
        return self._property(with_label(self.graph.edges, label), name, agg)

    def _temporal(self, kind: str, name: str, agg: str, label: str | None) -> DataFrame:
        """Aggregate of a temporal property: the last sample of each element at every step."""
        from .temporal import as_of_grid

        owners = with_label(self.graph.elements(kind), label).select(
            "start_time", "end_time", F.col("ts_ids").getItem(name).alias("ts_id")).filter(F.col("ts_id").isNotNull())
        mine = self.graph.measurements.join(owners.select("ts_id").distinct(), "ts_id", "left_semi")
        known = as_of_grid(mine, self.grid).join(self.grid.clamp(owners).select("ts_id", "_lo", "_hi"), "ts_id")
        inside = known.filter(F.col("step").between(F.col("_lo"), F.col("_hi")))
        return self._filled(inside.groupBy("step").agg(_AGGREGATES[agg]("value").alias("value")))

    def edges_between(self, a: str, b: str, label: str | None = None, directed: bool = True,
                      prop: str | None = None, agg: str = "sum") -> DataFrame:
        from .scans import between_pair

        edges = between_pair(self.graph.edges, a, b, label, directed)
        if prop is None:
            return self._filled(self.grid.running_count(edges, name="value"))
        return self._property(edges, prop, agg)

    # components ----------------------------------------------------------------------------------
    def _components(self, directed: bool, label: str | None = None) -> DataFrame:
        """``step, n_components, biggest``; strong components need the edges of every step."""
        nodes = with_label(self.graph.nodes, label).select("uid", "start_time", "end_time")
        edges = self._among(label).select("src", "dst", "start_time", "end_time")
        if directed:
            nodes, edges = self.grid.expand(nodes), self.grid.expand(edges)
            return component_summary(components(nodes, edges, directed, ["step"]), ["step"])
        from ..plans.connectivity import components_in_windows, numbered
        from ..plans.lineage import cut

        # a number for each distinct name, since the edges go through shuffles; the nodes' side is the one to hash
        nodes = cut(nodes)
        numbers, n_nodes = numbered(nodes.select("uid"))
        known = self.grid.clamp(nodes.join(numbers, "uid")).select("uid", "_number", F.col("_lo").alias("_from"), F.col("_hi").alias("_to"))
        edges = self.grid.clamp(edges).drop("start_time", "end_time")
        for end in ("src", "dst"):
            edges = edges.join(known.withColumnRenamed("uid", end).hint("shuffle_hash"), end).select(
                *({"src", "dst"} - {end}), F.col("_number").alias(end), F.greatest("_lo", "_from").alias("_lo"), F.least("_hi", "_to").alias("_hi")).filter("_lo <= _hi")
        joined = components_in_windows(edges, self.grid, n_nodes=n_nodes)
        n = self.grid.running_count(nodes, name="n_nodes")
        return n.join(joined, "step", "left").select(
            "step", (F.col("n_nodes") - F.coalesce("joins", F.lit(0))).alias("n_components"), F.coalesce("biggest", F.least("n_nodes", F.lit(1))).alias("biggest"))

    def component_count(self, directed: bool = True, label: str | None = None) -> DataFrame:
        return self._filled(self._components(directed, label).withColumnRenamed("n_components", "value"))

    def largest_component(self, directed: bool = True, label: str | None = None) -> DataFrame:
        return self._filled(self._components(directed, label).withColumnRenamed("biggest", "value"))

    # request form --------------------------------------------------------------------------------
    def compute(self, entity: str, metric: str, agg: str | None = None, **options) -> DataFrame:
        """A metric by name, with its name as a column."""
        if metric == "property":
            df = getattr(self, f"{entity}_property")(options.pop("name"), agg or "avg", **options)
        elif metric == "degree":
            df = self.degree(agg or "avg", **options)
        elif metric == "count":
            df = getattr(self, f"{entity}_count")(**options)
        elif metric in ("density", "component_count", "largest_component"):
            df = getattr(self, metric)(**options)
        else:
            raise ValueError(f"unknown metric {metric!r}")
        return df.withColumn("metric", F.lit(metric_name(entity, metric, agg, options.get("label"))))

    def request(self, scope: str, entity: str, metric: str, aggregation: str = "avg", *, label: str | None = None, direction: str = "both",
                weight: str | None = None, prop: str | None = None, uid: str | None = None, other: str | None = None, directed: bool = True) -> DataFrame:
        """A series by request: ``step, snap_ts, value, metric``, the last being the request's name (see ``request_name``).

        Scope ``global``: ``count``, ``degree`` and ``property`` of ``nodes``, ``count`` and ``property`` of ``edges``, ``density`` and ``connected_components`` of the
        ``graph``. Scope ``entity``: ``degree`` of the node ``uid``, ``count`` and ``property`` of the edges between ``uid`` and ``other``.
        """
        name = request_name(scope, entity, metric, aggregation, label, direction, weight, prop, uid, other)
        asked = (scope, entity, metric)
        if asked == ("global", "nodes", "count"):
            df = self.node_count(label)
        elif asked == ("global", "edges", "count"):
            df = self.edge_count(label)
        elif asked == ("global", "nodes", "degree"):
            df = self.degree(aggregation, direction, label, weight)
        elif asked in (("global", "nodes", "property"), ("global", "edges", "property")) and prop:
            df = (self.node_property if entity == "nodes" else self.edge_property)(prop, aggregation, label)
        elif asked == ("global", "graph", "density"):
            df = self.density(directed, label)
        elif asked == ("global", "graph", "connected_components"):
            df = self.component_count(directed, label)
        elif asked == ("entity", "nodes", "degree") and uid:
            df = self.entity_degree(uid, direction, label, weight).drop("uid")
        elif asked in (("entity", "edges", "count"), ("entity", "edges", "property")) and uid and other:
            df = self.edges_between(uid, other, label, directed, prop if metric == "property" else None, aggregation)
        else:
            raise ValueError(f"no series for {scope} {entity} {metric}")
        return df.withColumn("metric", F.lit(name))

    @staticmethod
    def as_measurements(values: DataFrame, ts_id: str, variable: str) -> DataFrame:
        return from_results(values, ts_id, variable)

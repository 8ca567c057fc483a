"""Difference of two snapshots: elements, properties, degrees, series, and similarity of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import value_as_of
from ..functions.values import compare_numbers, safe_divide
from ..model import TemporalGraph
from .metrics import degrees
from .scans import edge_ends
from .series import catalogue_with, series_aggregates
from .snapshot import Snapshot
from .temporal import time_column, within

ADDED, REMOVED, PERSISTENT = "added", "removed", "persistent"


def change_type(in_first: Column, in_second: Column) -> Column:
    return F.when(in_first & in_second, PERSISTENT).when(in_second, ADDED).when(in_first, REMOVED)


def element_changes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Full outer comparison by uid, with labels, properties and series ids of both sides."""
    def side(df: DataFrame, n: int) -> DataFrame:
        return df.select("uid", F.col("label").alias(f"label_{n}"), F.col("props").alias(f"props_{n}"),
                         F.col("ts_ids").alias(f"ts_ids_{n}"), F.lit(True).alias(f"in_{n}"))

    both = side(first, 1).join(side(second, 2), "uid", "full_outer")
    flags = F.coalesce("in_1", F.lit(False)), F.coalesce("in_2", F.lit(False))
    return both.select(
        "uid", F.coalesce("label_2", "label_1").alias("label"), change_type(*flags).alias("change_type"),
        "props_1", "props_2", "ts_ids_1", "ts_ids_2",
    )


def changes_within(df: DataFrame, in_first: Column, in_second: Column) -> DataFrame:
    """The same for two states of one table with one row per uid: a scan, without any join."""
    rows = df.withColumns({"_1": in_first, "_2": in_second}).filter("_1 OR _2")
    sides = [F.when(F.col(f"_{n}"), F.col(c)).alias(f"{c}_{n}") for c in ("props", "ts_ids") for n in (1, 2)]
    return rows.select("uid", "label", change_type(F.col("_1"), F.col("_2")).alias("change_type"), *sides)


def degree_changes_within(nodes: DataFrame, edges: DataFrame, in_first: Column, in_second: Column,
                          direction: str = "both") -> DataFrame:
    """Degrees of two states of one graph from one pass over the edges; a self loop counts twice."""
    marked = edges.withColumns({"_1": in_first.cast("int"), "_2": in_second.cast("int")}).filter("_1 + _2 > 0")
    counted = edge_ends(marked.select("src", "dst", "_1", "_2"), direction).groupBy(F.col("node").alias("uid")).agg(
        F.sum("_1").alias("k1"), F.sum("_2").alias("k2"))
    present = nodes.select("uid", in_first.alias("_1"), in_second.alias("_2")).filter("_1 OR _2")
    degree = lambda n: F.when(F.col(f"_{n}"), F.coalesce(f"k{n}", F.lit(0))).otherwise(F.lit(0))
    return present.join(counted, "uid", "left").select(
        "uid", degree(1).alias("degree_1"), degree(2).alias("degree_2"), (degree(2) - degree(1)).alias("degree_change"))


def similarity(changes: DataFrame) -> DataFrame:
    """Churn, addition and deletion rate, and Jaccard of one kind of element, as one row."""
    kinds = [F.count_if(F.col("change_type") == k).alias(f"n_{k}") for k in (ADDED, REMOVED, PERSISTENT)]
    n = changes.agg(*kinds)
    total = F.col("n_added") + F.col("n_removed") + F.col("n_persistent")
    share = lambda part, empty: F.when(total == 0, F.lit(empty)).otherwise(safe_divide(part, total))
    return n.withColumns({
        "churn": share(F.col("n_added") + F.col("n_removed"), 0.0),
        "addition_rate": share(F.col("n_added"), 0.0), "deletion_rate": share(F.col("n_removed"), 0.0),
        "jaccard": share(F.col("n_persistent"), 1.0),
    })


def overall_similarity(nodes: DataFrame, edges: DataFrame, node_weight: float = 1.0, edge_weight: float = 1.0,
                       stability_weights: tuple = (0.5, 0.5)) -> DataFrame:
    """Node and edge rates side by side, the weighted edit distance and the stability score."""
    n, e = similarity(nodes), similarity(edges)
    both = (n.withColumnsRenamed({c: f"node_{c}" for c in n.columns})
            .crossJoin(e.withColumnsRenamed({c: f"edge_{c}" for c in e.columns})))  # one row each
    changed = lambda k: F.col(f"{k}_n_added") + F.col(f"{k}_n_removed")
    union = lambda k: changed(k) + F.col(f"{k}_n_persistent")
    weight = node_weight * union("node") + edge_weight * union("edge")
    edits = node_weight * changed("node") + edge_weight * changed("edge")
    a, b = stability_weights
    score = (a * F.col("node_jaccard") + b * F.col("edge_jaccard")) / (a + b) if a + b else F.lit(0.0)
    return both.withColumns({
        "edit_distance": F.when(weight == 0, F.lit(0.0)).otherwise(safe_divide(edits, weight)), "stability": score})


def property_changes(changes: DataFrame) -> DataFrame:
    """One row per persistent element and static property: ``uid, property, change, old, new, delta``."""
    empty = F.create_map().cast("map<string,string>")
    entry = lambda k, a, b: F.struct(a.alias("old"), b.alias("new"))
    zipped = F.map_zip_with(F.coalesce("props_1", empty), F.coalesce("props_2", empty), entry)
    rows = changes.filter(F.col("change_type") == PERSISTENT).select("uid", F.explode(zipped).alias("property", "v"))
    return _classified(rows.select("uid", "property", "v.old", "v.new"))


def _classified(rows: DataFrame) -> DataFrame:
    old, new = F.col("old"), F.col("new")
    kind = (F.when(old.isNull(), ADDED).when(new.isNull(), REMOVED)
            .when(old == new, PERSISTENT).otherwise("changed"))
    delta = new.try_cast("double") - old.try_cast("double")
    return rows.withColumns({"change": kind, "delta": F.when(kind == "changed", delta)})


class SnapshotDiff:
    """Two snapshots, first and second; every method returns a DataFrame."""

    def __init__(self, first: Snapshot, second: Snapshot):
        self.first, self.second = first, second
        self.same_graph = first.graph is not None and first.graph is second.graph
        if self.same_graph:
            self.nodes = changes_within(first.graph.nodes, first.holds(), second.holds())
            self.edges = changes_within(first.graph.edges, first.holds(), second.holds())
        else:
            self.nodes = element_changes(first.nodes, second.nodes)
            self.edges = element_changes(first.edges, second.edges)

    def changes(self, kind: str) -> DataFrame:
        return self.nodes if kind == "node" else self.edges

    def added_series(self) -> DataFrame:
        ids = lambda s: s.nodes.select(F.explode("ts_ids").alias("property", "ts_id")).unionByName(
            s.edges.select(F.explode("ts_ids").alias("property", "ts_id"))).select("ts_id").distinct()
        return ids(self.second).join(ids(self.first), "ts_id", "left_anti")

    def value_changes(self) -> DataFrame:
        """Resolved series values of both snapshots, compared like properties."""
        if self.same_graph and self.first.between is None and self.second.between is None:
            return _classified(self._point_values())
        def side(s: Snapshot, name: str) -> DataFrame:
            if s.values is None:
                raise ValueError("series values need snapshots of mode 'hybrid'")
            return s.values.filter(F.col("value").isNotNull()).select(F.col("owner").alias("uid"), "owner_kind", "property", F.col("value").cast("string").alias(name))

        rows = side(self.first, "old").join(side(self.second, "new"), ["uid", "owner_kind", "property"], "full_outer")
        return _classified(rows)

    def _point_values(self) -> DataFrame:
        """Values at both moments from one pass over the samples."""
        g, one, two = self.first.graph, self.first, self.second
        owners = catalogue_with(g, {"_1": one.holds(), "_2": two.holds()}).filter("_1 OR _2")
        last = lambda at: value_as_of(F.col("value"), F.col("ts"), time_column(at)).cast("string")
        latest = F.greatest(time_column(one.at), time_column(two.at))
        found = g.measurements.filter(F.col("ts") <= latest).groupBy("ts_id").agg(last(one.at).alias("old"), last(two.at).alias("new"))
        side = lambda n, c: F.when(F.col(n), F.col(c)).alias(c)
        rows = owners.join(found, "ts_id").select(F.col("owner").alias("uid"), "owner_kind", "property", side("_1", "old"), side("_2", "new"))
        return rows.filter(F.col("old").isNotNull() | F.col("new").isNotNull())

    def property_changes(self, kind: str = "node") -> DataFrame:
        static = property_changes(self.changes(kind))
        if self.first.values is None or self.second.values is None:
            return static
        stays = self.changes(kind).filter(F.col("change_type") == PERSISTENT).select("uid")
        temporal = self.value_changes().filter(F.col("owner_kind") == kind).drop("owner_kind").join(stays, "uid", "left_semi")
        return static.unionByName(temporal)

    def changed(self, kind: str = "node", ids: list[str] | None = None) -> DataFrame:
        """Persistent elements with at least one changed property, and how many."""
        rows = self.property_changes(kind)
        if ids is not None:
            rows = rows.filter(F.col("uid").isin(ids))
        return rows.filter(F.col("change") != PERSISTENT).groupBy("uid").agg(F.count(F.lit(1)).alias("n_changes"))

    def metrics(self, **weights) -> DataFrame:
        return overall_similarity(self.nodes, self.edges, **weights)

    def degree_changes(self, direction: str = "both") -> DataFrame:
        """Degree in both snapshots and its change; absent counts as 0, a self loop as 2."""
        if self.same_graph:
            g = self.first.graph
            return degree_changes_within(g.nodes, g.edges, self.first.holds(), self.second.holds(), direction)
        one = degrees(self.first.nodes, self.first.edges, direction).withColumnRenamed("degree", "degree_1")
        two = degrees(self.second.nodes, self.second.edges, direction).withColumnRenamed("degree", "degree_2")
        d1, d2 = F.coalesce("degree_1", F.lit(0)), F.coalesce("degree_2", F.lit(0))
        return one.join(two, "uid", "full_outer").select(
            "uid", d1.alias("degree_1"), d2.alias("degree_2"), (d2 - d1).alias("degree_change"))

    def property_change(self, name: str, kind: str = "node") -> DataFrame:
        """Difference and percent difference of a numeric property; from about 0 the percentage is NULL."""
        old, new = (F.col(f"props_{i}").getItem(name).try_cast("double") for i in (1, 2))
        delta = new - old
        return self.changes(kind).filter(F.col("change_type") == PERSISTENT).select(
            "uid", old.alias("old"), new.alias("new"), delta.alias("change"),
            F.when(F.abs(old) >= 1e-9, safe_divide(delta * 100, F.abs(old))).alias("change_percent"))

    def series_change(self, prop: str, agg: str = "mean", kind: str = "node", lookback=None) -> DataFrame:
        """Change of an aggregate of a series from the samples up to the first moment to those up to the second.

        One side missing counts as 0; with both missing the change is NULL.
        """
        measurements = self.first.measurements
        def side(n: int, s: Snapshot) -> DataFrame:
            owners = self.changes(kind).select("uid", F.col(f"ts_ids_{n}").getItem(prop).alias("ts_id")).filter(F.col("ts_id").isNotNull())
            inside = within(measurements, *(s.between or (s.at - lookback if lookback else None, s.at)))
            stats = series_aggregates(inside, ["ts_id"], [agg]).toDF("ts_id", f"agg_{n}")
            return owners.join(stats, "ts_id").drop("ts_id")

        rows = self.changes(kind).select("uid", "change_type").join(side(1, self.first), "uid", "left").join(side(2, self.second), "uid", "left")
        a, b = F.col("agg_1"), F.col("agg_2")
        change = F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(F.coalesce(b, F.lit(0.0)) - F.coalesce(a, F.lit(0.0)))
        return rows.withColumn("change", change)

    def compare(self) -> DataFrame:
        """Counts of each kind of change and the similarity measures, one row."""
        return self.metrics()

    def query(self) -> "DiffQuery":
        return DiffQuery(self)


class DiffQuery:
    """Fluent selection of changed elements: kind, label, conditions, order, limit."""

    def __init__(self, diff, frame: DataFrame | None = None, kind: str = "node", order=(), top: int | None = None):
        self.diff, self.kind, self.order, self.top = diff, kind, order, top
        self.frame = frame

    def _new(self, frame=None, kind=None, order=None, top=None):
        return type(self)(self.diff, self.frame if frame is None else frame, kind or self.kind,
                          self.order if order is None else order, self.top if top is None else top)

    def nodes(self, *change_types: str) -> "DiffQuery":
        return self._pick("node", change_types)

    def edges(self, *change_types: str) -> "DiffQuery":
        return self._pick("edge", change_types)

    def _pick(self, kind, change_types):
        df = self.diff.changes(kind)
        return self._new(df.filter(F.col("change_type").isin(*change_types)) if change_types else df, kind)

    def changed_nodes(self) -> "DiffQuery":
        return self._new(self.diff.nodes.join(self.diff.changed("node"), "uid", "left_semi"), "node")

    def changed_edges(self) -> "DiffQuery":
        return self._new(self.diff.edges.join(self.diff.changed("edge"), "uid", "left_semi"), "edge")

    def label(self, label: str) -> "DiffQuery":
        return self._new(self.frame.filter(F.col("label") == label))

    def where(self, condition: Column) -> "DiffQuery":
        return self._new(self.frame.filter(F.coalesce(condition, F.lit(False))))

    def _with_value(self, values: DataFrame, column: str, op: str, limit: float, name: str) -> "DiffQuery":
        kept = values.select("uid", F.col(column).alias(name)).filter(compare_numbers(F.col(name), op, limit))
        return self._new(self.frame.join(kept, "uid"))

    def where_degree_change(self, op: str, value: float, direction: str = "both") -> "DiffQuery":
        return self._with_value(self.diff.degree_changes(direction), "degree_change", op, value, "degree_change")

    def where_property_change(self, name: str, op: str, value: float) -> "DiffQuery":
        return self._with_value(self.diff.property_change(name, self.kind), "change", op, value, f"{name}_change")

    def where_ts_change(self, prop: str, agg: str, op: str, value: float) -> "DiffQuery":
        return self._with_value(self.diff.series_change(prop, agg, self.kind), "change", op, value, f"{prop}_{agg}_change")

    def order_by(self, column, descending: bool = False) -> "DiffQuery":
        c = F.col(column) if isinstance(column, str) else column
        return self._new(order=(c.desc() if descending else c.asc(),))

    def limit(self, n: int) -> "DiffQuery":
        return self._new(top=n)

    def execute(self) -> DataFrame:
        df = self.frame.orderBy(*self.order, "uid") if self.order else self.frame
        return df if self.top is None else df.limit(self.top)

    def count(self) -> int:
        return self.execute().count()

    def first(self) -> DataFrame:
        return self.limit(1).execute()

    def exists(self) -> bool:
        return not self.execute().isEmpty()

    def node_ids(self) -> DataFrame:
        return self.execute().select("uid")

    def as_subgraph(self, g: TemporalGraph) -> TemporalGraph:
        return g.subgraph(self.node_ids())

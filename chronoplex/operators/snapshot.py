"""Snapshots at a moment or over an interval, and sequences of them on a grid."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import TemporalGraph
from .scans import edges_among, with_label
from .series import catalogue, catalogue_with, series_aggregates
from .temporal import Grid, as_of_grid, is_valid_at, meets, overlapping, valid_at, within


@dataclass(frozen=True)
class Snapshot:
    """The elements of one snapshot; ``values`` holds resolved series, one row per owner and property."""

    nodes: DataFrame
    edges: DataFrame
    values: DataFrame | None = None
    graph: TemporalGraph | None = None
    at: object = None
    between: tuple | None = None
    samples: DataFrame | None = None

    @property
    def measurements(self) -> DataFrame:
        return self.samples if self.graph is None else self.graph.measurements

    def holds(self) -> Column:
        """Condition on a row of the graph's tables to be in this snapshot."""
        return is_valid_at(self.at) if self.between is None else meets(*self.between)

    def resolved(self, kind: str = "node") -> DataFrame:
        """Elements with their series values as a map next to the static properties."""
        df = self.nodes if kind == "node" else self.edges
        if self.values is None:
            raise ValueError("a snapshot of mode 'graph' has no series values")
        maps = (
            self.values.filter(F.col("owner_kind") == kind).groupBy(F.col("owner").alias("uid"))
            .agg(F.map_from_entries(F.collect_list(F.struct("property", "value"))).alias("values"))  # one per property
        )
        return df.join(maps, "uid", "left")

    def counts(self) -> DataFrame:
        n = self.nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.coalesce(F.sum(F.size("ts_ids")), F.lit(0)).alias("a"))
        e = self.edges.agg(F.count(F.lit(1)).alias("n_edges"), F.coalesce(F.sum(F.size("ts_ids")), F.lit(0)).alias("b"))
        return n.crossJoin(e).select("n_nodes", "n_edges", (F.col("a") + F.col("b")).alias("n_series"))  # one row each

    def with_labels(self, node_label: str) -> "Snapshot":
        """The subgraph of the nodes of a label."""
        nodes = with_label(self.nodes, node_label)
        edges = edges_among(self.edges, nodes)
        values = self.values
        if values is not None:
            kept = reduce(DataFrame.unionByName, (df.select(F.col("uid").alias("owner"), F.lit(kind).alias("owner_kind"))
                                                  for kind, df in (("node", nodes), ("edge", edges))))
            values = values.join(kept, ["owner", "owner_kind"], "left_semi").select(*values.columns)
        return Snapshot(nodes, edges, values, None, self.at, self.between, self.measurements)

    def density(self, label: str | None = None, directed: bool = True) -> DataFrame:
        from .metrics import density

        s = self if label is None else self.with_labels(label)
        return density(s.nodes, s.edges, directed)

    def documents(self, with_graph: bool = True) -> DataFrame:
        """Elements as JSON texts, or only the counts."""
        if not with_graph:
            return self.counts().select(F.lit("counts").alias("kind"), F.to_json(F.struct("*")).alias("document"))
        parts = [df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("document"))
                 for kind, df in (("node", self.nodes), ("edge", self.edges))]
        return parts[0].unionByName(parts[1])


def snapshot(g: TemporalGraph, at=None, between: tuple | None = None, mode: str = "hybrid",
             aggregate: str | None = None) -> Snapshot:
    """Elements valid at a moment, or meeting an interval.

    In hybrid mode the series are resolved: the last value at or before the moment; over an
    interval the named aggregate, or without one all samples inside (as rows with ``ts``).
    An edge stays even where an end node is not valid.
    """
    if (at is None) == (between is None):
        raise ValueError("give either a moment or an interval")
    if mode not in ("graph", "hybrid"):
        raise ValueError("mode is 'graph' or 'hybrid'")
    pick = (lambda df: valid_at(df, at)) if between is None else (lambda df: overlapping(df, *between))
    nodes, edges = pick(g.nodes), pick(g.edges)
    if mode == "graph":
        return Snapshot(nodes, edges, graph=g, at=at, between=between)
    owners = catalogue(nodes, edges)
    inside = within(g.measurements, end=at) if between is None else within(g.measurements, *between)
    if between is None:
        found = inside.groupBy("ts_id").agg(F.max_by("value", "ts").alias("value"))
    elif aggregate:
        found = series_aggregates(inside, ["ts_id"], [aggregate]).toDF("ts_id", "value")
    else:
        found = inside.select("ts_id", "ts", "value")
    return Snapshot(nodes, edges, owners.join(found, "ts_id", "left"), g, at, between)


@dataclass(frozen=True)
class SnapshotSequence:
    """All snapshots of a grid as one frame keyed by ``step``; the grid's end is exclusive."""

    graph: TemporalGraph
    grid: Grid
    mode: str = "graph"

    @property
    def steps(self) -> DataFrame:
        return self.grid.frame(self.graph.spark)

    def nodes(self, label: str | None = None) -> DataFrame:
        return self._timed(self.grid.expand(with_label(self.graph.nodes, label)))

    def edges(self, label: str | None = None) -> DataFrame:
        return self._timed(self.grid.expand(with_label(self.graph.edges, label)))

    def _timed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("snap_ts", self.grid.time(F.col("step")))

    def values(self) -> DataFrame:
        """Series values at every step: the last sample at or before it, for owners valid then."""
        owned = self.grid.expand(catalogue_with(self.graph, {c: F.col(c) for c in ("start_time", "end_time")}))
        return self._timed(owned.join(as_of_grid(self.graph.measurements, self.grid), ["ts_id", "step"], "left"))

    def window(self, start, end) -> "SnapshotSequence":
        """The snapshots of a closed time window."""
        inside = [i for i in (self._bound(start, up=True), self._bound(end, up=False))]
        return self._cut(max(0, inside[0]), min(self.grid.size - 1, inside[1]) + 1)

    def _bound(self, t, up: bool) -> int:
        from .temporal import micros

        offset = micros(t) - micros(self.grid.start)
        return -(-offset // self.grid.step) if up else offset // self.grid.step

    def _cut(self, first: int, stop: int) -> "SnapshotSequence":
        g = self.grid
        return SnapshotSequence(self.graph, Grid(g.start + first * g.every, g.start + max(first, stop) * g.every, g.every), self.mode)

    def slice(self, first: int, stop: int) -> "SnapshotSequence":
        start, end, _ = slice(first, stop).indices(self.grid.size)
        return self._cut(start, end)

    def head(self, n: int) -> "SnapshotSequence":
        return self._cut(0, min(n, self.grid.size))

    def tail(self, n: int) -> "SnapshotSequence":
        return self._cut(max(0, self.grid.size - n), self.grid.size)

    def __len__(self) -> int:
        return self.grid.size

    def __getitem__(self, i: int) -> Snapshot:
        if not -len(self) <= i < len(self):
            raise IndexError(i)
        return snapshot(self.graph, at=self.grid.start + (i % len(self)) * self.grid.every, mode=self.mode)

    def summary(self) -> DataFrame:
        """Nodes, edges and series per snapshot; steps without any keep a zero row."""
        n = self.grid.running_totals(self.graph.nodes, {"n_nodes": F.lit(1), "_a": F.size("ts_ids")})
        e = self.grid.running_totals(self.graph.edges, {"n_edges": F.lit(1), "_b": F.size("ts_ids")}).drop("snap_ts")
        return n.join(e, "step").select("step", "snap_ts", "n_nodes", "n_edges", (F.col("_a") + F.col("_b")).alias("n_series"))

    def averages(self) -> DataFrame:
        return self.summary().agg(
            F.count(F.lit(1)).alias("n_snapshots"), F.min("snap_ts").alias("first_ts"), F.max("snap_ts").alias("last_ts"),
            F.avg("n_nodes").alias("avg_nodes"), F.avg("n_edges").alias("avg_edges"), F.avg("n_series").alias("avg_series"))

    def tsgen(self):
        from .evolution import Evolution

        return Evolution(self)

"""The graph: three DataFrames, with every operator reachable from one object."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = ("uid STRING, label STRING, start_time TIMESTAMP, end_time TIMESTAMP, "
               "props MAP<STRING,STRING>, ts_ids MAP<STRING,STRING>")
EDGE_SCHEMA = ("uid STRING, src STRING, dst STRING, label STRING, start_time TIMESTAMP, end_time TIMESTAMP, "
               "props MAP<STRING,STRING>, ts_ids MAP<STRING,STRING>")
MEASUREMENT_SCHEMA = "ts_id STRING, variable STRING, ts TIMESTAMP, value DOUBLE"

#: Longest id and label.
MAX_ID, MAX_LABEL = 255, 100


@dataclass(frozen=True)
class TemporalGraph:
    """Nodes and edges with validity, properties and series references, plus the samples of all series.

    A node or edge that *is* a series has no properties and one entry in ``ts_ids``. ``named_series`` says that the samples of
    series property p carry p as their variable, so that scans of one property can skip all others.
    """

    nodes: DataFrame
    edges: DataFrame
    measurements: DataFrame
    named_series: bool = False

    @property
    def spark(self):
        return self.nodes.sparkSession

    def with_(self, **tables) -> "TemporalGraph":
        """Replace tables; new elements may refer to any series, so ``named_series`` then has to be said anew."""
        if tables.keys() & {"nodes", "edges"}:
            tables.setdefault("named_series", False)
        return replace(self, **tables)

    def elements(self, kind: str) -> DataFrame:
        if kind not in ("node", "edge"):
            raise ValueError("kind is 'node' or 'edge'")
        return self.nodes if kind == "node" else self.edges

    def samples_of(self, *properties: str) -> DataFrame:
        """The measurements that can belong to these series properties."""
        return self.measurements.filter(F.col("variable").isin(*properties)) if self.named_series and properties else self.measurements

    def add_property_columns(self, nodes: dict[str, str] | None = None, edges: dict[str, str] | None = None):
        from .functions.values import promote

        return self.with_(nodes=promote(self.nodes, nodes or {}), edges=promote(self.edges, edges or {}))

    # entry points of the operators -------------------------------------------------------------
    def query(self):
        from .operators.query import QueryStart

        return QueryStart(self)

    def match(self):
        from .operators.pattern import PatternQuery

        return PatternQuery(self)

    def snapshot(self, at=None, between=None, mode: str = "hybrid", **options):
        from .operators.snapshot import snapshot

        return snapshot(self, at=at, between=between, mode=mode, **options)

    def snapshot_sequence(self, start, end, every, mode: str = "graph"):
        from .operators.snapshot import SnapshotSequence
        from .operators.temporal import Grid, granularity

        every = granularity(every) if isinstance(every, str) else every
        return SnapshotSequence(self, Grid(start, end, every), mode=mode)

    def diff(self, first, second):
        from .operators.diff import SnapshotDiff

        return SnapshotDiff(self.snapshot(at=first), self.snapshot(at=second))

    def interval_diff(self, first, second):
        from .operators.interval_diff import IntervalDiff

        return IntervalDiff(self, first, second)

    def predicate_induced(self, label: str, predicate: str, start, end, **options):
        from .operators.induced import InducedGraph

        return InducedGraph(self, label, predicate, start, end, **options)

    def subgraph(self, node_ids: DataFrame):
        from .operators.subgraph import subgraph

        return subgraph(self, node_ids)


def validate(df: DataFrame, is_edge: bool = False) -> tuple[DataFrame, DataFrame]:
    """Split rows into valid ones and rejects, which carry a ``reason``."""
    checks = [
        (F.col("uid").isNull() | (F.length("uid") == 0), "missing id"),
        (F.length("uid") > MAX_ID, "id too long"),
        (F.length("label") > MAX_LABEL, "label too long"),
        (F.col("start_time") >= F.col("end_time"), "start is not before end"),
    ]
    if is_edge:
        checks.append((F.col("src").isNull() | F.col("dst").isNull(), "missing source or target"))
    reason = F.lit(None).cast("string")
    for test, text in reversed(checks):
        reason = F.when(test, text).otherwise(reason)
    checked = df.withColumn("reason", reason)
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(F.col("reason").isNotNull())

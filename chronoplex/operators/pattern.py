"""Graph patterns as chains of equi-joins, with conditions across elements and across series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import compare_values, guarded_corr, property_column
from ..model import TemporalGraph
from .query import ElementQuery, QueryStart
from .series import aligned_pairs
from .subgraph import subgraph


class PatternQuery:
    """``match().node("a", "User").edge("a", "e", "b", "Peer").run()`` gives one uid column per variable."""

    def __init__(self, graph: TemporalGraph):
        self.graph = graph
        self._nodes: dict[str, ElementQuery] = {}
        self._edges: list[tuple[str, str, str, ElementQuery, str]] = []
        self._cross: list[tuple] = []
        self._series: list[tuple] = []
        self._top: int | None = None

    # building ------------------------------------------------------------------------------------
    def node(self, var: str, what: ElementQuery | str | None = None, uid: str | None = None,
             uid_in: DataFrame | None = None) -> "PatternQuery":
        """A variable with its candidates: a label, or any node query."""
        q = what if isinstance(what, ElementQuery) else QueryStart(self.graph).nodes(what)
        if uid is not None:
            q = q.where(F.col("uid") == uid)
        self._nodes[var] = q if uid_in is None else q.uid_in(uid_in)
        return self

    def from_diff(self, var: str, diff_query, label: str | None = None) -> "PatternQuery":
        return self.node(var, label, uid_in=diff_query.node_ids())

    def edge(self, source: str, var: str, target: str, what: ElementQuery | str | None = None,
             direction: str = "out") -> "PatternQuery":
        if direction not in ("out", "in", "both"):
            raise ValueError("direction is 'out', 'in' or 'both'")
        q = what if isinstance(what, ElementQuery) else QueryStart(self.graph).edges(what)
        self._edges.append((source, var, target, q, direction))
        return self

    def where_cross(self, left: str, op: str, right) -> "PatternQuery":
        """``"a.x"`` or ``"a.x:max"`` against another such text or a constant.

        Without an aggregate the static property counts, and where it is missing the series mean.
        """
        self._cross.append((left, op, right))
        return self

    def where_series(self, left: str, relation: str, right: str, threshold: float = 0.7, lag: int = 1) -> "PatternQuery":
        if relation not in SERIES_RELATIONS:
            raise ValueError(f"unknown relation {relation!r}")
        self._series.append((left, relation, right, threshold, lag))
        return self

    def limit(self, n: int) -> "PatternQuery":
        self._top = n
        return self

    # running -------------------------------------------------------------------------------------
    def _candidates(self, var: str, q: ElementQuery, is_edge: bool) -> DataFrame:
        """Matching elements of a variable with just the columns that later conditions read."""
        df = q.execute()
        keep = ["uid", "src", "dst"] if is_edge else ["uid"]
        columns = {}
        for operand in self._operands():
            owner, prop, agg = _parse(operand)
            if owner != var:
                continue
            stats = q._with(frame=df, tests=(), extra=())
            series = lambda name: stats._series(prop, [name]).toDF("uid", "_agg")
            if agg:
                df = df.join(series(agg), "uid", "left").withColumnRenamed("_agg", operand)
            else:
                df = df.withColumn(operand, property_column(df, prop).cast("string"))
                without = stats._with(frame=df.filter(F.col(f"`{operand}`").isNull()))
                mean = without._series(prop, ["mean"]).toDF("uid", "_agg")
                df = df.join(mean, "uid", "left").withColumn(operand, F.coalesce(f"`{operand}`", F.col("_agg").cast("string"))).drop("_agg")
            columns[operand] = operand
        for left, _, right, _, _ in self._series:
            for operand in (left, right):
                owner, prop, _ = _parse(operand)
                if owner == var:
                    df = df.withColumn(f"{operand}#", F.col("ts_ids").getItem(prop))
                    columns[f"{operand}#"] = f"{operand}#"
        return df.select(*keep, *[f"`{c}`" for c in columns]).withColumnRenamed("uid", var)

    def _operands(self) -> list[str]:
        texts = [t for left, _, right in self._cross for t in (left, right) if isinstance(t, str) and _is_operand(t)]
        return list(dict.fromkeys(texts))

    def run(self) -> DataFrame:
        if not self._edges:
            raise ValueError("a pattern without edges is read with node_sets()")
        ends = {v for e in self._edges for v in (e[0], e[2])}
        nodes = {v: self._candidates(v, self._nodes.get(v) or QueryStart(self.graph).nodes(), False) for v in ends}
        bound: set[str] = set()
        rows: DataFrame | None = None
        pending = list(self._edges)
        while pending:
            ready = next((e for e in pending if rows is None or {e[0], e[2]} & bound), None)
            if ready is None:
                raise ValueError("the pattern is not connected")
            pending.remove(ready)
            source, var, target, q, direction = ready
            edges = self._directed(self._candidates(var, q, True), source, target, direction)
            ends = list(dict.fromkeys([source, target]))
            if rows is None:
                rows = edges
            else:
                rows = rows.join(edges, [v for v in ends if v in bound])
            for v in ends:
                if v not in bound:
                    rows = rows.join(nodes[v], v)
            bound |= set(ends)
        rows = self._apply_cross(rows)
        rows = self._apply_series(rows)
        variables = list(dict.fromkeys([v for e in self._edges for v in (e[0], e[1], e[2])]))
        rows = rows.select(*variables)
        return rows if self._top is None else rows.limit(self._top)

    @staticmethod
    def _directed(edges: DataFrame, source: str, target: str, direction: str) -> DataFrame:
        forward = F.struct(F.col("src").alias("s"), F.col("dst").alias("t"))
        backward = F.struct(F.col("dst").alias("s"), F.col("src").alias("t"))
        ends = {"out": F.array(forward), "in": F.array(backward),
                "both": F.array_distinct(F.array(forward, backward))}[direction]
        placed = edges.withColumn("_e", F.explode(ends))
        if source == target:
            return placed.filter("_e.s = _e.t").withColumn(source, F.col("_e.s")).drop("_e", "src", "dst")
        return placed.withColumns({source: F.col("_e.s"), target: F.col("_e.t")}).drop("_e", "src", "dst")

    def _apply_cross(self, rows: DataFrame) -> DataFrame:
        for left, op, right in self._cross:
            other = F.col(f"`{right}`") if isinstance(right, str) and _is_operand(right) else F.lit(right)
            rows = rows.filter(compare_values(F.col(f"`{left}`"), op, other))
        return rows

    def _apply_series(self, rows: DataFrame) -> DataFrame:
        for left, relation, right, threshold, lag in self._series:
            l, r = f"`{left}#`", f"`{right}#`"
            pairs = rows.select(F.col(l).alias("left_ts"), F.col(r).alias("right_ts")).dropna().distinct()
            kept = related_series(self.graph.measurements, pairs, relation, threshold, lag)
            kept = kept.select(F.col("left_ts").alias(f"{left}#"), F.col("right_ts").alias(f"{right}#"))
            rows = rows.join(kept, [f"{left}#", f"{right}#"], "left_semi")
        return rows

    def node_sets(self) -> DataFrame:
        """A pattern of nodes alone: each variable is a row set of its own (``variable, uid``)."""
        sets = [q.execute().select(F.lit(v).alias("variable"), "uid") for v, q in self._nodes.items()]
        return reduce(lambda a, b: a.unionByName(b), sets)

    def count(self) -> int:
        return self.run().count()

    def as_subgraph(self) -> TemporalGraph:
        return subgraph(self.graph, self.matched_ids().filter("kind = 'node'"))

    def matched_ids(self) -> DataFrame:
        """Distinct ids of all matched nodes and edges."""
        rows = self.run()
        edge_vars = {e[1] for e in self._edges}
        items = F.array(*[F.struct(F.lit("edge" if v in edge_vars else "node").alias("kind"), F.col(v).alias("uid")) for v in rows.columns])
        return rows.select(F.explode(items).alias("i")).select("i.kind", "i.uid").distinct()

    def describe(self) -> str:
        arrow = {"out": ("-", "->"), "in": ("<-", "-"), "both": ("-", "-")}
        return ", ".join(f"({s}){arrow[d][0]}[{v}]{arrow[d][1]}({t})" for s, v, t, _, d in self._edges) or ", ".join(f"({v})" for v in self._nodes)


def _is_operand(text: str) -> bool:
    head, dot, tail = text.partition(".")
    return bool(dot) and head.isidentifier() and tail.split(":")[0].isidentifier()


def _parse(operand: str) -> tuple[str, str, str | None]:
    var, _, rest = operand.partition(".")
    prop, _, agg = rest.partition(":")
    return var, prop, agg or None


#: Relations between two series.
SERIES_RELATIONS = ("correlates", "anti_correlates", "diverges_from", "similar_to", "leads", "lags",
                    "more_volatile", "more_stable", "contains_pattern_from")


def related_series(m: DataFrame, pairs: DataFrame, relation: str, threshold: float = 0.7, lag: int = 1) -> DataFrame:
    """Pairs ``left_ts, right_ts`` whose series stand in a relation over their common length."""
    if relation == "contains_pattern_from":
        from .subsequence import pairs_with_pattern

        return pairs_with_pattern(m, pairs, threshold)
    if relation in ("leads", "lags") and lag <= 0:
        return pairs.limit(0)
    ids = pairs.select(F.explode(F.array("left_ts", "right_ts")).alias("ts_id")).distinct()
    shift = {"leads": lag, "lags": -lag}.get(relation, 0)
    both = aligned_pairs(m.join(ids, "ts_id", "left_semi"), pairs, shift).groupBy("left_ts", "right_ts")
    x, y = F.col("x"), F.col("y")
    stats = both.agg(
        F.count(F.lit(1)).alias("n"), guarded_corr(x, y).alias("r"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
        F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"))
    n, r, mx, my, sx, sy = (F.col(c) for c in ("n", "r", "mx", "my", "sx", "sy"))
    gap = lambda a, b: F.when(b != 0, F.abs(a - b) / F.abs(b)).otherwise(F.abs(a))
    test = {
        "correlates": r >= threshold, "leads": r >= threshold, "lags": r >= threshold,
        "anti_correlates": r <= -threshold, "diverges_from": F.abs(F.coalesce(r, F.lit(0.0))) < threshold,
        "similar_to": (gap(mx, my) <= threshold) & (gap(sx, sy) <= threshold),
        "more_volatile": sx > sy, "more_stable": sx < sy,
    }[relation]
    return stats.filter((n >= 2) & test).select("left_ts", "right_ts")

"""Two induced graphs, or two periods of one, compared: who came, who went, how the signals of the rest changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import compare_numbers
from ..model import TemporalGraph
from ..plans.lineage import cut
from ..plans.positions import with_position
from .induced import InducedGraph
from .interval_diff import in_periods
from .propagation import Propagation
from .series import slope_column
from .subgraph import subgraph
from .temporal import within

ADDED, REMOVED, PERSISTED = "ADDED", "REMOVED", "PERSISTED"
DESCRIPTORS = ("delta_mu", "sigma_ratio", "delta_slope", "nrmse")


def frequent_members(induced: InducedGraph, period: tuple, min_frequency: float = 0.0) -> DataFrame:
    """Members in at least a share of the evaluated steps of a period ``[start, end)``; 0 means ever."""
    grid = induced.grid
    rows = within(induced.membership().withColumn("snap_ts", grid.time(F.col("step"))), *period, column="snap_ts", closed_end=False)
    if min_frequency <= 0:
        return rows.select("uid").distinct()
    steps = within(induced.steps(), *period, column="snap_ts", closed_end=False).agg(F.count(F.lit(1)).alias("n_steps"))  # one row
    counts = rows.groupBy("uid").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(steps)).filter(F.col("n") >= min_frequency * F.col("n_steps")).select("uid")


def signal_descriptors(samples: DataFrame, key: str = "uid") -> DataFrame:
    """Level shift, spread ratio, slope change and normalised error between period 1 and 2.

    ``samples`` has ``key, period, ts, value``. Values of equal position meet in one row, so all
    four come from a single aggregate; under two samples on a side they are (0, 1, 0, 0).
    """
    rows = with_position(samples, [key, "period"], "ts")
    pick = lambda k: F.max(F.when(F.col("period") == k, F.col("value")))
    wide = rows.groupBy(key, "idx").agg(pick(1).alias("a"), pick(2).alias("b"))
    a, b, idx = F.col("a"), F.col("b"), F.col("idx")
    both = a.isNotNull() & b.isNotNull()
    s = wide.groupBy(key).agg(
        F.count(a).alias("n_1"), F.count(b).alias("n_2"), (F.avg(b) - F.avg(a)).alias("_mu"),
        F.stddev_pop(a).alias("_s1"), F.stddev_pop(b).alias("_s2"),
        (slope_column(b, F.when(b.isNotNull(), idx)) - slope_column(a, F.when(a.isNotNull(), idx))).alias("_slope"),
        F.sqrt(F.avg(F.when(both, F.pow(a - b, 2)))).alias("_rmse"), F.stddev_pop(F.when(both, a)).alias("_s1_common"))
    enough = (F.col("n_1") >= 2) & (F.col("n_2") >= 2)
    safe = lambda x, y, empty: F.when(F.col(y) > 1e-9, F.try_divide(F.col(x), F.col(y))).otherwise(empty)
    return s.select(
        key, "n_1", "n_2", F.when(enough, F.col("_mu")).otherwise(0.0).alias("delta_mu"),
        F.when(enough, safe("_s2", "_s1", 1.0)).otherwise(1.0).alias("sigma_ratio"),
        F.when(enough, F.col("_slope")).otherwise(0.0).alias("delta_slope"),
        F.when(enough, safe("_rmse", "_s1_common", 0.0)).otherwise(0.0).alias("nrmse"))


class InducedDiff:
    """Period 1 of one induced graph against period 2 of another (or of the same)."""

    def __init__(self, first: InducedGraph, second: InducedGraph, period_1: tuple | None = None,
                 period_2: tuple | None = None, min_frequency: float = 0.0, series: str | None = None,
                 max_delay_days: float | None = None):
        self.first, self.second = first, second
        self.period_1 = period_1 or (first.grid.start, first.grid.end)
        self.period_2 = period_2 or (second.grid.start, second.grid.end)
        self.min_frequency = min_frequency
        self.series = series or first.predicate.series[0]
        self.max_delay_days = max_delay_days
        self._memo: dict[str, DataFrame] = {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._memo:
            self._memo[name] = cut(make())
        return self._memo[name]

    @classmethod
    def between(cls, graph: TemporalGraph, label: str, predicate: str, period_1: tuple, period_2: tuple, **options) -> "InducedDiff":
        """Predicate and two ranges in one call; hour filter and step apply to both."""
        own = {k: options.pop(k) for k in ("min_frequency", "series", "max_delay_days") if k in options}
        one = InducedGraph(graph, label, predicate, *period_1, **options)
        two = InducedGraph(graph, label, predicate, *period_2, **options)
        return cls(one, two, period_1, period_2, **own)

    @classmethod
    def sliced(cls, induced: InducedGraph, period_1: tuple, period_2: tuple, **options) -> "InducedDiff":
        return cls(induced, induced, period_1, period_2, **options)

    def structure(self) -> DataFrame:
        """``uid, delta_struct`` for every node in either period."""
        def make():
            one = frequent_members(self.first, self.period_1, self.min_frequency).withColumn("_1", F.lit(True))
            two = frequent_members(self.second, self.period_2, self.min_frequency).withColumn("_2", F.lit(True))
            kind = F.when(F.col("_1").isNull(), ADDED).when(F.col("_2").isNull(), REMOVED).otherwise(PERSISTED)
            return one.join(two, "uid", "full_outer").select("uid", kind.alias("delta_struct"))
        return self._once("structure", make)

    def added_times(self) -> DataFrame:
        """First step in the closed period 2 at which an added node is a member."""
        grid = self.second.grid
        rows = within(self.second.membership().withColumn("snap_ts", grid.time(F.col("step"))), *self.period_2, column="snap_ts")
        first = rows.groupBy("uid").agg(F.min("snap_ts").alias("transition_ts"))
        return self.structure().filter(F.col("delta_struct") == ADDED).select("uid").join(first, "uid", "left")

    def descriptors(self) -> DataFrame:
        """Signal descriptors of persisted nodes; zeros are dropped, a node without the series too."""
        owners = (self.structure().filter(F.col("delta_struct") == PERSISTED).join(self.first.nodes(), "uid")
                  .select("uid", F.col("ts_ids").getItem(self.series).alias("ts_id")).filter(F.col("ts_id").isNotNull()))
        samples = in_periods(self.first.graph.measurements, self.period_1, self.period_2, closed_end=False)
        if self.first.zero_is_missing:
            samples = samples.filter(F.col("value") != 0)
        found = signal_descriptors(samples.join(owners, "ts_id").select("uid", "period", "ts", "value"))
        empty = {"n_1": 0, "n_2": 0, "delta_mu": 0.0, "sigma_ratio": 1.0, "delta_slope": 0.0, "nrmse": 0.0}
        return owners.select("uid").join(found, "uid", "left").fillna(empty)

    def nodes(self) -> DataFrame:
        """All compared nodes with label, change, descriptors and transition time."""
        def make():
            s = self.structure()
            persisted = s.filter(F.col("delta_struct") == PERSISTED).join(self.descriptors(), "uid")
            other = s.filter(F.col("delta_struct") != PERSISTED).join(self.added_times(), "uid", "left")
            return (persisted.unionByName(other, allowMissingColumns=True).withColumn("label", F.lit(self.first.label)))
        return self._once("nodes", make)

    def edges(self) -> DataFrame:
        """Edges among the compared nodes."""
        return subgraph(self.first.graph, self.structure()).edges

    def propagation(self) -> Propagation:
        return Propagation(self.added_times().dropna(), self.second.adjacency(), self.max_delay_days)

    def summary(self) -> DataFrame:
        """One row: counts, Jaccard, size and homogeneity of the signal change, shape of the propagation."""
        n = self.nodes()
        s = self.structure().agg(*[F.count_if(F.col("delta_struct") == k).alias(k.lower()) for k in (ADDED, REMOVED, PERSISTED)])
        total = F.col("added") + F.col("removed") + F.col("persisted")
        s = s.withColumn("jaccard_nodes", F.when(total == 0, F.lit(1.0)).otherwise(F.try_divide(F.col("persisted").cast("double"), total)))
        d = n.agg(*[F.coalesce(f, F.lit(0.0)).alias(c) for c, f in (
            ("avg_nrmse", F.avg("nrmse")), ("max_nrmse", F.max("nrmse")), ("change_homogeneity", F.var_pop("nrmse")))])
        return s.crossJoin(d).crossJoin(self.propagation().summary())  # one row each

    def query(self) -> "InducedDiffQuery":
        return InducedDiffQuery(self, self.nodes())

    def annotated(self) -> TemporalGraph:
        """The compared nodes as a graph again: the descriptors become node properties."""
        g = subgraph(self.first.graph, self.nodes())
        fields = ["delta_struct", *DESCRIPTORS, "transition_ts"]
        notes = F.map_filter(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))]), lambda k, v: v.isNotNull())
        marked = self.nodes().select("uid", notes.alias("_notes"))
        nodes = g.nodes.join(marked, "uid")
        merged = F.map_concat(F.map_filter("props", lambda k, v: ~k.isin(fields)), F.col("_notes"))
        return g.with_(nodes=nodes.withColumn("props", merged).drop("_notes"))


class InducedDiffQuery:
    def __init__(self, diff: InducedDiff, frame: DataFrame, order: tuple = (), top: int | None = None):
        self.diff, self.frame, self.order, self.top = diff, frame, order, top

    def _new(self, frame=None, order=None, top=None):
        return InducedDiffQuery(self.diff, self.frame if frame is None else frame, self.order if order is None else order,
                                self.top if top is None else top)

    def edges(self) -> "InducedDiffQuery":
        return self._new(self.diff.edges())

    def label(self, label: str):
        return self._new(self.frame.filter(F.col("label") == label))

    def where_struct(self, kind: str):
        return self._new(self.frame.filter(F.col("delta_struct") == kind))

    def added(self):
        return self.where_struct(ADDED)

    def removed(self):
        return self.where_struct(REMOVED)

    def persisted(self):
        return self.where_struct(PERSISTED)

    def where(self, condition: Column):
        return self._new(self.frame.filter(F.coalesce(condition, F.lit(False))))

    def where_descriptor(self, name: str, op: str, value: float):
        return self._new(self.frame.filter(compare_numbers(F.col(name), op, value)))

    def where_nrmse(self, op: str, value: float):
        return self.where_descriptor("nrmse", op, value)

    def where_delta_mu(self, op: str, value: float):
        return self.where_descriptor("delta_mu", op, value)

    def where_sigma_ratio(self, op: str, value: float):
        return self.where_descriptor("sigma_ratio", op, value)

    def order_by(self, column: str, descending: bool = False):
        c = F.col(column)
        return self._new(order=(c.desc() if descending else c.asc(),))

    def limit(self, n: int):
        return self._new(top=n)

    def execute(self) -> DataFrame:
        df = self.frame.orderBy(*self.order, "uid") if self.order else self.frame
        return df if self.top is None else df.limit(self.top)

    def count(self) -> int:
        return self.execute().count()

    def first(self) -> DataFrame:
        return self.limit(1).execute()

    def node_ids(self) -> DataFrame:
        return self.execute().select("uid")


def compare_signals(signals_1: DataFrame, signals_2: DataFrame) -> DataFrame:
    """Descriptors of graph-level signals by metric; under two samples on a side they are NULL."""
    side = lambda df, k: df.select("metric", F.lit(k).alias("period"), F.col("snap_ts").alias("ts"), F.col("value").cast("double").alias("value"))
    d = signal_descriptors(side(signals_1, 1).unionByName(side(signals_2, 2)), "metric")
    enough = (F.col("n_1") >= 2) & (F.col("n_2") >= 2)
    return d.withColumns({c: F.when(enough, F.col(c)) for c in DESCRIPTORS})

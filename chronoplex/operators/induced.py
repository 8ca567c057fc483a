"""Subgraphs induced by a predicate on series: membership over time, components and their life cycle."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import TemporalGraph
from ..plans.fixpoint import weak_components
from ..plans.lineage import cut
from .scans import edges_among, with_label
from .temporal import Grid, time_column, within

#: Fixed value: components match when their Jaccard similarity is strictly above this.
MATCH_ABOVE = 0.3

_WORD = re.compile(r"(?<![\w.])(?!nullif\b)[A-Za-z_]\w*")
_ALLOWED = re.compile(r"[\w\s.+\-*/()<>=!]+")
_TERM = re.compile(r"(.+?)(<=|>=|==|!=|<|>|=)(.+)")


def _null_on_zero(text: str) -> str:
    """Wrap each divisor, so that dividing by zero gives NULL instead of failing the job."""
    head, slash, tail = text.partition("/")
    if not slash:
        return text
    tail = tail.lstrip()
    if tail.startswith("("):
        depth, stop = 0, 0
        for stop, char in enumerate(tail):
            depth += (char == "(") - (char == ")")
            if depth == 0:
                break
        stop += 1
        divisor = f"({_null_on_zero(tail[1:stop - 1])})"
    else:
        stop = re.match(r"[\w.]*", tail).end()
        divisor = tail[:stop]
    return f"{head}/ nullif({divisor}, 0){_null_on_zero(tail[stop:])}"


@dataclass(frozen=True)
class Term:
    """``expression comparison number``; the first name is the series, others are static properties."""

    expression: str
    op: str
    limit: float

    @classmethod
    def of(cls, text: str) -> "Term":
        found = _TERM.fullmatch(text.strip())
        if not found or not _ALLOWED.fullmatch(text):
            raise ValueError(f"cannot read the predicate {text!r}")
        left, op, right = (g.strip() for g in found.groups())
        if not _WORD.search(left):
            raise ValueError(f"no series in the predicate {text!r}")
        return cls(left, "=" if op == "==" else op, float(right))

    @property
    def series(self) -> str:
        return _WORD.search(self.expression).group()

    @property
    def statics(self) -> list[str]:
        return [w for w in dict.fromkeys(_WORD.findall(self.expression)) if w != self.series]

    def value(self) -> Column:
        """The expression over columns of the same names; a division by zero is NULL."""
        return F.expr(_WORD.sub(lambda w: f"`{w.group()}`", _null_on_zero(self.expression))).cast("double")

    def test(self, limit=None) -> Column:
        x, y = self.value(), F.lit(self.limit) if limit is None else limit
        result = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y, "=": x == y, "!=": x != y}[self.op]
        return F.coalesce(result, F.lit(False))


@dataclass(frozen=True)
class Predicate:
    """Terms joined by AND / OR, taken strictly from left to right; a term with a missing value is false."""

    terms: tuple[Term, ...]
    joiners: tuple[str, ...]

    @classmethod
    def of(cls, text: str) -> "Predicate":
        parts = re.split(r"\s+(AND|OR)\s+", text, flags=re.IGNORECASE)
        return cls(tuple(Term.of(p) for p in parts[::2]), tuple(j.upper() for j in parts[1::2]))

    @property
    def series(self) -> list[str]:
        return list(dict.fromkeys(t.series for t in self.terms))

    @property
    def statics(self) -> list[str]:
        names = [s for t in self.terms for s in t.statics]
        return [n for n in dict.fromkeys(names) if n not in self.series]

    def test(self) -> Column:
        result = self.terms[0].test()
        for joiner, term in zip(self.joiners, self.terms[1:]):
            result = (result & term.test()) if joiner == "AND" else (result | term.test())
        return result


class InducedGraph:
    """Membership of the nodes of a label at every step of a grid with an inclusive end.

    ``hours`` keeps steps whose hour lies in a closed range; each stretch of consecutive steps is a
    run of its own, in which membership and components start anew. A sample counts only at its
    exact step, unless ``nearest_tolerance`` lets the nearest sample within that distance stand in.
    """

    def __init__(self, graph: TemporalGraph, label: str, predicate: str | Predicate, start, end,
                 every: dt.timedelta | None = None, step_minutes: float = 60, hours: tuple[int, int] | None = None,
                 zero_is_missing: bool = True, nearest_tolerance: dt.timedelta | None = None):
        self.graph, self.label = graph, label
        self.predicate = predicate if isinstance(predicate, Predicate) else Predicate.of(predicate)
        self.grid = Grid(start, end, every or dt.timedelta(minutes=step_minutes), closed_end=True)
        self.hours, self.zero_is_missing, self.nearest_tolerance = hours, zero_is_missing, nearest_tolerance
        self._memo: dict[str, DataFrame] = {}

    def _once(self, name: str, make) -> DataFrame:
        """Results that several operators start from are written once."""
        if name not in self._memo:
            self._memo[name] = cut(make())
        return self._memo[name]

    # steps ---------------------------------------------------------------------------------------
    def _hour_filter(self, df: DataFrame, ts: str) -> DataFrame:
        if self.hours is None:
            return df
        return df.filter(F.hour(ts).between(*self.hours))

    def steps(self) -> DataFrame:
        """Evaluated steps with their run: ``step, snap_ts, run, run_last``. Its size is that of the grid."""
        df = self._hour_filter(self.grid.frame(self.graph.spark), "snap_ts")
        in_order = Window.partitionBy(F.lit(0)).orderBy("step")
        fresh = F.coalesce(F.col("step") - F.lag("step").over(in_order) > 1, F.lit(False)).cast("int")
        return (df.withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(in_order))
                .withColumn("run_last", F.max("step").over(Window.partitionBy("run"))).drop("_fresh"))

    # membership ----------------------------------------------------------------------------------
    def nodes(self) -> DataFrame:
        return with_label(self.graph.nodes, self.label)

    def readings(self) -> DataFrame:
        """``uid, step`` with one column per series and static property that the predicate reads."""
        names, statics = self.predicate.series, self.predicate.statics
        fixed = [F.col("props").getItem(s).try_cast("double").alias(s) for s in statics]
        owners = self.nodes().select("uid", F.explode("ts_ids").alias("property", "ts_id"), *fixed).filter(F.col("property").isin(names))
        samples = within(self.graph.samples_of(*names), *self._reach())
        if self.zero_is_missing:
            samples = samples.filter(F.col("value") != 0)
        offset = F.unix_micros("ts") - F.unix_micros(time_column(self.grid.start))
        if self.nearest_tolerance is None:
            placed = samples.filter(self.grid.on_grid(F.col("ts"))).withColumn("step", (offset / self.grid.step).cast("long"))
        else:
            tol = self.nearest_tolerance // dt.timedelta(microseconds=1)
            low = F.greatest(F.lit(0), F.ceil((offset - tol) / self.grid.step))
            high = F.least(F.lit(self.grid.size - 1), F.floor((offset + tol) / self.grid.step))
            near = (samples.withColumns({"_lo": low.cast("long"), "_hi": high.cast("long"), "_off": offset}).filter("_lo <= _hi")
                    .withColumn("step", F.explode(F.sequence("_lo", "_hi"))))
            gap = F.abs(F.col("_off") - F.col("step") * self.grid.step)
            placed = near.groupBy("ts_id", "step").agg(F.min_by("value", F.struct(gap, F.col("ts"))).alias("value"))
        placed = self._hour_filter(placed.withColumn("snap_ts", self.grid.time(F.col("step"))), "snap_ts")
        joined = placed.select("ts_id", "step", "value").join(owners, "ts_id")
        if len(names) == 1:
            return joined.select("uid", "step", F.col("value").alias(names[0]), *statics)
        columns = [F.max(F.when(F.col("property") == n, F.col("value"))).alias(n) for n in names]
        return joined.groupBy("uid", "step").agg(*columns, *[F.first(s).alias(s) for s in statics])

    def _reach(self):
        tol = self.nearest_tolerance or dt.timedelta(0)
        return self.grid.start - tol, self.grid.end + tol

    def membership(self) -> DataFrame:
        """``uid, step``: the members at every evaluated step."""
        return self._once("membership", lambda: self.readings().filter(self.predicate.test()).select("uid", "step"))

    def membership_changes(self) -> DataFrame:
        """``run, step, snap_ts, uid, change``: who enters and who leaves at a step."""
        rows = self.membership().join(self.steps().select("step", "run", "run_last"), "step")
        in_run = Window.partitionBy("uid", "run").orderBy("step")  # at most one row per step
        here = F.col("step")
        enters = F.coalesce(F.lag("step").over(in_run) < here - 1, F.lit(True))
        leaves = F.coalesce(F.lead("step").over(in_run) > here + 1, F.lit(True)) & (here < F.col("run_last"))
        marks = F.filter(F.array(
            F.when(F.col("_enters"), F.struct(here.alias("step"), F.lit("enter").alias("change"))),
            F.when(F.col("_leaves"), F.struct((here + 1).alias("step"), F.lit("exit").alias("change"))),
        ), lambda x: x.isNotNull())
        marked = rows.withColumns({"_enters": enters, "_leaves": leaves}).withColumn("m", F.explode(marks))
        return marked.select("run", "m.step", self.grid.time(F.col("m.step")).alias("snap_ts"), "uid", "m.change")

    def change_steps(self) -> DataFrame:
        """``run, step, k``: steps at which membership changed, and the first one of all; numbered per run."""
        def make():
            changed = self.membership_changes().select("run", "step").distinct()
            first = self.steps().orderBy("step").limit(1).select(F.col("run").cast("long").alias("run"), "step")
            rank = F.row_number().over(Window.partitionBy("run").orderBy("step"))  # at most one row per step
            return changed.unionByName(first).distinct().withColumn("k", rank)
        return self._once("change_steps", make)

    def first_entry(self) -> DataFrame:
        return self.membership().groupBy("uid").agg(F.min("step").alias("step")).select(
            "uid", self.grid.time(F.col("step")).alias("first_ts"))

    def members_at_changes(self) -> DataFrame:
        return self.membership().join(self.change_steps().select("run", "step", "k"), "step")

    # structure -----------------------------------------------------------------------------------
    def adjacency(self) -> DataFrame:
        return edges_among(self.graph.edges, self.nodes()).select(F.col("uid").alias("edge"), "src", "dst")

    def _edges_for(self, members: DataFrame) -> DataFrame:
        ends = members.select("uid", "step")
        busy = members.groupBy("step").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("step")
        return (self.adjacency().join(ends.withColumnRenamed("uid", "src"), "src")
                .join(ends.withColumnRenamed("uid", "dst"), ["dst", "step"]).join(busy, "step", "left_semi"))

    def edges(self) -> DataFrame:
        """Edges between members at each change step: ``edge, src, dst, step``; parallel edges stay."""
        return self._once("edges", lambda: self._edges_for(self.members_at_changes()).select("edge", "src", "dst", "step"))

    def components(self) -> DataFrame:
        """``run, k, step, uid, comp`` at every change step."""
        def make():
            comps = weak_components(self.members_at_changes().select("step", "uid"), self.edges(), ["step"], edges_inside=True)
            return comps.join(self.change_steps(), "step").select("run", "k", "step", "uid", "comp")
        return self._once("components", make)

    # life cycle ----------------------------------------------------------------------------------
    def _component_table(self) -> DataFrame:
        """Every component with its size, number of links from the change before, and its lasting id."""
        def make():
            comps = self.components()
            sizes = comps.groupBy("run", "k", "step", "comp").agg(F.count(F.lit(1)).alias("size"))
            links = self.component_links()
            into = links.groupBy("run", "k", "comp").agg(F.count(F.lit(1)).alias("n_in"), F.min("parent").alias("only_parent"),
                                                          F.min("parent_out").alias("parent_out"), F.min("parent_size").alias("parent_size"))
            table = sizes.join(into, ["run", "k", "comp"], "left").withColumn("n_in", F.coalesce("n_in", F.lit(0)))
            inherits = (F.col("n_in") == 1) & (F.col("parent_out") == 1)
            key = lambda k, comp: F.concat_ws("/", F.col("run").cast("string"), k.cast("string"), comp)
            table = table.withColumns({
                "inherits": inherits, "key": key(F.col("k"), F.col("comp")),
                "root": F.when(inherits, key(F.col("k") - 1, F.col("only_parent"))).otherwise(key(F.col("k"), F.col("comp"))),
            })
            pointers = cut(table.select("key", "root"))
            while True:  # each round doubles the length of chain that a pointer spans
                up = pointers.select(F.col("key").alias("root"), F.col("root").alias("further"))
                jumped = cut(pointers.join(up, "root").select("key", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")))
                pointers = jumped.drop("moved")
                if jumped.filter("moved").isEmpty():
                    break
            origin = table.select(F.col("key").alias("root"), F.concat_ws("_", F.lit("C"), F.col("step").cast("string"), "comp").alias("component_id"))
            return table.drop("root").join(pointers, "key").join(origin, "root").drop("root", "key")
        return self._once("component_table", make)

    def component_links(self) -> DataFrame:
        """Pairs of components of consecutive change steps that match: ``run, k, comp, parent, …``."""
        def make():
            comps = self.components()
            sizes = comps.groupBy("run", "k", "comp").agg(F.count(F.lit(1)).alias("size"))
            before = comps.select("run", (F.col("k") + 1).alias("k"), "uid", F.col("comp").alias("parent"))
            shared = comps.join(before, ["run", "k", "uid"]).groupBy("run", "k", "comp", "parent").agg(F.count(F.lit(1)).alias("both"))
            parents = sizes.select("run", (F.col("k") + 1).alias("k"), F.col("comp").alias("parent"), F.col("size").alias("parent_size"))
            j = F.col("both") / (F.col("size") + F.col("parent_size") - F.col("both"))
            matched = (shared.join(sizes, ["run", "k", "comp"]).join(parents, ["run", "k", "parent"])
                       .withColumn("jaccard", j).filter(F.col("jaccard") > MATCH_ABOVE))
            out = matched.groupBy("run", "k", "parent").agg(F.count(F.lit(1)).alias("parent_out"))
            return matched.join(out, ["run", "k", "parent"])
        return self._once("links", make)

    def lifecycle(self) -> DataFrame:
        """Events: ``run, step, snap_ts, event, component_id, comp, size, n_related``.

        BIRTH, GROW, SHRINK, CONTINUE and MERGE belong to a component of the step, SPLIT and DEATH
        to one of the change step before. The child of a split has a new id and no event.
        """
        table = self._component_table()
        own = table.withColumn("event", F.when(F.col("n_in") == 0, "BIRTH").when(F.col("n_in") >= 2, "MERGE").when(
            F.col("inherits"), F.when(F.col("size") > F.col("parent_size"), "GROW").when(F.col("size") < F.col("parent_size"), "SHRINK").otherwise("CONTINUE")))
        now = own.filter(F.col("event").isNotNull()).select("run", "step", "event", "component_id", "comp", "size", F.col("n_in").alias("n_related"))
        following = self.change_steps().select("run", (F.col("k") - 1).alias("k"), F.col("step").alias("next_step"))
        out = self.component_links().select("run", (F.col("k") - 1).alias("k"), F.col("parent").alias("comp"), F.col("parent_out").alias("n_children")).distinct()
        past = table.join(following, ["run", "k"]).join(out, ["run", "k", "comp"], "left").withColumn("n_related", F.coalesce("n_children", F.lit(0)))
        gone = past.withColumn("event", F.when(F.col("n_related") == 0, "DEATH").when(F.col("n_related") > 1, "SPLIT"))
        ended = gone.filter(F.col("event").isNotNull()).select("run", F.col("next_step").alias("step"), "event", "component_id", "comp", "size", "n_related")
        return now.unionByName(ended).withColumn("snap_ts", self.grid.time(F.col("step")))

    def lifecycle_relations(self) -> DataFrame:
        """Parents of GROW, SHRINK, CONTINUE and MERGE and children of SPLIT, one row each."""
        ids = self._component_table().select("run", "k", "step", "comp", "component_id", "n_in", "inherits")
        parent_ids = ids.select("run", (F.col("k") + 1).alias("k"), F.col("comp").alias("parent"), F.col("component_id").alias("parent_id"))
        linked = self.component_links().join(ids, ["run", "k", "comp"]).join(parent_ids, ["run", "k", "parent"])
        parents = linked.filter(F.col("inherits") | (F.col("n_in") >= 2)).select("step", "component_id", F.lit("parent").alias("role"), F.col("parent_id").alias("related_id"))
        children = linked.filter(F.col("parent_out") > 1).select("step", F.col("parent_id").alias("component_id"), F.lit("child").alias("role"), F.col("component_id").alias("related_id"))
        return parents.unionByName(children).withColumn("snap_ts", self.grid.time(F.col("step")))

    def component_members(self) -> DataFrame:
        """Members of every component with its lasting id."""
        ids = self._component_table().select("run", "k", "comp", "component_id")
        return self.components().join(ids, ["run", "k", "comp"])

    def structural_transitions(self) -> DataFrame:
        """First time at which a node is in a born, grown or merged component of at least two."""
        events = self.lifecycle().filter(F.col("event").isin("BIRTH", "GROW", "MERGE") & (F.col("size") >= 2)).select("step", "comp")
        return (self.components().join(events, ["step", "comp"]).groupBy("uid").agg(F.min("step").alias("step"))
                .select("uid", self.grid.time(F.col("step")).alias("transition_ts")))

    # lookups -------------------------------------------------------------------------------------
    def _step_at(self, t, steps: DataFrame) -> DataFrame:
        return steps.filter(self.grid.time(F.col("step")) <= time_column(t)).agg(F.max("step").alias("step"))

    def members_at(self, t) -> DataFrame:
        """Members at the last evaluated step at or before a time."""
        return self.membership().join(self._step_at(t, self.steps()), "step").select("uid")

    def edges_at(self, t) -> DataFrame:
        members = self.membership().join(self._step_at(t, self.steps()), "step")
        return self._edges_for(members).select("edge", "src", "dst")

    def components_at(self, t) -> DataFrame:
        return self.components().join(self._step_at(t, self.change_steps()), "step").select("uid", "comp")

    def summary(self) -> DataFrame:
        """One row: steps, change steps, members, largest membership, and the number of events."""
        n_steps = self.steps().agg(F.count(F.lit(1)).alias("n_steps"))
        n_changes = self.change_steps().agg(F.count(F.lit(1)).alias("n_change_steps"))
        unique = self.membership().agg(F.countDistinct("uid").alias("n_members"))
        top = self.membership().groupBy("step").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("max_members"))
        mapped = self.nodes().filter(F.exists(F.map_keys("ts_ids"), lambda k: k.isin(self.predicate.series))).agg(F.count(F.lit(1)).alias("n_mapped"))
        events = self.lifecycle().agg(*[F.count_if(F.col("event") == e).alias(f"n_{e.lower()}") for e in EVENTS])
        out = n_steps
        for part in (n_changes, unique, top, mapped, events):  # one row each
            out = out.crossJoin(part)
        return out

    def export(self) -> DataFrame:
        """Raw readings of all mapped nodes on the grid, for drawing."""
        return self.readings().withColumn("snap_ts", self.grid.time(F.col("step")))

    # thresholds ----------------------------------------------------------------------------------
    def sweep(self, limits: list[float]) -> DataFrame:
        """Membership under other thresholds of the first term: ``threshold, uid, step``."""
        term = self.predicate.terms[0]
        readings = self.readings().withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in limits])))
        return readings.filter(term.test(F.col("threshold"))).select("threshold", "uid", "step")

    def expression_range(self) -> DataFrame:
        x = self.predicate.terms[0].value()
        return self.readings().agg(F.min(x).alias("low"), F.max(x).alias("high"))


#: Kinds of life-cycle event.
EVENTS = ("BIRTH", "GROW", "SHRINK", "CONTINUE", "MERGE", "SPLIT", "DEATH")

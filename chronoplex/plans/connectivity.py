"""Weak components at every step of a grid, offline.

Edges sit on aligned ranges of steps (every second length of the dyadic ones). Ranges are taken from the longest downwards: inside a range, the edges
that are valid all over it join components, and below only their representatives go on, and only where a shorter range still has an edge at them.
A step's number of components is its number of nodes less the joins in the ranges that hold it; its largest component is the largest that any of
these ranges has made. So no edge is repeated for every step, and what is written shrinks from length to length.

``components_in_windows`` cuts the grid into aligned windows of one task each, as long as possible. A task reads the edges that are valid all over its
window as a stream and keeps only the root of every node. Edges that begin or end inside the window follow; those that still join roots are kept, and with
them the task goes down its window in the same way, with numpy. So its memory is one number per node and what begins or ends in the window, however many
edges a step has. Edges travel as blocks of numbers, not as rows. Graphs with more nodes than a task has room for take the way by joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.temporal import Grid
from .dyadic import ancestors, cover, levels
from .fixpoint import weak_components
from .lineage import cut

#: First and last steps of edges, loops left out, in a window of one task; it bounds the task's memory, not the result. A window of one step may have any number.
WINDOW_EDGES = 24_000_000
#: Windows are at most the grid's dyadic length divided by this power of two, so that there are several tasks.
WINDOW_SPLITS = 4
#: Nodes, with an edge or without, of a graph whose roots a task can hold (4 bytes each, and some copies).
WINDOW_NODES = 1 << 25
#: Edges that a task sends, and connects, at once.
_BLOCK = 1 << 19
_ROUND = 1 << 21


def _pieces(edges: DataFrame, grid: Grid) -> DataFrame:
    """``level, block, a, b`` with even levels only; the ends in order, loops and repeated edges left out."""
    n = levels(grid)
    ranges = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.inline(cover(F.col("_lo"), F.col("_hi"), n)))
    halves = F.when(F.col("level") % 2 == 1, F.array(F.col("block") * 2, F.col("block") * 2 + 1)).otherwise(F.array("block"))
    return ranges.select((F.col("level") - F.col("level") % 2).alias("level"), F.explode(halves).alias("block"), "a", "b").distinct()


def component_changes(edges: DataFrame, grid: Grid) -> DataFrame:
    """``level, block, joins, biggest`` of the ranges in which edges join components.

    ``edges``: src, dst, _lo, _hi, the steps at which the edge and both its ends are valid. A node that has no edge is no row here: it is a component of its own.
    """
    pieces = cut(_pieces(edges, grid))
    top = (levels(grid) - 1) // 2 * 2
    state, found = None, []
    for level in range(top, -1, -2):
        own = pieces.filter(F.col("level") == level).select("block", "a", "b")
        if state is None:
            mapped = own.withColumns({"sa": F.lit(1).cast("long"), "sb": F.lit(1).cast("long")})
        else:
            mapped = own
            for end, size in (("a", "sa"), ("b", "sb")):
                known = state.select("block", F.col("v").alias(end), F.col("rep").alias("_rep"), F.col("size").alias(size))
                mapped = mapped.join(known, ["block", end], "left").withColumns({end: F.coalesce("_rep", end), size: F.coalesce(size, F.lit(1))}).drop("_rep")
        mapped = cut(mapped.filter("a <> b").distinct())
        members = mapped.select("block", F.explode(F.array(F.struct(F.col("a").alias("uid"), F.col("sa").alias("size")), F.struct(F.col("b").alias("uid"), F.col("sb").alias("size")))).alias("m"))
        members = members.select("block", "m.uid", "m.size").distinct()
        comps = weak_components(members, mapped.select("block", F.col("a").alias("src"), F.col("b").alias("dst")), ["block"], edges_inside=True)
        comps = cut(members.join(comps, ["block", "uid"]))
        made = comps.groupBy("block", "comp").agg(F.sum("size").alias("total"), (F.count(F.lit(1)) - 1).alias("joins"))
        found.append(made.groupBy("block").agg(F.sum("joins").alias("joins"), F.max("total").alias("biggest")).withColumn("level", F.lit(level)))
        if level == 0:
            break
        # what shorter ranges still touch, with the representative that this range has left it
        below = pieces.filter(F.col("level") < level).select(
            F.expr(f"shiftright(block, {level - 2} - level)").alias("block"), F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("_in", F.shiftright("block", 2))
        if state is None:
            below = below.withColumns({"rep": F.col("v"), "size": F.lit(1).cast("long")})
        else:
            below = below.join(state.withColumnRenamed("block", "_in"), ["_in", "v"], "left").withColumns({"rep": F.coalesce("rep", "v"), "size": F.coalesce("size", F.lit(1))})
        joined = comps.join(made.select("block", "comp", "total"), ["block", "comp"]).select(F.col("block").alias("_in"), F.col("uid").alias("rep"), "comp", "total")
        below = below.join(joined, ["_in", "rep"], "left").select("block", "v", F.coalesce("comp", "rep").alias("rep"), F.coalesce("total", "size").alias("size"))
        state = cut(below.filter("size > 1"))
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def components_over_steps(edges: DataFrame, grid: Grid) -> DataFrame:
    """``step, joins, biggest``: steps at which edges join nodes."""
    held = ancestors(grid, edges.sparkSession).join(component_changes(edges, grid), ["level", "block"])
    return held.groupBy("step").agg(F.sum("joins").alias("joins"), F.max("biggest").alias("biggest"))


def _windows(edges: DataFrame, grid: Grid, most: int) -> DataFrame:
    """``step, first, last, fits, w``: each step's window and the windows' numbers in order; a row of ``edges`` counts as often as its ``n`` says, if it has one."""
    spark = edges.sparkSession
    times = F.col("n") if "n" in edges.columns else F.lit(1)
    mark = lambda c, begun, ended: F.struct(F.col(c).alias("step"), F.lit(begun).alias("begun"), F.lit(ended).alias("ended"))
    marks = edges.select(times.alias("n"), F.explode(F.array(mark("_lo", 1, 0), mark("_hi", 0, 1))).alias("m")).groupBy("m.step").agg(
        F.sum(F.col("n") * F.col("m.begun")).alias("begun"), F.sum(F.col("n") * F.col("m.ended")).alias("ended"))
    so_far = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over one row per step
    here = grid.frame(spark).select("step").join(marks, "step", "left").na.fill(0, ["begun", "ended"])
    totals = here.select("step", F.sum("begun").over(so_far).alias("begun"), (F.sum("ended").over(so_far) - F.col("ended")).alias("gone"))
    # an edge is valid somewhere in a range if it has begun by the last step and was not gone before the first
    held = ancestors(grid, spark)
    fitting = held.join(totals, "step").groupBy("level", "block").agg((F.max("begun") - F.min("gone")).alias("n")).filter(
        (F.col("n") <= most) & (F.col("level") <= max(0, levels(grid) - 1 - WINDOW_SPLITS)))
    longest = held.join(fitting, ["level", "block"], "left").groupBy("step").agg(F.max(F.when(F.col("n").isNotNull(), F.col("level"))).alias("level"))
    fits, level = F.col("level").isNotNull(), F.coalesce("level", F.lit(0))
    bounds = longest.select("step", fits.alias("fits"), level.alias("level")).withColumn("first", F.expr("shiftleft(shiftright(step, level), level)"))
    last = F.least(F.expr("first + shiftleft(1L, level) - 1"), F.lit(grid.size - 1))
    return bounds.select("step", "first", last.alias("last"), "fits", F.dense_rank().over(Window.orderBy("first")).alias("w"))


def numbered(names: DataFrame) -> tuple[DataFrame, int]:
    """``uid, _number``: numbers from 0 without gaps for the distinct names, and how many there are."""
    rows = cut(names.distinct().withColumn("_id", F.monotonically_increasing_id()))  # the upper bits are the partition's number
    part = F.shiftright("_id", 33)
    counts = dict(rows.groupBy(part).count().collect())  # one row per partition
    before = np.cumsum([0, *(counts.get(k, 0) for k in range(max(counts, default=0) + 1))]).tolist()
    number = F.element_at(F.array(*map(F.lit, before)), (part + 1).cast("int")) + F.col("_id") - F.shiftleft(part, 33)
    return rows.select(names.columns[0], number.cast("long").alias("_number")), before[-1]


def _connect(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots of the nodes after the edges (a, b) too; ``parent`` holds the roots before and is written over."""
    a, b = parent[a], parent[b]
    while (apart := a != b).any():
        a, b = a[apart], b[apart]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, high, low)  # of several edges of a root the smallest other end counts; the others come again
        while True:  # roots that have become others' children; what lies below them follows at the end
            up = parent[parent[high]]
            if np.array_equal(up, parent[high]):
                break
            parent[high] = up
        a, b = parent[low], up
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    return parent


def _steps_of_window(first: int, last: int, edges: tuple[np.ndarray, ...], size: np.ndarray, joins: int, biggest: int) -> list[tuple[int, int, int]]:
    """``step, joins, biggest`` of the steps at which edges join nodes.

    ``edges`` are first steps, last steps and both ends, as roots; ``size`` says how many nodes each root stands for, ``joins`` and ``biggest`` what the edges have
    made that led to them. Edges go on below only as far as they still join roots, and roots only as far as such an edge is at them.
    """
    found, ranges = [], [(first, last, edges, size, joins, biggest)]
    del edges  # a range's edges are held by the ranges below that still wait
    while ranges:
        first, last, (lo, hi, a, b), size, joins, biggest = ranges.pop()
        touch = (lo <= last) & (hi >= first) & (a != b)
        lo, hi, a, b = lo[touch], hi[touch], a[touch], b[touch]
        if not len(a):
            found += [(step, joins, biggest) for step in range(first, last + 1) if joins]
            continue
        touched = np.zeros(len(size), bool)
        touched[a] = touched[b] = True
        number = np.cumsum(touched, dtype=np.int32) - 1
        a, b, size = number[a], number[b], size[touched]
        whole = (lo <= first) & (hi >= last)
        if whole.any():
            root = _connect(np.arange(len(size), dtype=np.int32), a[whole], b[whole])
            joins += int((root != np.arange(len(size))).sum())
            size = np.bincount(root, weights=size, minlength=len(size)).astype(np.int64)
            biggest = max(biggest, int(size.max()))
            a, b = root[a], root[b]
        if first == last:
            found.append((first, joins, biggest))
            continue
        middle = (first + last) // 2
        ranges += [(low, high, (lo, hi, a, b), size, joins, biggest) for low, high in ((first, middle), (middle + 1, last))]
    return found


def _blocks(batches: Iterator[pa.RecordBatch], firsts: np.ndarray, lasts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``w, inside, ends``: edges that touch window ``w``, as columns of numbers: both ends and, of those that begin or end ``inside`` it, first and last step."""

    def of(block: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        columns = np.concatenate(block, axis=1)
        opens, closes = (np.searchsorted(firsts, columns[k], "right") - 1 for k in (2, 3))
        for w in range(opens.min(), closes.max() + 1):
            here = (opens <= w) & (closes >= w)
            whole = here & (columns[2] <= firsts[w]) & (columns[3] >= lasts[w])
            for inside, chosen in ((False, columns[:2, whole]), (True, columns[:, here & ~whole])):
                if chosen.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), pa.array([inside]), pa.array([chosen.tobytes()], pa.binary())], ["w", "inside", "ends"])

    block, held = [], 0
    for batch in batches:
        if batch.num_rows:
            block.append(np.stack([batch.column(c).to_numpy() for c in ("src", "dst", "_lo", "_hi")]))
            held += batch.num_rows
        if held >= _BLOCK:
            yield from of(block)
            block, held = [], 0
    if held:
        yield from of(block)


class _Stream:
    """What a task keeps of the edges of its window; those that are valid all over it come first."""

    def __init__(self, n_nodes: int, first: int, last: int):
        self.first, self.last = first, last
        self.root = np.arange(n_nodes, dtype=np.int32)
        self.waiting, self.n_waiting, self.inside = [], 0, []

    def connect(self) -> None:
        if self.waiting:
            a, b = np.concatenate(self.waiting, axis=1)
            self.root = _connect(self.root, a, b)
        self.waiting, self.n_waiting = [], 0

    def add(self, inside: bool, ends: np.ndarray) -> None:
        if inside:
            self.connect()
            a, b = self.root[ends[0]], self.root[ends[1]]
            apart = a != b
            short = np.min_scalar_type(self.last - self.first)  # steps count from the window's first
            lo, hi = (np.clip(c[apart], self.first, self.last) - self.first for c in ends[2:])
            self.inside.append((lo.astype(short), hi.astype(short), a[apart], b[apart]))
            return
        self.waiting.append(ends)
        self.n_waiting += ends.shape[1]
        if self.n_waiting >= min(_ROUND, max(_BLOCK, len(self.root))):  # connecting goes over all nodes
            self.connect()

    def _kept(self) -> tuple[np.ndarray, ...]:
        parts, self.inside = self.inside, []
        return tuple(np.concatenate([p[k] for p in parts] or [np.empty(0, np.int32)]) for k in range(4))

    def steps(self) -> pa.RecordBatch:
        self.connect()
        size = np.bincount(self.root, minlength=len(self.root))
        found = _steps_of_window(0, self.last - self.first, self._kept(), size, int((size == 0).sum()), int(size.max()))
        return pa.RecordBatch.from_arrays([pa.array([r[k] + add for r in found], pa.int64()) for k, add in enumerate((self.first, 0, 0))], ["step", "joins", "biggest"])


def _window_components(batches: Iterator[pa.RecordBatch], firsts: np.ndarray, lasts: np.ndarray, n_nodes: int) -> Iterator[pa.RecordBatch]:
    """Rows of a window follow each other, those with ``inside`` last."""
    w, stream = None, None
    for batch in batches:
        for k in range(batch.num_rows):
            if batch["w"][k].as_py() != w:
                if stream:
                    yield stream.steps()
                w = batch["w"][k].as_py()
                stream = _Stream(n_nodes, int(firsts[w]), int(lasts[w]))
            inside = batch["inside"][k].as_py()
            stream.add(inside, np.frombuffer(batch["ends"][k].as_buffer(), np.int32).reshape(4 if inside else 2, -1))
    if stream:
        yield stream.steps()


def components_in_windows(edges: DataFrame, grid: Grid, most: int | None = None, n_nodes: int | None = None) -> DataFrame:
    """``step, joins, biggest`` as ``components_over_steps`` gives them, by windows in which at most ``most`` edges begin or end, or of one step.

    ``n_nodes`` says that the ends are numbers below it; others are numbered here.
    """
    edges = edges.filter("src <> dst").select("src", "dst", "_lo", "_hi")
    if n_nodes is None:
        edges = cut(edges)
        numbers, n_nodes = numbered(edges.select(F.explode(F.array("src", "dst")).alias("uid")))
        for end in ("src", "dst"):
            edges = edges.join(numbers.withColumnRenamed("uid", end), end).drop(end).withColumnRenamed("_number", end)
    if n_nodes > WINDOW_NODES:
        return components_over_steps(edges, grid)
    edges = cut(edges.select(*(F.col(c).cast("int").alias(c) for c in ("src", "dst", "_lo", "_hi"))))
    turns = edges.select(F.explode(F.array("_lo", "_hi")).alias("_lo")).groupBy("_lo").agg(F.count(F.lit(1)).alias("n")).withColumn("_hi", F.col("_lo"))
    windows = sorted(_windows(turns, grid, WINDOW_EDGES if most is None else most).select("first", "last").distinct().collect())  # one row per window
    firsts, lasts = (np.array([r[k] for r in windows], np.int64) for k in range(2))
    blocks = edges.mapInArrow(partial(_blocks, firsts=firsts, lasts=lasts), "w int, inside boolean, ends binary")
    placed = blocks.repartitionById(max(1, len(windows)), F.col("w")).sortWithinPartitions("w", "inside")
    return placed.mapInArrow(partial(_window_components, firsts=firsts, lasts=lasts, n_nodes=n_nodes), "step long, joins long, biggest long")

"""Components, reachability and shortest paths by repeated joins.

All functions work on many graphs at once: ``keys`` are columns that tell the graphs apart (a
snapshot time, say), so the rounds of the loop are shared. Every round ends in a written table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .positions import with_position

#: Tables of this many rounds are merged into one, so that plans stay short.
MERGE_EVERY = 16


def _signature(edges: DataFrame, cols: list[str]):
    h = F.xxhash64(*cols).cast("decimal(38,0)")
    return edges.agg(F.count(F.lit(1)), F.sum(h)).first()


def weak_components(nodes: DataFrame, edges: DataFrame, keys: list[str] = (), edges_inside: bool = False) -> DataFrame:
    """``keys, uid, comp`` with ``comp`` the smallest uid of the weakly connected component.

    Alternates two contractions until the edges form stars around the smallest node: link larger
    neighbours to the smallest one, then link smaller neighbours to it. Edge count never grows and
    the number of rounds is logarithmic. Each contraction aggregates before it joins, so a node
    with very many edges costs one row per partition, and AQE splits its join partition.
    Edges whose ends are not in ``nodes`` do not connect; ``edges_inside`` says that there are none.
    """
    keys = list(keys)
    ids = nodes.select(*keys, "uid").distinct()
    inside = edges.select(*keys, "src", "dst").filter(F.col("src") != F.col("dst"))
    for end in () if edges_inside else ("src", "dst"):
        inside = inside.join(ids.withColumnRenamed("uid", end), [*keys, end], "left_semi")
    links = cut(inside.select(*keys, F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    before = None
    while not links.isEmpty():
        # a is the larger end; both directions make the neighbourhood of every node
        both = links.select(*keys, F.explode(F.array(
            F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
            F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select(*keys, "e.u", "e.v")
        lowest = both.groupBy(*keys, "u").agg(F.min(F.least("u", "v")).alias("low"))
        large = both.filter(F.col("v") > F.col("u")).join(lowest, [*keys, "u"]).select(
            *keys, F.col("v").alias("a"), F.col("low").alias("b")).distinct()
        smallest = large.groupBy(*keys, "a").agg(F.min("b").alias("low"))
        small = large.join(smallest, [*keys, "a"]).select(*keys, F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct(F.col("a"), F.col("low").alias("b")))).alias("e")
        ).select(*keys, "e.a", "e.b").filter(F.col("a") != F.col("b")).distinct()
        links = cut(small)
        now = _signature(links, [*keys, "a", "b"])
        if now == before:
            break
        before = now
    stars = links.select(*keys, F.col("a").alias("uid"), F.col("b").alias("comp"))
    return ids.join(stars, [*keys, "uid"], "left").withColumn("comp", F.coalesce("comp", "uid"))


#: A round of shrinking that removes a smaller share of the nodes than one in this many is followed by a round of colours.
_SHRINK_SHARE = 8


def _colors(edges: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """``keys, uid, ahead, behind``: the smallest colour that reaches a node and the smallest that it reaches; each node's own is drawn at random.

    Both directions go at once. Colours move along edges and along a pointer per node to a node that is known to reach it. Pointers
    double their distance every round, so a colour does not need a round for each edge of a long way.
    """
    ways = [*keys, "way"]
    both = cut(edges.select(*keys, F.explode(F.array(
        F.struct(F.lit(0).alias("way"), "src", "dst"), F.struct(F.lit(1).alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e"))
        .select(*keys, "e.way", "e.src", "e.dst"))
    drawn = lambda c: F.struct(F.xxhash64(c, F.lit(seed)).alias("draw"), F.col(c).alias("owner"))
    ends = both.select(*ways, F.explode(F.array(
        F.struct(F.col("dst").alias("uid"), drawn("src").alias("via")), F.struct(F.col("src").alias("uid"), F.lit(None).alias("via")))).alias("e"))
    state = cut(ends.select(*ways, "e.uid", "e.via").groupBy(*ways, "uid").agg(F.min("via").alias("via"))
                .select(*ways, "uid", drawn("uid").alias("color"), F.coalesce("via.owner", "uid").alias("jump")))
    changed = state
    while not changed.isEmpty():
        offers = (changed.select(*ways, F.col("uid").alias("src"), "color").join(both, [*ways, "src"])
                  .groupBy(*ways, F.col("dst").alias("uid")).agg(F.min("color").alias("offer")))
        there = state.select(*ways, F.col("uid").alias("jump"), F.col("color").alias("far"), F.col("jump").alias("next"))
        low = F.least("color", "far", F.coalesce("offer", "color"))
        state = cut(state.drop("moved").join(there, [*ways, "jump"]).join(offers, [*ways, "uid"], "left")
                    .select(*ways, "uid", low.alias("color"), F.col("next").alias("jump"), (low < F.col("color")).alias("moved")))
        changed = state.filter("moved").drop("moved")
    way = lambda w: F.max(F.when(F.col("way") == w, F.col("color")))
    return cut(state.groupBy(*keys, "uid").agg(way(0).alias("ahead"), way(1).alias("behind")))


def strong_components(nodes: DataFrame, edges: DataFrame, keys: list[str] = ()) -> DataFrame:
    """``keys, uid, comp``: strongly connected components, named by a member.

    Rounds of shrinking remove nodes without incoming or outgoing edges, which are components of their own, and about a third of the
    nodes with one edge of either kind: an edge over such a node takes its place, and the node belongs to the component of that
    edge's ends if they share one. Chains and rings so end after a logarithmic number of rounds. When few nodes go, a round of colours
    follows: nodes that are reached by the colour which they reach themselves form that colour's component, and edges between
    nodes of different colours go. Colours are drawn anew each time, so all parts of the graph have pivots at once.
    """
    keys = list(keys)
    ids = nodes.select(*keys, "uid").distinct()
    rest = edges.select(*keys, "src", "dst").filter(F.col("src") != F.col("dst")).distinct()
    for end in ("src", "dst"):
        rest = rest.join(ids.withColumnRenamed("uid", end), [*keys, end], "left_semi")
    rest = cut(rest)
    levels: list[tuple[str, DataFrame]] = []  # what the rounds found, last to be read first
    while not rest.isEmpty():
        ends = rest.select(*keys, F.explode(F.array(
            F.struct(F.col("src").alias("uid"), F.col("dst").alias("after"), F.lit(None).alias("before")),
            F.struct(F.col("dst").alias("uid"), F.lit(None).alias("after"), F.col("src").alias("before")))).alias("e")).select(*keys, "e.*")
        draw = lambda c: F.xxhash64(c, F.lit(len(levels)))
        state = (ends.groupBy(*keys, "uid").agg(*(f(c).alias(n) for c in ("before", "after") for f, n in ((F.count, f"n_{c}"), (F.min, c))))
                 .withColumn("alone", (F.col("n_before") == 0) | (F.col("n_after") == 0))
                 .withColumn("between", (F.col("n_before") == 1) & (F.col("n_after") == 1)
                             & (draw("uid") < draw("before")) & (draw("uid") < draw("after"))))
        state = cut(state.select(*keys, "uid", "before", "after", "alone", "between"))
        n_alone, n_between, n_all = state.agg(F.count_if("alone"), F.count_if("between"), F.count(F.lit(1))).first()
        if n_alone + n_between:
            between = state.filter("between").select(*keys, "uid", "before", "after")
            over = between.select(*keys, F.col("before").alias("src"), F.col("after").alias("dst")).filter(F.col("src") != F.col("dst"))
            rest, gone = rest.unionByName(over), state.filter("alone OR between").select(*keys, "uid")
            for end in ("src", "dst"):
                rest = rest.join(gone.withColumnRenamed("uid", end), [*keys, end], "left_anti")
            rest = cut(rest.distinct())
            levels.append(("between", between if n_between else None))
        if (n_alone + n_between) * _SHRINK_SHARE < n_all and not rest.isEmpty():
            colors = _colors(rest, keys, len(levels))
            levels.append(("found", colors.filter(F.col("ahead") == F.col("behind")).select(*keys, "uid", F.col("ahead.owner").alias("comp"))))
            open_ = colors.filter(F.col("ahead") != F.col("behind"))
            of = lambda end: open_.select(*keys, F.col("uid").alias(end), F.struct("ahead", "behind").alias(f"at_{end}"))
            rest = cut(rest.join(of("src"), [*keys, "src"]).join(of("dst"), [*keys, "dst"]).filter("at_src = at_dst").select(*keys, "src", "dst"))
    comps = None  # of nodes that are not components by themselves under their own name
    for kind, part in reversed(levels):
        if part is None:
            continue
        if kind == "between":
            for end in ("before", "after"):
                if comps is not None:
                    named = comps.select(*keys, F.col("uid").alias(end), F.col("comp").alias(f"_{end}"))
                    part = part.join(named, [*keys, end], "left").withColumn(f"_{end}", F.coalesce(f"_{end}", end))
                else:
                    part = part.withColumn(f"_{end}", F.col(end))
            part = part.filter("_before = _after").select(*keys, "uid", F.col("_before").alias("comp"))
        comps = cut(part if comps is None else comps.unionByName(part))
    if comps is None:
        return ids.withColumn("comp", F.col("uid"))
    return ids.join(comps, [*keys, "uid"], "left").withColumn("comp", F.coalesce("comp", "uid"))


def hops(start: DataFrame, edges: DataFrame, keys: list[str] = (), until: str | None = None) -> DataFrame:
    """Breadth-first distance: ``keys, root, uid, hop, parent`` from every root in ``start``."""
    keys = list(keys)
    ends = edges.select("src", "dst").distinct()
    seen = cut(start.select(*keys, "root", F.col("root").alias("uid"), F.lit(0).alias("hop"), F.lit(None).cast("string").alias("parent")))
    frontier, hop = seen, 0
    while True:
        hop += 1
        reached = (
            frontier.select(*keys, "root", F.col("uid").alias("src")).join(ends, "src")
            .groupBy(*keys, "root", F.col("dst").alias("uid")).agg(F.min("src").alias("parent"))
            .join(seen.select(*keys, "root", "uid"), [*keys, "root", "uid"], "left_anti")
            .withColumn("hop", F.lit(hop))
        )
        frontier = cut(reached.select(*seen.columns))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if hop % MERGE_EVERY == 0:
            seen = cut(seen)
        if until is not None and not frontier.filter(F.col("uid") == until).isEmpty():
            return seen


#: Roots that share a number.
_BITS = 64


def greatest_depth(roots: DataFrame, edges: DataFrame) -> int:
    """The largest breadth-first distance from any root (``uid``) to any node it reaches, 0 without roots.

    All roots go at once, 64 in the bits of one number: a node has a row per 64 roots that reach it, not per root. A hop joins the
    bits that came last to the edges, unites them per node with ``bit_or``, and takes away those that the node had before.
    """
    numbered = with_position(roots.select("uid").distinct(), [], "uid")
    bit = F.expr(f"shiftleft(1L, cast(idx % {_BITS} AS int))")
    ends = cut(edges.select(F.col("src").alias("uid"), "dst").distinct())
    frontier = cut(numbered.select("uid", F.floor(F.col("idx") / _BITS).alias("word"), bit.alias("bits")))
    parts, hop = [frontier], 0
    while True:
        seen = reduce(DataFrame.unionByName, parts).groupBy("uid", "word").agg(F.bit_or("bits").alias("had"))
        if len(parts) > MERGE_EVERY:
            seen = cut(seen)
            parts = [seen.withColumnRenamed("had", "bits")]
        reached = frontier.join(ends, "uid").groupBy(F.col("dst").alias("uid"), "word").agg(F.bit_or("bits").alias("bits"))
        new = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long"))))
        frontier = cut(reached.join(seen, ["uid", "word"], "left").select("uid", "word", new.alias("bits")).filter("bits <> 0"))
        if frontier.isEmpty():
            return hop
        parts.append(frontier)
        hop += 1

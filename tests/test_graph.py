import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from chronoplex.operators import metrics as G, scans, subgraph as X
from chronoplex.operators.diff import SnapshotDiff
from chronoplex.operators.temporal import Grid, granularity_label, valid_at
from chronoplex.plans.fixpoint import strong_components, weak_components

from conftest import day, make_edges, make_graph, make_nodes, make_samples, rows

DAY = dt.timedelta(days=1)


def test_validity_is_closed_and_null_is_open(spark):
    times = {"a": (None, None), "b": (day(1), None), "c": (None, day(3)), "d": (day(1), day(3))}
    nodes = make_nodes(spark, "abcd", times=times)
    at = lambda t: {r.uid for r in valid_at(nodes, t).collect()}
    assert at(day(0)) == {"a", "c"}
    assert at(day(1)) == at(day(3)) == {"a", "b", "c", "d"}
    assert at(day(4)) == {"a", "b"}


def test_self_loop_rules(spark):
    nodes, edges = make_nodes(spark, "abc"), make_edges(spark, [("a", "a"), ("a", "b"), ("b", "a")])
    assert rows(G.degrees(nodes, edges)) == [("a", 4), ("b", 2), ("c", 0)]
    assert rows(G.degree_distribution(nodes, edges)) == [(0, 1), (2, 1), (3, 1)]
    assert rows(scans.self_loops(edges).select("uid")) == [("e0",)]
    g = make_graph(spark, "abc", [("a", "a"), ("a", "b"), ("b", "a")])
    t = g.snapshot_sequence(day(0), day(2), DAY).tsgen()
    assert [r.value for r in t.degree("sum").collect()] == [5.0, 5.0]
    assert [r.value for r in t.degree("min").collect()] == [0.0, 0.0]
    assert [r.value for r in t.entity_degree("a").collect()] == [4.0, 4.0]


def test_components_strong_and_weak(spark):
    nodes = make_nodes(spark, "abcdx")
    edges = make_edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c")])
    weak = {r.uid: r.comp for r in weak_components(nodes, edges).collect()}
    assert weak == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x"}
    strong = {r.uid: r.comp for r in strong_components(nodes, edges).collect()}
    assert strong["a"] == strong["b"] != strong["c"] == strong["d"] and strong["x"] == "x"


def test_components_against_a_plain_search(spark):
    import random

    rng = random.Random(5)
    ids = [f"n{i:03d}" for i in range(120)]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(130)]
    nodes, edges = make_nodes(spark, ids), make_edges(spark, pairs)
    reach = {i: {i} for i in ids}
    for start in ids:
        todo = [start]
        while todo:
            here = todo.pop()
            for a, b in pairs:
                if a == here and b not in reach[start]:
                    reach[start].add(b)
                    todo.append(b)
    strong = {frozenset(j for j in reach[i] if i in reach[j]) for i in ids}
    groups = {}
    for r in strong_components(nodes, edges).collect():
        groups.setdefault(r.comp, set()).add(r.uid)
    assert {frozenset(g) for g in groups.values()} == strong
    both = {i: set() for i in ids}
    for a, b in pairs:
        both[a].add(b)
        both[b].add(a)
    weak = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for b in both[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        weak[i] = min(seen)
    assert {r.uid: r.comp for r in weak_components(nodes, edges).collect()} == weak


def test_snapshot_keeps_dangling_edges(spark):
    g = make_graph(spark, "ab", [("a", "b")], times={"b": (day(5), None)})
    s = g.snapshot(at=day(1), mode="graph")
    assert rows(s.nodes.select("uid")) == [("a",)]
    assert rows(s.edges.select("src", "dst")) == [("a", "b")]


def test_as_of_and_nearest(spark):
    from chronoplex.operators.series import value_nearest
    from chronoplex.operators.temporal import as_of_grid

    m = make_samples(spark, {"s": [None, 10, None, 30]})
    grid = Grid(day(0), day(5), DAY)
    assert rows(as_of_grid(m, grid).select("step", "value")) == [(1, 10.0), (2, 10.0), (3, 30.0), (4, 30.0)]
    assert value_nearest(m, day(2)).first().value == 10.0
    g = make_graph(spark, ["n"], samples=m, ts={"n": {"x": "s"}})
    assert [r.value for r in g.snapshot(at=day(0)).values.collect()] == [None]


def test_sequence_end_is_exclusive_and_sliceable(spark):
    g = make_graph(spark, "ab", [("a", "b")], edge_times={("a", "b"): (day(1), day(2))})
    seq = g.snapshot_sequence(day(0), day(4), DAY)
    assert [r.n_edges for r in seq.summary().orderBy("step").collect()] == [0, 1, 1, 0]
    assert len(seq) == 4 and len(seq.head(2)) == 2 and len(seq.window(day(1), day(2))) == 2
    assert seq.tail(1).grid.start == seq.grid.start + 3 * DAY
    assert seq[-1].edges.count() == 0 and seq[1].edges.count() == 1


def test_grid_arithmetic_on_uneven_bounds(spark):
    grid = Grid(day(0, 6), day(3), dt.timedelta(hours=12))
    nodes = make_nodes(spark, "abc", times={"a": (day(0, 7), day(0, 17)), "b": (day(0, 18), day(1, 6)), "c": (None, day(0, 5))})
    assert rows(grid.expand(nodes).select("uid", "step")) == [("b", 1), ("b", 2)]
    assert grid.size == 6
    assert granularity_label(dt.timedelta(hours=36)) == "36H" and granularity_label(dt.timedelta(days=14)) == "2W"


def test_shortest_path_and_depth_in_a_diamond(spark):
    edges = make_edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")])
    path = [r.uid for r in G.shortest_path(edges, "a", "e").orderBy("position").collect()]
    assert path in (["a", "b", "d", "e"], ["a", "c", "d", "e"])
    assert G.shortest_path(edges, "e", "a").count() == 0
    assert [r.uid for r in G.shortest_path(edges, "a", "a").collect()] == ["a"]


def test_diff_of_snapshots(spark):
    times = {"a": (day(0), day(1)), "b": (None, None), "c": (day(2), None)}
    g = make_graph(spark, "abc", [("a", "b"), ("b", "c")], times=times, edge_times={("a", "b"): (day(0), day(1)), ("b", "c"): (day(2), None)})
    d = SnapshotDiff(g.snapshot(at=day(0), mode="graph"), g.snapshot(at=day(3), mode="graph"))
    assert rows(d.nodes.select("uid", "change_type")) == [("a", "removed"), ("b", "persistent"), ("c", "added")]
    m = d.metrics().first()
    assert m.node_churn == pytest.approx(2 / 3) and m.edge_churn == 1.0 and m.edge_jaccard == 0.0
    assert rows(d.degree_changes()) == [("a", 1, 0, -1), ("b", 1, 1, 0), ("c", 0, 1, 1)]
    empty = g.with_(nodes=g.nodes.limit(0), edges=g.edges.limit(0))
    nothing = SnapshotDiff(empty.snapshot(at=day(0), mode="graph"), empty.snapshot(at=day(3), mode="graph")).metrics().first()
    assert nothing.node_jaccard == 1.0 and nothing.node_churn == 0.0 and nothing.edit_distance == 0.0


def test_jaccard_is_symmetric(spark):
    times = {c: (day(i % 3), day(i % 4 + 1)) for i, c in enumerate("abcdefgh")}
    g = make_graph(spark, "abcdefgh", times=times)
    one, two = g.snapshot(at=day(1), mode="graph"), g.snapshot(at=day(2), mode="graph")
    there, back = SnapshotDiff(one, two).metrics().first(), SnapshotDiff(two, one).metrics().first()
    assert there.node_jaccard == back.node_jaccard and there.node_n_added == back.node_n_removed


def test_saved_members_and_cover(spark, tmp_path):
    g = make_graph(spark, "abc")
    X.save_members(g.nodes.filter("uid < 'c'"), str(tmp_path), "first")
    X.save_members(g.nodes, str(tmp_path), "all")
    assert rows(X.list_subgraphs(spark, str(tmp_path))) == [("all", 3), ("first", 2)]
    wanted = X.load_members(spark, str(tmp_path), "first").unionByName(spark.createDataFrame([("z", "first")], "uid string, subgraph string"))
    assert rows(X.missing_members(g, wanted)) == [("z",)]
    assert g.subgraph(wanted).nodes.count() == 2


def test_pattern_cycles_need_both_ends(spark):
    g = make_graph(spark, "abcd", [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])
    m = g.match().edge("x", "e", "y").edge("y", "f", "z").edge("z", "g", "x").run()
    assert rows(m.select("x", "y", "z")) == [("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b")]
    with pytest.raises(ValueError, match="not connected"):
        g.match().edge("x", "e", "y").edge("p", "f", "q").run()


def test_cross_conditions_need_a_value(spark):
    g = make_graph(spark, "abc", [("a", "b"), ("b", "c"), ("a", "c")], props={"a": {"w": "1"}, "b": {"w": "2"}})
    assert rows(g.match().edge("x", "e", "y").where_cross("x.w", "<", "y.w").run().select("x", "y")) == [("a", "b")]
    assert g.match().edge("x", "e", "y").where_cross("y.w", "!=", 7).run().count() == 1


def test_lead_and_lag(spark):
    base = [1, 5, 2, 8, 3, 9, 4, 7, 2, 6]
    m = make_samples(spark, {"l": base, "r": [0, 0, *base[:-2]]})
    g = make_graph(spark, "ab", [("a", "b")], samples=m, ts={"a": {"x": "l"}, "b": {"x": "r"}})
    ask = lambda rel, lag: g.match().edge("a", "e", "b").where_series("a.x", rel, "b.x", 0.99, lag).run().count()
    assert ask("leads", 2) == 1
    assert [ask("leads", k) for k in (0, 1, 10)] == [0, 0, 0]
    assert ask("lags", 2) == 0


def test_no_cartesian_product_and_pushed_filters(spark):
    from chronoplex.sources.warehouse import order_graph, signal_graph

    d = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().toString()
    g = signal_graph(spark, d)
    text = plan(g.match().edge("a", "e", "b").edge("b", "f", "c").run())
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "Python" not in text
    text = plan(order_graph(spark, d).snapshot_sequence("1996-01-01", "1996-02-01", DAY).tsgen().degree("avg"))
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "Python" not in text
    raw = signal_graph(spark, d, by_day=False)
    text = plan(raw.snapshot(at="2024-01-05").values)
    assert "LessThanOrEqual(ts" in text and "props" not in text.split("ReadSchema")[1][:120]


def test_labelled_snapshot_has_only_its_values(spark):
    g = make_graph(spark, "ab", samples=make_samples(spark, {"s": [1, 2]}), ts={"a": {"x": "s"}})
    s = g.snapshot(at=day(1))
    assert s.with_labels("N").values.count() == 1 and s.with_labels("none").values.count() == 0


def test_series_filters_read_one_property_of_its_owners(spark):
    from chronoplex.sources.warehouse import signal_graph

    q = signal_graph(spark, "/root/testdata/sf0.001", by_day=False).query().nodes("User").where_static("nationkey", "=", 3)
    plan = q.where_ts_agg("view", "mean", ">", 1).execute()._jdf.queryExecution()
    assert "EqualTo(event_type,view)" in plan.executedPlan().toString()
    lines = plan.optimizedPlan().toString().splitlines()
    scan = next(i for i, x in enumerate(lines) if "event_type" in x and "view" in x and "Filter" in x)
    above = [x.strip(" :+-|") for x in lines[:scan]]
    assert max(i for i, x in enumerate(above) if x.startswith("Join LeftSemi")) > max(i for i, x in enumerate(above) if x.startswith("Aggregate"))
    both = q.where_ts_compare("click", "max", ">", "view", "mean").execute()._jdf.queryExecution().optimizedPlan().toString()
    assert both.count("Aggregate [uid") == 1


def _strong_by_search(ids, pairs):
    out = {i: {b for a, b in pairs if a == i} for i in ids}
    reach = {}
    for start in ids:
        seen, todo = {start}, [start]
        while todo:
            new = out[todo.pop()] - seen
            seen |= new
            todo += new
        reach[start] = seen
    return {frozenset(j for j in reach[i] if i in reach[j]) for i in ids}


def _groups(result):
    groups = {}
    for r in result.collect():
        groups.setdefault(r.comp, set()).add(r.uid)
    assert all(comp in members for comp, members in groups.items())
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("shape", ["chain", "ring"])
def test_long_chains_and_rings_take_logarithmic_rounds(spark, monkeypatch, shape):
    import math

    from chronoplex.plans import fixpoint

    n = 1000
    ids = [f"n{i * 7919 % n:04d}" for i in range(n)]
    pairs = list(zip(ids, ids[1:] + ids[:1] if shape == "ring" else ids[1:]))
    nodes = spark.createDataFrame([(i,) for i in ids], "uid string")
    edges = spark.createDataFrame(pairs, "src string, dst string")
    tables, real = [], fixpoint.cut
    monkeypatch.setattr(fixpoint, "cut", lambda df: tables.append(df.columns) or real(df))
    result = _groups(strong_components(nodes, edges))
    assert len(result) == (1 if shape == "ring" else n)
    assert sum("between" in t for t in tables) <= 2 * math.log2(n)  # one such table a round
    assert not any("way" in t for t in tables)  # shrinking alone was enough


def test_strong_components_of_several_graphs_at_once(spark):
    import random

    rng = random.Random(11)
    ids = [f"n{i:03d}" for i in range(60)]
    graphs = {
        0: [(a, rng.choice(ids)) for a in ids for _ in range(2)],  # one large component and what hangs on it
        1: [(a, rng.choice(ids[i // 10 * 10:i // 10 * 10 + 12])) for i, a in enumerate(ids) for _ in range(3)],  # some that lead to each other
        2: [(ids[i], ids[j]) for i in range(60) for j in (i + 1, i + 2, i + 3) if j < 60],  # none, and no chain
        3: [(ids[i], ids[i ^ 1]) for i in range(60)] + [(ids[0], ids[0])],  # pairs
        4: [(ids[i], ids[(i + 2) % 60]) for i in range(60)] + [(ids[i], ids[i + 1]) for i in range(0, 60, 2)],  # rungs from one ring to another
        5: [("n000", "n001"), ("n001", "n000"), ("n000", "n002"), ("n002", "n003"), ("n003", "n002"), ("n001", "gone"), ("gone", "n001")],
    }
    nodes = spark.createDataFrame([(g, i) for g in graphs for i in ids], "g int, uid string")
    edges = spark.createDataFrame([(g, a, b) for g, pairs in graphs.items() for a, b in pairs], "g int, src string, dst string")
    result = strong_components(nodes, edges, ["g"])
    assert result.count() == 60 * len(graphs)
    for g, pairs in graphs.items():
        known = [p for p in pairs if "gone" not in p]
        assert _groups(result.filter(F.col("g") == g)) == _strong_by_search(ids, known), g
    assert strong_components(nodes.limit(0), edges, ["g"]).count() == 0
    assert _groups(strong_components(nodes, edges.limit(0), ["g"]).filter("g = 0")) == {frozenset([i]) for i in ids}

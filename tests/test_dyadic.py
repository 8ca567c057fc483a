"""Aggregates over steps by dyadic ranges, and the generated series that use them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chronoplex.operators.temporal import Grid
from chronoplex.plans.dyadic import cover, levels, over_steps
from conftest import day, make_graph

DAY = dt.timedelta(days=1)


@pytest.mark.parametrize("size", [1, 2, 7, 16, 33])
def test_cover_is_exact_and_short(spark, size):
    grid = Grid(day(0), day(size), DAY)
    pairs = [(a, b) for a in range(size) for b in range(a, size)]
    found = spark.createDataFrame(pairs, "a long, b long").select("a", "b", cover(F.col("a"), F.col("b"), levels(grid)).alias("r")).collect()
    assert len(found) == len(pairs)
    for row in found:
        steps = sorted(s for x in row.r for s in range(x.block << x.level, (x.block + 1) << x.level))
        assert steps == list(range(row.a, row.b + 1))
        assert len(row.r) <= max(1, 2 * (size - 1).bit_length())


def test_aggregates_match_a_row_per_step(spark):
    rng = random.Random(1)
    rows = [(a, min(36, a + rng.randint(0, 20)), rng.choice([0.125, 0.75, -3.0, 1e9])) for a in (rng.randint(0, 36) for _ in range(200)) if not 10 < a < 14]
    grid = Grid(day(0), day(37), DAY)
    df = spark.createDataFrame(rows, "_lo long, _hi long, x double").repartition(5)
    got = over_steps(df, grid, {"s": ("sum", F.col("x")), "n": ("count", F.col("x")), "low": ("min", F.col("x")), "high": ("max", F.col("x"))})
    want = {}
    for a, b, x in rows:
        for step in range(a, b + 1):
            want.setdefault(step, []).append(x)
    got = {r.step: r for r in got.collect()}
    assert set(got) == set(want)
    for step, xs in want.items():
        r = got[step]
        assert (r.n, r.low, r.high) == (len(xs), min(xs), max(xs)) and r.s == sum(xs)


def random_graph(spark, seed, n=12, m=60, days=25):
    rng = random.Random(seed)
    ids = [f"n{k}" for k in range(n)]
    moment = lambda: None if rng.random() < 0.1 else day(rng.randint(-3, days + 3))

    def span():
        a, b = moment(), moment()
        return (b, a) if a and b and a > b else (a, b)

    pairs = list({(rng.choice(ids), rng.choice(ids)) for _ in range(m)})
    times, edge_times = {i: span() for i in ids if rng.random() < 0.7}, {p: span() for p in pairs}
    props = {i: {"x": str(rng.randint(-5, 5) / 4)} for i in ids if rng.random() < 0.8}
    g = make_graph(spark, ids, pairs, times=times, edge_times=edge_times, props=props)
    valid = lambda s, t: (s[0] is None or s[0] <= t) and (s[1] is None or s[1] >= t)
    at = lambda t: ({i for i in ids if valid(times.get(i, (None, None)), t)}, [p for p in pairs if valid(edge_times[p], t)])
    return g, g.snapshot_sequence(day(0), day(days), DAY).tsgen(), at, props


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_degree_extremes_and_properties_match_every_snapshot(spark, seed):
    _, series, at, props = random_graph(spark, seed)
    stats = {r.step: r for r in series.degree_stats("both").collect()}
    out = {r.step: r for r in series.degree_stats("out").collect()}
    values = {a: {r.step: r.value for r in series.node_property("x", a).collect()} for a in ("avg", "sum", "min", "max")}
    for k in range(25):
        nodes, edges = at(day(k))
        both = {i: sum((a == i) or (b == i) for a, b in edges) for i in nodes}
        left = {i: sum(a == i for a, b in edges) for i in nodes}
        for got, want in ((stats[k], both), (out[k], left)):
            assert (got.n_nodes, got.sum) == (len(want), sum(want.values()))
            assert (got.min, got.max) == ((min(want.values()), max(want.values())) if want else (None, None))
        xs = [float(props[i]["x"]) for i in nodes if i in props]
        want = {"avg": sum(xs) / len(xs), "sum": sum(xs), "min": min(xs), "max": max(xs)} if xs else dict.fromkeys(values, 0.0)
        assert all(abs(values[a][k] - want[a]) < 1e-9 for a in values)


def test_no_row_per_element_and_step(spark):
    _, series, _, _ = random_graph(spark, 1)
    for df in (series.degree_stats(), series.node_property("x", "max"), series.edge_property("x", "avg")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(sequence" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("seed,m", [(4, 8), (5, 20), (6, 60)])
def test_weak_components_match_every_snapshot(spark, seed, m):
    _, series, at, _ = random_graph(spark, seed, m=m)
    count = {r.step: r.value for r in series.component_count(directed=False).collect()}
    largest = {r.step: r.value for r in series.largest_component(directed=False).collect()}
    for k in range(25):
        nodes, edges = at(day(k))
        comp = {i: i for i in nodes}
        for a, b in edges:
            if a in comp and b in comp:
                comp = {i: comp[a] if c == comp[b] else c for i, c in comp.items()}
        sizes = [list(comp.values()).count(c) for c in set(comp.values())]
        assert (count[k], largest[k]) == (len(sizes), max(sizes, default=0))


def test_what_is_written_shrinks_towards_the_steps(spark, monkeypatch):
    """A path whose edges are valid nearly all the time, and one edge that comes and goes: below the top only what that edge needs goes on."""
    from chronoplex.plans import connectivity

    days, n = 64, 40
    rows = [(f"v{i:02}", f"v{i + 1:02}", 0, 63) for i in range(n)] + [("v00", "v40", k, k) for k in range(0, 64, 5)] + [("x", "v03", 9, 20)]
    written = []
    monkeypatch.setattr(connectivity, "cut", lambda df, real=connectivity.cut: written.append(real(df)) or written[-1])
    grid = Grid(day(0), day(days), DAY)
    found = {r.step: r for r in connectivity.components_over_steps(spark.createDataFrame(rows, "src string, dst string, _lo long, _hi long"), grid).collect()}
    assert all(found[k].joins == n + (9 <= k <= 20) and found[k].biggest == n + 1 + (9 <= k <= 20) for k in range(days))
    edges = [w.count() for w in written[1:] if w.columns[:3] == ["block", "a", "b"]]
    assert edges[0] == n and sum(edges[1:]) <= 10  # edges inside a component do not go on


def test_requests(spark):
    _, series, at, _ = random_graph(spark, 7)
    values = lambda df: {r.step: r.value for r in df.collect()}
    named = series.request("entity", "nodes", "degree", uid="n1", direction="in")
    assert {r.metric for r in named.collect()} == {"degree_n1_in"}
    got, between = values(named), values(series.request("entity", "edges", "count", uid="n1", other="n2"))
    density = values(series.request("global", "graph", "density", label="N"))
    parts = values(series.request("global", "graph", "connected_components", label="N", directed=False))
    assert parts == values(series.component_count(directed=False)) and density == values(series.density())
    for k in range(25):
        nodes, edges = at(day(k))
        assert got[k] == (sum(b == "n1" for _, b in edges) if "n1" in nodes else 0)
        assert between[k] == sum((a, b) == ("n1", "n2") for a, b in edges)
    assert {r.metric for r in series.request("global", "nodes", "degree", "min", weight="x").collect()} == {"min_weighted_degree_x_both"}
    with pytest.raises(ValueError):
        series.request("global", "graph", "degree")
    with pytest.raises(ValueError):
        series.request("entity", "nodes", "degree")


@pytest.mark.parametrize("most", [100, 12, 5])
def test_windows_give_the_components_of_every_step(spark, most):
    """Windows of any number of edges, and steps with too many that take the way by joins; loops and repeated edges join nothing."""
    from chronoplex.plans import connectivity

    rng = random.Random(most)
    rows = [("a", "a", 0, 63), ("a", "b", 3, 3), ("a", "b", 3, 9)]
    for _ in range(60):
        low = rng.randrange(64)
        rows.append((f"v{rng.randrange(14)}", f"v{rng.randrange(14)}", low, min(63, low + rng.choice([0, 1, 5, 20]))))
    edges = spark.createDataFrame(rows, "src string, dst string, _lo long, _hi long")
    grid = Grid(day(0), day(64), DAY)
    windows = connectivity._windows(edges.filter("src <> dst"), grid, most).collect()
    assert len(windows) == 64 and all(r.first <= r.step <= r.last for r in windows)
    for r in windows:
        held = sum(a != b and lo <= r.last and hi >= r.first for a, b, lo, hi in rows)
        assert r.fits == (held <= most)
    got = {r.step: (r.joins, r.biggest) for r in connectivity.components_in_windows(edges, grid, most).collect()}
    want = {}
    for k in range(64):
        comp = {v: v for a, b, _, _ in rows for v in (a, b)}
        for a, b, lo, hi in rows:
            if lo <= k <= hi:
                comp = {v: comp[a] if c == comp[b] else c for v, c in comp.items()}
        sizes = [list(comp.values()).count(c) for c in set(comp.values())]
        if len(sizes) < len(comp):
            want[k] = (len(comp) - len(sizes), max(sizes))
    assert got == want


def test_weak_components_of_a_grid_take_windows(spark, monkeypatch):
    """Before, every length of the ranges was a loop of joins."""
    from chronoplex.plans import connectivity

    monkeypatch.setattr(connectivity, "weak_components", lambda *a, **k: pytest.fail("a loop of joins"))
    _, series, _, _ = random_graph(spark, 4)
    assert len(series.component_count(directed=False).collect()) == 25


@pytest.mark.parametrize("metric", ["largest_component", "component_count"])
def test_steps_with_many_edges_take_no_loop_of_joins(spark, monkeypatch, metric):
    """Before, a step with more edges than a window may have took the way by joins, and at 60 times sf0.1 every step has."""
    from chronoplex.plans import connectivity

    _, series, at, _ = random_graph(spark, 8, m=60)
    monkeypatch.setattr(connectivity, "weak_components", lambda *a, **k: pytest.fail("a loop of joins"))
    monkeypatch.setattr(connectivity, "WINDOW_EDGES", 2)
    got = {r.step: r.value for r in getattr(series, metric)(directed=False).collect()}
    for k in range(25):
        nodes, edges = at(day(k))
        comp = {i: i for i in nodes}
        for a, b in edges:
            if a in comp and b in comp:
                comp = {i: comp[a] if c == comp[b] else c for i, c in comp.items()}
        sizes = [list(comp.values()).count(c) for c in set(comp.values())]
        assert got[k] == (max(sizes, default=0) if metric == "largest_component" else len(sizes))


def test_a_task_keeps_the_roots_and_not_the_edges_of_its_window():
    """40 blocks of edges that are valid all over a window, a star whose rounds must not follow its leaves, and edges inside the window that join nothing any more."""
    import numpy as np

    from chronoplex.plans.connectivity import _Stream, _blocks

    n, rng = 1000, np.random.default_rng(1)
    stream = _Stream(n, 0, 7)
    for _ in range(40):
        stream.add(False, rng.integers(0, n - 2, (2, 50_000), dtype=np.int32))
        assert sum(x.shape[1] for x in stream.waiting) < 1_000_000
    inside = np.array([*rng.integers(0, n - 2, (2, 50_000)), *np.sort(rng.integers(0, 8, (2, 50_000)), axis=0)], dtype=np.int32)
    stream.add(True, inside)
    stream.add(True, np.array([[0], [n - 2], [2], [3]], dtype=np.int32))
    assert sum(len(x[0]) for x in stream.inside) == 1 and stream.inside[0][0].itemsize == 1
    found = {r["step"]: r["biggest"] for r in stream.steps().to_pylist()}
    assert found == {k: n - 2 + (k in (2, 3)) for k in range(8)}
    leaves = np.arange(200_000, dtype=np.int32)
    star = _Stream(200_001, 0, 0)
    star.add(False, np.stack([leaves, np.full_like(leaves, 200_000)]))
    assert star.steps().to_pylist() == [{"step": 0, "joins": 200_000, "biggest": 200_001}]
    assert list(_blocks(iter([]), np.array([0]), np.array([7]))) == []


def test_numbers_have_no_gaps(spark):
    from chronoplex.plans.connectivity import numbered

    found, n = numbered(spark.range(0, 500, 1, 7).selectExpr("concat('n', id % 300) AS uid"))
    assert n == 300 and sorted(r._number for r in found.collect()) == list(range(300)) and found.select("uid").distinct().count() == 300
    assert numbered(found.filter("uid IS NULL").select("uid"))[1] == 0

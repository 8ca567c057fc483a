import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chronoplex.operators import signals as V
from chronoplex.operators.induced import InducedGraph, Predicate, Term
from chronoplex.operators.induced_diff import InducedDiff, frequent_members, signal_descriptors
from chronoplex.operators.propagation import Propagation
from chronoplex.plans import fixpoint

from conftest import day, make_edges, make_graph, make_samples, rows

DAY = dt.timedelta(days=1)


def induced(spark, members_by_step, pairs, step=DAY, **options):
    """A graph in which ``x > 5`` selects the given members at each step."""
    ids = sorted({c for s in members_by_step for c in s} | {c for p in pairs for c in p})
    values = {f"ts_x_{i}": [9 if i in s else 1 for s in members_by_step] for i in ids}
    g = make_graph(spark, ids, pairs, make_samples(spark, values, step=step), ts={i: {"x": f"ts_x_{i}"} for i in ids})
    return InducedGraph(g, "N", "x > 5", day(0), day(0) + (len(members_by_step) - 1) * step, every=step, **options)


LIFE = [("a", "b"), ("c", "d"), ("b", "x"), ("x", "c"), ("b", "e")]


def test_life_cycle(spark):
    i = induced(spark, ["abcd", "abcdx", "abcd", "abcde", ""], LIFE)
    events = rows(i.lifecycle().select("step", "event", "size"))
    assert events == [(0, "BIRTH", 2), (0, "BIRTH", 2), (1, "MERGE", 5), (2, "SPLIT", 5), (3, "CONTINUE", 2), (3, "GROW", 3), (4, "DEATH", 2), (4, "DEATH", 3)]
    ids = {(r.step, r.event, r.size): r.component_id for r in i.lifecycle().collect()}
    assert ids[(3, "GROW", 3)] == ids[(4, "DEATH", 3)] == "C_2_a"
    related = rows(i.lifecycle_relations().select("step", "role", "related_id"))
    assert related == [(1, "parent", "C_0_a"), (1, "parent", "C_0_c"), (2, "child", "C_2_a"), (2, "child", "C_2_c"), (3, "parent", "C_2_a"), (3, "parent", "C_2_c")]
    assert rows(i.structural_transitions().select("uid")) == [(c,) for c in "abcdex"]
    assert rows(i.members_at(day(3, 5))) == [(c,) for c in "abcde"]
    s = i.summary().first()
    assert (s.n_steps, s.n_change_steps, s.n_members, s.max_members, s.n_merge, s.n_split, s.n_death) == (5, 5, 6, 5, 1, 1, 2)


def test_merge_and_split_of_one_parent(spark):
    # abmdef splits into ab and def, and gh joins def by way of k: one of the two successors also merges
    pairs = [("a", "b"), ("b", "m"), ("m", "d"), ("d", "e"), ("e", "f"), ("g", "h"), ("f", "k"), ("k", "g")]
    i = induced(spark, ["abmdefgh", "abdefkgh"], pairs)
    events = rows(i.lifecycle().filter("step = 1").select("event", "size"))
    assert events == [("MERGE", 6), ("SPLIT", 6)]
    assert rows(i.lifecycle_relations().filter("step = 1").select("role", "related_id")) == [("child", "C_1_a"), ("child", "C_1_d"), ("parent", "C_0_a"), ("parent", "C_0_g")]


def test_every_component_has_one_origin(spark):
    i = induced(spark, ["abcd", "abcdx", "bcdx", "ab", "abe", "abe", "cd"], LIFE)
    own = i.lifecycle().filter(~F.col("event").isin("SPLIT", "DEATH")).select("step", "comp")
    children = i.lifecycle_relations().filter("role = 'child'").select("step", F.col("related_id"))
    table = i._component_table()
    with_event = table.join(own, ["step", "comp"], "left_semi").count()
    silent = table.join(own, ["step", "comp"], "left_anti")
    assert own.count() == with_event
    assert silent.join(children, silent.component_id == children.related_id, "left_anti").count() == 0


def test_overlap_of_exactly_three_tenths_does_not_match(spark):
    from chronoplex.operators.induced import MATCH_ABOVE

    ids = [f"n{k}" for k in range(10)]
    pairs = [(a, b) for a, b in zip(ids, ids[1:])]
    # 6 members then 7 others with 3 shared: 3 / 10
    i = induced_named(spark, [ids[:6], ids[3:]], pairs)
    assert MATCH_ABOVE == 0.3
    assert sorted(r.event for r in i.lifecycle().filter("step = 1").collect()) == ["BIRTH", "DEATH"]


def induced_named(spark, sets, pairs):
    ids = sorted({c for s in sets for c in s})
    values = {f"ts_x_{i}": [9 if i in s else 1 for s in sets] for i in ids}
    g = make_graph(spark, ids, pairs, make_samples(spark, values), ts={i: {"x": f"ts_x_{i}"} for i in ids})
    return InducedGraph(g, "N", "x > 5", day(0), day(len(sets) - 1), every=DAY)


def test_runs_of_an_hour_filter_start_anew(spark):
    sets = ["ab", "ab", "ab", "ab"] * 2  # every six hours over two days
    i = induced(spark, sets, [("a", "b")], step=dt.timedelta(hours=6), hours=(6, 12))
    assert rows(i.steps().select("step", "run")) == [(1, 0), (2, 0), (5, 1), (6, 1)]
    assert rows(i.membership_changes().select("step", "uid", "change")) == [(1, "a", "enter"), (1, "b", "enter"), (5, "a", "enter"), (5, "b", "enter")]
    assert rows(i.lifecycle().select("step", "event")) == [(1, "BIRTH"), (5, "BIRTH")]


def test_first_step_counts_even_if_empty(spark):
    i = induced(spark, ["", "a", "a"], [("a", "b")])
    assert rows(i.change_steps().select("step", "k")) == [(0, 1), (1, 2)]
    s = {r.step: r for r in V.structure(i).collect()}
    assert s[0].node_count == 0 and s[0].density == 0.0 and s[1].component_count == 1


def test_zero_is_missing_here_only(spark):
    m = make_samples(spark, {"s": [0, 3]})
    g = make_graph(spark, ["n"], samples=m, ts={"n": {"x": "s"}})
    member = lambda **o: rows(InducedGraph(g, "N", "x < 5", day(0), day(1), every=DAY, **o).membership())
    assert member() == [("n", 1)] and member(zero_is_missing=False) == [("n", 0), ("n", 1)]
    assert g.query().nodes().where_ts_agg("x", "min", "=", 0).count() == 1


def test_terms_and_left_to_right(spark):
    t = Term.of("speed / (free + 0.5) >= 0.25")
    assert (t.series, t.statics, t.op, t.limit) == ("speed", ["free"], ">=", 0.25)
    df = spark.createDataFrame([(4.0, 2.0, None), (1.0, -0.5, 3.0)], "speed double, free double, other double")
    assert [r[0] for r in df.select(t.value()).collect()] == [1.6, None]
    chain = Predicate.of("speed > 0 OR free > 0 AND other > 100")
    assert [r[0] for r in df.select(chain.test()).collect()] == [False, False]
    for bad in ("5 < 3", "x", "x; drop < 1"):
        with pytest.raises(ValueError):
            Term.of(bad)


def test_frequency_counts_every_step(spark):
    i = induced(spark, ["ab", "ab", "a", "a"], [("a", "b")])
    period = (day(0), day(4))
    assert rows(frequent_members(i, period, 0.6)) == [("a",)]
    assert rows(frequent_members(i, period, 0.5)) == [("a",), ("b",)]
    assert rows(frequent_members(i, (day(2), day(4)))) == [("a",)]


def test_descriptors(spark):
    series = [("u", 1, [1, 2, 3, 4, 10]), ("u", 2, [2, 2, 5]), ("c", 1, [3, 3, 3]), ("c", 2, [4, 4, 5]), ("one", 1, [1]), ("one", 2, [2, 3])]
    table = [(u, p, day(10 * p + i), float(v)) for u, p, vs in series for i, v in enumerate(vs)]
    d = {r.uid: r for r in signal_descriptors(spark.createDataFrame(table, "uid string, period int, ts timestamp, value double")).collect()}
    assert d["u"].delta_mu == pytest.approx(-1.0) and d["u"].nrmse == pytest.approx((5 / 3) ** 0.5 / (2 / 3) ** 0.5)
    assert (d["c"].sigma_ratio, d["c"].nrmse) == (1.0, 0.0)
    assert (d["one"].delta_mu, d["one"].sigma_ratio, d["one"].delta_slope, d["one"].nrmse) == (0.0, 1.0, 0.0, 0.0)


def test_propagation(spark):
    times = spark.createDataFrame([("a", day(1)), ("b", day(1)), ("c", day(2)), ("d", day(9))], "uid string, transition_ts timestamp")
    adjacency = make_edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("c", "b")]).select("src", "dst")
    p = Propagation(times, adjacency)
    assert rows(p.edges().select("src", "dst", "delay_days")) == [("b", "c", 1.0), ("c", "d", 7.0)]
    assert [r.uid for r in p.roots().collect()] == ["a", "b"] and [r.uid for r in p.leaves().collect()] == ["d", "a"]
    assert [(r.path, r.total_delay_days) for r in p.paths().collect()] == [(["b", "c", "d"], 8.0)]
    s = p.summary().first()
    assert (s.cpg_nodes, s.cpg_edges, s.cpg_avg_delay_days, s.cpg_max_depth) == (4, 2, 4.0, 2)
    assert rows(Propagation(times, adjacency, 1).edges().select("src")) == [("b",)]


def test_paths_and_depth_of_a_diamond(spark):
    times = spark.createDataFrame([(c, day(k)) for k, c in enumerate("abcd")], "uid string, transition_ts timestamp")
    p = Propagation(times, make_edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]).select("src", "dst"))
    assert rows(p.paths().select("path")) == [(["a", "b", "d"],), (["a", "c", "d"],)]
    assert p.summary().first().cpg_max_depth == 2


def test_two_periods_and_annotation(spark):
    i = induced(spark, ["ab", "ab", "bc", "bc"], [("a", "b"), ("b", "c")])
    d = InducedDiff.sliced(i, (day(0), day(2)), (day(2), day(4)))
    assert rows(d.structure()) == [("a", "REMOVED"), ("b", "PERSISTED"), ("c", "ADDED")]
    props = {r.uid: r.props for r in d.annotated().nodes.collect()}
    assert props["c"]["delta_struct"] == "ADDED" and "nrmse" in props["b"] and "nrmse" not in props["a"]
    s = d.summary().first()
    assert (s.added, s.removed, s.persisted) == (1, 1, 1) and s.jaccard_nodes == pytest.approx(1 / 3)
    assert d.query().added().count() == 1


@pytest.mark.parametrize("seed,n,m", [(1, 30, 40), (2, 200, 260), (3, 150, 900), (4, 5, 0)])
def test_greatest_depth_is_that_of_single_searches(spark, monkeypatch, seed, n, m):
    rng = random.Random(seed)
    ids = [f"v{k}" for k in range(n)]
    times = spark.createDataFrame([(i, day(rng.randint(0, 60))) for i in ids], "uid string, transition_ts timestamp")
    adjacency = spark.createDataFrame([tuple(rng.sample(ids, 2)) for _ in range(m)], "src string, dst string")
    p = Propagation(times, adjacency)
    n_roots, deepest = p.roots().count(), p.depths().agg({"hop": "max"}).first()[0]
    tables = []
    real = fixpoint.cut
    monkeypatch.setattr(fixpoint, "cut", lambda df: tables.append(df.columns) or real(df))
    s = p.summary().first()
    assert (s.cpg_roots, s.cpg_max_depth) == (n_roots, deepest or 0)
    assert tables and not [c for c in tables if "root" in c]  # never a row per root and node
    if seed == 2:
        assert n_roots > 64


def test_depth_of_a_chain_and_a_ring(spark):
    chain = spark.createDataFrame([(f"c{k:02}", f"c{k + 1:02}") for k in range(20)] + [("c00", "c15"), ("c20", "c00")], "src string, dst string")
    roots = spark.createDataFrame([("c00",), ("c03",), ("elsewhere",)], "uid string")
    assert fixpoint.greatest_depth(roots, chain) == 20  # c03 along the chain to c20, by the ring to c00, on to c02
    assert fixpoint.greatest_depth(roots.limit(0), chain) == 0


def test_paths_of_a_layered_graph_are_counted_and_the_shortest_listed(spark):
    layers, width = 10, 20
    node = lambda k, j: f"l{k}_{j:02}"
    times = spark.createDataFrame([(node(k, j), day(2 * k, j if k in (0, layers - 1) else 0)) for k in range(layers) for j in range(width)],
                                  "uid string, transition_ts timestamp")
    adjacency = spark.createDataFrame([(node(k, i), node(k + 1, j)) for k in range(layers - 1) for i in range(width) for j in range(width)],
                                      "src string, dst string")
    p = Propagation(times, adjacency)
    counts = p.path_counts().collect()
    assert len(counts) == width and {(r.n_hops, int(r.n_paths)) for r in counts} == {(layers - 1, width ** (layers - 1))}
    found = p.paths(top_k=100).collect()
    assert len(found) == 100
    # the latest root and the earliest leaf are nearest; among those paths the order of names decides
    first = found[0].path
    assert first == [node(0, width - 1)] + [node(k, 0) for k in range(1, layers)]
    assert [r.path for r in found] == [first[:7] + [node(7, a), node(8, b), node(9, 0)] for a in range(5) for b in range(20)]
    assert {r.total_delay_days for r in found} == {2.0 * (layers - 1) - (width - 1) / 24}
    assert p.paths(max_hops=3).count() == 0 and p.path_counts(max_hops=3).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_first_paths_are_those_of_all(spark, seed):
    rng = random.Random(seed)
    ids = [f"v{k}" for k in range(18)]
    times = spark.createDataFrame([(i, day(rng.randint(0, 9))) for i in ids], "uid string, transition_ts timestamp")
    p = Propagation(times, spark.createDataFrame([tuple(rng.sample(ids, 2)) for _ in range(50)], "src string, dst string"))
    every = [(r.path, r.n_hops, r.total_delay_days) for r in p.paths().collect()]
    assert every == sorted(every, key=lambda r: (r[2], r[0])) and len(every) > 20
    for k in (1, 7, len(every) + 5):
        assert [(r.path, r.n_hops, r.total_delay_days) for r in p.paths(top_k=k).collect()] == every[:k]
    short = [r for r in every if r[1] <= 2]
    assert [tuple(r) for r in p.paths(top_k=5, max_hops=2).collect()] == short[:5]
    counts = {}
    for path, n, _ in every:
        counts[path[-1], n] = counts.get((path[-1], n), 0) + 1
    assert {(r.uid, r.n_hops): int(r.n_paths) for r in p.path_counts().collect()} == counts
    assert p.paths(top_k=0).count() == 0 and Propagation(times.limit(0), p.adjacency).paths(top_k=3).count() == 0

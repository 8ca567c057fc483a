import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoplex.functions.templates import TEMPLATE_NAMES, template, z_normalised
from chronoplex.operators import interval_diff as I, series as S, subsequence as P
from chronoplex.operators.pattern import related_series
from chronoplex.plans.positions import exact_percentiles, in_ranges, with_position

from conftest import day, make_graph, make_samples, rows

HOUR = dt.timedelta(hours=1)


def znorm(w):
    w = np.asarray(w, float)
    return (w - w.mean()) / (w.std() or 1.0)


def spikes(n=100, seed=3):
    rng = np.random.default_rng(seed)
    x = 10 + rng.normal(0, 0.5, n)
    for i in range(20, 31):
        x[i] = 10 + 20 * np.exp(-((i - 25) ** 2) / 8)
    for i in range(50, 61):
        x[i] = 10 - 15 * np.exp(-((i - 55) ** 2) / 8)
    return x


@pytest.fixture(params=["4", "23"])
def partitions(spark, request):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(request.param == "4").lower())
    yield int(request.param)
    for k, v in before.items():
        spark.conf.set(k, v)


def test_positions(spark, partitions):
    rng = random.Random(1)
    values = {"big": [rng.random() for _ in range(200)], "small": [1, 2]}
    m = make_samples(spark, values)
    out = with_position(m, ["ts_id"], "ts")
    got = {(r.ts_id, r.idx): (r.value, r.n) for r in out.collect()}
    assert got == {(k, i): (float(v), len(vs)) for k, vs in values.items() for i, v in enumerate(vs)}
    assert out.columns == [*m.columns, "idx", "n"]


def test_positions_by_text_and_null_keys(spark, partitions):
    rows = [(k, f"t{i:03d}", i) for k in ("a", None) for i in range(40)]
    got = with_position(spark.createDataFrame(rows, "k string, o string, i int"), ["k"], "o").collect()
    assert len(got) == 80 and all(r.idx == r.i and r.n == 40 for r in got)


@pytest.mark.parametrize("skewed", ["outlier", "values"])
def test_long_groups_are_split_evenly(spark, partitions, skewed):
    if partitions == 4:
        pytest.skip("small partitions are joined")
    rng = random.Random(3)
    order = [dt.datetime(1970, 1, 1)] + [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s) for s in range(9_999)]
    if skewed == "values":
        order = [dt.datetime(2000, 1, 1) + dt.timedelta(microseconds=int(x)) for x in sorted({int(1.004 ** k * 1000) + k + rng.randint(0, 0) for k in range(5_000)})]
    rows = in_ranges(spark.createDataFrame([("x", t) for t in order], "ts_id string, ts timestamp"), ["ts_id"], "ts")
    sizes = [r["count"] for r in rows.groupBy("_part").count().collect()]
    assert len(sizes) == partitions and max(sizes) <= 2 * len(order) / partitions


def test_exact_percentiles(spark, partitions):
    rng = random.Random(2)
    values = {"a": [rng.choice([1.0, 2.0, 2.0, 7.5, 9.0]) for _ in range(57)], "b": [3.0], "c": [rng.gauss(0, 5) for _ in range(40)]}
    got = exact_percentiles(make_samples(spark, values), ["ts_id"], "value", {"p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0})
    for r in got.collect():
        for name, q in (("p50", 50), ("p95", 95), ("p0", 0), ("p100", 100)):
            assert r[name] == pytest.approx(np.percentile(values[r.ts_id], q))


def test_templates_are_the_closed_forms():
    x = np.linspace(0, 1, 10)
    assert template("spike") == pytest.approx(np.exp(-((x - 0.5) ** 2) / 0.02))
    assert template("valley") == pytest.approx(4 * (x - 0.5) ** 2)
    assert template("plateau") == template("step_down")
    assert len(template("oscillation")) == 20
    assert all(len(template(n, 7)) == 7 for n in TEMPLATE_NAMES)
    with pytest.raises(ValueError):
        template("zigzag")


def brute_distances(x, pattern):
    m, p = len(pattern), znorm(pattern)
    return [float(np.sqrt(((znorm(x[i:i + m]) - p) ** 2).sum())) for i in range(len(x) - m + 1)]


def greedy(d, reach, k=None, limit=None):
    chosen = []
    for i in sorted(range(len(d)), key=lambda i: (d[i], i)):
        if (limit is not None and d[i] > limit) or (k is not None and len(chosen) == k):
            break
        if all(abs(i - j) > reach for j in chosen):
            chosen.append(i)
    return chosen


@pytest.mark.parametrize("block", [16, 4096])
def test_distances_and_top_matches(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    x = spikes()
    m = make_samples(spark, {"s": x}, step=HOUR)
    d = brute_distances(x, template("spike"))
    got = {r.idx: r.distance for r in P.window_distances(m, "spike").collect()}
    assert len(got) == len(d) and all(got[i] == pytest.approx(v) for i, v in enumerate(d))
    best = [r.idx for r in P.find_pattern(m, "spike", top_k=4).orderBy("distance").collect()]
    assert best == greedy(d, 9 + 5, k=4)
    assert 18 <= best[0] <= 24


@pytest.mark.parametrize("block", [20, 64, 10_000])
def test_threshold_matches_follow_the_greedy_choice(spark, block):
    rng = np.random.default_rng(7)
    scores = {"a": rng.random(300).round(2), "b": np.linspace(0, 1, 120), "c": np.ones(90)}
    rows_in = [(k, i, float(v)) for k, vs in scores.items() for i, v in enumerate(vs)]
    w = spark.createDataFrame(rows_in, "ts_id string, idx long, score double")
    got = {}
    for r in P.all_without_overlap(w, "score", reach=6, block=block).collect():
        got.setdefault(r.ts_id, set()).add(r.idx)
    assert got == {k: set(greedy(list(v), 6)) for k, v in scores.items()}


def brute_profile(x, m, sep):
    w = [znorm(x[i:i + m]) for i in range(len(x) - m + 1)]
    return [min(float(np.linalg.norm(a - b)) for j, b in enumerate(w) if abs(i - j) >= sep) for i, a in enumerate(w)]


@pytest.mark.parametrize("block", [8, 1024])
def test_window_profile_motifs_and_discords(spark, monkeypatch, block):
    monkeypatch.setattr(P, "PROFILE_BLOCK", block)
    x = spikes(140, seed=11)
    m = make_samples(spark, {"s": x, "short": [1, 2, 3]}, step=HOUR)
    expected = brute_profile(x, 12, 4)
    profile = P.window_profile(m, 12)
    got = {r.idx: r.distance for r in profile.collect()}
    assert len(got) == len(expected) and all(got[i] == pytest.approx(v, abs=1e-9) for i, v in enumerate(expected))
    top = P.discords(m, 12, top_k=3).orderBy("rank").collect()
    assert [r.idx for r in top] == greedy([-v for v in expected], 11, k=3)
    pairs = P.motifs(m, 12, top_k=2).orderBy("rank").collect()
    assert len(pairs) == 2 and all(r.neighbour - r.idx >= 12 for r in pairs)
    assert len({i for r in pairs for i in (r.idx, r.neighbour)}) == 4


@pytest.mark.parametrize("block", [7, 4096])
def test_pattern_from_another_series(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    x, other = spikes(), [1.0, 2.0, 9.0, 2.0, 1.0, 1.5, 0.5, 0.4, 1.0]
    flat = [5.0] * 40
    m = make_samples(spark, {"x": x, "p": other, "flat": flat}, step=HOUR)
    best = min(brute_distances(x, other))
    pairs = spark.createDataFrame([("x", "p"), ("p", "x"), ("flat", "p")], "left_ts string, right_ts string")
    found = lambda th: rows(related_series(m, pairs, "contains_pattern_from", th))
    assert found(best + 1e-6) == ([("x", "p")] if best < 3 - 1e-3 else rows(related_series(m, pairs, "contains_pattern_from", best + 1e-6)))
    assert ("x", "p") not in found(best - 1e-3)
    assert ("flat", "p") in found(3.0 + 1e-9)


@pytest.mark.parametrize("block", [4, 2048])
def test_warping_distance(spark, block):
    rng = np.random.default_rng(4)
    sides = {"u": (rng.random(11), rng.random(6)), "v": (rng.random(3), rng.random(9)), "w": (rng.random(1), rng.random(1))}
    table = [(u, p, i, len(s), float(v)) for u, pair in sides.items() for p, s in enumerate(pair, 1) for i, v in enumerate(s)]
    df = spark.createDataFrame(table, "uid string, period int, idx long, n long, value double")
    got = {r.uid: r.dtw for r in I.dtw_distance(df, block).collect()}
    for u, (a, b) in sides.items():
        t = np.full((len(a) + 1, len(b) + 1), np.inf)
        t[0, 0] = 0
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = abs(a[i] - b[j]) + min(t[i, j + 1], t[i + 1, j], t[i, j])
        assert got[u] == pytest.approx(t[-1, -1] / (len(a) + len(b)))


def test_resampled_correlation(spark):
    a, b = [1.0, 4.0, 2.0, 8.0, 5.0, 7.0, 3.0], [2.0, 5.0, 1.0]
    table = [("u", p, i, len(s), v) for p, s in ((1, a), (2, b)) for i, v in enumerate(s)]
    table += [("c", p, i, 3, 1.0) for p in (1, 2) for i in range(3)]
    df = spark.createDataFrame(table, "uid string, period int, idx long, n long, value double")
    got = {r.uid: r.correlation for r in I.resampled_correlation(df).collect()}
    stretched = np.interp(np.linspace(0, 1, 7), np.linspace(0, 1, 3), b)
    assert got["u"] == pytest.approx(np.corrcoef(a, stretched)[0, 1]) and got["c"] is None


def test_bucket_conditions(spark):
    m = make_samples(spark, {"s": [1, 1, 9, 9]}, step=dt.timedelta(hours=12))
    g = make_graph(spark, ["n"], samples=m, ts={"n": {"x": "s"}})
    ask = lambda cond, v: g.query().nodes().where_ts_bucketed("x", "1 day", "avg", cond, ">", v).count()
    assert [ask("all", 5), ask("any", 5), ask("majority", 5), ask("avg", 4.9), ask("avg", 5)] == [0, 1, 0, 1, 0]


def test_equal_times_first_or_last(spark):
    from chronoplex.operators.mutate import upsert_samples

    old, new = make_samples(spark, {"s": [1, 2]}), make_samples(spark, {"s": [7]})
    assert rows(upsert_samples(old, new).select("value")) == [(2.0,), (7.0,)]
    assert rows(S.merge_series([old, new]).select("value")) == [(1.0,), (2.0,)]


def test_change_percent_from_zero(spark):
    c = {r.ts_id: r.change_percent for r in S.changes(make_samples(spark, {"up": [0, 2], "flat": [0, 0], "half": [-4, -2]})).collect()}
    assert c == {"up": float("inf"), "flat": 0.0, "half": 50.0}


def test_python_predicate_rows_that_fail_do_not_match(spark):
    g = make_graph(spark, "abc", props={"a": {"w": "4"}, "b": {"w": "oops"}, "c": {"w": "-1"}})
    assert rows(g.query().nodes().where_python(lambda w: w.astype(float) > 0, ["w"]).execute().select("uid")) == [("a",)]


def test_order_then_limit_with_missing_as_zero(spark):
    g = make_graph(spark, "abcd", props={"a": {"w": "4"}, "b": {"w": "-1"}, "d": {"w": "2"}})
    assert [r.uid for r in g.query().nodes().order_by("w").limit(3).execute().collect()] == ["b", "c", "d"]
    assert g.query().nodes().where(w=2).exists() and not g.query().nodes().where(w=3).exists()


def test_features_window(spark):
    m = make_samples(spark, {"s": [0, 0, 10, 20, 10, 0, 0, 0]})
    best = P.find_features(m, {"mean": 40 / 3, "max": 20}, length=3, top_k=1).collect()
    assert [r.idx for r in best] == [2]


def test_nearest_window_needs_two_lengths(spark):
    assert P.window_profile(make_samples(spark, {"s": [1, 2, 3, 4, 5]}), 3).count() == 0

"""Aggregates written in Python."""

import datetime as dt
import random

import numpy as np
import pytest

from chronoplex.functions import aggregates as A
from chronoplex.functions.python_aggregates import KURTOSIS, PythonAggregate, python_aggregate
from chronoplex.operators.series import series_aggregates
from conftest import day, make_graph, make_samples

SCHEMA = "ts_id string, variable string, ts timestamp, value double"


def kurtosis(xs):
    x = np.array(xs, dtype=float)
    if len(x) == 0 or x.std() == 0:
        return None
    return float(((x - x.mean()) ** 4).mean() / x.var() ** 2 - 3)


def close(a, b):
    return a == b if a is None or b is None else abs(a - b) < 1e-9


@pytest.mark.parametrize("parts", [1, 7])
def test_states_merge_over_partitions(spark, parts):
    rng = random.Random(parts)
    groups = {"hot": 900, "one": 1, "two": 2, "same": 30, None: 40, "nulls": 5, "mixed": 50}
    rows = []
    for g, n in groups.items():
        for i in range(n):
            x = 2.5 if g == "same" else None if g == "nulls" or (g == "mixed" and i % 3 == 0) else rng.gauss(1e3, 3) ** 2
            rows.append((g, "v", day(0) + dt.timedelta(minutes=i), x))
    rng.shuffle(rows)
    m = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = {r.ts_id: r.k for r in python_aggregate(m, ["ts_id"], KURTOSIS, "k").collect()}
    assert set(got) == set(groups)
    assert all(close(got[g], kurtosis([r[3] for r in rows if r[0] == g and r[3] is not None])) for g in groups)


def test_times_and_several_keys(spark):
    last = PythonAggregate(lambda v, t: (float(t.max()), float(v[t.argmax()])) if len(v) else (-np.inf, np.nan), max, lambda s: None if np.isnan(s[1]) else s[1])
    rows = [(f"s{i % 3}", "ab"[i % 2], day(0) + dt.timedelta(hours=(i * 37) % 101), float(i)) for i in range(100)]
    got = {(r.ts_id, r.variable): r.last for r in python_aggregate(spark.createDataFrame(rows, SCHEMA).repartition(7), ["ts_id", "variable"], last, "last").collect()}
    assert got == {k: max((r[2], r[3]) for r in rows if r[:2] == k)[1] for k in {r[:2] for r in rows}}


def test_empty_table(spark):
    df = python_aggregate(spark.createDataFrame([], SCHEMA), ["ts_id"], KURTOSIS, "k")
    assert df.columns == ["ts_id", "k"] and df.collect() == []


def test_names_serve_in_filters_and_next_to_built_in_ones(spark):
    A.register_python_aggregate("kurtosis", KURTOSIS)
    A.register_aggregate("energy", lambda v, t: A.F.sum(v * v))
    values = {"flat": [1, 2, 1, 2, 1, 2], "peaked": [0, 0, 0, 0, 0, 9]}
    m = make_samples(spark, values)
    got = {r.ts_id: r for r in series_aggregates(m, ["ts_id"], ["kurtosis", "energy", "median"]).collect()}
    assert all(close(got[k].kurtosis, kurtosis(v)) and got[k].energy == sum(x * x for x in v) and got[k].median == np.median(v) for k, v in values.items())
    g = make_graph(spark, "ab", samples=m, ts={"a": {"x": "flat"}, "b": {"x": "peaked"}})
    assert [r.uid for r in g.query().nodes("N").where_ts_agg("x", "kurtosis", ">", 0).execute().collect()] == ["b"]
    with pytest.raises(ValueError):
        series_aggregates(m, ["ts_id"], ["unheard of"])

import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chronoplex.model import EDGE_SCHEMA, MEASUREMENT_SCHEMA, NODE_SCHEMA, TemporalGraph  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def day(n, hour=0):
    """Day n of January 2024 (counted from 0), naive UTC."""
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=hour)


def make_nodes(spark, ids, label="N", times=None, props=None, ts=None):
    times, props, ts = times or {}, props or {}, ts or {}
    rows = [(i, label, *times.get(i, (None, None)), props.get(i, {}), ts.get(i, {})) for i in ids]
    return spark.createDataFrame(rows, NODE_SCHEMA)


def make_edges(spark, pairs, times=None, props=None):
    times, props = times or {}, props or {}
    rows = [(f"e{k}", a, b, "E", *times.get((a, b), (None, None)), props.get((a, b), {}), {}) for k, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, EDGE_SCHEMA)


def make_samples(spark, series, variable="x", start=None, step=dt.timedelta(days=1)):
    start = start or day(0)
    rows = [(k, variable, start + i * step, float(v)) for k, values in series.items() for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, MEASUREMENT_SCHEMA)


def make_graph(spark, ids, pairs=(), samples=None, **options):
    samples = samples if samples is not None else spark.createDataFrame([], MEASUREMENT_SCHEMA)
    edge_times = options.pop("edge_times", None)
    edges = make_edges(spark, pairs, edge_times) if pairs else spark.createDataFrame([], EDGE_SCHEMA)
    return TemporalGraph(make_nodes(spark, ids, **options), edges, samples)


def rows(df):
    return sorted(tuple(r) for r in df.collect())

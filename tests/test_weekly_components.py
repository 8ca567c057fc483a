"""Weak components of the order graph per week, on tables made here, against the registered SQL."""

import datetime as dt
import random

import duckdb
import pytest

import __spark_entry__ as entry_module
from chronoplex.catalog.evolution import _years
from chronoplex.plans import connectivity
from chronoplex.sources.warehouse import EVENT_SCHEMA, order_graph
from test_catalog import table_rows

PLAIN_TIMES = {t: f"REPLACE ({c}::TIMESTAMP AS {c})" for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, at = random.Random(3), str(tmp_path_factory.mktemp("orders"))
    date = lambda: dt.datetime(1995, 1, 1) + dt.timedelta(days=rng.randrange(400))
    rows = {
        "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", [(k, f"c{k}", 1, 1.0, "A") for k in range(30)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey int, s_acctbal double", [(k, f"s{k}", 1, 1.0) for k in range(8)]),
        "orders": ("o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp", [(k, rng.choice([None, *range(34)]), 1.0, date()) for k in range(80)]),
        "lineitem": ("l_orderkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp",
                     [(rng.randrange(85), rng.choice([None, *range(9)]), 1.0, 1.0, date()) for _ in range(150)]),
        "events": (EVENT_SCHEMA, []),
    }
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.mark.parametrize("most", [1, 40, 10_000])
@pytest.mark.parametrize("name", ["t9_component_count_weak", "t10_largest_component_weak"])
def test_components_match_the_sql_without_a_loop_of_joins(spark, tables, monkeypatch, name, most):
    monkeypatch.setattr(connectivity, "weak_components", lambda *a, **k: pytest.fail("a loop of joins"))
    monkeypatch.setattr(connectivity, "WINDOW_EDGES", most)
    db = duckdb.connect()
    for t in ("customer", "supplier", "orders", "lineitem", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * {PLAIN_TIMES.get(t, '')} FROM '{tables}/{t}.parquet/*.parquet'")
    got = entry_module.queries()[name](spark, tables)
    cursor = db.execute(entry_module.oracle_sql()[name])
    assert table_rows(got.columns, got.collect()) == table_rows([c[0] for c in cursor.description], cursor.fetchall())


def test_edges_are_written_once_for_the_span_and_the_components(spark, tables):
    """Before, the pairs of orders and suppliers were aggregated and joined once for the span and again for the components."""
    edges = _years(spark, tables, dt.timedelta(days=7), ends_only=True).graph.edges
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    ends = ["src", "dst", "start_time", "end_time"]
    assert sorted(map(str, edges.select(ends).collect())) == sorted(map(str, order_graph(spark, tables).edges.select(ends).collect()))

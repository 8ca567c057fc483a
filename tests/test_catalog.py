"""Registered queries against their SQL at the smallest scale, some also with groups spread over many partitions."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

ORDINARY = ["a23_summary", "f9_declared_constraints", "n13_sequence_summary", "t3_degree_extremes", "d13_d18_degree_changes",
            "r9_cross_conditions", "u8_membership_changes", "q6_summary", "io11_free_flow", "m2_created_edges", "g3_strong_components",
            "k5_paths", "k5_shortest_paths", "k5_path_counts", "s27_series_documents", "m9_shared_series", "i6_warping_distance", "s12_typed_properties"]
SPREAD = ["a2_percentiles", "a12_value_at_index", "a15_correlation_by_position", "a18_a19_trends", "i2_i3_i7_i8_series_comparison",
       "i4_i5_resampled_correlation", "p1_p2_window_distances", "p6_window_features", "p7_p8_window_profile", "q3_q4_descriptors"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def table_rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, (int, float)):
            return "None" if isinstance(v, float) and math.isnan(v) else round(float(v), 5) + 0.0
        return str(v)

    return sorted(([plain(r[i]) for i in order] for r in data), key=str)


def same(spark, db, name):
    df = entry_module.queries()[name](spark, SF)
    got = table_rows(df.columns, df.collect())
    cursor = db.execute(entry_module.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    expected = table_rows(columns, cursor.fetchall())
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=2e-5)) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", ORDINARY)
def test_query(spark, db, name):
    same(spark, db, name)


@pytest.mark.parametrize("name", SPREAD)
def test_query_with_groups_over_many_partitions(spark, db, name):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "19")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same(spark, db, name)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_every_sql_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert len(entry_module.queries()) > 200


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["snap_ts", "active_edges", "avg_degree"] and df.count() == 30

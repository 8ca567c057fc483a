import json

import pytest
from pyspark.sql import functions as F

from chronoplex.model import EDGE_SCHEMA, MEASUREMENT_SCHEMA
from chronoplex.operators import mutate as M
from chronoplex.sources import matrices as X, readers, writers

from conftest import day, make_edges, make_graph, make_nodes, make_samples, rows


def test_csv_graph(spark, tmp_path):
    (tmp_path / "nodes").mkdir()
    (tmp_path / "edges").mkdir()
    (tmp_path / "nodes/Sensor.csv").write_text("id,node_id,lat,note,speed_ts_id,start_time,end_time\n1,s1,3.5,,ts_0,2024-01-01 00:00:00,2024-02-01 00:00:00\n2,s2,4.5,ok,,,\n")
    (tmp_path / "edges/road.csv").write_text("start_id,start_vertex_type,end_id,end_vertex_type,weight,label,start_time,end_time\n1,Sensor,2,Sensor,0.5,road,2024-01-01,\n")
    (tmp_path / "measurements.csv").write_text("ts_id,variable,timestamp,value\nts_0,speed,2024-01-01 00:00:00,1\nts_0,speed,2024-01-01 00:05:00,2\nts_0,speed,2024-01-01 00:00:00,3\n")
    g = readers.read_csv_graph(spark, str(tmp_path), ["Sensor"], ["road"])
    n = {r.uid: r for r in g.nodes.collect()}
    assert n["1"].ts_ids == {"speed": "ts_0"} and n["1"].props == {"lat": "3.5"} and n["1"].start_time == day(0)
    assert n["2"].props == {"lat": "4.5", "note": "ok"} and n["2"].end_time is None
    e = g.edges.first()
    assert (e.src, e.dst, e.label, e.uid, e.props) == ("1", "2", "road", "road_1_2_2024-01-01", {"weight": "0.5"})
    assert rows(g.measurements.select("value")) == [(2.0,), (3.0,)]


def test_json_graph(spark, tmp_path):
    (tmp_path / "nodes").mkdir()
    (tmp_path / "edges").mkdir()
    stations = [{"station": "a", "start": "2024-01-01", "capacity": 5, "ts": {"bikes": [{"Start": "2024-01-01T00:00:00", "Value": 0}, {"Start": "2024-01-01T01:00:00", "Value": 4}]}},
                {"station": "b", "start": "2024-01-01", "capacity": 7}]
    trips = [{"from": "a", "to": "b", "start": "2024-01-02"}, {"from": "a", "to": "ghost", "start": "2024-01-02"}]
    (tmp_path / "nodes/Station.json").write_text(json.dumps(stations))
    (tmp_path / "edges/Trip.json").write_text(json.dumps(trips))
    g = readers.read_json_graph(spark, str(tmp_path), ["Station"], ["Trip"], node_fields={"id": ("station",)})
    n = {r.uid: r for r in g.nodes.collect()}
    assert n["a"].ts_ids == {"bikes": "ts_bikes_a"} and n["a"].props == {"capacity": "5", "node_id": "a"} and n["b"].ts_ids == {}
    assert rows(g.edges.select("src", "dst")) == [("a", "b")]
    assert rows(g.measurements.select("value")) == [(0.0,), (4.0,)]


def test_parquet_round_trip_prunes_days(spark, tmp_path):
    g = make_graph(spark, "ab", [("a", "b")], make_samples(spark, {"s": [1, 2, 3]}), ts={"a": {"x": "s"}})
    writers.write_graph(g, str(tmp_path / "g"))
    back = writers.read_graph(spark, str(tmp_path / "g"))
    assert rows(back.nodes.select("uid", "label")) == [("a", "N"), ("b", "N")] and back.edges.count() == 1
    assert back.measurements.columns == g.measurements.columns and back.measurements.count() == 3
    some = writers.read_graph(spark, str(tmp_path / "g"), day(1), day(2)).measurements
    assert rows(some.select("value")) == [(2.0,), (3.0,)]
    assert "PartitionFilters: [isnotnull(day" in some._jdf.queryExecution().toString()


@pytest.mark.parametrize("text,kind,value", [("5", "int", 5), ("x", "int", None), ("2.5", "float", 2.5), ("Yes", "bool", True), ("0", "bool", False), ("q", "str", "q")])
def test_casting(spark, text, kind, value):
    assert spark.range(1).select(readers.cast_value(F.lit(text), kind)).first()[0] == value


def test_matrices(spark):
    wide = spark.createDataFrame([(0, 61.234, 0.0), (1, float("nan"), 50.0)], "step int, a double, b double")
    assert rows(X.wide_to_measurements(wide, "step", "speed", day(0)).select("ts_id", "value")) == [("ts_speed_a", 61.23), ("ts_speed_b", 50.0)]
    matrix = spark.createDataFrame([("a", 1.0, 0.5), ("b", 0.0, 1.0)], "sensor string, a double, b double")
    assert rows(X.adjacency_to_edges(matrix, "sensor").select("src", "dst", "weight")) == [("a", "b", 0.5)]
    known = spark.createDataFrame([("a",)], "uid string")
    assert X.adjacency_to_edges(matrix, "sensor", known).count() == 0


def test_free_flow_falls_back(spark):
    night = [(f"q", "x", day(0, h), float(v)) for h, v in ((0, 10), (1, 20), (12, 99), (2, 0))]
    busy = [("b", "x", day(0, 12), 7.0)]
    m = spark.createDataFrame(night + busy, MEASUREMENT_SCHEMA)
    assert rows(X.free_flow(m)) == [("b", 7.0), ("q", 19.5)]


def test_create_update_delete(spark):
    g = make_graph(spark, "ab", [("a", "b")], make_samples(spark, {"ts_x_a": [1]}), ts={"a": {"x": "ts_x_a"}})
    series = spark.createDataFrame([("c", "load", day(0), 5.0)], "uid string, variable string, ts timestamp, value double")
    new = make_nodes(spark, ["c", "d" * 300], times={"c": (day(0), day(1))})
    g2, bad = M.create_nodes(g, new, series)
    assert rows(bad.select("reason")) == [("id too long",)] and g2.nodes.count() == 3
    assert g2.nodes.filter("uid = 'c'").first().ts_ids == {"load": "ts_load_c"}
    g3, lost = M.create_edges(g2, make_edges(spark, [("a", "c"), ("a", "zz")]).withColumn("uid", F.concat(F.lit("n"), "uid")))
    assert rows(lost.select("reason")) == [("unknown source or target",)] and g3.edges.count() == 2
    g4 = M.delete_nodes(g3, spark.createDataFrame([("c",)], "uid string"))
    assert g4.edges.count() == 1 and rows(g4.measurements.select("ts_id")) == [("ts_x_a",)]
    replaced = M.set_properties(make_nodes(spark, ["a"], props={"a": {"p": "1", "q": "2"}}), spark.createDataFrame([("a", {"q": "9"})], "uid string, props map<string,string>"), "replace")
    assert replaced.first().props == {"q": "9"}


def test_dense_ids(spark):
    from chronoplex.sources.readers import dense_ids

    nodes = make_nodes(spark, "dcba")
    assert rows(dense_ids(nodes)) == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]


@pytest.mark.parametrize("parts", [1, 5])
def test_batches_with_duplicate_keys(spark, parts):
    old = make_samples(spark, {"s": [1.0, 2.0]})
    new = spark.createDataFrame([("s", "x", day(1), 5.0, 2), ("s", "x", day(1), 6.0, 1), ("s", "x", day(4), 7.0, 3), ("s", "x", day(4), 8.0, 4)],
                                "ts_id string, variable string, ts timestamp, value double, n int").repartition(parts, "value")
    value = lambda df: [(r.ts, r.value) for r in df.orderBy("ts", "value").collect()]
    assert value(M.upsert_samples(old, new, order="n")) == [(day(0), 1.0), (day(1), 5.0), (day(4), 8.0)]
    assert value(M.upsert_samples(old, new)) == [(day(0), 1.0), (day(1), 6.0), (day(4), 8.0)]
    assert value(M.update_samples(old, new, order="n")) == [(day(0), 1.0), (day(1), 5.0)]
    longer, late = M.append_samples(old, new)
    assert value(longer) == [(day(0), 1.0), (day(1), 2.0), (day(4), 7.0)] and value(late) == [(day(1), 5.0), (day(1), 6.0), (day(4), 8.0)]
    longer, late = M.append_samples(old.limit(0), new, order="n")
    assert value(longer) == [(day(1), 6.0), (day(4), 7.0)] and late.count() == 2


def test_changes_with_duplicate_keys(spark):
    nodes = make_nodes(spark, "ab", props={"a": {"k": "0"}})
    changes = spark.createDataFrame([("a", {"k": "1"}, None, day(3), 1), ("a", {"k": "2", "m": "3"}, day(1), None, 2), ("a", {"k": "9"}, None, day(2), 0)],
                                    "uid string, props map<string,string>, start_time timestamp, end_time timestamp, n int")
    got = {r.uid: r.props for r in M.set_properties(nodes, changes.select("uid", "props", "n"), order="n").collect()}
    assert got == {"a": {"k": "2", "m": "3"}, "b": {}}
    got = {r.uid: (r.start_time, r.end_time) for r in M.change_validity(nodes, changes, order="n").collect()}
    assert got == {"a": (day(1), None), "b": (None, None)}
    assert M.upsert_elements(nodes, nodes.unionByName(nodes)).count() == 2


def test_series_documents_round_trip(spark):
    import datetime as dt

    from chronoplex.operators import scans

    samples = [("one", "x", day(k) + dt.timedelta(microseconds=k), float(k)) for k in range(10)] + [("one", "x", day(20), None)]
    samples += [("two", v, day(k), k / 3) for v in ("a", "b") for k in range(3)] + [("two", "a", day(7), 5.0), ("lone", "y", day(1), float("inf"))]
    m = spark.createDataFrame(samples, MEASUREMENT_SCHEMA)
    g = make_graph(spark, "npq", [("n", "p")], samples=m, ts={"n": {"s": "one"}, "p": {"s": "one", "t": "two"}})
    documents = scans.series_to_documents(g, part_length=4)
    texts = [(r.ts_id, r.part, json.loads(r.document)) for r in documents.orderBy("ts_id", "part").collect()]
    assert [(t, p, len(d["timestamps"])) for t, p, d in texts] == [("lone", 0, 1), ("one", 0, 4), ("one", 1, 4), ("one", 2, 3), ("two", 0, 4)]
    assert texts[1][2]["metadata"] == {"element_type": "node", "owner_id": "n"} and texts[0][2]["metadata"] is None
    assert texts[-1][2]["variables"] == ["a", "b"] and texts[-1][2]["data"][-1] == [5.0, None]
    back = {(r.ts_id, r.variable, r.ts): r.value for r in scans.series_from_documents(documents.repartition(3)).collect()}
    assert back == {(t, v, at): x for t, v, at, x in samples} | {("two", "b", day(7)): None}
    assert scans.series_to_documents(make_graph(spark, "n")).count() == 0


def test_attached_series_is_stored_once_or_copied(spark):
    g = make_graph(spark, "abc", samples=make_samples(spark, {"own": [1, 2]}), ts={"a": {"y": "own"}})
    points = spark.createDataFrame([(day(k), float(k)) for k in range(3)], "ts timestamp, value double")
    members = spark.createDataFrame([("a",), ("b",), ("b",), ("nobody",)], "uid string")
    once = M.attach_series(g, "node", members, points, "load")
    assert once.measurements.count() == 5 and rows(once.measurements.select("ts_id").distinct()) == [("own",), ("ts_load_shared",)]
    assert {r.uid: r.ts_ids for r in once.nodes.collect()} == {"a": {"y": "own", "load": "ts_load_shared"}, "b": {"load": "ts_load_shared"}, "c": {}}
    less = M.delete_nodes(once, spark.createDataFrame([("a",)], "uid string"))
    assert rows(less.measurements.select("ts_id").distinct()) == [("ts_load_shared",)]  # b still refers to it
    none = M.delete_nodes(less, spark.createDataFrame([("b",)], "uid string"))
    assert none.measurements.count() == 0
    copied = M.attach_series(g, "node", members, points, "load", copies=True)
    assert copied.measurements.count() == 8 and rows(copied.measurements.select("ts_id").distinct()) == [("own",), ("ts_load_a",), ("ts_load_b",)]
    named = M.attach_series(g, "node", members, points, "load", shared_id="own_name")
    assert rows(named.measurements.select("ts_id").distinct()) == [("own",), ("own_name",)]


def test_typed_properties_reach_the_scan_and_follow_changes(spark, tmp_path):
    from chronoplex.functions.values import promoted
    from chronoplex.operators.query import QueryStart

    values = {f"n{k:02}": {"size": str(k), "rate": str(k / 4), "kind": "odd" if k % 2 else "even"} for k in range(40)}
    values |= {"none": {}, "text": {"size": "many", "rate": "nan", "kind": "7"}}
    plain = make_graph(spark, list(values), props=values)
    types = {"size": "bigint", "rate": "double", "kind": "string"}
    writers.write_graph(plain.add_property_columns(nodes=types), str(tmp_path / "g"))
    g = writers.read_graph(spark, str(tmp_path / "g"))
    assert promoted(g.nodes) == types and promoted(g.edges) == {}
    asked = [("size", ">", 31), ("size", "<=", 3), ("size", ">", 30.5), ("size", "=", 7), ("size", "!=", 7), ("rate", "=", 2.25), ("rate", ">=", 9),
             ("rate", "<", 0.5), ("kind", "=", "odd"), ("kind", "!=", "odd"), ("kind", "=", "7.0"), ("kind", "contains", "ve"), ("size", "=", "12")]
    for name, op, value in asked:
        found, wanted = (QueryStart(x).nodes().where_static(name, op, value).execute() for x in (g, plain))
        assert rows(found.select("uid")) == rows(wanted.select("uid")), (name, op, value)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for name, op, value, pushed in [("size", ">", 31, "GreaterThan(size,31)"), ("rate", "=", 2.25, "GreaterThanOrEqual(rate,"), ("kind", "=", "odd", "EqualTo(kind,odd)")]:
        text = plan(QueryStart(g).nodes().where_static(name, op, value).execute().select("uid"))
        assert pushed in text.split("PushedFilters:")[1].split("]")[0], text
        assert "props" not in text.split("ReadSchema:")[1].splitlines()[0]  # the map is not read
    changed = M.set_properties(g.nodes, spark.createDataFrame([("n01", {"size": "100"}), ("n02", {"size": "x"})], "uid string, props map<string,string>"))
    assert {r.uid: r["size"] for r in changed.collect() if r.uid in ("n01", "n02", "n03")} == {"n01": 100, "n02": None, "n03": 3}
    assert promoted(changed) == types
    assert M.remove_property(g.nodes, "rate").filter("rate IS NOT NULL").count() == 0
    more = M.upsert_elements(g.nodes, make_nodes(spark, ["n05", "new"], props={"n05": {"size": "55"}, "new": {"rate": "1"}}))
    assert {r.uid: (r["size"], r.rate, r.kind) for r in more.collect() if r.uid in ("n05", "new")} == {"n05": (55, None, None), "new": (None, 1.0, None)}

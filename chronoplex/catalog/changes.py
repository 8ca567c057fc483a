"""Batch mutations, and the table steps of readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import promote
from ..model import validate
from ..operators import mutate as M
from ..operators.series import entity_series
from ..sources import matrices as X, readers
from ..sources.warehouse import EVENT_SCHEMA, ORDER_SCHEMA, empty_map, order_graph, signal_graph, table
from .registry import day_text, query, r6


def _kinds(spark, d) -> list[str]:
    """The event types of the table: they become columns."""
    return [r[0] for r in table(spark, d, "events").select("event_type").distinct().orderBy("event_type").collect()]


def _nations(spark, d) -> list[int]:
    return [r[0] for r in table(spark, d, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]


def _node_rows(df, uid, label, props=None, ts=None):
    none = F.lit(None).cast("timestamp")
    return df.select(uid.alias("uid"), F.lit(label).alias("label"), none.alias("start_time"), none.alias("end_time"),
                     (props if props is not None else empty_map()).alias("props"), empty_map().alias("ts_ids"))


@query("io2_dense_ids", "SELECT uid, row_number() OVER (ORDER BY label, uid) AS dense_id FROM o_nodes")
def _(spark, d):
    return readers.dense_ids(order_graph(spark, d).nodes)


@query("io5_property_casting", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type IN ('true', '1', 'yes') AS flag, round(value, 6) AS v FROM events""")
def _(spark, d):
    e = table(spark, d, "events")
    text = F.get_json_object("props", "$.k")
    return e.select("event_id", readers.cast_value(text, "int").alias("k"), readers.cast_value(F.col("event_type"), "bool").alias("flag"),
                    r6(readers.cast_value(F.col("value").cast("string"), "float")).alias("v"))


@query("io6_synthetic_edge_ids", "SELECT 'Supplies_' || src || '_' || dst || '_' || strftime(start_time, '%Y-%m-%d') AS id, count(*) AS n FROM o_edges GROUP BY 1")
def _(spark, d):
    e = order_graph(spark, d).edges
    ids = e.select(readers.synthetic_edge_id(F.col("label"), F.col("src"), F.col("dst"), F.date_format("start_time", "yyyy-MM-dd")).alias("id"))
    return ids.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("io7_series_columns", "SELECT DISTINCT uid, variable AS property, ts_id FROM samples")
def _(spark, d):
    wide = signal_graph(spark, d).nodes.select(F.col("uid").alias("id"), *[F.col("ts_ids")[k].alias(f"{k}_ts_id") for k in _kinds(spark, d)])
    n = readers._elements(wide, readers.NODE_FIELDS, False, F.lit("User"))
    return n.select("uid", F.explode("ts_ids").alias("property", "ts_id"))


@query("io8_wide_readings", """
SELECT 'ts_speed_' || variable AS ts_id, strftime(TIMESTAMP '2012-03-01' + u.user_id::INT * INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S') AS ts, round(v, 2) AS value
FROM (SELECT user_id, event_type AS variable, max(value) AS v FROM events GROUP BY user_id, event_type) u WHERE v <> 0""")
def _(spark, d):
    e = table(spark, d, "events")
    kinds = _kinds(spark, d)
    wide = e.groupBy("user_id").agg(*[F.max(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in kinds])
    return X.wide_to_measurements(wide, "user_id", "speed", "2012-03-01").select("ts_id", day_text("ts").alias("ts"), "value")


@query("io9_adjacency", """
SELECT n1::VARCHAR AS src, n2::VARCHAR AS dst, count(*)::DOUBLE AS weight FROM (SELECT a.s_nationkey AS n1, c_nationkey AS n2 FROM lineitem JOIN supplier a ON a.s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)
WHERE n1 <> n2 GROUP BY n1, n2""")
def _(spark, d):
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    flows = (l.join(s, l.l_suppkey == s.s_suppkey).join(o, l.l_orderkey == o.o_orderkey).join(c, c.c_custkey == o.o_custkey))
    matrix = flows.groupBy("s_nationkey").agg(*[F.count_if(F.col("c_nationkey") == i).alias(str(i)) for i in _nations(spark, d)])
    return X.adjacency_to_edges(matrix, "s_nationkey").select("src", "dst", "weight")


@query("io10_locations", "SELECT uid, coalesce(CASE WHEN k % 2 = 0 THEN acctbal END, 0) AS lat, coalesce(CASE WHEN k % 2 = 0 THEN nationkey::DOUBLE END, 0) AS lon FROM u_nodes")
def _(spark, d):
    from ..functions.values import property_number

    n = signal_graph(spark, d).nodes
    places = n.filter(F.substring("uid", 2, 20).cast("int") % 2 == 0).select(
        F.col("uid").alias("sensor_id"), property_number(n, "acctbal").alias("latitude"), property_number(n, "nationkey").alias("longitude"))
    return X.with_locations(n.select("uid"), places)


@query("io11_free_flow", """
WITH q AS (SELECT ts_id, quantile_cont(value, 0.95) AS p FROM samples WHERE value <> 0 AND hour(ts) IN (22, 23, 0, 1, 2, 3, 4) GROUP BY ts_id), a AS (SELECT ts_id, quantile_cont(value, 0.95) AS p FROM samples WHERE value <> 0 GROUP BY ts_id)
SELECT a.ts_id, round(coalesce(q.p, a.p), 6) AS free_flow FROM a LEFT JOIN q ON q.ts_id = a.ts_id""")
def _(spark, d):
    return X.free_flow(signal_graph(spark, d, by_day=False).measurements).withColumn("free_flow", r6("free_flow"))


@query("io12_m1_upsert_nodes", """
SELECT uid, label FROM o_nodes WHERE label <> 'Supplier' UNION ALL SELECT 'S' || s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Depot' ELSE 'Supplier' END FROM supplier UNION ALL SELECT 'P' || p_partkey, 'Part' FROM part""")
def _(spark, d):
    g = order_graph(spark, d)
    depots = _node_rows(table(spark, d, "supplier").filter("s_suppkey % 2 = 0"), F.concat(F.lit("S"), "s_suppkey"), "Depot")
    parts = _node_rows(table(spark, d, "part"), F.concat(F.lit("P"), "p_partkey"), "Part")
    return M.create_nodes(g, depots.unionByName(parts))[0].nodes.select("uid", "label")


@query("io14_flattened_series", """
SELECT ts_id, variable, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(CASE WHEN variable = 'scaled' THEN CASE WHEN value > 50 THEN value / 2 ELSE 0 END ELSE value END, 6) AS value
FROM (SELECT ts_id, ts, value, unnest(['value', 'scaled']) AS variable FROM days)""")
def _(spark, d):
    m = signal_graph(spark, d).measurements
    wide = m.groupBy("ts_id").agg(F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("r")).select(
        "ts_id", F.col("r.ts").alias("ts"), F.col("r.value").alias("value"), F.transform("r.value", lambda v: F.when(v > 50, v / 2)).alias("scaled"))
    return M.flatten_series(wide, ["value", "scaled"]).select("ts_id", "variable", day_text("ts").alias("ts"), r6("value").alias("value"))


@query("m2_created_edges", """
SELECT uid, '' AS reason FROM o_edges UNION ALL
SELECT 'N' || c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'missing source or target' WHEN c_custkey NOT IN (SELECT o_custkey FROM orders) OR c_custkey % 200 >= 100 THEN 'unknown source or target' ELSE '' END FROM customer""")
def _(spark, d):
    g = order_graph(spark, d)
    c = table(spark, d, "customer")
    none = F.lit(None).cast("timestamp")
    new = c.select(F.concat(F.lit("N"), "c_custkey").alias("uid"), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("C"), "c_custkey")).alias("src"),
                   F.concat(F.when(F.col("c_custkey") % 200 < 100, "S").otherwise("Z"), (F.col("c_custkey") % 10).cast("string")).alias("dst"), F.lit("Prefers").alias("label"),
                   none.alias("start_time"), none.alias("end_time"), empty_map().alias("props"), empty_map().alias("ts_ids"))
    out, bad = M.create_edges(g, new)
    return out.edges.select("uid", F.lit("").alias("reason")).unionByName(bad.select("uid", "reason"))


@query("m3_set_properties", "SELECT uid, acctbal, CASE WHEN acctbal < 0 THEN 'low' ELSE segment END AS segment FROM o_nodes")
def _(spark, d):
    n = order_graph(spark, d).nodes
    low = n.filter(n.props["acctbal"].cast("double") < 0).select("uid", F.create_map(F.lit("segment"), F.lit("low")).alias("props"))
    merged = M.set_properties(n, low)
    return merged.select("uid", F.col("props")["acctbal"].cast("double").alias("acctbal"), F.col("props")["segment"].alias("segment"))


@query("m4_m10_added_series", """
SELECT 'ts_orders_C' || o_custkey AS ts_id, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d %H:%M:%S') AS ts, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2""")
def _(spark, d):
    g = order_graph(spark, d)
    monthly = table(spark, d, "orders").groupBy(F.concat(F.lit("C"), "o_custkey").alias("uid"), F.date_trunc("month", "o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("value"))
    g = M.add_series(g, "node", monthly.withColumn("variable", F.lit("orders")))
    return entity_series(g.nodes, g.measurements, "orders").select("ts_id", day_text("ts").alias("ts"), F.round("value", 2).alias("value"))


@query("m5_changed_validity", """
SELECT uid, strftime(CASE WHEN segment = 'BUILDING' THEN greatest(end_time, TIMESTAMP '2010-01-01') ELSE end_time END, '%Y-%m-%d') AS end_day, strftime(start_time, '%Y-%m-%d') AS start_day FROM o_nodes""")
def _(spark, d):
    n = order_graph(spark, d).nodes
    later = n.filter(n.props["segment"] == "BUILDING").select("uid", F.greatest("end_time", F.lit("2010-01-01").cast("timestamp")).alias("end_time"))
    out = M.extend_validity(n, later)
    return out.select("uid", F.date_format("end_time", "yyyy-MM-dd").alias("end_day"), F.date_format("start_time", "yyyy-MM-dd").alias("start_day"))


@query("m6_soft_delete", "SELECT uid, CASE WHEN acctbal < 0 THEN '1999-01-01' ELSE strftime(end_time, '%Y-%m-%d') END AS end_day FROM o_nodes")
def _(spark, d):
    n = order_graph(spark, d).nodes
    out = M.soft_delete(n, n.filter(n.props["acctbal"].cast("double") < 0), "1999-01-01")
    return out.select("uid", F.date_format("end_time", "yyyy-MM-dd").alias("end_day"))


@query("m6_hard_delete", """
WITH gone AS (SELECT uid FROM u_nodes WHERE acctbal < 2000) SELECT 'node' AS part, count(*) AS n FROM u_nodes WHERE uid NOT IN (SELECT uid FROM gone)
UNION ALL SELECT 'edge', count(*) FROM peers WHERE src NOT IN (SELECT uid FROM gone) AND dst NOT IN (SELECT uid FROM gone) UNION ALL SELECT 'sample', count(*) FROM days WHERE uid NOT IN (SELECT uid FROM gone)""")
def _(spark, d):
    g = signal_graph(spark, d)
    g = M.delete_nodes(g, g.nodes.filter(g.nodes.props["acctbal"].cast("double") < 2000))
    count = lambda df, p: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("part"), "n")
    return count(g.nodes, "node").unionByName(count(g.edges, "edge")).unionByName(count(g.measurements, "sample"))


@query("m7_validation", """
SELECT CASE WHEN length(text) = 0 THEN 'missing id' WHEN length(text) > 255 THEN 'id too long' WHEN doc_id % 2 = 0 THEN 'start is not before end' ELSE 'valid' END AS reason, count(*) AS n FROM documents GROUP BY 1""")
def _(spark, d):
    day = F.lit("2024-01-02").cast("timestamp")
    rows = table(spark, d, "documents").select(F.col("text").alias("uid"), F.lit("Doc").alias("label"), day.alias("start_time"),
                                               F.when(F.col("doc_id") % 2 == 0, day).alias("end_time"), empty_map().alias("props"), empty_map().alias("ts_ids"))
    good, bad = validate(rows)
    reasons = good.select(F.lit("valid").alias("reason")).unionByName(bad.select("reason"))
    return reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("m8_deleted_samples", "SELECT variable, count(*) AS n FROM samples WHERE NOT (variable IN ('view', 'click') AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10') GROUP BY variable")
def _(spark, d):
    m = M.delete_samples(signal_graph(spark, d, by_day=False).measurements, variables=["view", "click"], start="2024-01-05", end="2024-01-10")
    return m.groupBy("variable").agg(F.count(F.lit(1)).alias("n"))


@query("m10_append_and_update", """
WITH l AS (SELECT ts_id, max(ts) AS t FROM days GROUP BY ts_id), new AS (SELECT ts_id, variable, ts + INTERVAL 3 DAY AS ts, 1.0::DOUBLE AS value FROM days WHERE variable = 'view')
SELECT 'appended' AS kind, count(*) AS n FROM new JOIN l ON l.ts_id = new.ts_id WHERE ts > t UNION ALL SELECT 'rejected', count(*) FROM new JOIN l ON l.ts_id = new.ts_id WHERE ts <= t
UNION ALL SELECT 'updated', count(*) FROM days d JOIN new ON new.ts_id = d.ts_id AND new.ts = d.ts""")
def _(spark, d):
    m = signal_graph(spark, d).measurements
    new = m.filter("variable = 'view'").select("ts_id", "variable", (F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts"), F.lit(1.0).alias("value"))
    longer, late = M.append_samples(m, new)
    appended = longer.join(m, ["ts_id", "variable", "ts"], "left_anti")
    updated = M.update_samples(m.withColumn("value", F.lit(0.0)), new).filter("value = 1.0")
    count = lambda df, k: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n")
    return count(appended, "appended").unionByName(count(late, "rejected")).unionByName(count(updated, "updated"))


@query("m11_removed_property", "SELECT uid, nationkey::VARCHAR AS nationkey, NULL::VARCHAR AS acctbal FROM o_nodes")
def _(spark, d):
    n = M.remove_property(order_graph(spark, d).nodes, "acctbal", "static")
    return n.select("uid", F.col("props")["nationkey"].alias("nationkey"), F.col("props")["acctbal"].alias("acctbal"))


@query("m12_tags_and_computed", "SELECT uid, CASE WHEN acctbal > 0 THEN 'credit' ELSE 'debit' END AS side FROM o_nodes WHERE acctbal > 0")
def _(spark, d):
    n = order_graph(spark, d).nodes
    rich = M.add_tags(n.filter(n.props["acctbal"].cast("double") > 0), ["checked", "rich"])
    poor = M.add_tags(n.filter(n.props["acctbal"].cast("double") <= 0), ["checked"])
    tagged = M.has_tag(M.remove_tag(rich.unionByName(poor), "checked"), "rich")
    computed = M.set_computed(tagged, "side", F.lit("credit"))
    return computed.select("uid", M.get_computed("side").alias("side"))


@query("s7_promoted_properties", "SELECT uid, acctbal, nationkey FROM o_nodes WHERE acctbal BETWEEN 100 AND 900")
def _(spark, d):
    n = promote(order_graph(spark, d).nodes, {"acctbal": "double", "nationkey": "int"})
    return n.filter("acctbal BETWEEN 100 AND 900").select("uid", "acctbal", "nationkey")


# files: written from the tables, read back by the readers ------------------------------------------
def _folder(spark):
    import uuid

    from ..plans.lineage import scratch_root

    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


_GRAPH_SUMS = """
SELECT 'node' AS part, count(*) AS n, round(sum(acctbal), 2) AS total FROM u_nodes UNION ALL SELECT 'edge', count(*), round(sum(weight), 2) FROM peers
UNION ALL SELECT 'sample', count(*), round(sum(value), 2) FROM days"""


def _sums(g):
    number = lambda c: F.col("props")[c].cast("double")
    part = lambda df, name, x: df.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(x), 2).alias("total")).select(F.lit(name).alias("part"), "n", "total")
    return part(g.nodes, "node", number("acctbal")).unionByName(part(g.edges, "edge", number("weight"))).unionByName(part(g.measurements, "sample", F.col("value")))


@query("io16_parquet_graph", _GRAPH_SUMS)
def _(spark, d):
    from ..sources.writers import read_graph, write_graph

    root = _folder(spark)
    write_graph(signal_graph(spark, d), root)
    return _sums(read_graph(spark, root))


@query("io4_io15_csv_graph", _GRAPH_SUMS)
def _(spark, d):
    g, root = signal_graph(spark, d), _folder(spark)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    kinds = _kinds(spark, d)
    nodes = g.nodes.select(F.col("uid").alias("id"), F.col("props")["acctbal"].alias("acctbal"), text("start_time").alias("start_time"), *[F.col("ts_ids")[k].alias(f"{k}_ts_id") for k in kinds])
    nodes.write.csv(f"{root}/nodes/User.csv", header=True)
    g.edges.select(F.col("src").alias("start_id"), F.col("dst").alias("end_id"), F.col("props")["weight"].alias("weight")).write.csv(f"{root}/edges/Peer.csv", header=True)
    g.measurements.select("ts_id", "variable", text("ts").alias("timestamp"), "value").write.csv(f"{root}/measurements.csv", header=True)
    return _sums(readers.read_csv_graph(spark, root, ["User"], ["Peer"]))


@query("io1_io15_json_graph", _GRAPH_SUMS)
def _(spark, d):
    g, root = signal_graph(spark, d), _folder(spark)
    points = entity_series(g.nodes, g.measurements).groupBy("uid", "property").agg(
        F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("start"), "value")).alias("p"))  # at most one per day
    kinds = _kinds(spark, d)
    series = points.groupBy("uid").pivot("property", kinds).agg(F.first("p"))
    nodes = g.nodes.join(series, "uid").select(F.col("uid").alias("user"), F.col("props")["acctbal"].alias("acctbal"), F.struct(*kinds).alias("ts"))
    nodes.write.json(f"{root}/nodes/User.json")
    ghosts = g.edges.withColumn("dst", F.concat(F.lit("ghost"), "dst"))
    g.edges.unionByName(ghosts).select(F.col("src").alias("from"), F.col("dst").alias("to"), F.col("props")["weight"].alias("weight")).write.json(f"{root}/edges/Peer.json")
    return _sums(readers.read_json_graph(spark, root, ["User"], ["Peer"], node_fields={"id": ("user",)}, multi_line=False))


@query("x2_saved_subgraphs", """
SELECT 'rich' AS subgraph, count(*) AS n_nodes FROM u_nodes WHERE acctbal > 5000 UNION ALL SELECT 'low_nations', count(*) FROM u_nodes WHERE nationkey < 5""")
def _(spark, d):
    from ..operators import subgraph as sub

    g, root = signal_graph(spark, d), _folder(spark)
    q = g.query().nodes("User")
    sub.save_members(q.where_static("acctbal", ">", 5000).ids(), root, "rich")
    sub.save_members(q.where_static("nationkey", "<", 5).ids(), root, "low_nations")
    return sub.list_subgraphs(spark, root)


@query("io12_io13_last_of_a_batch", """
WITH d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, * FROM events)
SELECT 'ts_' || event_type || '_' || user_id AS ts_id, strftime(day, '%Y-%m-%d %H:%M:%S') AS ts, round(arg_max(value, event_id), 6) AS value
FROM d GROUP BY event_type, user_id, day""")
def _(spark, d):
    events = table(spark, d, "events", EVENT_SCHEMA)
    new = events.select(F.concat(F.lit("ts_"), "event_type", F.lit("_"), "user_id").alias("ts_id"), F.col("event_type").alias("variable"),
                        F.date_trunc("day", "ts").alias("ts"), "value", "event_id")
    m = M.upsert_samples(signal_graph(spark, d).measurements, new, order="event_id")
    return m.select("ts_id", day_text("ts").alias("ts"), r6("value").alias("value"))


@query("m3_m5_changes_with_duplicates", """
WITH last AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k, arg_max(o_orderdate, (o_orderdate, o_orderkey)) AS e FROM orders GROUP BY o_custkey)
SELECT uid, k::VARCHAR AS last_order, strftime(e, '%Y-%m-%d %H:%M:%S') AS end_time FROM o_nodes JOIN last ON uid = 'C' || o_custkey""")
def _(spark, d):
    orders = table(spark, d, "orders", ORDER_SCHEMA)
    rows = orders.select(F.concat(F.lit("C"), "o_custkey").alias("uid"), F.create_map(F.lit("last_order"), F.col("o_orderkey").cast("string")).alias("props"),
                         F.lit(None).cast("timestamp").alias("start_time"), F.col("o_orderdate").alias("end_time"), F.struct("o_orderdate", "o_orderkey").alias("arrival"))
    nodes = M.set_properties(order_graph(spark, d).nodes, rows.select("uid", "props", "arrival"), order="arrival")
    nodes = M.change_validity(nodes, rows.drop("props"), order="arrival")
    return nodes.filter(F.col("props")["last_order"].isNotNull()).select("uid", F.col("props")["last_order"].alias("last_order"), day_text("end_time").alias("end_time"))


@query("m10_append_in_batch_order", """
WITH l AS (SELECT 'ts_' || event_type || '_' || user_id AS ts_id, max(date_trunc('day', ts)) AS t FROM events GROUP BY 1),
new AS (SELECT 'ts_' || event_type || '_' || user_id AS ts_id, ts + INTERVAL 15 DAY AS ts, event_id FROM events),
seen AS (SELECT *, max(ts) OVER (PARTITION BY ts_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM new)
SELECT ts_id, count(*) FILTER (WHERE seen.ts > t AND (b IS NULL OR seen.ts > b)) AS appended,
       count(*) FILTER (WHERE NOT (seen.ts > t AND (b IS NULL OR seen.ts > b))) AS rejected FROM seen JOIN l USING (ts_id) GROUP BY ts_id""")
def _(spark, d):
    m = signal_graph(spark, d).measurements
    events = table(spark, d, "events", EVENT_SCHEMA)
    new = events.select(F.concat(F.lit("ts_"), "event_type", F.lit("_"), "user_id").alias("ts_id"), F.col("event_type").alias("variable"),
                        (F.col("ts") + F.expr("INTERVAL 15 DAYS")).alias("ts"), "value", "event_id")
    longer, late = M.append_samples(m, new, order="event_id")
    size = lambda df, name: df.groupBy("ts_id").agg(F.count(F.lit(1)).alias(name))
    grown = size(longer, "after").join(size(m, "before"), "ts_id").join(size(late, "rejected"), "ts_id", "left")
    return grown.select("ts_id", (F.col("after") - F.col("before")).alias("appended"), F.coalesce("rejected", F.lit(0)).cast("long").alias("rejected"))

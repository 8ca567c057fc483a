"""Lookups on elements, static and series filters, subgraphs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import scans, series as S, subgraph as X
from ..operators.temporal import intervals_overlap, overlapping, valid_at
from ..functions.values import property_number, property_or
from ..sources.warehouse import order_graph, signal_graph
from .registry import day_text, query, r6

AT = "1996-06-15"


@query("s1_nodes_by_label", "SELECT uid, acctbal FROM o_nodes WHERE label = 'Supplier'")
def _(spark, d):
    n = scans.with_label(order_graph(spark, d).nodes, "Supplier")
    return n.select("uid", property_number(n, "acctbal").alias("acctbal"))


@query("s2_valid_at", f"""
SELECT uid, label FROM o_nodes WHERE (start_time IS NULL OR start_time <= TIMESTAMP '{AT}') AND (end_time IS NULL OR end_time >= TIMESTAMP '{AT}')""")
def _(spark, d):
    return valid_at(order_graph(spark, d).nodes, AT).select("uid", "label")


@query("s3_overlapping", """
SELECT uid, src, dst FROM o_edges WHERE start_time <= TIMESTAMP '1996-02-01' AND end_time >= TIMESTAMP '1996-01-01'""")
def _(spark, d):
    return overlapping(order_graph(spark, d).edges, "1996-01-01", "1996-02-01").select("uid", "src", "dst")


@query("s4_interval_overlap_pairs", """
SELECT e.uid, e.start_time > n.start_time AS starts_inside FROM o_edges e JOIN o_nodes n ON e.dst = n.uid
WHERE e.start_time <= n.end_time AND e.end_time >= n.start_time AND e.end_time > n.end_time""")
def _(spark, d):
    g = order_graph(spark, d)
    e, n = g.edges.alias("e"), g.nodes.alias("n")
    meets = intervals_overlap(F.col("e.start_time"), F.col("e.end_time"), F.col("n.start_time"), F.col("n.end_time"))
    both = e.join(n, F.col("e.dst") == F.col("n.uid")).filter(meets & (F.col("e.end_time") > F.col("n.end_time")))
    return both.select("e.uid", (F.col("e.start_time") > F.col("n.start_time")).alias("starts_inside"))


@query("s5_edges_by_source_and_time", """
SELECT uid, dst FROM o_edges WHERE src = 'S3' AND label = 'Supplies' AND start_time <= TIMESTAMP '1997-01-01' AND end_time >= TIMESTAMP '1997-01-01'""")
def _(spark, d):
    e = scans.edges_where(order_graph(spark, d).edges, "Supplies", source="S3")
    return valid_at(e, "1997-01-01").select("uid", "dst")


@query("s6_node_by_id", "SELECT uid, label FROM o_nodes WHERE uid = 'C7'")
def _(spark, d):
    return scans.by_id(order_graph(spark, d).nodes, "C7").select("uid", "label")


@query("s7_property_with_default", "SELECT uid, coalesce(segment, 'none') AS segment FROM o_nodes")
def _(spark, d):
    n = order_graph(spark, d).nodes
    return n.select("uid", property_or(n, "segment", "none").alias("segment"))


@query("s8_neighbours", """
SELECT DISTINCT uid, neighbour FROM (SELECT src AS uid, dst AS neighbour FROM peers UNION ALL SELECT dst, src FROM peers)""")
def _(spark, d):
    return scans.neighbours(signal_graph(spark, d).edges)


@query("s8_neighbours_of_some", """
SELECT DISTINCT src AS uid, dst AS neighbour FROM o_edges WHERE src IN (SELECT uid FROM o_nodes WHERE label = 'Supplier' AND acctbal > 9000)""")
def _(spark, d):
    g = order_graph(spark, d)
    rich = scans.where_static(scans.with_label(g.nodes, "Supplier"), "acctbal", ">", 9000)
    return scans.neighbours(g.edges, rich, "out")


@query("s9_edges_between_pair", "SELECT uid FROM o_edges WHERE src = 'S12' AND dst = 'C1250'")
def _(spark, d):
    return scans.between_pair(order_graph(spark, d).edges, "S12", "C1250").select("uid")


@query("s10_s11_label_histogram", """
SELECT 'node' AS kind, label, count(*) AS n FROM o_nodes GROUP BY label UNION ALL SELECT 'edge', label, count(*) FROM o_edges GROUP BY label""")
def _(spark, d):
    g = order_graph(spark, d)
    return scans.label_histogram(g.nodes, g.edges)


@query("s12_keyword_filter", "SELECT uid FROM o_nodes WHERE label = 'Customer' AND segment = 'MACHINERY' AND acctbal > 5000")
def _(spark, d):
    g = order_graph(spark, d)
    q = g.query().nodes("Customer").where(segment="MACHINERY")
    return q.where(property_number(g.nodes, "acctbal") > 5000).execute().select("uid")


@query("s13_static_comparisons", """
SELECT uid FROM o_nodes WHERE label = 'Customer' AND acctbal <= 1500 AND abs(nationkey - 5) >= 1e-9 AND segment <> 'BUILDING'""")
def _(spark, d):
    q = order_graph(spark, d).query().nodes("Customer").where_static("acctbal", "<=", 1500)
    return q.where_static("nationkey", "!=", "5.0").where_static("segment", "!=", "BUILDING").execute().select("uid")


@query("s14_id_contains", "SELECT uid FROM o_nodes WHERE lower(uid) LIKE '%c11%'")
def _(spark, d):
    return scans.id_contains(order_graph(spark, d).nodes, "C11").select("uid")


@query("s15_text_operators", """
SELECT uid FROM o_nodes WHERE segment LIKE '%UILD%' OR segment LIKE 'AUTO%'""")
def _(spark, d):
    q = order_graph(spark, d).query().nodes()
    a = q.where_static("segment", "contains", "UILD").execute()
    return a.unionByName(q.where_static("segment", "starts_with", "AUTO").execute()).select("uid")


@query("s18_value_as_of_filter", """
SELECT uid FROM (SELECT uid, arg_max(value, ts) AS v FROM samples WHERE variable = 'click' AND ts <= TIMESTAMP '2024-01-15' GROUP BY uid) WHERE v > 80""")
def _(spark, d):
    q = signal_graph(spark, d, by_day=False).query().nodes("User")
    return q.where_value_as_of("click", "2024-01-15", ">", 80).execute().select("uid")


@query("s21_s22_order_and_limit", """
SELECT uid, acctbal FROM o_nodes WHERE label = 'Customer' ORDER BY acctbal DESC, uid LIMIT 25""")
def _(spark, d):
    top = order_graph(spark, d).query().nodes("Customer").order_by("acctbal", descending=True).limit(25).execute()
    return top.select("uid", property_number(top, "acctbal").alias("acctbal"))


@query("s23_edges_among_matches", """
WITH m AS (SELECT uid FROM u_nodes WHERE acctbal > 3000)
SELECT uid, src, dst FROM peers WHERE src IN (SELECT uid FROM m) AND dst IN (SELECT uid FROM m)""")
def _(spark, d):
    g = signal_graph(spark, d)
    return scans.edges_among(g.edges, g.query().nodes("User").where_static("acctbal", ">", 3000).ids()).select("uid", "src", "dst")


@query("s24_geographic_centre", """
SELECT round(avg(nationkey), 6) AS lat, round(avg(acctbal / 100), 6) AS lng FROM o_nodes WHERE label = 'Customer'""")
def _(spark, d):
    n = scans.with_label(order_graph(spark, d).nodes, "Customer")
    placed = n.withColumns({"latitude": n.props["nationkey"].cast("double"), "lon": n.props["acctbal"].cast("double") / 100})
    c = scans.geographic_centre(placed)
    return c.select(r6("lat").alias("lat"), r6("lng").alias("lng"))


@query("s26_self_loops", """
WITH e AS (SELECT uid, src, CASE WHEN weight > 0.5 THEN src ELSE dst END AS dst FROM peers) SELECT uid FROM e WHERE src = dst""")
def _(spark, d):
    e = signal_graph(spark, d).edges
    looped = e.withColumn("dst", F.when(property_number(e, "weight") > 0.5, F.col("src")).otherwise(F.col("dst")))
    return scans.self_loops(looped).select("uid")


@query("s27_documents_round_trip", "SELECT uid, label, acctbal::VARCHAR AS acctbal FROM o_nodes")
def _(spark, d):
    from ..model import NODE_SCHEMA

    back = scans.from_documents(scans.to_documents(order_graph(spark, d).nodes), NODE_SCHEMA)
    return back.select("uid", "label", F.col("props")["acctbal"].alias("acctbal"))


@query("s27_series_documents", """
SELECT ts_id, variable, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(value, 6) AS value, uid AS owner_id FROM days""")
def _(spark, d):
    documents = scans.series_to_documents(signal_graph(spark, d), part_length=16)
    owner = documents.select("ts_id", F.get_json_object("document", "$.metadata.owner_id").alias("owner_id")).distinct()
    back = scans.series_from_documents(documents).join(owner, "ts_id")
    return back.select("ts_id", "variable", day_text("ts").alias("ts"), r6("value").alias("value"), "owner_id")


@query("s12_typed_properties", """
SELECT 'node' AS kind, uid FROM o_nodes WHERE acctbal > 5000 AND segment = 'BUILDING' UNION ALL SELECT 'edge', uid FROM o_edges WHERE quantity >= 45 AND n_lines = 1""")
def _(spark, d):
    import uuid

    from ..plans.lineage import scratch_folder
    from ..sources.writers import read_graph, write_graph

    root = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    typed = order_graph(spark, d).add_property_columns(nodes={"acctbal": "double", "segment": "string"}, edges={"quantity": "double", "lines": "int"})
    write_graph(typed, root)
    g = read_graph(spark, root)
    nodes = g.query().nodes().where_static("acctbal", ">", 5000).where_static("segment", "=", "BUILDING").execute()
    edges = g.query().edges().where_static("quantity", ">=", 45).where_static("lines", "=", 1).execute()
    return nodes.select(F.lit("node").alias("kind"), "uid").unionByName(edges.select(F.lit("edge").alias("kind"), "uid"))


@query("s28_edge_report", """
SELECT uid, src, dst, round(price, 6) AS price FROM o_edges WHERE quantity >= 50 AND lower(uid) LIKE '%s1%' AND start_time >= TIMESTAMP '1998-01-01'""")
def _(spark, d):
    q = order_graph(spark, d).query().edges("Supplies").where_static("quantity", ">=", 50).id_contains("S1")
    e = q.where(F.col("start_time") >= "1998-01-01").execute()
    return e.select("uid", "src", "dst", r6(property_number(e, "price")).alias("price"))


@query("f1_ts_agg_filter", """
SELECT uid FROM samples WHERE variable = 'view' GROUP BY uid HAVING avg(value) < 45""")
def _(spark, d):
    return signal_graph(spark, d, by_day=False).query().nodes("User").where_ts_agg("view", "mean", "<", 45).execute().select("uid")


@query("f1_two_series_and_static", """
SELECT uid FROM u_nodes WHERE acctbal > 1000 AND uid IN (SELECT uid FROM samples WHERE variable = 'view' GROUP BY uid HAVING max(value) > 150 AND count(*) >= 10)
AND uid IN (SELECT uid FROM samples WHERE variable = 'click' GROUP BY uid HAVING quantile_cont(value, 0.5) > 25)""")
def _(spark, d):
    q = signal_graph(spark, d, by_day=False).query().nodes("User").where_static("acctbal", ">", 1000)
    q = q.where_ts_agg("view", "max", ">", 150).where_ts_agg("view", "count", ">=", 10).where_ts_agg("click", "median", ">", 25)
    return q.execute().select("uid")


@query("f1_edge_series", """
WITH e AS (SELECT p.uid, p.src FROM peers p) SELECT e.uid FROM e JOIN (SELECT uid, stddev_pop(value) AS sd FROM days WHERE variable = 'error' GROUP BY uid) s ON s.uid = e.src WHERE sd > 40""")
def _(spark, d):
    g = signal_graph(spark, d)
    ids = F.create_map(F.lit("load"), F.concat(F.lit("ts_error_"), F.substring("src", 2, 20)))
    g = g.with_(edges=g.edges.withColumn("ts_ids", ids))
    return g.query().edges("Peer").where_ts_agg("load", "std", ">", 40).execute().select("uid")


_BUCKETS = """
WITH b AS (SELECT uid, time_bucket(INTERVAL 5 DAY, ts, TIMESTAMP '2000-01-03') AS w, avg(value) AS v FROM samples WHERE variable = 'purchase' {range} GROUP BY 1, 2)
SELECT uid FROM b GROUP BY uid HAVING {having}"""


@query("f2_bucketed_all", _BUCKETS.format(range="", having="bool_and(v > 20)"))
def _(spark, d):
    return _bucketed(spark, d, "all", 20)


@query("f2_bucketed_any", _BUCKETS.format(range="AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'", having="bool_or(v > 90)"))
def _(spark, d):
    return _bucketed(spark, d, "any", 90, start="2024-01-05", end="2024-01-20")


@query("f2_bucketed_majority", _BUCKETS.format(range="", having="avg((v > 45)::INT) > 0.5"))
def _(spark, d):
    return _bucketed(spark, d, "majority", 45)


@query("f2_bucketed_average", _BUCKETS.format(range="", having="avg(v) > 50"))
def _(spark, d):
    return _bucketed(spark, d, "avg", 50)


def _bucketed(spark, d, condition, value, **times):
    q = signal_graph(spark, d, by_day=False).query().nodes("User")
    return q.where_ts_bucketed("purchase", "5 days", "avg", condition, ">", value, **times).execute().select("uid")


@query("f3_compare_two_series", """
SELECT a.uid FROM (SELECT uid, max(value) AS v FROM samples WHERE variable = 'click' GROUP BY uid) a
JOIN (SELECT uid, avg(value) * 1 AS v FROM samples WHERE variable = 'view' GROUP BY uid) b ON a.uid = b.uid WHERE a.v > b.v""")
def _(spark, d):
    q = signal_graph(spark, d, by_day=False).query().nodes("User")
    return q.where_ts_compare("click", "max", ">", "view", "mean").execute().select("uid")


@query("f5_similar_to_reference", """
WITH r AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM samples WHERE ts_id = 'ts_view_3'),
s AS (SELECT uid, avg(value) AS m, stddev_pop(value) AS sd FROM samples WHERE variable = 'view' GROUP BY uid)
SELECT s.uid FROM s, r WHERE abs(s.m - r.m) / abs(r.m) <= 0.2 AND abs(s.sd - r.sd) / abs(r.sd) <= 0.2""")
def _(spark, d):
    g = signal_graph(spark, d, by_day=False)
    reference = g.measurements.filter("ts_id = 'ts_view_3'")
    return g.query().nodes("User").where_ts_similar("view", reference=reference, tolerance={"mean": 0.2, "std": 0.2}).execute().select("uid")


@query("f6_similar_features", """
SELECT uid FROM samples WHERE variable = 'view' GROUP BY uid HAVING abs(avg(value) - 48) / 48 <= 0.1 AND abs(stddev_pop(value) - 48) / 48 <= 0.3""")
def _(spark, d):
    q = signal_graph(spark, d, by_day=False).query().nodes("User")
    return q.where_ts_similar("view", features={"mean": 48, "std": 48}, tolerance={"std": 0.3}).execute().select("uid")


_SHAPES = {
    "increasing": "arg_max(value, ts) > arg_min(value, ts)", "decreasing": "arg_max(value, ts) < arg_min(value, ts)",
    "stable": "stddev_pop(value) / abs(avg(value)) < 0.1", "spike": "max(value) - avg(value) > 2 * stddev_pop(value)",
    "drop": "avg(value) - min(value) > 2 * stddev_pop(value)", "drop_by_150": "max(value) - min(value) >= 150",
    "increase_by_50": "arg_max(value, ts) - arg_min(value, ts) >= 50",
}


@query("f7_named_shapes", " UNION ALL ".join(
    f"SELECT '{k}' AS shape, uid FROM samples WHERE variable = 'error' GROUP BY uid HAVING {v}" for k, v in _SHAPES.items()))
def _(spark, d):
    q = signal_graph(spark, d, by_day=False).query().nodes("User")
    parts = [q.where_ts_similar("error", shape=s).execute().select(F.lit(s).alias("shape"), "uid") for s in _SHAPES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_KINDS = [
    (dict(type="aggregation", aggregation="sum", operator=">", value=900), "sum(value) > 900"),
    (dict(type="first", operator="<", value=30), "arg_min(value, ts) < 30"),
    (dict(type="last", operator=">=", value=60), "arg_max(value, ts) >= 60"),
    (dict(type="range", operator=">", value=180), "max(value) - min(value) > 180"),
    (dict(type="change", operator=">", value=20), "arg_max(value, ts) - arg_min(value, ts) > 20"),
    (dict(type="trend", value=-1), "arg_max(value, ts) < arg_min(value, ts)"),
    (dict(type="volatility", operator=">", value=1.1), "stddev_pop(value) / abs(avg(value)) > 1.1"),
    (dict(type="count_above", value=200), "count(*) FILTER (value > 200) > 0"),
    (dict(type="count_below", value=1), "count(*) FILTER (value < 1) > 0"),
    (dict(type="percent_above", value=40), "avg((value > 40)::INT) >= 0.5"),
    (dict(type="percent_below", value=10, threshold=0.3), "avg((value < 10)::INT) >= 0.3"),
    (dict(type="similar_template", template="spike"), "max(value) - avg(value) > 2 * stddev_pop(value)"),
    (dict(type="value_at", timestamp="2024-01-15T00:00:00Z", operator=">", value=70),
     "arg_min(value, abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15'))) > 70"),
]


@query("f9_declared_constraints", " UNION ALL ".join(
    f"SELECT '{c['type']}' AS kind, uid FROM samples WHERE variable = 'signup' GROUP BY uid HAVING {sql}" for c, sql in _KINDS))
def _(spark, d):
    q = signal_graph(spark, d, by_day=False).query().nodes("User")
    out = None
    for c, _sql in _KINDS:
        part = q.constrain(property="signup", **c).execute().select(F.lit(c["type"]).alias("kind"), "uid")
        out = part if out is None else out.unionByName(part)
    return out


@query("f10_any_condition_on_aggregates", """
SELECT uid FROM samples WHERE variable = 'view' GROUP BY uid HAVING max(value) > 4 * avg(value) OR arg_max(value, ts) = min(value)""")
def _(spark, d):
    q = signal_graph(spark, d, by_day=False).query().nodes("User")
    return q.where_ts("view", ["max", "mean", "last", "min"], lambda s: (s("max") > 4 * s("mean")) | (s("last") == s("min"))).execute().select("uid")


@query("f11_x1_subgraph_of_query", """
WITH m AS (SELECT uid FROM days WHERE variable = 'view' GROUP BY uid HAVING max(value) > 160)
SELECT 'node' AS part, count(*) AS n FROM u_nodes WHERE uid IN (SELECT uid FROM m)
UNION ALL SELECT 'edge', count(*) FROM peers WHERE src IN (SELECT uid FROM m) AND dst IN (SELECT uid FROM m)
UNION ALL SELECT 'sample', count(*) FROM days WHERE uid IN (SELECT uid FROM m)""")
def _(spark, d):
    sub = signal_graph(spark, d).query().nodes("User").where_ts_agg("view", "max", ">", 160).as_subgraph()
    parts = [("node", sub.nodes), ("edge", sub.edges), ("sample", sub.measurements)]
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("part"), "n") for p, df in parts]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("x1_subgraph_edges", """
WITH m AS (SELECT uid FROM o_nodes WHERE nationkey IN (1, 2, 3)) SELECT uid FROM o_edges WHERE src IN (SELECT uid FROM m) AND dst IN (SELECT uid FROM m)""")
def _(spark, d):
    g = order_graph(spark, d)
    ids = g.nodes.filter(property_number(g.nodes, "nationkey").isin(1, 2, 3))
    return g.subgraph(ids).edges.select("uid")


@query("x2_missing_members", """
SELECT 'C' || p_partkey AS uid FROM part WHERE p_partkey NOT IN (SELECT o_custkey FROM orders)""")
def _(spark, d):
    from ..sources.warehouse import table

    wanted = table(spark, d, "part").select(F.concat(F.lit("C"), "p_partkey").alias("uid"))
    return X.missing_members(order_graph(spark, d), wanted)


@query("m13_covering_members", """
SELECT uid FROM o_nodes WHERE (start_time IS NULL OR start_time <= TIMESTAMP '1996-01-01') AND (end_time IS NULL OR end_time >= TIMESTAMP '2000-01-01')""")
def _(spark, d):
    return X.covers(order_graph(spark, d).nodes, "1996-01-01", "2000-01-01").select("uid")


@query("udf1_python_predicate", "SELECT uid FROM u_nodes WHERE round(sqrt(abs(acctbal))) % 2 = 0")
def _(spark, d):
    even_root = lambda balance: np.round(np.sqrt(balance.astype(float).abs())) % 2 == 0
    return signal_graph(spark, d).query().nodes("User").where_python(even_root, ["acctbal"]).execute().select("uid")

"""Snapshots, sequences, graph metrics, generated series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import metrics as G, scans
from ..operators.temporal import granularity, granularity_label
from ..plans.lineage import cut
from ..sources.warehouse import order_graph, signal_graph
from .registry import day_text, query, r6

AT = "1996-06-15"
DAY = dt.timedelta(days=1)


def _month(spark, d):
    return order_graph(spark, d).snapshot_sequence("1996-01-01", "1996-01-31", DAY)


def _weeks(spark, d):
    return order_graph(spark, d).snapshot_sequence("1996-01-01", "1996-02-26", dt.timedelta(days=7))


def _years(spark, d, every=DAY, ends_only=False):
    """Every day, or other step, from the first start to the last end of the order graph's edges.

    With ``ends_only`` the edges are ends and validity, written once for the span and for what reads them after it.
    """
    g = order_graph(spark, d)
    if ends_only:
        g = g.with_(edges=cut(g.edges.select("src", "dst", "start_time", "end_time")))
    span = g.edges.agg(F.date_format(F.min("start_time"), "yyyy-MM-dd").alias("a"), F.date_format(F.max("end_time"), "yyyy-MM-dd").alias("b")).first()
    return g.snapshot_sequence(span.a, span.b, every)


def _valid(alias: str, t: str = "t") -> str:
    return f"({alias}.start_time IS NULL OR {alias}.start_time <= {t}) AND ({alias}.end_time IS NULL OR {alias}.end_time >= {t})"


_AT = f"TIMESTAMP '{AT}'"


@query("n1_point_snapshot", f"""
SELECT 'node' AS kind, uid FROM o_nodes n WHERE {_valid('n', _AT)} UNION ALL SELECT 'edge', uid FROM o_edges e WHERE {_valid('e', _AT)}""")
def _(spark, d):
    s = order_graph(spark, d).snapshot(at=AT, mode="graph")
    return s.nodes.select(F.lit("node").alias("kind"), "uid").unionByName(s.edges.select(F.lit("edge").alias("kind"), "uid"))


@query("n2_hybrid_snapshot", """
SELECT ids.uid AS owner, ids.variable AS property, v.value FROM (SELECT DISTINCT uid, variable, ts_id FROM samples) ids
LEFT JOIN (SELECT ts_id, arg_max(value, ts) AS value FROM samples WHERE ts <= TIMESTAMP '2024-01-05' GROUP BY ts_id) v ON v.ts_id = ids.ts_id""")
def _(spark, d):
    return signal_graph(spark, d, by_day=False).snapshot(at="2024-01-05").values.select("owner", "property", "value")


@query("n2_resolved_elements", """
SELECT uid, max(value) FILTER (variable = 'click') AS click, max(value) FILTER (variable = 'view') AS view FROM (
  SELECT u.uid, s.variable, arg_max(s.value, s.ts) AS value FROM u_nodes u LEFT JOIN samples s ON s.uid = u.uid AND s.ts <= TIMESTAMP '2024-01-05' GROUP BY u.uid, s.variable) GROUP BY uid""")
def _(spark, d):
    r = signal_graph(spark, d, by_day=False).snapshot(at="2024-01-05").resolved("node")
    return r.select("uid", F.col("values")["click"].alias("click"), F.col("values")["view"].alias("view"))


@query("n3_interval_snapshot", """
SELECT uid, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS valid_from, strftime(end_time, '%Y-%m-%d %H:%M:%S') AS valid_to FROM o_edges
WHERE start_time <= TIMESTAMP '1996-01-31' AND end_time >= TIMESTAMP '1996-01-01'""")
def _(spark, d):
    s = order_graph(spark, d).snapshot(between=("1996-01-01", "1996-01-31"), mode="graph")
    return s.edges.select("uid", day_text("start_time").alias("valid_from"), day_text("end_time").alias("valid_to"))


@query("n4_interval_aggregate", """
SELECT ids.uid AS owner, ids.variable AS property, round(v.value, 6) AS value FROM (SELECT DISTINCT uid, variable, ts_id FROM samples) ids LEFT JOIN (
  SELECT ts_id, avg(value) AS value FROM samples WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-06' GROUP BY ts_id) v ON v.ts_id = ids.ts_id""")
def _(spark, d):
    s = signal_graph(spark, d, by_day=False).snapshot(between=("2024-01-03", "2024-01-06"), aggregate="mean")
    return s.values.select("owner", "property", r6("value").alias("value"))


@query("n5_n7_interval_slice", """
SELECT ids.uid AS owner, ids.variable AS property, strftime(v.ts, '%Y-%m-%d %H:%M:%S') AS ts, v.value FROM (SELECT DISTINCT uid, variable, ts_id FROM samples) ids
LEFT JOIN (SELECT ts_id, ts, value FROM samples WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-06') v ON v.ts_id = ids.ts_id""")
def _(spark, d):
    s = signal_graph(spark, d, by_day=False).snapshot(between=("2024-01-03", "2024-01-06"))
    return s.values.select("owner", "property", day_text("ts").alias("ts"), "value")


@query("n8_snapshot_counts", """
SELECT (SELECT count(*) FROM u_nodes) AS n_nodes, (SELECT count(*) FROM peers) AS n_edges, (SELECT count(DISTINCT ts_id) FROM samples) AS n_series""")
def _(spark, d):
    return signal_graph(spark, d).snapshot(at="2024-01-05", mode="graph").counts()


@query("n9_snapshot_documents", f"""
SELECT 'node' AS kind, count(*) AS n FROM o_nodes n WHERE {_valid('n', _AT)} UNION ALL SELECT 'edge', count(*) FROM o_edges e WHERE {_valid('e', _AT)}""")
def _(spark, d):
    docs = order_graph(spark, d).snapshot(at=AT, mode="graph").documents()
    return docs.filter(F.get_json_object("document", "$.uid").isNotNull()).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("n11_sequence_edges", f"SELECT step, e.uid FROM week_grid JOIN o_edges e ON {_valid('e')}")
def _(spark, d):
    return _weeks(spark, d).edges().select("step", "uid")


@query("n11_sequence_values", """
SELECT j.step, ids.ts_id, v.value FROM january j CROSS JOIN (SELECT DISTINCT ts_id FROM samples) ids LEFT JOIN (
  SELECT step, ts_id, arg_max(value, ts) AS value FROM january JOIN samples ON ts <= t GROUP BY step, ts_id) v ON v.step = j.step AND v.ts_id = ids.ts_id""")
def _(spark, d):
    seq = signal_graph(spark, d, by_day=False).snapshot_sequence("2024-01-01", "2024-01-31", "1D", mode="hybrid")
    return seq.values().select("step", "ts_id", "value")


@query("n12_sequence_window", f"""
SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS snap_ts, count(e.uid) AS n_edges FROM month_grid LEFT JOIN o_edges e ON {_valid('e')}
WHERE step BETWEEN 4 AND 11 GROUP BY t""")
def _(spark, d):
    seq = _month(spark, d).slice(3, 20).window("1996-01-04T12:00:00", "1996-01-14T06:00:00").head(9).head(8)
    return seq.summary().select(day_text("snap_ts").alias("snap_ts"), "n_edges")


_COUNTS = f"""
n AS (SELECT step, count(o.uid) AS n_nodes FROM month_grid LEFT JOIN o_nodes o ON {_valid('o')} GROUP BY step),
e AS (SELECT step, count(o.uid) AS n_edges FROM month_grid LEFT JOIN o_edges o ON {_valid('o')} GROUP BY step)"""


@query("n13_sequence_summary", f"WITH {_COUNTS} SELECT step, n_nodes, n_edges, 0::BIGINT AS n_series FROM n JOIN e USING (step)")
def _(spark, d):
    return _month(spark, d).summary().drop("snap_ts")


@query("n13_sequence_averages", f"""
WITH {_COUNTS} SELECT count(*) AS n_snapshots, round(avg(n_nodes), 6) AS avg_nodes, round(avg(n_edges), 6) AS avg_edges FROM n JOIN e USING (step)""")
def _(spark, d):
    return _month(spark, d).averages().select("n_snapshots", r6("avg_nodes").alias("avg_nodes"), r6("avg_edges").alias("avg_edges"))


@query("n14_granularities", """
SELECT '1H' AS label, count(DISTINCT date_trunc('hour', ts)) AS n FROM samples UNION ALL SELECT '6H', count(DISTINCT time_bucket(INTERVAL 6 HOUR, ts)) FROM samples
UNION ALL SELECT '1W', count(DISTINCT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '2000-01-03')) FROM samples""")
def _(spark, d):
    from ..operators.temporal import bucket_start

    m = signal_graph(spark, d, by_day=False).measurements
    steps = [granularity(x) for x in ("1H", "6H", "7D")]
    counts = [m.agg(F.countDistinct(bucket_start(F.col("ts"), s)).alias("n")).select(F.lit(granularity_label(s)).alias("label"), "n") for s in steps]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# metrics of one graph ----------------------------------------------------------------------------
_SNAP = f"""
sn AS (SELECT * FROM o_nodes o WHERE {_valid('o', _AT)}), se AS (SELECT * FROM o_edges o WHERE {_valid('o', _AT)})"""


def _snap(spark, d):
    return order_graph(spark, d).snapshot(at=AT, mode="graph")


@query("g1_density", f"""
WITH {_SNAP} SELECT n_nodes, n_edges, CASE WHEN n_nodes <= 1 THEN 0 ELSE round(n_edges / (n_nodes * (n_nodes - 1.0::DOUBLE)), 6) END AS density
FROM (SELECT (SELECT count(*) FROM sn) AS n_nodes, (SELECT count(*) FROM se) AS n_edges)""")
def _(spark, d):
    return _snap(spark, d).density().withColumn("density", r6("density"))


_UNDIRECTED = "pairs AS (SELECT src AS a, dst AS b FROM peers UNION SELECT dst, src FROM peers)"
_WEAK = f"""
WITH RECURSIVE {_UNDIRECTED}, reach(a, b) AS (SELECT uid, uid FROM u_nodes UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b),
comps AS (SELECT a AS uid, min(b) AS comp FROM reach GROUP BY a)"""


@query("g2_weak_components", f"{_WEAK} SELECT uid, comp FROM comps")
def _(spark, d):
    g = signal_graph(spark, d)
    return G.components(g.nodes, g.edges)


_STRONG = """
WITH RECURSIVE reach(a, b) AS (SELECT uid, uid FROM u_nodes UNION SELECT r.a, p.dst FROM reach r JOIN peers p ON p.src = r.b),
comps AS (SELECT x.a AS uid, min(x.b) AS comp FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"""


@query("g3_strong_components", f"{_STRONG} SELECT uid, min(uid) OVER (PARTITION BY comp) AS comp FROM comps")
def _(spark, d):
    g = signal_graph(spark, d)
    c = G.components(g.nodes, g.edges, directed=True)
    names = c.groupBy("comp").agg(F.min("uid").alias("name"))
    return c.join(names, "comp").select("uid", F.col("name").alias("comp"))


@query("g4_component_sizes", f"{_WEAK} SELECT comp, count(*) AS size FROM comps GROUP BY comp")
def _(spark, d):
    g = signal_graph(spark, d)
    return G.component_sizes(G.components(g.nodes, g.edges))


@query("g4_component_summary", f"""
{_STRONG} SELECT count(*) AS n_components, max(n) AS biggest, min(n) AS smallest FROM (SELECT comp, count(*) AS n FROM comps GROUP BY comp)""")
def _(spark, d):
    g = signal_graph(spark, d)
    return G.component_summary(G.components(g.nodes, g.edges, directed=True))


@query("g4_component_of_node", f"{_WEAK} SELECT uid FROM comps WHERE comp = (SELECT comp FROM comps WHERE uid = 'U7')")
def _(spark, d):
    g = signal_graph(spark, d)
    return G.component_of(G.components(g.nodes, g.edges), "U7").select("uid")


_ENDS = "ends AS (SELECT src AS uid FROM se UNION ALL SELECT dst FROM se)"


@query("g5_degrees", f"""
WITH {_SNAP}, {_ENDS}, c AS (SELECT uid, count(*) AS n FROM ends GROUP BY uid) SELECT sn.uid, coalesce(c.n, 0) AS degree FROM sn LEFT JOIN c ON c.uid = sn.uid""")
def _(spark, d):
    s = _snap(spark, d)
    return G.degrees(s.nodes, s.edges)


@query("g5_weighted_in_degree", f"""
WITH {_SNAP}, c AS (SELECT dst AS uid, sum(quantity) AS n FROM se GROUP BY dst) SELECT sn.uid, round(coalesce(c.n, 0), 6) AS degree FROM sn LEFT JOIN c ON c.uid = sn.uid""")
def _(spark, d):
    s = _snap(spark, d)
    return G.degrees(s.nodes, s.edges, "in", weight="quantity").withColumn("degree", r6("degree"))


@query("g6_degree_distribution", f"""
WITH {_SNAP}, {_ENDS}, c AS (SELECT uid, count(*) AS n FROM ends GROUP BY uid), f AS (SELECT coalesce(c.n, 0) AS degree FROM sn LEFT JOIN c ON c.uid = sn.uid)
SELECT degree, count(*) AS n_nodes FROM f GROUP BY degree""")
def _(spark, d):
    s = _snap(spark, d)
    return G.degree_distribution(s.nodes, s.edges)


@query("g7_label_induced", f"""
WITH {_SNAP}, l AS (SELECT uid FROM sn WHERE label = 'Customer') SELECT (SELECT count(*) FROM l) AS n_nodes,
(SELECT count(*) FROM se WHERE src IN (SELECT uid FROM l) AND dst IN (SELECT uid FROM l)) AS n_edges""")
def _(spark, d):
    return _snap(spark, d).with_labels("Customer").counts().drop("n_series")


@query("g8_interval_degrees", """
WITH n AS (SELECT uid FROM o_nodes WHERE (start_time IS NULL OR start_time <= TIMESTAMP '1996-03-31') AND (end_time IS NULL OR end_time >= TIMESTAMP '1996-01-01')),
e AS (SELECT * FROM o_edges WHERE start_time <= TIMESTAMP '1996-03-31' AND end_time >= TIMESTAMP '1996-01-01'),
c AS (SELECT src AS uid, count(*) AS n FROM e GROUP BY src) SELECT n.uid, coalesce(c.n, 0) AS degree FROM n LEFT JOIN c ON c.uid = n.uid""")
def _(spark, d):
    s = order_graph(spark, d).snapshot(between=("1996-01-01", "1996-03-31"), mode="graph")
    return G.degrees(s.nodes, s.edges, "out")


@query("g9_shortest_path_length", """
WITH RECURSIVE best(uid, h) USING KEY (uid) AS (SELECT 'U0', 0 UNION
  SELECT p.dst, min(b.h) + 1 FROM best b JOIN peers p ON p.src = b.uid LEFT JOIN recurring.best o ON o.uid = p.dst WHERE o.uid IS NULL GROUP BY p.dst)
SELECT (SELECT max_by(uid, (h, uid)) FROM best) AS target, (SELECT max(h) FROM best) AS hops""")
def _(spark, d):
    from ..plans.fixpoint import hops

    e = signal_graph(spark, d).edges
    seen = hops(spark.range(1).select(F.lit("U0").alias("root")), e)
    return seen.agg(F.max_by("uid", F.struct("hop", "uid")).alias("target"), F.max("hop").alias("hops"))


@query("g9_shortest_path", """
WITH RECURSIVE best(uid, h) USING KEY (uid) AS (SELECT 'U113', 0 UNION
  SELECT p.dst, min(b.h) + 1 FROM best b JOIN peers p ON p.src = b.uid LEFT JOIN recurring.best o ON o.uid = p.dst WHERE o.uid IS NULL GROUP BY p.dst),
par AS (SELECT b.uid, b.h, min(p.src) AS parent FROM best b JOIN peers p ON p.dst = b.uid JOIN best a ON a.uid = p.src AND a.h = b.h - 1 GROUP BY b.uid, b.h),
path(uid, h) AS (SELECT uid, h FROM best WHERE uid = 'U19' UNION SELECT par.parent, par.h - 1 FROM path JOIN par ON par.uid = path.uid) SELECT h AS position, uid FROM path""")
def _(spark, d):
    return G.shortest_path(signal_graph(spark, d).edges, "U113", "U19")


# generated series --------------------------------------------------------------------------------
def _series(df):
    return df.select("step", r6("value").alias("value"))


@query("t1_node_count", f"SELECT step, count(n.uid)::DOUBLE AS value FROM year_grid LEFT JOIN o_nodes n ON n.label = 'Customer' AND {_valid('n')} GROUP BY step")
def _(spark, d):
    return _series(_years(spark, d).tsgen().node_count("Customer"))


@query("t2_edge_count", f"SELECT step, count(e.uid)::DOUBLE AS value FROM year_grid LEFT JOIN o_edges e ON {_valid('e')} GROUP BY step")
def _(spark, d):
    return _series(_years(spark, d).tsgen().edge_count())


_DEGREES = f"""
n AS (SELECT step, n.uid FROM year_grid JOIN o_nodes n ON {_valid('n')} {{where}}),
e AS (SELECT step, e.src, e.dst, e.quantity FROM year_grid JOIN o_edges e ON {_valid('e')}),
ends AS (SELECT step, src AS uid, quantity FROM e UNION ALL SELECT step, dst, quantity FROM e),
deg AS (SELECT n.step, n.uid, count(ends.uid) AS k, coalesce(sum(ends.quantity), 0) AS w FROM n LEFT JOIN ends ON ends.step = n.step AND ends.uid = n.uid GROUP BY n.step, n.uid)"""


_MONTH_DEGREES = _DEGREES.replace("year_grid", "month_grid")


@query("t3_degree_avg", f"WITH {_DEGREES.format(where='')} SELECT step, round(avg(k), 6) AS value FROM deg GROUP BY step")
def _(spark, d):
    return _series(_years(spark, d).tsgen().degree("avg"))


_CUSTOMERS = "WHERE n.label = 'Customer'"


@query("t3_degree_extremes", f"WITH {_DEGREES.format(where=_CUSTOMERS)} SELECT step, max(k)::DOUBLE AS high, min(k)::DOUBLE AS low, coalesce(sum(k), 0)::DOUBLE AS total FROM year_grid LEFT JOIN deg USING (step) GROUP BY step")
def _(spark, d):
    stats = _years(spark, d).tsgen().degree_stats(label="Customer")
    return stats.select("step", *[F.col(a).cast("double").alias(b) for a, b in (("max", "high"), ("min", "low"), ("sum", "total"))])


@query("t3_weighted_degree", f"WITH {_DEGREES.format(where=_CUSTOMERS)} SELECT step, coalesce(round(avg(w), 6), 0) AS value FROM year_grid LEFT JOIN deg USING (step) GROUP BY step")
def _(spark, d):
    return _series(_years(spark, d).tsgen().degree("avg", label="Customer", weight="quantity"))


@query("t4_node_property", f"SELECT step, coalesce(round(avg(acctbal), 6), 0) AS value FROM year_grid LEFT JOIN o_nodes n ON {_valid('n')} AND label = 'Customer' GROUP BY step")
def _(spark, d):
    return _series(_years(spark, d).tsgen().node_property("acctbal", "avg", "Customer"))


@query("t4_temporal_property", """
WITH v AS (SELECT step, ts_id, arg_max(value, ts) AS value FROM january JOIN samples ON ts <= t AND variable = 'click' GROUP BY step, ts_id)
SELECT j.step, round(coalesce(sum(v.value), 0), 6) AS value FROM january j LEFT JOIN v ON v.step = j.step GROUP BY j.step""")
def _(spark, d):
    seq = signal_graph(spark, d, by_day=False).snapshot_sequence("2024-01-01", "2024-01-31", DAY)
    return _series(seq.tsgen().node_property("click", "sum", source="temporal"))


@query("t5_edge_property", f"SELECT step, round(sum(price), 2) AS value FROM year_grid JOIN o_edges e ON {_valid('e')} GROUP BY step")
def _(spark, d):
    return _years(spark, d).tsgen().edge_property("price", "sum").select("step", F.round("value", 2).alias("value"))


@query("t6_edges_between", """
SELECT step, count(e.uid)::DOUBLE AS value FROM (SELECT i::BIGINT AS step, TIMESTAMP '1995-01-01' + i * INTERVAL 30 DAY AS t FROM range(80) r(i))
LEFT JOIN o_edges e ON src = 'S12' AND dst = 'C1250' AND start_time <= t AND end_time >= t GROUP BY step""")
def _(spark, d):
    seq = order_graph(spark, d).snapshot_sequence("1995-01-01", "2001-07-28", "30D")
    return _series(seq.tsgen().edges_between("S12", "C1250"))


@query("t7_edge_property_between", """
SELECT step, round(coalesce(max(price), 0), 6) AS value FROM (SELECT i::BIGINT AS step, TIMESTAMP '1995-01-01' + i * INTERVAL 30 DAY AS t FROM range(80) r(i))
LEFT JOIN o_edges e ON src = 'S12' AND dst = 'C1250' AND start_time <= t AND end_time >= t GROUP BY step""")
def _(spark, d):
    seq = order_graph(spark, d).snapshot_sequence("1995-01-01", "2001-07-28", "30D")
    return _series(seq.tsgen().edges_between("S12", "C1250", prop="price", agg="max"))


@query("t8_density", f"WITH {_COUNTS.replace('month_grid', 'year_grid')} SELECT step, round(n_edges / (n_nodes * (n_nodes - 1.0::DOUBLE)), 6) AS value FROM n JOIN e USING (step)")
def _(spark, d):
    return _series(_years(spark, d).tsgen().density())


_WEEKLY_WEAK = f"""
WITH RECURSIVE wn AS (SELECT step, n.uid FROM all_weeks JOIN o_nodes n ON {_valid('n')}),
we AS (SELECT step, e.src, e.dst FROM all_weeks JOIN o_edges e ON {_valid('e')} JOIN wn a USING (step) JOIN wn b USING (step) WHERE a.uid = e.src AND b.uid = e.dst),
pairs AS (SELECT step, src AS a, dst AS b FROM we UNION SELECT step, dst, src FROM we),
cc(step, uid, comp) USING KEY (step, uid) AS (SELECT step, uid, uid FROM wn UNION
  SELECT p.step, p.b, min(c.comp) FROM cc c JOIN pairs p ON p.step = c.step AND p.a = c.uid JOIN recurring.cc o ON o.step = p.step AND o.uid = p.b WHERE c.comp < o.comp GROUP BY p.step, p.b),
sizes AS (SELECT step, comp, count(*) AS n FROM cc GROUP BY step, comp)"""


@query("t9_component_count_weak", f"{_WEEKLY_WEAK} SELECT step, count(*)::DOUBLE AS value FROM sizes GROUP BY step")
def _(spark, d):
    return _series(_years(spark, d, 7 * DAY, ends_only=True).tsgen().component_count(directed=False))


@query("t10_largest_component_weak", f"{_WEEKLY_WEAK} SELECT step, max(n)::DOUBLE AS value FROM sizes GROUP BY step")
def _(spark, d):
    return _series(_years(spark, d, 7 * DAY, ends_only=True).tsgen().largest_component(directed=False))


@query("t9_component_count_strong", f"SELECT step, count(n.uid)::DOUBLE AS value FROM week_grid LEFT JOIN o_nodes n ON {_valid('n')} GROUP BY step")
def _(spark, d):
    """Orders only lead from suppliers to customers, so every node is a strong component of its own."""
    return _series(_weeks(spark, d).tsgen().component_count())


@query("t11_entity_degree_all", f"""
WITH {_MONTH_DEGREES.format(where='')} SELECT step, uid, k::DOUBLE AS value FROM deg""")
def _(spark, d):
    return _month(spark, d).tsgen().entity_degree().select("step", "uid", "value")


@query("t11_entity_degree_one", f"""
SELECT step, count(e.uid)::DOUBLE AS value FROM month_grid LEFT JOIN o_edges e ON e.src = 'S3' AND {_valid('e')} GROUP BY step""")
def _(spark, d):
    return _series(_month(spark, d).tsgen().entity_degree("S3", "out"))


@query("t12_t13_metric_request", f"""
WITH {_MONTH_DEGREES.format(where=_CUSTOMERS)} SELECT step, 'node_degree_max_Customer' AS metric, max(k)::DOUBLE AS value FROM deg WHERE step BETWEEN 5 AND 9 GROUP BY step""")
def _(spark, d):
    t = _month(spark, d).tsgen().window("1996-01-06", "1996-01-10").compute("node", "degree", "max", label="Customer")
    return t.select((F.col("step") + 5).alias("step"), "metric", "value")


@query("t13_metric_requests", f"""
WITH {_MONTH_DEGREES.format(where='')},
arrivals AS (SELECT step, n.uid, count(e.uid) AS k FROM month_grid JOIN o_nodes n ON label = 'Customer' AND {_valid('n')} LEFT JOIN o_edges e ON e.dst = n.uid AND {_valid('e')} GROUP BY step, n.uid)
SELECT step, 'max_degree_in' AS metric, max(k)::DOUBLE AS value FROM arrivals GROUP BY step
UNION ALL SELECT step, 'avg_weighted_degree_quantity_both', round(avg(w), 6) FROM deg GROUP BY step
UNION ALL SELECT step, 'degree_S3_out', count(e.uid)::DOUBLE FROM month_grid LEFT JOIN o_edges e ON e.src = 'S3' AND {_valid('e')} GROUP BY step
UNION ALL SELECT step, 'edges_S12_C1250_sum_price', coalesce(sum(price), 0) FROM month_grid LEFT JOIN o_edges e ON e.src = 'S12' AND e.dst = 'C1250' AND {_valid('e')} GROUP BY step
UNION ALL SELECT step, 'connected_components', count(n.uid)::DOUBLE FROM month_grid LEFT JOIN o_nodes n ON label = 'Supplier' AND {_valid('n')} GROUP BY step""")
def _(spark, d):
    """Suppliers have no edges among themselves, so each is a component."""
    t = _month(spark, d).tsgen()
    asked = [t.request("global", "nodes", "degree", "max", label="Customer", direction="in"), t.request("global", "nodes", "degree", weight="quantity"),
             t.request("entity", "nodes", "degree", uid="S3", direction="out"), t.request("entity", "edges", "property", "sum", uid="S12", other="C1250", prop="price"),
             t.request("global", "graph", "connected_components", label="Supplier", directed=False)]
    found = asked[0]
    for more in asked[1:]:
        found = found.unionByName(more)
    return found.select("step", "metric", r6("value").alias("value"))


@query("t14_t15_m9_saved_series", f"""
SELECT 'ts_load_' || n.uid AS ts_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS ts, v.value FROM month_grid
JOIN (SELECT step, count(e.uid)::DOUBLE AS value FROM month_grid LEFT JOIN o_edges e ON {_valid('e')} GROUP BY step) v USING (step)
CROSS JOIN (SELECT uid FROM o_nodes WHERE label = 'Supplier') n""")
def _(spark, d):
    from ..operators.mutate import attach_series
    from ..operators.series import entity_series

    g = order_graph(spark, d)
    values = g.snapshot_sequence("1996-01-01", "1996-01-31", DAY).tsgen().edge_count().withColumnRenamed("snap_ts", "ts")
    members = scans.with_label(g.nodes, "Supplier")
    g = attach_series(g, "node", members, values, "load", copies=True)
    return entity_series(g.nodes, g.measurements, "load").select("ts_id", day_text("ts").alias("ts"), "value")


@query("m9_shared_series", f"""
SELECT n.uid, 'ts_load_shared' AS ts_id, count(*) AS n, sum(v.value) AS total, max(v.value) AS most FROM o_nodes n
CROSS JOIN (SELECT step, count(e.uid)::DOUBLE AS value FROM all_weeks LEFT JOIN o_edges e ON {_valid('e')} GROUP BY step) v
WHERE n.label = 'Supplier' GROUP BY n.uid""")
def _(spark, d):
    from ..operators.mutate import attach_series

    g = order_graph(spark, d)
    values = _years(spark, d, dt.timedelta(days=7)).tsgen().edge_count().withColumnRenamed("snap_ts", "ts")
    g = attach_series(g, "node", scans.with_label(g.nodes, "Supplier"), values, "load")
    each = g.measurements.groupBy("ts_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"))
    owners = g.nodes.select("uid", F.col("ts_ids")["load"].alias("ts_id"))  # the series is summed up once, not once per owner
    return owners.join(each, "ts_id").select("uid", "ts_id", "n", "total", "most")

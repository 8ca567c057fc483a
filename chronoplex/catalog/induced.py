"""Induced graphs: membership, life cycle, signals, differences, propagation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import induced_diff as Q, signals as V
from ..operators.induced import InducedGraph
from ..operators.series import bucketed
from ..sources.warehouse import signal_graph
from .registry import day_text, query, r6

DAY = dt.timedelta(days=1)


def _views(spark, d, predicate="view < 60", start="2024-01-01", end="2024-01-10", **options):
    with_base = "base_" in predicate
    return InducedGraph(signal_graph(spark, d, with_base=with_base), "User", predicate, start, end, every=DAY, **options)


_MEMBERS = """
mem AS (SELECT uid, date_diff('day', TIMESTAMP '2024-01-01', ts) AS step FROM days WHERE variable = 'view' AND value <> 0 AND value < 60 AND ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-10'),
chg AS (SELECT uid, step, 'enter' AS change FROM mem m WHERE NOT EXISTS (SELECT 1 FROM mem p WHERE p.uid = m.uid AND p.step = m.step - 1)
  UNION ALL SELECT uid, step + 1, 'exit' FROM mem m WHERE step < 9 AND NOT EXISTS (SELECT 1 FROM mem p WHERE p.uid = m.uid AND p.step = m.step + 1)),
cs AS (SELECT step, row_number() OVER (ORDER BY step) AS k FROM (SELECT DISTINCT step FROM chg UNION SELECT 0) x),
cm AS (SELECT mem.uid, cs.step, cs.k FROM mem JOIN cs ON cs.step = mem.step),
ce AS (SELECT p.uid AS edge, p.src, p.dst, a.step FROM peers p JOIN cm a ON a.uid = p.src JOIN cm b ON b.uid = p.dst AND b.step = a.step)"""
_REACH = f"""
WITH RECURSIVE {_MEMBERS}, un AS (SELECT step, src AS a, dst AS b FROM ce UNION SELECT step, dst, src FROM ce),
reach(step, a, b) AS (SELECT step, uid, uid FROM cm UNION SELECT r.step, r.a, u.b FROM reach r JOIN un u ON u.step = r.step AND u.a = r.b),
comp AS (SELECT step, a AS uid, min(b) AS comp FROM reach GROUP BY step, a),
kc AS (SELECT comp.*, cs.k FROM comp JOIN cs ON cs.step = comp.step), sz AS (SELECT k, step, comp, count(*) AS size FROM kc GROUP BY k, step, comp),
lk AS (SELECT * FROM (SELECT c.k, c.comp, p.comp AS parent, count(*) AS n FROM kc c JOIN kc p ON p.uid = c.uid AND p.k = c.k - 1 GROUP BY c.k, c.comp, p.comp) l
  JOIN (SELECT k AS k1, comp AS c1, size FROM sz) s ON s.k1 = l.k AND s.c1 = l.comp JOIN (SELECT k + 1 AS k2, comp AS c2, size AS psize FROM sz) q ON q.k2 = l.k AND q.c2 = l.parent WHERE n / (size + psize - n) > 0.3),
inn AS (SELECT k, comp, count(*) AS n_in, min(parent) AS parent FROM lk GROUP BY k, comp), ot AS (SELECT k - 1 AS k, parent AS comp, count(*) AS n_out FROM lk GROUP BY k, parent),
ev AS (SELECT sz.step, sz.comp, sz.size, CASE WHEN coalesce(n_in, 0) = 0 THEN 'BIRTH' WHEN n_in >= 2 THEN 'MERGE' WHEN n_out = 1 THEN CASE WHEN sz.size > ps.size THEN 'GROW' WHEN sz.size < ps.size THEN 'SHRINK' ELSE 'CONTINUE' END END AS event
  FROM sz LEFT JOIN inn ON inn.k = sz.k AND inn.comp = sz.comp LEFT JOIN ot ON ot.k = sz.k - 1 AND ot.comp = inn.parent LEFT JOIN sz ps ON ps.k = sz.k - 1 AND ps.comp = inn.parent
  UNION ALL SELECT cs.step, sz.comp, sz.size, CASE WHEN n_out IS NULL THEN 'DEATH' WHEN n_out > 1 THEN 'SPLIT' END FROM sz JOIN cs ON cs.k = sz.k + 1 LEFT JOIN ot ON ot.k = sz.k AND ot.comp = sz.comp)"""


@query("u1_u3_u6_membership", f"WITH {_MEMBERS} SELECT uid, step FROM mem")
def _(spark, d):
    return _views(spark, d).membership()


@query("u1_static_in_expression", """
WITH b AS (SELECT uid, quantile_cont(value, 0.95) AS p FROM days WHERE variable = 'view' GROUP BY uid)
SELECT days.uid, date_diff('day', TIMESTAMP '2024-01-01', ts) AS step FROM days JOIN b ON b.uid = days.uid WHERE variable = 'view' AND value <> 0 AND value / b.p < 0.5 AND ts <= TIMESTAMP '2024-01-10'""")
def _(spark, d):
    return _views(spark, d, "view / base_view < 0.5").membership()


@query("u2_compound_left_to_right", """
WITH p AS (SELECT uid, ts, max(value) FILTER (variable = 'view') AS v, max(value) FILTER (variable = 'click') AS c, max(value) FILTER (variable = 'error') AS e FROM days WHERE value <> 0 AND ts <= TIMESTAMP '2024-01-20' GROUP BY uid, ts)
SELECT uid, date_diff('day', TIMESTAMP '2024-01-01', ts) AS step FROM p WHERE (coalesce(v < 40, false) OR coalesce(c > 80, false)) AND coalesce(e > 20, false)""")
def _(spark, d):
    return _views(spark, d, "view < 40 OR click > 80 AND error > 20", end="2024-01-20").membership()


@query("u4_hour_filter_changes", """
WITH b AS (SELECT uid, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-03') AS ts, avg(value) AS value FROM samples WHERE variable = 'view' GROUP BY 1, 2),
mem AS (SELECT uid, date_diff('hour', TIMESTAMP '2024-01-01', ts) // 6 AS step FROM b WHERE value <> 0 AND value < 60 AND ts <= TIMESTAMP '2024-01-10' AND hour(ts) BETWEEN 6 AND 12),
r AS (SELECT *, step // 4 AS run, step % 4 AS h FROM mem)
SELECT run, step, uid, 'enter' AS change FROM r WHERE h = 1 OR NOT EXISTS (SELECT 1 FROM mem p WHERE p.uid = r.uid AND p.step = r.step - 1)
UNION ALL SELECT run, step + 1, uid, 'exit' FROM r WHERE h = 1 AND NOT EXISTS (SELECT 1 FROM mem p WHERE p.uid = r.uid AND p.step = r.step + 1)""")
def _(spark, d):
    g = signal_graph(spark, d, by_day=False)
    six = bucketed(g.measurements, "6 hours", "avg", keys=["ts_id", "variable"]).withColumnRenamed("bucket", "ts")
    i = InducedGraph(g.with_(measurements=six), "User", "view < 60", "2024-01-01", "2024-01-10", step_minutes=360, hours=(6, 12))
    return i.membership_changes().select("run", "step", "uid", "change")


@query("u5_mapping", "SELECT DISTINCT uid, ts_id FROM samples WHERE variable = 'view'")
def _(spark, d):
    i = _views(spark, d)
    return i.nodes().select("uid", F.col("ts_ids")[i.predicate.series[0]].alias("ts_id")).dropna()


@query("u7_member_edges", f"WITH {_MEMBERS} SELECT edge, step FROM ce")
def _(spark, d):
    return _views(spark, d).edges().select("edge", "step")


@query("u8_membership_changes", f"WITH {_MEMBERS} SELECT uid, step, change FROM chg")
def _(spark, d):
    return _views(spark, d).membership_changes().select("uid", "step", "change")


@query("u9_first_entry", f"WITH {_MEMBERS} SELECT uid, strftime(TIMESTAMP '2024-01-01' + min(step)::INT * INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS first_ts FROM mem GROUP BY uid")
def _(spark, d):
    return _views(spark, d).first_entry().withColumn("first_ts", day_text("first_ts"))


@query("u10_components", f"{_REACH} SELECT step, uid, comp FROM comp")
def _(spark, d):
    return _views(spark, d).components().select("step", "uid", "comp")


@query("u11_u12_lifecycle", f"{_REACH} SELECT step, comp, size, event FROM ev WHERE event IS NOT NULL")
def _(spark, d):
    return _views(spark, d).lifecycle().select("step", "comp", "size", "event")


@query("u12_lifecycle_relations", f"""
{_REACH}, lo AS (SELECT lk.*, n_in, n_out FROM lk JOIN inn ON inn.k = lk.k AND inn.comp = lk.comp JOIN ot ON ot.k = lk.k - 1 AND ot.comp = lk.parent),
ids(k, comp, id) AS (SELECT sz.k, sz.comp, 'C_' || sz.step || '_' || sz.comp FROM sz WHERE NOT EXISTS (SELECT 1 FROM lo WHERE lo.k = sz.k AND lo.comp = sz.comp AND n_in = 1 AND n_out = 1)
  UNION ALL SELECT lo.k, lo.comp, ids.id FROM ids JOIN lo ON lo.k = ids.k + 1 AND lo.parent = ids.comp AND n_in = 1 AND n_out = 1),
rel AS (SELECT cs.step, c.id AS child, p.id AS parent, n_in, n_out FROM lo JOIN cs ON cs.k = lo.k JOIN ids c ON c.k = lo.k AND c.comp = lo.comp JOIN ids p ON p.k = lo.k - 1 AND p.comp = lo.parent)
SELECT step, child AS component_id, 'parent' AS role, parent AS related_id FROM rel WHERE n_in >= 2 OR n_out = 1 UNION ALL SELECT step, parent, 'child', child FROM rel WHERE n_out > 1""")
def _(spark, d):
    return _views(spark, d).lifecycle_relations().drop("snap_ts")


@query("u13_structural_transitions", f"""
{_REACH} SELECT comp.uid, strftime(TIMESTAMP '2024-01-01' + min(comp.step)::INT * INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS transition_ts FROM comp JOIN ev ON ev.step = comp.step AND ev.comp = comp.comp
WHERE event IN ('BIRTH', 'GROW', 'MERGE') AND size >= 2 GROUP BY comp.uid""")
def _(spark, d):
    return _views(spark, d).structural_transitions().withColumn("transition_ts", day_text("transition_ts"))


@query("u14_u16_members_at", f"WITH {_MEMBERS} SELECT uid FROM mem WHERE step = 3")
def _(spark, d):
    return _views(spark, d).members_at("2024-01-04T15:00:00")


@query("u14_components_at", f"{_REACH} SELECT uid, comp FROM comp WHERE step = 3")
def _(spark, d):
    return _views(spark, d).components_at("2024-01-04T15:00:00")


@query("u15_summary", f"""
{_REACH} SELECT 10::BIGINT AS n_steps, (SELECT count(*) FROM cs) AS n_change_steps, (SELECT count(DISTINCT uid) FROM mem) AS n_members, (SELECT max(n) FROM (SELECT count(*) AS n FROM mem GROUP BY step)) AS max_members,
(SELECT count(DISTINCT uid) FROM samples WHERE variable = 'view') AS n_mapped, {', '.join(f"(SELECT count(*) FROM ev WHERE event = '{e}') AS n_{e.lower()}" for e in ("BIRTH", "GROW", "SHRINK", "CONTINUE", "MERGE", "SPLIT", "DEATH"))}""")
def _(spark, d):
    return _views(spark, d).summary()


@query("u17_threshold_sweep", """
SELECT t.x AS threshold, date_diff('day', TIMESTAMP '2024-01-01', ts) AS step, count(*) AS n FROM days, (VALUES (20.0::DOUBLE), (40.0), (80.0)) t(x)
WHERE variable = 'view' AND value <> 0 AND value < t.x AND ts <= TIMESTAMP '2024-01-10' GROUP BY t.x, ts""")
def _(spark, d):
    return _views(spark, d).sweep([20, 40, 80]).groupBy("threshold", "step").agg(F.count(F.lit(1)).alias("n"))


@query("u17_expression_range", "SELECT round(min(value), 6) AS low, round(max(value), 6) AS high FROM days WHERE variable = 'view' AND value <> 0 AND ts <= TIMESTAMP '2024-01-10'")
def _(spark, d):
    return _views(spark, d).expression_range().select(r6("low").alias("low"), r6("high").alias("high"))


@query("u17_nearest_reading", """
WITH c AS (SELECT uid, step, value, row_number() OVER (PARTITION BY uid, step ORDER BY abs(epoch_us(ts) - epoch_us(t)), ts) AS k FROM january JOIN samples ON abs(epoch_us(ts) - epoch_us(t)) <= 21600000000 WHERE variable = 'view' AND value <> 0 AND step <= 9)
SELECT uid, step FROM c WHERE k = 1 AND value < 60""")
def _(spark, d):
    g = signal_graph(spark, d, by_day=False)
    return InducedGraph(g, "User", "view < 60", "2024-01-01", "2024-01-10", every=DAY, nearest_tolerance=dt.timedelta(hours=6)).membership()


_STRUCTURE = f"""
{_REACH}, st AS (SELECT cs.step, coalesce(n, 0) AS n, coalesce(m, 0) AS m, coalesce(c, 0) AS c, coalesce(g, 0) AS g FROM cs LEFT JOIN (SELECT step, count(*) AS n FROM cm GROUP BY step) a ON a.step = cs.step
LEFT JOIN (SELECT step, count(*) AS m FROM ce GROUP BY step) b ON b.step = cs.step LEFT JOIN (SELECT step, count(*) AS c, max(size) AS g FROM sz GROUP BY step) x ON x.step = cs.step)"""


@query("v1_structure_signals", f"""
{_STRUCTURE} SELECT step, n AS node_count, m AS edge_count, c AS component_count, g AS largest_component, round(CASE WHEN n <= 1 THEN 0 ELSE m / (n * (n - 1)) END, 6) AS density,
round(CASE WHEN n > 0 THEN 2 * m / n ELSE 0 END, 6) AS avg_degree FROM st""")
def _(spark, d):
    s = V.structure(_views(spark, d))
    return s.select("step", "node_count", "edge_count", "component_count", "largest_component", r6("density").alias("density"), r6("avg_degree").alias("avg_degree"))


_VALUES = """, vals AS (SELECT uid, value, date_diff('day', TIMESTAMP '2024-01-01', ts) AS step FROM days WHERE variable = 'click' AND value <> 0)"""


@query("v2_member_values", f"WITH {_MEMBERS}{_VALUES} SELECT cs.step, round(coalesce(avg(vals.value), 0), 6) AS value FROM cs LEFT JOIN cm ON cm.step = cs.step LEFT JOIN vals ON vals.uid = cm.uid AND vals.step = cm.step GROUP BY cs.step")
def _(spark, d):
    return V.member_signal(_views(spark, d), "click", "mean").select("step", r6("value").alias("value"))


@query("v2_largest_component_values", f"""
{_REACH}{_VALUES}, big AS (SELECT step, comp FROM (SELECT step, comp, row_number() OVER (PARTITION BY step ORDER BY size DESC, comp) AS k FROM sz) WHERE k = 1)
SELECT cs.step, round(coalesce(max(vals.value), 0), 6) AS value FROM cs LEFT JOIN big ON big.step = cs.step LEFT JOIN comp ON comp.step = big.step AND comp.comp = big.comp LEFT JOIN vals ON vals.uid = comp.uid AND vals.step = comp.step GROUP BY cs.step""")
def _(spark, d):
    return V.member_signal(_views(spark, d), "click", "max", "largest").select("step", r6("value").alias("value"))


@query("v3_signals_in_range", f"""
{_STRUCTURE} SELECT 'density' AS metric, step, round(CASE WHEN n <= 1 THEN 0 ELSE m / (n * (n - 1)) END, 6) AS value FROM st WHERE step BETWEEN 2 AND 6
UNION ALL SELECT 'component_count', step, c FROM st WHERE step BETWEEN 2 AND 6 UNION ALL SELECT 'largest_component', step, g FROM st WHERE step BETWEEN 2 AND 6""")
def _(spark, d):
    s = V.signals(_views(spark, d), start="2024-01-03", end="2024-01-07")
    return s.select("metric", F.datediff("snap_ts", F.lit("2024-01-01")).cast("long").alias("step"), r6("value").alias("value"))


@query("v4_saved_signals", f"""
{_STRUCTURE} SELECT 'ts_node_count___graph__' AS ts_id, strftime(TIMESTAMP '2024-01-01' + step::INT * INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS ts, n::DOUBLE AS value FROM st""")
def _(spark, d):
    from ..operators.mutate import attach_graph_series

    i = _views(spark, d)
    s = V.signals(i, ["node_count"]).withColumnRenamed("snap_ts", "ts")
    saved = attach_graph_series(i.graph, s, "node_count").measurements.filter("ts_id = 'ts_node_count___graph__'")
    return saved.select("ts_id", day_text("ts").alias("ts"), "value")


# differences of induced graphs -------------------------------------------------------------------
_TWO = """
m1 AS (SELECT DISTINCT uid FROM days WHERE variable = 'view' AND value <> 0 AND value < 60 AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-07'),
mem2 AS (SELECT uid, ts FROM days WHERE variable = 'view' AND value <> 0 AND value < 60 AND ts >= TIMESTAMP '2024-01-07' AND ts <= TIMESTAMP '2024-01-13'),
m2 AS (SELECT DISTINCT uid FROM mem2 WHERE ts < TIMESTAMP '2024-01-13'),
st AS (SELECT coalesce(m1.uid, m2.uid) AS uid, CASE WHEN m1.uid IS NULL THEN 'ADDED' WHEN m2.uid IS NULL THEN 'REMOVED' ELSE 'PERSISTED' END AS delta_struct FROM m1 FULL JOIN m2 ON m1.uid = m2.uid),
ad AS (SELECT st.uid, min(ts) AS t FROM st JOIN mem2 ON mem2.uid = st.uid WHERE delta_struct = 'ADDED' GROUP BY st.uid)"""
_DESC = f"""
WITH {_TWO}, pr AS (SELECT uid, value, ts, CASE WHEN ts < TIMESTAMP '2024-01-07' THEN 1 ELSE 2 END AS p FROM days WHERE variable = 'view' AND value <> 0 AND ts < TIMESTAMP '2024-01-13'),
pn AS (SELECT *, row_number() OVER (PARTITION BY uid, p ORDER BY ts) - 1 AS i FROM pr),
ab AS (SELECT uid, i, max(value) FILTER (p = 1) AS a, max(value) FILTER (p = 2) AS b FROM pn GROUP BY uid, i),
g AS (SELECT uid, count(a) AS n1, count(b) AS n2, avg(b) - avg(a) AS mu, stddev_pop(a) AS s1, stddev_pop(b) AS s2, regr_slope(b, i) AS k2, regr_slope(a, i) AS k1, sqrt(avg(pow(a - b, 2)) FILTER (a IS NOT NULL AND b IS NOT NULL)) AS rmse, stddev_pop(a) FILTER (b IS NOT NULL) AS sc FROM ab GROUP BY uid),
ds AS (SELECT st.uid, CASE WHEN n1 >= 2 AND n2 >= 2 THEN mu ELSE 0 END AS delta_mu, CASE WHEN n1 >= 2 AND n2 >= 2 AND s1 > 1e-9 THEN s2 / s1 ELSE 1 END AS sigma_ratio, CASE WHEN n1 >= 2 AND n2 >= 2 THEN k2 - k1 ELSE 0 END AS delta_slope,
  CASE WHEN n1 >= 2 AND n2 >= 2 AND sc > 1e-9 THEN rmse / sc ELSE 0 END AS nrmse FROM st LEFT JOIN g ON g.uid = st.uid WHERE delta_struct = 'PERSISTED')"""
_CPG = """
adj AS (SELECT src, dst FROM peers UNION SELECT dst, src FROM peers),
cpg AS (SELECT adj.src, adj.dst, (epoch_us(b.t) - epoch_us(a.t)) / 86400000000.0 AS delay FROM adj JOIN ad a ON a.uid = adj.src JOIN ad b ON b.uid = adj.dst WHERE b.t > a.t AND b.t - a.t <= INTERVAL 4 DAY)"""


def _two(spark, d, **options):
    options = {"max_delay_days": 4} | options
    return Q.InducedDiff.between(signal_graph(spark, d), "User", "view < 60", ("2024-01-01", "2024-01-07"), ("2024-01-07", "2024-01-13"), every=DAY, **options)


@query("q1_frequent_members", "SELECT uid FROM days WHERE variable = 'view' AND value <> 0 AND value < 60 AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-11' GROUP BY uid HAVING count(*) >= 0.3 * 10")
def _(spark, d):
    return Q.frequent_members(_views(spark, d, end="2024-01-20"), ("2024-01-01", "2024-01-11"), 0.3)


@query("q2_q10_structure", f"WITH {_TWO} SELECT uid, delta_struct FROM st")
def _(spark, d):
    return _two(spark, d).structure()


@query("q3_q4_descriptors", f"{_DESC} SELECT uid, round(delta_mu, 6) AS delta_mu, round(sigma_ratio, 6) AS sigma_ratio, round(delta_slope, 6) AS delta_slope, round(nrmse, 6) AS nrmse FROM ds")
def _(spark, d):
    return _two(spark, d).descriptors().select("uid", *[r6(c).alias(c) for c in Q.DESCRIPTORS])


@query("q5_added_times", f"WITH {_TWO} SELECT uid, strftime(t, '%Y-%m-%d %H:%M:%S') AS transition_ts FROM ad")
def _(spark, d):
    return _two(spark, d).added_times().withColumn("transition_ts", day_text("transition_ts"))


@query("q6_summary", f"""
{_DESC}, c AS (SELECT count(*) FILTER (delta_struct = 'ADDED') AS added, count(*) FILTER (delta_struct = 'REMOVED') AS removed, count(*) FILTER (delta_struct = 'PERSISTED') AS persisted FROM st)
SELECT added, removed, persisted, round(persisted / (added + removed + persisted), 6) AS jaccard_nodes, (SELECT round(avg(nrmse), 6) FROM ds) AS avg_nrmse, (SELECT round(max(nrmse), 6) FROM ds) AS max_nrmse, (SELECT round(var_pop(nrmse), 6) FROM ds) AS change_homogeneity FROM c""")
def _(spark, d):
    s = _two(spark, d).summary()
    return s.select("added", "removed", "persisted", *[r6(c).alias(c) for c in ("jaccard_nodes", "avg_nrmse", "max_nrmse", "change_homogeneity")])


@query("q7_q8_result_query", f"{_DESC} SELECT uid, round(nrmse, 6) AS nrmse FROM ds WHERE nrmse > 1 AND delta_mu < 20 AND sigma_ratio >= 0.5 ORDER BY nrmse DESC, uid LIMIT 15")
def _(spark, d):
    q = _two(spark, d).query().persisted().label("User").where_nrmse(">", 1).where_delta_mu("<", 20).where_sigma_ratio(">=", 0.5)
    return q.order_by("nrmse", descending=True).limit(15).execute().select("uid", r6("nrmse").alias("nrmse"))


@query("q8_edges_of_result", f"WITH {_TWO} SELECT uid FROM peers WHERE src IN (SELECT uid FROM st) AND dst IN (SELECT uid FROM st)")
def _(spark, d):
    return _two(spark, d).query().edges().execute().select("uid")


@query("q9_graph_signals", f"""
{_STRUCTURE}, v AS (SELECT CASE WHEN step <= 4 THEN 1 ELSE 2 END AS p, step, n::DOUBLE AS value FROM st), x AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY step) - 1 AS i FROM v),
ab AS (SELECT i, max(value) FILTER (p = 1) AS a, max(value) FILTER (p = 2) AS b FROM x GROUP BY i)
SELECT 'node_count' AS metric, round(avg(b) - avg(a), 6) AS delta_mu, round(stddev_pop(b) / stddev_pop(a), 6) AS sigma_ratio, round(regr_slope(b, i) - regr_slope(a, i), 6) AS delta_slope,
round(sqrt(avg(pow(a - b, 2))) / stddev_pop(a) FILTER (b IS NOT NULL), 6) AS nrmse FROM ab""")
def _(spark, d):
    i = _views(spark, d)
    c = Q.compare_signals(V.signals(i, ["node_count"], end="2024-01-05"), V.signals(i, ["node_count"], start="2024-01-06"))
    return c.select("metric", *[r6(x).alias(x) for x in Q.DESCRIPTORS])


@query("q11_sliced_periods", """
WITH m AS (SELECT uid, ts FROM days WHERE variable = 'view' AND value <> 0 AND value < 60), a AS (SELECT DISTINCT uid FROM m WHERE ts < TIMESTAMP '2024-01-05'), b AS (SELECT DISTINCT uid FROM m WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09')
SELECT coalesce(a.uid, b.uid) AS uid, CASE WHEN a.uid IS NULL THEN 'ADDED' WHEN b.uid IS NULL THEN 'REMOVED' ELSE 'PERSISTED' END AS delta_struct FROM a FULL JOIN b ON a.uid = b.uid""")
def _(spark, d):
    return Q.InducedDiff.sliced(_views(spark, d), ("2024-01-01", "2024-01-05"), ("2024-01-05", "2024-01-09")).structure()


@query("q12_annotated_graph", f"{_DESC} SELECT st.uid, delta_struct, acctbal, round(nrmse, 6) AS nrmse FROM st JOIN u_nodes ON u_nodes.uid = st.uid LEFT JOIN ds ON ds.uid = st.uid")
def _(spark, d):
    n = _two(spark, d).annotated().nodes
    p = F.col("props")
    return n.select("uid", p["delta_struct"].alias("delta_struct"), p["acctbal"].cast("double").alias("acctbal"), r6(p["nrmse"].cast("double")).alias("nrmse"))


@query("k1_propagation_edges", f"WITH {_TWO}, {_CPG} SELECT src, dst, round(delay, 6) AS delay_days FROM cpg")
def _(spark, d):
    return _two(spark, d).propagation().edges().select("src", "dst", r6("delay_days").alias("delay_days"))


@query("k2_roots_and_leaves", f"WITH {_TWO}, {_CPG} SELECT 'root' AS kind, uid FROM ad WHERE uid NOT IN (SELECT dst FROM cpg) UNION ALL SELECT 'leaf', uid FROM ad WHERE uid NOT IN (SELECT src FROM cpg)")
def _(spark, d):
    p = _two(spark, d).propagation()
    return p.roots().select(F.lit("root").alias("kind"), "uid").unionByName(p.leaves().select(F.lit("leaf").alias("kind"), "uid"))


_PATHS = f"""
WITH RECURSIVE {_TWO}, {_CPG}, walk(root, uid, hop, path, total) AS (SELECT uid, uid, 0, uid, 0.0::DOUBLE FROM ad WHERE uid NOT IN (SELECT dst FROM cpg) UNION ALL SELECT root, dst, hop + 1, path || '>' || dst, total + delay FROM walk JOIN cpg ON cpg.src = walk.uid)"""


@query("k3_depths", f"{_PATHS} SELECT root, uid, min(hop) AS hop FROM walk GROUP BY root, uid")
def _(spark, d):
    return _two(spark, d).propagation().depths()


@query("k5_paths", f"{_PATHS} SELECT path, hop AS n_hops, round(total, 6) AS total_delay_days FROM walk WHERE hop > 0 AND uid NOT IN (SELECT src FROM cpg)")
def _(spark, d):
    return _two(spark, d).propagation().paths().select(F.array_join("path", ">").alias("path"), "n_hops", r6("total_delay_days").alias("total_delay_days"))


@query("k5_shortest_paths", f"{_PATHS} SELECT path, hop AS n_hops, round(total, 6) AS total_delay_days FROM walk WHERE hop > 0 AND uid NOT IN (SELECT src FROM cpg) ORDER BY round(total, 6), string_split(path, '>') LIMIT 25")
def _(spark, d):
    paths = _two(spark, d).propagation().paths(top_k=25)
    return paths.select(F.array_join("path", ">").alias("path"), "n_hops", r6("total_delay_days").alias("total_delay_days"))


@query("k5_path_counts", f"{_PATHS} SELECT uid, hop AS n_hops, count(*) AS n_paths FROM walk WHERE hop > 0 AND uid NOT IN (SELECT src FROM cpg) GROUP BY uid, hop")
def _(spark, d):
    return _two(spark, d).propagation().path_counts().withColumn("n_paths", F.col("n_paths").cast("long"))


@query("k4_k6_summary", f"""
{_PATHS} SELECT (SELECT count(*) FROM ad) AS cpg_nodes, (SELECT count(*) FROM cpg) AS cpg_edges, (SELECT round(coalesce(avg(delay), 0), 6) FROM cpg) AS cpg_avg_delay_days, (SELECT count(*) FROM ad WHERE uid NOT IN (SELECT dst FROM cpg)) AS cpg_roots,
(SELECT count(*) FROM ad WHERE uid NOT IN (SELECT src FROM cpg)) AS cpg_leaves, (SELECT coalesce(max(h), 0) FROM (SELECT min(hop) AS h FROM walk GROUP BY root, uid)) AS cpg_max_depth""")
def _(spark, d):
    return _two(spark, d).propagation().summary().withColumn("cpg_avg_delay_days", r6("cpg_avg_delay_days"))


@query("k6_timeline", f"WITH {_TWO} SELECT uid, strftime(t, '%Y-%m-%d %H:%M:%S') AS transition_ts FROM ad")
def _(spark, d):
    return _two(spark, d).propagation().timeline().withColumn("transition_ts", day_text("transition_ts"))


@query("u16_export", "SELECT uid, strftime(ts, '%Y-%m-%d %H:%M:%S') AS snap_ts, round(value, 6) AS view FROM days WHERE variable = 'view' AND value <> 0 AND ts <= TIMESTAMP '2024-01-10'")
def _(spark, d):
    return _views(spark, d).export().select("uid", day_text("snap_ts").alias("snap_ts"), r6("view").alias("view"))


@query("u16_component_members", f"{_REACH} SELECT step, comp, uid FROM comp")
def _(spark, d):
    return _views(spark, d).component_members().select("step", "comp", "uid")

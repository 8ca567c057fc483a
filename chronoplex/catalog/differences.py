"""Differences of snapshots and of intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.diff import SnapshotDiff
from ..operators.interval_diff import IntervalDiff
from ..sources.warehouse import order_graph, signal_graph
from .registry import query, r6

FIRST, SECOND = "1996-06-15", "1997-06-15"


def _valid(alias: str, day: str) -> str:
    t = f"TIMESTAMP '{day}'"
    return f"({alias}.start_time IS NULL OR {alias}.start_time <= {t}) AND ({alias}.end_time IS NULL OR {alias}.end_time >= {t})"


_SIDES = f"""
n1 AS (SELECT * FROM o_nodes o WHERE {_valid('o', FIRST)}), n2 AS (SELECT * FROM o_nodes o WHERE {_valid('o', SECOND)}),
e1 AS (SELECT * FROM o_edges o WHERE {_valid('o', FIRST)}), e2 AS (SELECT * FROM o_edges o WHERE {_valid('o', SECOND)}),
nd AS (SELECT coalesce(b.uid, a.uid) AS uid, coalesce(b.label, a.label) AS label, CASE WHEN a.uid IS NULL THEN 'added' WHEN b.uid IS NULL THEN 'removed' ELSE 'persistent' END AS change_type FROM n1 a FULL JOIN n2 b ON a.uid = b.uid),
ed AS (SELECT coalesce(b.uid, a.uid) AS uid, CASE WHEN a.uid IS NULL THEN 'added' WHEN b.uid IS NULL THEN 'removed' ELSE 'persistent' END AS change_type FROM e1 a FULL JOIN e2 b ON a.uid = b.uid)"""


def _diff(spark, d):
    g = order_graph(spark, d)
    return SnapshotDiff(g.snapshot(at=FIRST, mode="graph"), g.snapshot(at=SECOND, mode="graph"))


@query("d2_element_changes", f"WITH {_SIDES} SELECT 'node' AS kind, uid, change_type FROM nd UNION ALL SELECT 'edge', uid, change_type FROM ed")
def _(spark, d):
    x = _diff(spark, d)
    part = lambda k: x.changes(k).select(F.lit(k).alias("kind"), "uid", "change_type")
    return part("node").unionByName(part("edge"))


@query("d3_added_series", """
SELECT DISTINCT ts_id FROM samples WHERE uid IN (SELECT uid FROM samples GROUP BY uid HAVING min(ts) >= TIMESTAMP '2024-01-01 06:00:00' AND min(ts) < TIMESTAMP '2024-01-02')""")
def _(spark, d):
    g = signal_graph(spark, d, by_day=False)
    first = g.measurements.groupBy(F.concat(F.lit("U"), F.element_at(F.split("ts_id", "_"), 3)).alias("uid")).agg(F.min("ts").alias("start_time"))
    nodes = g.nodes.drop("start_time").join(first, "uid")
    g = g.with_(nodes=nodes.select(*g.nodes.columns))
    at = F.lit("2024-01-02").cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND")
    one, two = g.snapshot(at=F.lit("2024-01-01 06:00:00").cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND"), mode="graph"), g.snapshot(at=at, mode="graph")
    return SnapshotDiff(one, two).added_series()


_EDITED = """
p1 AS (SELECT uid, nationkey::VARCHAR AS nation, acctbal AS bal, segment FROM n1), p2 AS (SELECT uid, CASE WHEN nationkey = 3 THEN NULL ELSE nationkey::VARCHAR END AS nation, CASE WHEN nationkey < 5 THEN 10.5 ELSE acctbal END AS bal,
  CASE WHEN nationkey = 7 THEN 'yes' END AS vip FROM n2)"""


def _edited(spark, d):
    """The second snapshot comes from a graph with changed properties."""
    g = order_graph(spark, d)
    nation = F.col("props")["nationkey"].cast("int")
    changed = g.nodes.withColumn("props", F.map_filter(F.map_concat(
        F.map_filter("props", lambda k, v: ~((k == "acctbal") & (nation < 5))),
        F.create_map(F.lit("vip"), F.when(nation == 7, "yes")),
        F.when(nation < 5, F.create_map(F.lit("acctbal"), F.lit("10.5"))).otherwise(F.create_map().cast("map<string,string>")),
    ), lambda k, v: v.isNotNull() & ~((k == "nationkey") & (nation == 3))))
    return SnapshotDiff(g.snapshot(at=FIRST, mode="graph"), g.with_(nodes=changed).snapshot(at=SECOND, mode="graph"))


_PROPS = f"""
WITH {_SIDES}, {_EDITED}, rows AS (
  SELECT uid, 'nationkey' AS property, p1.nation AS old, p2.nation AS new, CASE WHEN p2.nation IS NULL THEN 'removed' ELSE 'persistent' END AS change, NULL::DOUBLE AS delta FROM p1 JOIN p2 USING (uid)
  UNION ALL SELECT uid, 'acctbal', p1.bal::VARCHAR, p2.bal::VARCHAR, CASE WHEN p1.bal = p2.bal THEN 'persistent' ELSE 'changed' END, CASE WHEN p1.bal <> p2.bal THEN p2.bal - p1.bal END FROM p1 JOIN p2 USING (uid)
  UNION ALL SELECT uid, 'segment', p1.segment, p1.segment, 'persistent', NULL FROM p1 JOIN p2 USING (uid) WHERE p1.segment IS NOT NULL
  UNION ALL SELECT uid, 'vip', NULL, vip, 'added', NULL FROM p1 JOIN p2 USING (uid) WHERE vip IS NOT NULL)"""


@query("d4_property_changes", f"{_PROPS} SELECT uid, property, change, round(delta, 6) AS delta FROM rows")
def _(spark, d):
    p = _edited(spark, d).property_changes("node")
    return p.select("uid", "property", "change", r6("delta").alias("delta"))


@query("d5_changed_nodes", f"{_PROPS} SELECT uid, count(*) AS n_changes FROM rows WHERE change <> 'persistent' GROUP BY uid")
def _(spark, d):
    return _edited(spark, d).changed("node")


@query("d4_value_changes", """
WITH v AS (SELECT uid, variable, arg_max(value, ts) FILTER (ts <= TIMESTAMP '2024-01-04') AS a, arg_max(value, ts) AS b FROM samples WHERE ts <= TIMESTAMP '2024-01-12' GROUP BY uid, variable)
SELECT uid, variable AS property, CASE WHEN a IS NULL THEN 'added' WHEN a = b THEN 'persistent' ELSE 'changed' END AS change, round(CASE WHEN a <> b THEN b - a END, 6) AS delta FROM v""")
def _(spark, d):
    g = signal_graph(spark, d, by_day=False)
    v = g.diff("2024-01-04", "2024-01-12").value_changes()
    return v.select("uid", "property", "change", r6("delta").alias("delta"))


_RATES = """
c AS (SELECT count(*) FILTER (change_type = 'added') AS a, count(*) FILTER (change_type = 'removed') AS r, count(*) FILTER (change_type = 'persistent') AS p FROM nd),
f AS (SELECT count(*) FILTER (change_type = 'added') AS a, count(*) FILTER (change_type = 'removed') AS r, count(*) FILTER (change_type = 'persistent') AS p FROM ed)"""


@query("d6_d10_d17_similarity", f"""
WITH {_SIDES}, {_RATES} SELECT c.a AS node_n_added, c.r AS node_n_removed, c.p AS node_n_persistent, f.a AS edge_n_added, f.r AS edge_n_removed, f.p AS edge_n_persistent,
round((c.a + c.r) / (c.a + c.r + c.p), 6) AS node_churn, round(c.a / (c.a + c.r + c.p), 6) AS node_addition_rate, round(c.r / (c.a + c.r + c.p), 6) AS node_deletion_rate, round(c.p / (c.a + c.r + c.p), 6) AS node_jaccard,
round((f.a + f.r) / (f.a + f.r + f.p), 6) AS edge_churn, round(f.a / (f.a + f.r + f.p), 6) AS edge_addition_rate, round(f.r / (f.a + f.r + f.p), 6) AS edge_deletion_rate, round(f.p / (f.a + f.r + f.p), 6) AS edge_jaccard,
round((2 * (c.a + c.r) + 1 * (f.a + f.r)) / (2 * (c.a + c.r + c.p) + 1 * (f.a + f.r + f.p)), 6) AS edit_distance,
round(0.5 * c.p / (c.a + c.r + c.p) + 0.5 * f.p / (f.a + f.r + f.p), 6) AS stability FROM c, f""")
def _(spark, d):
    m = _diff(spark, d).metrics(node_weight=2.0)
    return m.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes])


@query("d11_added_customers", f"WITH {_SIDES} SELECT uid FROM nd WHERE change_type = 'added' AND label = 'Customer'")
def _(spark, d):
    return _diff(spark, d).query().nodes("added").label("Customer").node_ids()


@query("d12_property_change", f"""
WITH {_SIDES}, {_EDITED} SELECT uid, p1.bal AS old, p2.bal AS new, round(p2.bal - p1.bal, 6) AS change, round(CASE WHEN abs(p1.bal) >= 1e-9 THEN (p2.bal - p1.bal) * 100 / abs(p1.bal) END, 6) AS change_percent FROM p1 JOIN p2 USING (uid)""")
def _(spark, d):
    c = _edited(spark, d).property_change("acctbal")
    return c.withColumns({"change": r6("change"), "change_percent": r6("change_percent")})


_DEG = """
d1 AS (SELECT n1.uid, count(x.uid) AS k FROM n1 LEFT JOIN (SELECT src AS uid FROM e1 UNION ALL SELECT dst FROM e1) x ON x.uid = n1.uid GROUP BY n1.uid),
d2 AS (SELECT n2.uid, count(x.uid) AS k FROM n2 LEFT JOIN (SELECT src AS uid FROM e2 UNION ALL SELECT dst FROM e2) x ON x.uid = n2.uid GROUP BY n2.uid),
dc AS (SELECT coalesce(d1.uid, d2.uid) AS uid, coalesce(d1.k, 0) AS degree_1, coalesce(d2.k, 0) AS degree_2, coalesce(d2.k, 0) - coalesce(d1.k, 0) AS degree_change FROM d1 FULL JOIN d2 ON d1.uid = d2.uid)"""


@query("d13_d18_degree_changes", f"WITH {_SIDES}, {_DEG} SELECT * FROM dc")
def _(spark, d):
    return _diff(spark, d).degree_changes()


_AGG = """
s AS (SELECT uid, avg(value) FILTER (ts <= TIMESTAMP '2024-01-03') AS a, avg(value) FILTER (ts <= TIMESTAMP '2024-01-12') AS b FROM samples WHERE variable = 'view' GROUP BY uid)"""


@query("d14_series_change", f"WITH {_AGG} SELECT u.uid, round(CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE coalesce(b, 0) - coalesce(a, 0) END, 6) AS change FROM u_nodes u LEFT JOIN s ON s.uid = u.uid")
def _(spark, d):
    c = signal_graph(spark, d, by_day=False).diff("2024-01-03", "2024-01-12").series_change("view")
    return c.select("uid", r6("change").alias("change"))


@query("d15_d16_diff_query", f"WITH {_SIDES}, {_DEG} SELECT dc.uid, degree_change FROM dc JOIN nd ON nd.uid = dc.uid WHERE change_type = 'persistent' AND degree_change > 3 ORDER BY degree_change DESC, dc.uid LIMIT 20")
def _(spark, d):
    q = _diff(spark, d).query().nodes("persistent").where_degree_change(">", 3)
    return q.order_by("degree_change", descending=True).limit(20).execute().select("uid", "degree_change")


@query("d15_where_series_change", f"WITH {_AGG} SELECT uid FROM s WHERE b IS NOT NULL AND b - coalesce(a, 0) > 10")
def _(spark, d):
    return signal_graph(spark, d, by_day=False).diff("2024-01-03", "2024-01-12").query().nodes().where_ts_change("view", "mean", ">", 10).node_ids()


@query("d15_where_property_change", f"WITH {_SIDES}, {_EDITED} SELECT uid FROM p1 JOIN p2 USING (uid) WHERE p2.bal - p1.bal < -2000")
def _(spark, d):
    return _edited(spark, d).query().nodes().where_property_change("acctbal", "<", -2000).node_ids()


@query("d16_diff_subgraph", f"WITH {_SIDES} SELECT count(*) AS n FROM o_edges WHERE src IN (SELECT uid FROM nd WHERE change_type = 'persistent') AND dst IN (SELECT uid FROM nd WHERE change_type = 'persistent')")
def _(spark, d):
    g = order_graph(spark, d)
    return _diff(spark, d).query().nodes("persistent").as_subgraph(g).edges.agg(F.count(F.lit(1)).alias("n"))


# intervals ---------------------------------------------------------------------------------------
P1, P2 = ("2024-01-01", "2024-01-14"), ("2024-01-16", "2024-01-29")


def _intervals(spark, d):
    return IntervalDiff(signal_graph(spark, d), P1, P2)


@query("i1_i11_interval_structure", """
WITH x AS (SELECT uid, start_time <= TIMESTAMP '1996-03-31' AND end_time >= TIMESTAMP '1996-01-01' AS a, start_time <= TIMESTAMP '1996-06-30' AND end_time >= TIMESTAMP '1996-04-01' AS b FROM o_edges),
c AS (SELECT count(*) FILTER (b AND NOT a) AS ad, count(*) FILTER (a AND NOT b) AS re, count(*) FILTER (a AND b) AS pe FROM x)
SELECT ad AS edge_n_added, re AS edge_n_removed, pe AS edge_n_persistent, round((ad + re) / (ad + re + pe), 6) AS edge_churn, round(pe / (ad + re + pe), 6) AS edge_jaccard FROM c""")
def _(spark, d):
    m = IntervalDiff(order_graph(spark, d), ("1996-01-01", "1996-03-31"), ("1996-04-01", "1996-06-30")).metrics()
    return m.select("edge_n_added", "edge_n_removed", "edge_n_persistent", r6("edge_churn").alias("edge_churn"), r6("edge_jaccard").alias("edge_jaccard"))


_PERIODS = """
pr AS (SELECT uid, value, ts, CASE WHEN ts <= TIMESTAMP '2024-01-14' THEN 1 ELSE 2 END AS p FROM days WHERE variable = 'view' AND (ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-14' OR ts BETWEEN TIMESTAMP '2024-01-16' AND TIMESTAMP '2024-01-29')),
pn AS (SELECT *, row_number() OVER (PARTITION BY uid, p ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY uid, p) AS n FROM pr),
sd AS (SELECT uid, p, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi, sum(value) AS t, CASE WHEN count(*) >= 2 THEN regr_slope(value, i) ELSE 0 END AS slope FROM pn GROUP BY uid, p),
tr AS (SELECT *, CASE WHEN n < 2 THEN 'unknown' WHEN s / (abs(m) + 1e-9) > 0.5 THEN 'volatile' WHEN slope > 0.1 * s THEN 'increasing' WHEN slope < -0.1 * s THEN 'decreasing' ELSE 'stable' END AS trend FROM sd),
ids AS (SELECT DISTINCT uid FROM pr),
cmp AS (SELECT ids.uid, a.n AS n1, b.n AS n2, a.m AS m1, b.m AS m2, b.m - a.m AS md, b.s - a.s AS sdiff, b.lo - a.lo AS lod, b.hi - a.hi AS hid, b.t - a.t AS td, a.trend AS t1, b.trend AS t2,
  CASE WHEN abs(a.m) > 1e-9 THEN (b.m - a.m) / abs(a.m) * 100 END AS pct FROM ids LEFT JOIN tr a ON a.uid = ids.uid AND a.p = 1 LEFT JOIN tr b ON b.uid = ids.uid AND b.p = 2)"""


@query("i2_i3_i7_i8_series_comparison", f"""
WITH {_PERIODS} SELECT uid, round(md, 6) AS mean_diff, round(sdiff, 6) AS std_diff, round(lod, 6) AS min_diff, round(hid, 6) AS max_diff, round(td, 6) AS sum_diff, round(pct, 6) AS mean_diff_percent,
t1 AS trend_1, t2 AS trend_2, t1 <> t2 AS trend_changed, coalesce(abs(pct) > 10, false) AS significant FROM cmp""")
def _(spark, d):
    c = _intervals(spark, d).comparison("view", shape=False)
    numbers = ("mean_diff", "std_diff", "min_diff", "max_diff", "sum_diff", "mean_diff_percent")
    return c.select("uid", *[r6(x).alias(x) for x in numbers], "trend_1", "trend_2", "trend_changed", "significant")


_RESAMPLED = f"""
WITH {_PERIODS}, z AS (SELECT uid, n1, n2 FROM cmp WHERE n1 >= 2 AND n2 >= 2),
base AS (SELECT z.uid, pn.value AS x, pn.i * (least(n1, n2) - 1)::DOUBLE / (greatest(n1, n2) - 1) AS pos, least(n1, n2) AS sh, CASE WHEN n1 >= n2 THEN 2 ELSE 1 END AS op FROM z JOIN pn ON pn.uid = z.uid AND pn.p = CASE WHEN n1 >= n2 THEN 1 ELSE 2 END),
spot AS (SELECT *, least(floor(pos), sh - 2)::BIGINT AS lo_i FROM base),
xy AS (SELECT spot.uid, x, a.value + (b.value - a.value) * (pos - lo_i) AS y FROM spot JOIN pn a ON a.uid = spot.uid AND a.p = op AND a.i = lo_i JOIN pn b ON b.uid = spot.uid AND b.p = op AND b.i = lo_i + 1),
co AS (SELECT uid, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS r FROM xy GROUP BY uid)"""


@query("i4_i5_resampled_correlation", f"{_RESAMPLED} SELECT ids.uid, round(r, 6) AS correlation, round((r + 1) / 2, 6) AS shape_similarity FROM ids LEFT JOIN co ON co.uid = ids.uid")
def _(spark, d):
    c = _intervals(spark, d).comparison("view")
    return c.select("uid", r6("correlation").alias("correlation"), r6("shape_similarity").alias("shape_similarity"))


@query("i6_warping_distance", f"""
WITH RECURSIVE {_PERIODS}, sides AS (SELECT uid, list(value ORDER BY i) FILTER (p = 1) AS x, list(value ORDER BY i) FILTER (p = 2) AS y FROM pn GROUP BY uid HAVING count(*) FILTER (p = 1) >= 2 AND count(*) FILTER (p = 2) >= 2),
dp(uid, k, two, one) AS (SELECT uid, 1::BIGINT, NULL::DOUBLE[], NULL::DOUBLE[] FROM sides UNION ALL
  SELECT uid, k + 1, one, list_transform(range(1, len(x) + 1), lambda i: CASE WHEN k + 1 - i BETWEEN 1 AND len(y) THEN abs(x[i] - y[k + 1 - i]) + CASE WHEN k = 1 THEN 0 ELSE least(one[i - 1], one[i], two[i - 1]) END END)
  FROM dp JOIN sides USING (uid) WHERE k < len(x) + len(y))
SELECT ids.uid, round(one[len(x)] / (len(x) + len(y)), 6) AS dtw FROM ids LEFT JOIN (SELECT * FROM dp JOIN sides USING (uid) WHERE k = len(x) + len(y)) USING (uid)""")
def _(spark, d):
    return _intervals(spark, d).comparison("view", dtw=True).select("uid", r6("dtw").alias("dtw"))


@query("i9_significant_and_trend", f"{_RESAMPLED} SELECT 'significant' AS kind, uid FROM cmp WHERE abs(pct) > 10 UNION ALL SELECT 'trend', uid FROM cmp WHERE t1 <> t2 UNION ALL SELECT 'opposite', uid FROM co WHERE r < -0.5")
def _(spark, d):
    i = _intervals(spark, d)
    tag = lambda df, k: df.select(F.lit(k).alias("kind"), "uid")
    return tag(i.significant_changes("view"), "significant").unionByName(tag(i.trend_changes("view"), "trend")).unionByName(tag(i.anti_correlated("view"), "opposite"))


@query("i10_i14_summary", f"""
{_RESAMPLED} SELECT count(*) AS n_nodes, count(*) FILTER (abs(pct) > 10) AS n_significant, count(*) FILTER (t1 <> t2) AS n_trend_changes, (SELECT count(*) FROM co WHERE r < -0.5) AS n_anti_correlated,
round(avg(md), 6) AS mean_diff_avg, round(min(md), 6) AS mean_diff_min, round(max(md), 6) AS mean_diff_max, round(stddev_pop(md), 6) AS mean_diff_std, round(avg(sdiff), 6) AS std_diff_avg, round(min(sdiff), 6) AS std_diff_min, round(max(sdiff), 6) AS std_diff_max,
(SELECT round(avg(r), 6) FROM co) AS correlation_avg, (SELECT round(min(r), 6) FROM co) AS correlation_min, (SELECT round(max(r), 6) FROM co) AS correlation_max FROM cmp""")
def _(spark, d):
    s = _intervals(spark, d).summary("view")
    return s.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


@query("i12_i13_interval_query", f"{_RESAMPLED} SELECT cmp.uid, round(md, 6) AS view_mean_diff FROM cmp JOIN co ON co.uid = cmp.uid WHERE md > 5 AND r < 0 AND t1 <> t2 ORDER BY md DESC, cmp.uid LIMIT 10")
def _(spark, d):
    q = _intervals(spark, d).query().nodes().where_mean_diff("view", ">", 5).where_correlation("view", "<", 0).where_trend_changed("view")
    top = q.order_by("view_mean_diff", descending=True).limit(10).execute()
    return top.select("uid", r6("view_mean_diff").alias("view_mean_diff"))


@query("i12_interval_degree_change", """
WITH n AS (SELECT uid FROM o_nodes WHERE label = 'Supplier'), a AS (SELECT src AS uid, count(*) AS k FROM o_edges WHERE start_time <= TIMESTAMP '1996-03-31' AND end_time >= TIMESTAMP '1996-01-01' GROUP BY src),
b AS (SELECT src AS uid, count(*) AS k FROM o_edges WHERE start_time <= TIMESTAMP '1996-06-30' AND end_time >= TIMESTAMP '1996-04-01' GROUP BY src)
SELECT n.uid, coalesce(b.k, 0) - coalesce(a.k, 0) AS degree_change FROM n LEFT JOIN a ON a.uid = n.uid LEFT JOIN b ON b.uid = n.uid WHERE abs(coalesce(b.k, 0) - coalesce(a.k, 0)) > 5""")
def _(spark, d):
    i = IntervalDiff(order_graph(spark, d), ("1996-01-01", "1996-03-31"), ("1996-04-01", "1996-06-30"))
    changed = i.query().nodes().label("Supplier").where_degree_change(">", -10**9).where(F.abs("degree_change") > 5)
    return changed.execute().select("uid", "degree_change")

"""Graph patterns with static, series and cross conditions; shapes inside series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.templates import template, z_normalised
from ..operators import subsequence as P
from ..operators.diff import SnapshotDiff
from ..sources.warehouse import order_graph, signal_graph
from .registry import day_text, query, r6


def _users(spark, d):
    return signal_graph(spark, d)


@query("r1_node_sets", "SELECT 'a' AS variable, uid FROM u_nodes WHERE acctbal > 8000 UNION ALL SELECT 'b', uid FROM u_nodes WHERE nationkey = 5")
def _(spark, d):
    g = _users(spark, d)
    q = g.query().nodes("User")
    return g.match().node("a", q.where_static("acctbal", ">", 8000)).node("b", q.where_static("nationkey", "=", 5)).node_sets()


@query("r2_single_edge", "SELECT p.src AS a, p.uid AS e, p.dst AS b FROM peers p JOIN u_nodes a ON a.uid = p.src JOIN u_nodes b ON b.uid = p.dst WHERE a.acctbal > 5000")
def _(spark, d):
    g = _users(spark, d)
    return g.match().node("a", g.query().nodes("User").where_static("acctbal", ">", 5000)).node("b", "User").edge("a", "e", "b", "Peer").run()


@query("r3_path_of_two", "SELECT p.src AS a, p.uid AS e, p.dst AS b, q.uid AS f, q.dst AS c FROM peers p JOIN peers q ON q.src = p.dst")
def _(spark, d):
    return _users(spark, d).match().edge("a", "e", "b", "Peer").edge("b", "f", "c", "Peer").run()


@query("r3_triangle", "SELECT p.src AS a, p.dst AS b, q.dst AS c FROM peers p JOIN peers q ON q.src = p.dst JOIN peers r ON r.src = q.dst AND r.dst = p.src")
def _(spark, d):
    m = _users(spark, d).match().edge("a", "e", "b").edge("b", "f", "c").edge("c", "g", "a").run()
    return m.select("a", "b", "c")


@query("r3_star_of_orders", """
SELECT e.src AS s, e.dst AS c, f.dst AS k FROM o_edges e JOIN o_edges f ON f.src = e.src JOIN o_nodes n ON n.uid = e.src
WHERE n.acctbal > 9000 AND e.quantity > 80 AND f.quantity > 80 AND f.uid > e.uid""")
def _(spark, d):
    g = order_graph(spark, d)
    big = g.query().edges("Supplies").where_static("quantity", ">", 80)
    m = g.match().node("s", g.query().nodes("Supplier").where_static("acctbal", ">", 9000)).edge("s", "e", "c", big).edge("s", "f", "k", big).run()
    return m.filter("f > e").select("s", "c", "k")


@query("r4_directions", "SELECT 'in' AS way, dst AS a, src AS b FROM peers UNION ALL SELECT 'both', src, dst FROM peers UNION ALL SELECT 'both', dst, src FROM peers")
def _(spark, d):
    g = _users(spark, d)
    way = lambda w: g.match().edge("a", "e", "b", "Peer", direction=w).run().select(F.lit(w).alias("way"), "a", "b")
    return way("in").unionByName(way("both"))


@query("r5_static_conditions", """
SELECT e.src AS s, e.dst AS c FROM o_edges e JOIN o_nodes s ON s.uid = e.src JOIN o_nodes c ON c.uid = e.dst
WHERE c.segment LIKE '%HOUSE%' AND c.uid LIKE 'C1%' AND s.nationkey = 3""")
def _(spark, d):
    g = order_graph(spark, d)
    c = g.query().nodes("Customer").where_static("segment", "contains", "HOUSE").where_static("uid", "starts_with", "C1")
    return g.match().node("s", g.query().nodes("Supplier").where_static("nationkey", "=", 3)).node("c", c).edge("s", "e", "c").run().select("s", "c")


@query("r6_series_conditions", "SELECT p.src AS a, p.dst AS b FROM peers p JOIN (SELECT uid FROM days WHERE variable = 'view' GROUP BY uid HAVING avg(value) > 50) x ON x.uid = p.src")
def _(spark, d):
    g = _users(spark, d)
    return g.match().node("a", g.query().nodes("User").where_ts_agg("view", "mean", ">", 50)).edge("a", "e", "b").run().select("a", "b")


@query("r7_series_shape", "SELECT p.src AS a, p.dst AS b FROM peers p JOIN (SELECT uid FROM days WHERE variable = 'view' GROUP BY uid HAVING max(value) - avg(value) > 2 * stddev_pop(value)) x ON x.uid = p.src")
def _(spark, d):
    g = _users(spark, d)
    return g.match().node("a", g.query().nodes("User").where_ts_similar("view", shape="spike")).edge("a", "e", "b").run().select("a", "b")


@query("r8_edge_conditions", "SELECT src AS a, dst AS b FROM peers WHERE weight >= 0.1")
def _(spark, d):
    g = _users(spark, d)
    return g.match().edge("a", "e", "b", g.query().edges("Peer").where_static("weight", ">=", 0.1)).run().select("a", "b")


@query("r9_cross_conditions", """
WITH s AS (SELECT uid, max(value) FILTER (variable = 'click') AS c, avg(value) FILTER (variable = 'view') AS v FROM days GROUP BY uid)
SELECT p.src AS a, p.dst AS b FROM peers p JOIN u_nodes x ON x.uid = p.src JOIN u_nodes y ON y.uid = p.dst JOIN s sx ON sx.uid = p.src JOIN s sy ON sy.uid = p.dst
WHERE x.acctbal < y.acctbal AND sx.c > 2 * 60 AND sx.v > sy.v""")
def _(spark, d):
    m = _users(spark, d).match().edge("a", "e", "b", "Peer")
    m = m.where_cross("a.acctbal", "<", "b.acctbal").where_cross("a.click:max", ">", 120).where_cross("a.view", ">", "b.view")
    return m.run().select("a", "b")


_PAIRS = """
WITH xy AS (SELECT p.src AS a, p.dst AS b, x.value AS x, y.value AS y, x.idx AS i, least(x.n, y.n) AS n FROM peers p JOIN numbered x ON x.uid = p.src AND x.variable = 'view' JOIN numbered y ON y.uid = p.dst AND y.variable = 'view' AND y.idx = x.idx + {shift} WHERE x.idx + {up} < least(x.n, y.n)),
st AS (SELECT a, b, count(*) AS k, CASE WHEN count(*) >= 2 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS r, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM xy GROUP BY a, b)"""


def _relation(row: str, name: str, test: str, shift: int = 0, **options):
    sql = f"{_PAIRS.format(shift=shift, up=max(shift, 0))} SELECT a, b FROM st WHERE k >= 2 AND ({test})"

    @query(f"{row}_series_{name}", sql)
    def run(spark, d):
        m = _users(spark, d).match().edge("a", "e", "b", "Peer").where_series("a.view", name, "b.view", **options)
        return m.run().select("a", "b").distinct()


_relation("r10", "correlates", "r >= 0.3", threshold=0.3)
_relation("r10", "anti_correlates", "r <= -0.3", threshold=0.3)
_relation("r10", "diverges_from", "abs(coalesce(r, 0)) < 0.2", threshold=0.2)
_relation("r11", "similar_to", "abs(mx - my) / abs(my) <= 0.3 AND abs(sx - sy) / abs(sy) <= 0.3", threshold=0.3)
_relation("r12", "leads", "r >= 0.4", shift=2, threshold=0.4, lag=2)
_relation("r12", "lags", "r >= 0.4", shift=-2, threshold=0.4, lag=2)
_relation("r13", "more_volatile", "sx > sy")
_relation("r13", "more_stable", "sx < sy")


@query("r14_contains_pattern_from", """
WITH w AS (SELECT p.src AS a, p.uid AS e, p.dst AS b, x.idx AS i, q.idx AS j, y.value AS x, q.value AS p, q.n AS m FROM peers p JOIN numbered x ON x.uid = p.src AND x.variable = 'view'
  JOIN numbered q ON q.uid = p.dst AND q.variable = 'click' AND q.n >= 2 AND x.idx + q.n <= x.n JOIN numbered y ON y.ts_id = x.ts_id AND y.idx = x.idx + q.idx),
z AS (SELECT a, e, b, i, (x - avg(x) OVER k) / CASE WHEN stddev_pop(x) OVER k = 0 THEN 1 ELSE stddev_pop(x) OVER k END AS x, (p - avg(p) OVER k) / CASE WHEN stddev_pop(p) OVER k = 0 THEN 1 ELSE stddev_pop(p) OVER k END AS p FROM w WINDOW k AS (PARTITION BY e, i)),
d AS (SELECT a, e, b, i, sqrt(sum(pow(x - p, 2))) AS d FROM z GROUP BY a, e, b, i) SELECT a, b FROM d GROUP BY a, e, b HAVING min(d) <= 3.5""")
def _(spark, d):
    m = _users(spark, d).match().edge("a", "e", "b", "Peer").where_series("a.view", "contains_pattern_from", "b.click", threshold=3.5)
    return m.run().select("a", "b")


@query("r15_pattern_on_diff", """
WITH n1 AS (SELECT uid FROM o_nodes WHERE label = 'Customer' AND start_time <= TIMESTAMP '1996-01-01' AND end_time >= TIMESTAMP '1996-01-01'), n2 AS (SELECT uid FROM o_nodes WHERE label = 'Customer' AND start_time <= TIMESTAMP '1997-01-01' AND end_time >= TIMESTAMP '1997-01-01')
SELECT e.src AS s, e.uid AS e, e.dst AS c FROM o_edges e WHERE e.dst IN (SELECT uid FROM n2) AND e.dst NOT IN (SELECT uid FROM n1)""")
def _(spark, d):
    g = order_graph(spark, d)
    diff = SnapshotDiff(g.snapshot(at="1996-01-01", mode="graph"), g.snapshot(at="1997-01-01", mode="graph"))
    return g.match().from_diff("c", diff.query().nodes("added").label("Customer"), "Customer").edge("s", "e", "c").run()


@query("r16_r17_matched_ids", """
WITH m AS (SELECT p.src AS a, p.uid AS e, p.dst AS b FROM peers p JOIN u_nodes a ON a.uid = p.src WHERE a.acctbal > 5000)
SELECT 'node' AS kind, a AS uid FROM m UNION SELECT 'node', b FROM m UNION SELECT 'edge', e FROM m""")
def _(spark, d):
    g = _users(spark, d)
    return g.match().node("a", g.query().nodes("User").where_static("acctbal", ">", 5000)).edge("a", "e", "b", "Peer").matched_ids()


# shapes in series --------------------------------------------------------------------------------
def _distances(name: str, source: str = "numbered") -> str:
    """Distances of all windows by explicit positions; the template is spelled out as a table."""
    p = z_normalised(template(name))
    rows = ", ".join(f"({j}, {v!r}::DOUBLE)" for j, v in enumerate(p))
    return f"""
pat(j, p) AS (VALUES {rows}),
w AS (SELECT a.ts_id, a.idx, b.idx - a.idx AS j, b.value AS v, a.ts FROM {source} a JOIN {source} b ON b.ts_id = a.ts_id AND b.idx BETWEEN a.idx AND a.idx + {len(p) - 1} WHERE a.idx + {len(p) - 1} < a.n),
z AS (SELECT *, avg(v) OVER (PARTITION BY ts_id, idx) AS m, stddev_pop(v) OVER (PARTITION BY ts_id, idx) AS s FROM w),
dist AS (SELECT z.ts_id, z.idx, min(z.ts) AS start_ts, sqrt(sum(pow((v - m) / CASE WHEN s = 0 THEN 1 ELSE s END - p, 2))) AS d FROM z JOIN pat ON pat.j = z.j GROUP BY z.ts_id, z.idx)"""


def _greedy(source: str, score: str, reach: int, k: int) -> str:
    """``picked``: the best window of each series, then the best of those beyond its reach, and so on."""
    steps = []
    for i in range(1, k + 1):
        earlier = "".join(f" JOIN pick{j} p{j} ON p{j}.ts_id = x.ts_id AND abs(x.idx - p{j}.idx) > {reach}" for j in range(1, i))
        steps.append(f"pick{i} AS (SELECT x.ts_id, arg_min(x.idx, (x.{score}, x.idx)) AS idx, min(x.{score}) AS {score} FROM {source} x{earlier} GROUP BY x.ts_id)")
    return ", ".join(steps) + ", picked AS (" + " UNION ALL ".join(f"SELECT * FROM pick{i}" for i in range(1, k + 1)) + ")"


def _reach(name: str) -> int:
    n = len(template(name))
    return n - 1 + n // 2


_HOURLY = """hours AS (SELECT event_type AS ts_id, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2),
hourly AS (SELECT *, row_number() OVER (PARTITION BY ts_id ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY ts_id) AS n FROM hours)"""


@query("p1_p2_window_distances", f"WITH {_distances('spike')} SELECT ts_id, idx, strftime(start_ts, '%Y-%m-%d %H:%M:%S') AS start_ts, round(d, 6) AS distance FROM dist")
def _(spark, d):
    w = P.window_distances(_users(spark, d).measurements, "spike")
    return w.select("ts_id", "idx", day_text("start_ts").alias("start_ts"), r6("distance").alias("distance"))


@query("p2_p4_best_match", f"""
WITH {_distances('increasing')}, r AS (SELECT *, row_number() OVER (PARTITION BY ts_id ORDER BY d, idx) AS k FROM dist)
SELECT ts_id, idx, round(d, 6) AS distance, round(greatest(0, least(100, 100 * (1 - d / 4))), 6) AS similarity FROM r WHERE k = 1""")
def _(spark, d):
    m = P.find_pattern(_users(spark, d).measurements, "increasing", top_k=1)
    return m.select("ts_id", "idx", r6("distance").alias("distance"), r6("similarity").alias("similarity"))


@query("p3_top_matches", f"WITH {_HOURLY}, {_distances('spike', 'hourly')}, {_greedy('dist', 'd', _reach('spike'), 8)} SELECT ts_id, idx, round(d, 6) AS distance FROM picked")
def _(spark, d):
    g = signal_graph(spark, d, by_day=False)
    merged = g.measurements.select("variable", "ts", "value").groupBy(F.col("variable").alias("ts_id"), "variable", F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("value"))
    return P.find_pattern(merged, "spike", top_k=8).select("ts_id", "idx", r6("distance").alias("distance"))


@query("p3_threshold_matches", f"""
WITH RECURSIVE {_HOURLY}, {_distances('spike', 'hourly')}, r AS (SELECT *, row_number() OVER (PARTITION BY ts_id ORDER BY d, idx) AS k FROM dist WHERE d <= 2.5),
walk AS (SELECT DISTINCT ts_id, 0::BIGINT AS k, []::BIGINT[] AS chosen FROM r UNION ALL
         SELECT r.ts_id, r.k, CASE WHEN len(list_filter(chosen, lambda x: abs(x - r.idx) <= {_reach('spike')})) = 0 THEN list_append(chosen, r.idx) ELSE chosen END
         FROM walk JOIN r ON r.ts_id = walk.ts_id AND r.k = walk.k + 1),
kept AS (SELECT ts_id, unnest(arg_max(chosen, k)) AS idx FROM walk GROUP BY ts_id)
SELECT ts_id, idx, round(d, 6) AS distance FROM kept JOIN dist USING (ts_id, idx)""")
def _(spark, d):
    g = signal_graph(spark, d, by_day=False)
    merged = g.measurements.groupBy(F.col("variable").alias("ts_id"), "variable", F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("value"))
    return P.find_pattern(merged, "spike", mode="threshold", threshold=2.5).select("ts_id", "idx", r6("distance").alias("distance"))


@query("p5_f4_contains_pattern", f"WITH {_distances('decreasing')} SELECT uid FROM (SELECT 'U' || split_part(ts_id, '_', 3) AS uid, d FROM dist WHERE ts_id LIKE 'ts_view_%') GROUP BY uid HAVING min(d) <= 2.6")
def _(spark, d):
    return _users(spark, d).query().nodes("User").where_ts_pattern("view", "decreasing", threshold=2.6).execute().select("uid")


@query("p6_window_features", """
WITH w AS (SELECT ts_id, idx, n, avg(value) OVER s AS mean, stddev_pop(value) OVER s AS std FROM numbered WINDOW s AS (PARTITION BY ts_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
e AS (SELECT ts_id, idx, abs(mean - 50) / 50 + abs(std - 40) / 40 AS score FROM w WHERE idx <= n - 5 AND abs(mean - 50) / 50 <= 0.2 AND abs(std - 40) / 40 <= 0.2),
""" + _greedy("e", "score", 6, 3) + """
SELECT ts_id, idx, round(score, 6) AS score FROM picked""")
def _(spark, d):
    m = P.find_features(_users(spark, d).measurements, {"mean": 50, "std": 40}, length=5, top_k=3)
    return m.select("ts_id", "idx", r6("score").alias("score"))


_NEIGHBOURS = """
WITH w AS (SELECT a.ts_id, a.idx, b.idx - a.idx AS j, b.value AS v FROM numbered a JOIN numbered b ON b.ts_id = a.ts_id AND b.idx BETWEEN a.idx AND a.idx + 3 WHERE a.idx + 3 < a.n AND a.n >= 8),
z AS (SELECT ts_id, idx, j, (v - avg(v) OVER q) / CASE WHEN stddev_pop(v) OVER q = 0 THEN 1 ELSE stddev_pop(v) OVER q END AS v FROM w WINDOW q AS (PARTITION BY ts_id, idx)),
pd AS (SELECT a.ts_id, a.idx AS i, b.idx AS k, sqrt(sum(pow(a.v - b.v, 2))) AS d FROM z a JOIN z b ON a.ts_id = b.ts_id AND a.j = b.j AND abs(a.idx - b.idx) >= 2 GROUP BY a.ts_id, a.idx, b.idx),
nn AS (SELECT ts_id, i, arg_min(k, (d, k)) AS k, min(d) AS d FROM pd GROUP BY ts_id, i)"""


@query("p7_p8_window_profile", f"{_NEIGHBOURS} SELECT ts_id, i AS idx, round(d, 6) AS distance FROM nn")
def _(spark, d):
    return P.window_profile(_users(spark, d).measurements, 4).select("ts_id", "idx", r6("distance").alias("distance"))


@query("p7_motifs", f"{_NEIGHBOURS} SELECT ts_id, round(min(d), 6) AS distance FROM nn WHERE abs(i - k) >= 4 GROUP BY ts_id")
def _(spark, d):
    return P.motifs(_users(spark, d).measurements, 4, top_k=1).select("ts_id", r6("distance").alias("distance"))


@query("p8_discords", f"{_NEIGHBOURS} SELECT ts_id, round(max(d), 6) AS distance FROM nn GROUP BY ts_id")
def _(spark, d):
    return P.discords(_users(spark, d).measurements, 4, top_k=1).select("ts_id", r6("distance").alias("distance"))


@query("f8_pattern_matches", f"""
WITH {_distances('peak')}, {_greedy('dist', 'd', _reach('peak'), 3)}
SELECT 'U' || split_part(ts_id, '_', 3) AS uid, idx, round(d, 6) AS distance FROM picked WHERE ts_id LIKE 'ts_view_%' AND 'U' || split_part(ts_id, '_', 3) IN (SELECT uid FROM u_nodes WHERE acctbal > 2000)""")
def _(spark, d):
    q = _users(spark, d).query().nodes("User").where_static("acctbal", ">", 2000)
    return q.pattern_matches("view", "peak", top_k=3).select("uid", "idx", r6("distance").alias("distance"))


@query("p4_match_summary", f"""
WITH {_distances('increasing')}, {_greedy('dist', 'd', _reach('increasing'), 3)}, sp AS (SELECT ts_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0 AS days FROM days GROUP BY ts_id)
SELECT sp.ts_id, count(*) AS frequency, round(min(d), 6) AS best_distance, round(count(*) / any_value(days), 6) AS per_day FROM picked JOIN sp ON sp.ts_id = picked.ts_id GROUP BY sp.ts_id""")
def _(spark, d):
    m = _users(spark, d).measurements
    s = P.match_summary(P.find_pattern(m, "increasing", top_k=3), m)
    return s.select("ts_id", "frequency", r6("best_distance").alias("best_distance"), r6("per_day").alias("per_day"))

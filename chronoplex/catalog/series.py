"""Series: aggregates, lookups, trends, buckets, positions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions.python_aggregates import KURTOSIS
from ..operators import mutate, series as S
from ..operators.temporal import Grid, as_of_grid
from ..sources.warehouse import signal_graph
from .registry import day_text, query, r6


def _raw(spark, d):
    return signal_graph(spark, d, by_day=False).measurements


def _days(spark, d):
    return signal_graph(spark, d).measurements


@query("a1_a3_a4_a16_basic_aggregates", """
SELECT ts_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max,
       round(sum(value), 6) AS sum, count(*)::DOUBLE AS count, arg_min(value, ts) AS first, arg_max(value, ts) AS last
FROM samples GROUP BY ts_id""")
def _(spark, d):
    a = S.series_aggregates(_raw(spark, d), ["ts_id"], ["mean", "std", "min", "max", "sum", "count", "first", "last"])
    return a.withColumns({c: r6(c) for c in ("mean", "std", "sum")})


@query("a2_percentiles", """
SELECT ts_id, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM samples GROUP BY ts_id""")
def _(spark, d):
    return S.percentiles(_raw(spark, d), {"p50": 0.5, "p90": 0.9}).withColumns({"p50": r6("p50"), "p90": r6("p90")})


@query("a2_median_per_variable", """
SELECT variable, round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean FROM samples GROUP BY variable""")
def _(spark, d):
    a = S.series_aggregates(_raw(spark, d), ["variable"], ["median", "mean"])
    return a.withColumns({c: r6(c) for c in ("median", "mean")})


@query("a5_a6_a9_changes", """
WITH s AS (SELECT ts_id, max(value) - min(value) AS range, arg_max(value, ts) - arg_min(value, ts) AS change,
                  arg_min(value, ts) AS first, arg_max(value, ts) AS last, avg(value) AS m, stddev_pop(value) AS sd FROM samples GROUP BY ts_id)
SELECT ts_id, round(range, 6) AS range, round(change, 6) AS change, first, last,
       round(CASE WHEN first = 0 THEN CASE WHEN last > 0 THEN 'inf'::DOUBLE ELSE 0 END ELSE change / abs(first) * 100 END, 6) AS change_percent,
       round(CASE WHEN m = 0 THEN 0 ELSE sd / abs(m) END, 6) AS cv, last > first AS increasing, last < first AS decreasing,
       CASE WHEN m = 0 THEN 0 ELSE sd / abs(m) END < 0.1 AS stable FROM s""")
def _(spark, d):
    c = S.changes(_raw(spark, d))
    return c.withColumns({k: r6(k) for k in ("range", "change", "change_percent", "cv")})


@query("a7_a8_thresholds", """
SELECT ts_id, count(*) FILTER (value > 50) AS n_above, count(*) FILTER (value < 50) AS n_below,
       round(avg((value > 50)::INT), 6) AS share_above, round(avg((value < 50)::INT), 6) AS share_below FROM samples GROUP BY ts_id""")
def _(spark, d):
    return S.thresholds(_raw(spark, d), 50).withColumns({k: r6(k) for k in ("share_above", "share_below")})


@query("a10_value_at_time", """
SELECT ts_id, variable, round(value, 6) AS value FROM days WHERE ts = TIMESTAMP '2024-01-10'""")
def _(spark, d):
    return S.value_at(_days(spark, d), "2024-01-10").withColumn("value", r6("value"))


@query("a11_value_nearest", """
WITH g AS (SELECT *, abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 12:00:00')) AS gap FROM samples),
r AS (SELECT *, row_number() OVER (PARTITION BY ts_id ORDER BY gap, ts) AS rn FROM g)
SELECT ts_id, value FROM r WHERE rn = 1""")
def _(spark, d):
    return S.value_nearest(_raw(spark, d), "2024-01-10T12:00:00")


@query("a12_value_at_index", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY ts_id ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY ts_id) AS n FROM samples)
SELECT ts_id, idx, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value FROM r WHERE idx = n - 2""")
def _(spark, d):
    return S.value_at_index(_raw(spark, d), -2).withColumn("ts", day_text("ts"))


@query("a13_time_span", """
SELECT ts_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, count(*) AS n,
       round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS span_seconds FROM samples GROUP BY ts_id""")
def _(spark, d):
    s = S.time_span(_raw(spark, d))
    return s.withColumns({"first_ts": day_text("first_ts"), "last_ts": day_text("last_ts"), "span_seconds": r6("span_seconds")})


@query("a14_slice", """
SELECT ts_id, variable, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(value, 6) AS value FROM days
WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-08'""")
def _(spark, d):
    m = S.select_measurements(_days(spark, d), start="2024-01-05", end="2024-01-08")
    return m.select("ts_id", "variable", day_text("ts").alias("ts"), r6("value").alias("value"))


@query("a15_correlation_by_position", """
SELECT a.ts_id AS left_ts, b.ts_id AS right_ts,
       CASE WHEN count(*) >= 2 AND stddev_pop(a.value) > 0 AND stddev_pop(b.value) > 0 THEN round(corr(a.value, b.value), 6) END AS corr
FROM numbered a JOIN numbered b ON a.uid = b.uid AND a.idx = b.idx WHERE a.variable = 'click' AND b.variable = 'view'
GROUP BY a.ts_id, b.ts_id""")
def _(spark, d):
    g = signal_graph(spark, d)
    ids = lambda v: F.col("ts_ids").getItem(v)
    pairs = g.nodes.select(ids("click").alias("left_ts"), ids("view").alias("right_ts")).dropna()
    return S.pair_correlations(g.measurements, pairs).withColumn("corr", r6("corr"))


@query("a17_merge_series", """
WITH b AS (SELECT *, 0 AS o FROM days WHERE ts < TIMESTAMP '2024-01-11'
           UNION ALL SELECT ts_id, uid, variable, ts, value * 2, 1 FROM days WHERE ts >= TIMESTAMP '2024-01-09'),
r AS (SELECT *, row_number() OVER (PARTITION BY ts_id, variable, ts ORDER BY o) AS rn FROM b)
SELECT ts_id, variable, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(value, 6) AS value FROM r WHERE rn = 1""")
def _(spark, d):
    m = _days(spark, d)
    first, second = m.filter(F.col("ts") < "2024-01-11"), m.filter(F.col("ts") >= "2024-01-09").withColumn("value", F.col("value") * 2)
    return S.merge_series([first, second]).select("ts_id", "variable", day_text("ts").alias("ts"), r6("value").alias("value"))


@query("a18_a19_trends", """
WITH s AS (SELECT ts_id, count(*) AS n, avg(value) AS m, stddev_pop(value) AS sd, CASE WHEN count(*) >= 2 THEN regr_slope(value, idx) ELSE 0 END AS slope FROM numbered GROUP BY ts_id)
SELECT ts_id, n AS count, round(slope, 6) AS slope, CASE WHEN n < 2 THEN 'unknown' WHEN sd / (abs(m) + 1e-9) > 0.5 THEN 'volatile'
  WHEN slope > 0.1 * sd THEN 'increasing' WHEN slope < -0.1 * sd THEN 'decreasing' ELSE 'stable' END AS trend FROM s""")
def _(spark, d):
    return S.trends(_days(spark, d)).select("ts_id", "count", r6("slope").alias("slope"), "trend")


@query("udf2_user_aggregates", """
SELECT ts_id, round(sum(value * value), 4) AS energy, round(kurtosis_pop(value), 5) AS kurtosis, round(avg(value), 6) AS mean FROM samples GROUP BY ts_id""")
def _(spark, d):
    """Two aggregates of a user's own: one as a Column, one as mergeable Python, next to a built-in one."""
    A.register_aggregate("energy", lambda v, t: F.sum(v * v))
    A.register_python_aggregate("kurtosis", KURTOSIS)
    a = S.series_aggregates(_raw(spark, d), ["ts_id"], ["energy", "kurtosis", "mean"])
    return a.select("ts_id", F.round("energy", 4).alias("energy"), F.round("kurtosis", 5).alias("kurtosis"), r6("mean").alias("mean"))


@query("a20_time_buckets", """
SELECT ts_id, strftime(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '2000-01-03'), '%Y-%m-%d %H:%M:%S') AS bucket, round(max(value), 6) AS value
FROM samples GROUP BY ts_id, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '2000-01-03')""")
def _(spark, d):
    b = S.bucketed(_raw(spark, d), "7 days", "max")
    return b.select("ts_id", day_text("bucket").alias("bucket"), r6("value").alias("value"))


@query("a21_aggregate_in_range", """
SELECT ts_id, round(avg(value), 6) AS mean FROM samples WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' GROUP BY ts_id""")
def _(spark, d):
    m = S.select_measurements(_raw(spark, d), start="2024-01-05", end="2024-01-12")
    return S.series_aggregates(m, ["ts_id"], ["avg"]).withColumn("mean", r6("mean"))


@query("a22_value_as_of", """
SELECT ts_id, arg_max(value, ts) AS value FROM samples WHERE ts <= TIMESTAMP '2024-01-10' GROUP BY ts_id""")
def _(spark, d):
    return S.value_as_of(_raw(spark, d), "2024-01-10")


@query("a22_as_of_grid", """
WITH v AS (SELECT ts_id, step, arg_max(value, ts) AS value FROM january JOIN samples ON ts <= t GROUP BY ts_id, step)
SELECT ts_id, step, value FROM v""")
def _(spark, d):
    return as_of_grid(_raw(spark, d), Grid("2024-01-01", "2024-01-31", dt.timedelta(days=1)))


@query("a23_summary", """
SELECT ts_id, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(stddev_pop(value), 6) AS std, count(*)::DOUBLE AS count,
       arg_min(value, ts) AS first, arg_max(value, ts) AS last, round(max(value) - min(value), 6) AS range,
       round(arg_max(value, ts) - arg_min(value, ts), 6) AS change FROM samples GROUP BY ts_id""")
def _(spark, d):
    return S.summary(_raw(spark, d)).withColumns({c: r6(c) for c in ("mean", "std", "range", "change")})


@query("a24_series_from_results", """
SELECT 'ts_value_all' AS ts_id, 'value' AS variable, strftime(t, '%Y-%m-%d %H:%M:%S') AS ts, round(coalesce(sum(value), 0), 6) AS value
FROM january LEFT JOIN days ON ts = t AND variable = 'signup' AND value > 120 GROUP BY t""")
def _(spark, d):
    grid = Grid("2024-01-01", "2024-01-31", dt.timedelta(days=1)).frame(spark)
    high = _days(spark, d).filter("variable = 'signup' AND value > 120").groupBy(F.col("ts").alias("snap_ts")).agg(F.sum("value").alias("value"))
    out = S.from_results(grid.join(high, "snap_ts", "left"), "ts_value_all", "value")
    return out.withColumns({"ts": day_text("ts"), "value": r6("value")})


@query("a25_thinned_series", """
SELECT ts_id, variable, idx, round(value, 6) AS value FROM numbered WHERE idx % 3 = 0""")
def _(spark, d):
    return S.thin(_days(spark, d), 3).select("ts_id", "variable", "idx", r6("value").alias("value"))


@query("s16_entity_series", """
SELECT uid, variable AS property, ts_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(value, 6) AS value FROM days
WHERE variable = 'view' AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-06'""")
def _(spark, d):
    g = signal_graph(spark, d)
    out = S.entity_series(g.nodes, g.measurements, "view", "2024-01-03", "2024-01-06")
    return out.withColumns({"ts": day_text("ts"), "value": r6("value")})


@query("s17_select_measurements", """
WITH ids AS (SELECT DISTINCT ts_id FROM samples WHERE value > 200)
SELECT ts_id, variable, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value FROM samples
WHERE ts_id IN (SELECT ts_id FROM ids) AND variable IN ('click', 'view') AND ts <= TIMESTAMP '2024-01-20'""")
def _(spark, d):
    m = _raw(spark, d)
    ids = m.filter("value > 200").select("ts_id").distinct()
    return S.select_measurements(m, ids, ["click", "view"], end="2024-01-20").withColumn("ts", day_text("ts"))


@query("s17_first_measurements", """
SELECT ts_id, variable, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value FROM samples ORDER BY ts_id, variable, samples.ts LIMIT 50""")
def _(spark, d):
    return S.select_measurements(_raw(spark, d), limit=50).withColumn("ts", day_text("ts"))


@query("s19_variables", "SELECT DISTINCT ts_id, variable FROM samples")
def _(spark, d):
    return S.variables(_raw(spark, d))


@query("s20_measurement_stats", """
SELECT variable, count(*) AS n, count(DISTINCT ts_id) AS n_series, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM samples GROUP BY variable""")
def _(spark, d):
    return S.measurement_stats(_raw(spark, d)).withColumns({"first_ts": day_text("first_ts"), "last_ts": day_text("last_ts")})


@query("s25_series_catalogue", """
SELECT DISTINCT uid AS owner, 'node' AS owner_kind, 'User' AS label, variable AS property, ts_id FROM samples""")
def _(spark, d):
    g = signal_graph(spark, d)
    return S.catalogue(g.nodes, g.edges)


@query("io3_io13_upsert_samples", """
WITH b AS (SELECT ts_id, variable, ts, value, 0 AS o FROM days UNION ALL
           SELECT ts_id, variable, ts + INTERVAL 5 DAY, value + 1000, 1 FROM days WHERE variable = 'error'),
r AS (SELECT *, row_number() OVER (PARTITION BY ts_id, variable, ts ORDER BY o DESC) AS rn FROM b)
SELECT ts_id, variable, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(value, 6) AS value FROM r WHERE rn = 1""")
def _(spark, d):
    m = _days(spark, d)
    new = m.filter("variable = 'error'").select("ts_id", "variable", (F.col("ts") + F.expr("INTERVAL 5 DAYS")).alias("ts"), (F.col("value") + 1000).alias("value"))
    return mutate.upsert_samples(m, new).withColumns({"ts": day_text("ts"), "value": r6("value")})

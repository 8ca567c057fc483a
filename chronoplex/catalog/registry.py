"""Registry of queries and the shared pieces of their SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: SQL of the graph tables that the queries run on; see ``sources.warehouse`` for the same rules.
VIEWS = {
    "o_nodes": """
        SELECT 'C' || c_custkey AS uid, 'Customer' AS label, a.s AS start_time, a.e AS end_time,
               c_acctbal AS acctbal, c_mktsegment AS segment, c_nationkey AS nationkey
        FROM customer JOIN (SELECT o_custkey, min(o_orderdate) AS s, max(o_orderdate) + INTERVAL 90 DAY AS e
                            FROM orders GROUP BY o_custkey) a ON a.o_custkey = c_custkey
        UNION ALL SELECT 'S' || s_suppkey, 'Supplier', NULL, NULL, s_acctbal, NULL, s_nationkey FROM supplier""",
    "o_edges": """
        SELECT 'O' || o_orderkey || '_S' || l_suppkey AS uid, 'S' || l_suppkey AS src, 'C' || o_custkey AS dst,
               'Supplies' AS label, o_orderdate AS start_time,
               CASE WHEN shipped > o_orderdate THEN shipped ELSE o_orderdate + INTERVAL 90 DAY END AS end_time,
               quantity, price, n_lines
        FROM (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS quantity, sum(l_extendedprice) AS price,
                     count(*) AS n_lines, max(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey, l_suppkey)
        JOIN orders ON o_orderkey = l_orderkey""",
    "samples": """
        SELECT 'ts_' || event_type || '_' || user_id AS ts_id, 'U' || user_id AS uid, event_type AS variable, ts, value FROM events""",
    "days": """
        SELECT ts_id, uid, variable, date_trunc('day', ts)::TIMESTAMP AS ts, avg(value) AS value
        FROM samples GROUP BY ts_id, uid, variable, date_trunc('day', ts)""",
    "u_nodes": """
        SELECT 'U' || c_custkey AS uid, c_acctbal AS acctbal, c_nationkey AS nationkey, c_custkey AS k
        FROM customer WHERE c_custkey IN (SELECT user_id FROM events)""",
    "peers": """
        SELECT 'P' || a.k || '_' || b.k AS uid,
               CASE WHEN (a.k + b.k) % 3 = 0 THEN b.uid ELSE a.uid END AS src,
               CASE WHEN (a.k + b.k) % 3 = 0 THEN a.uid ELSE b.uid END AS dst, 1.0::DOUBLE / (b.k - a.k) AS weight
        FROM u_nodes a JOIN u_nodes b ON a.nationkey = b.nationkey AND a.k < b.k AND b.k - a.k <= 50""",
    "numbered": """
        SELECT ts_id, uid, variable, ts, value, row_number() OVER (PARTITION BY ts_id ORDER BY ts) - 1 AS idx,
               count(*) OVER (PARTITION BY ts_id) AS n FROM days""",
    "month_grid": """
        SELECT i::BIGINT AS step, TIMESTAMP '1996-01-01' + i * INTERVAL 1 DAY AS t FROM range(30) r(i)""",
    "week_grid": """
        SELECT i::BIGINT AS step, TIMESTAMP '1996-01-01' + i * INTERVAL 7 DAY AS t FROM range(8) r(i)""",
    "year_grid": """
        SELECT i::BIGINT AS step, first_day + i * INTERVAL 1 DAY AS t
        FROM (SELECT min(start_time)::TIMESTAMP AS first_day, date_diff('day', min(start_time)::TIMESTAMP, max(end_time)::TIMESTAMP) AS n_days FROM o_edges), range(n_days) r(i)""",
    "all_weeks": """
        SELECT i::BIGINT AS step, first_day + i * INTERVAL 7 DAY AS t
        FROM (SELECT min(start_time)::TIMESTAMP AS first_day, (date_diff('day', min(start_time)::TIMESTAMP, max(end_time)::TIMESTAMP) + 6) // 7 AS n_weeks FROM o_edges), range(n_weeks) r(i)""",
    "january": """
        SELECT i::BIGINT AS step, TIMESTAMP '2024-01-01' + i * INTERVAL 1 DAY AS t FROM range(30) r(i)""",
}


def _with_views(sql: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(body)
                needed.append(name)

    visit(sql)
    head = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
    body = sql.strip()
    recursive = bool(re.match(r"WITH RECURSIVE\b", body))
    own = re.sub(r"^WITH( RECURSIVE)?\s+", "", body) if body.upper().startswith("WITH") else None
    if not head:
        return body
    start = "WITH RECURSIVE " if recursive else "WITH "
    return f"{start}{head}, {own}" if own else f"{start}{head} {body}"


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = _with_views(sql)
        return fn
    return register


def day_text(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)

"""Queries and their SQL by name, and the SQL of the projections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL for the same rows if there is some."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def R(x: str) -> str:
    """Rounded to six digits, without a negative zero."""
    return f"CASE WHEN round(({x}), 6) = 0 THEN 0.0 ELSE round(({x}), 6) END"


P = "p AS (SELECT vec_id AS idx, CAST(vec_id // 25 AS INTEGER) AS y, CAST(vec_id % 25 AS INTEGER) AS x, label AS phase, CAST(embedding AS DOUBLE[]) AS p FROM embeddings)"
PX = "px AS (SELECT idx, y, x, CAST(i AS INTEGER) AS pixel, CAST(i // 8 AS INTEGER) AS r, CAST(i % 8 AS INTEGER) AS c, p[i + 1] AS v FROM p, range(64) t(i))"
L = """l AS (SELECT l_partkey AS idx, CAST((year(l_shipdate) - 1995) * 7 + l_linenumber - 1 AS INTEGER) AS pixel, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
lx AS (SELECT k.idx, CAST(i AS INTEGER) AS pixel, CAST(i // 7 AS INTEGER) AS r, CAST(i % 7 AS INTEGER) AS c, coalesce(l.v, 0.0) AS v FROM (SELECT DISTINCT idx FROM l) k CROSS JOIN range(49) t(i) LEFT JOIN l ON l.idx = k.idx AND l.pixel = i)"""
E = """ev AS (SELECT user_id AS idx, CAST(hour(ts) * 5 + list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS INTEGER) AS pixel, sum(value) AS v FROM events GROUP BY ALL),
ex AS (SELECT k.idx, CAST(i AS INTEGER) AS pixel, coalesce(ev.v, 0.0) AS v FROM (SELECT DISTINCT idx FROM ev) k CROSS JOIN range(120) t(i) LEFT JOIN ev ON ev.idx = k.idx AND ev.pixel = i)"""
#: The patterns of P at unit length (uq), and those centred before (un).
UNIT = "uq AS (SELECT idx, y, x, phase, list_transform(p, lambda v: v / sqrt(list_dot_product(p, p))) AS q FROM p)"
CENTRED = "cq AS (SELECT idx, y, x, phase, list_transform(p, lambda v: v - list_avg(p)) AS q FROM p), un AS (SELECT idx, y, x, phase, list_transform(q, lambda v: v / sqrt(list_dot_product(q, q))) AS q FROM cq)"

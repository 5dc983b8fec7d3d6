"""Registered queries of the analytics side and the DuckDB SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "possession_spans"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: The views that the SQL counterparts start from, as the sources module builds them.
_VIEWS = """WITH ev AS (
    SELECT user_id AS u, event_id AS id, CAST(floor(epoch(date_trunc('second', ts))) AS BIGINT) AS t, event_type AS state, value AS v FROM events
), bx AS (
    SELECT l_orderkey AS frame, CAST(l_linenumber AS BIGINT) AS id, CAST(l_partkey % 97 AS DOUBLE) AS x1, CAST(l_suppkey % 89 AS DOUBLE) AS y1,
           l_partkey % 97 + l_quantity AS x2, l_suppkey % 89 + l_quantity AS y2, l_discount AS score, l_returnflag AS label, l_partkey AS part, l_suppkey AS supp
    FROM lineitem
)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with SQL that goes on from the views `ev` and `bx`."""

    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = f"{_VIEWS}{sql}"
        return f

    return keep


def queries() -> dict[str, Query]:
    from touchline.plans import canonical, entities, evidence, frames, match, review, streams, tracking, tracks  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)

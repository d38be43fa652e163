"""Named queries over the driver's tables, each with its DuckDB oracle.

Every query reads the whole ``events`` table (through ``clicks_from_events``)
or data Spark derives from it.  ``QUERIES[name](spark, sf_dir)`` returns a
DataFrame; ``ORACLES[name]`` is the equivalent SQL over the same parquet
tables (views ``events`` …).  Queries without an oracle are checked by row
count and by the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The click log as SQL: same mapping as ``clicks_from_events``.
CLICKS_CTE = """clicks AS (
  SELECT click_id, ip, k % 20 AS app, k % 2 AS device, k % 3 AS os, k % 50 AS channel,
         click_time,
         CASE WHEN purchase THEN click_time + to_seconds(k) END AS attributed_time,
         CASE WHEN purchase THEN 1 ELSE 0 END AS is_attributed
  FROM (SELECT event_id AS click_id, user_id AS ip, CAST(ts AS TIMESTAMP) AS click_time,
               TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
               event_type = 'purchase' AS purchase
        FROM events))"""


def with_clicks(sql: str) -> str:
    """Prefix a query body with the clicks CTE.

    ``sql`` is either a SELECT or further CTEs starting with a comma.
    """
    body = sql.strip()
    if body.startswith(","):
        return f"WITH {CLICKS_CTE}{body}"
    return f"WITH {CLICKS_CTE}\n{body}"


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_clicks(sql)
        return fn
    return deco


# Register all query modules (import for side effects).
from clickcast.plans import (  # noqa: E402,F401
    q_explore,
    q_features,
    q_io,
    q_sequence,
)

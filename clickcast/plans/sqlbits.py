"""SQL fragments shared by the DuckDB oracles (CTEs that follow ``clicks``)."""

from __future__ import annotations

USER = "ip, device, os"
DIMS = ("device", "os", "app", "channel")


def epoch_s(col: str) -> str:
    """Whole epoch seconds, floor (same as Spark's cast to long)."""
    return f"(epoch_us({col}) // 1000000)"


TIME_FEATURES = """, tf AS (
  SELECT click_id, ip, app, device, os, channel, click_time,
         strftime(click_time, '%a') AS click_time_wday,
         attributed_time, strftime(attributed_time, '%a') AS attributed_time_wday,
         is_attributed, CAST(hour(click_time) AS VARCHAR) AS click_time_hour
  FROM clicks)"""


def sequence(src: str = "tf", name: str = "seq", label: str | None = "is_attributed") -> str:
    """prev_label, times_attributed, n_previous_clicks, click_time_diff."""
    lab = label if label else "0"
    o = "click_time, click_id"
    return f""", {name}_a AS (
  SELECT *, lag({lab}) OVER (PARTITION BY {USER} ORDER BY {o}) AS prev_label FROM {src})
, {name}_b AS (
  SELECT *, CAST(coalesce(sum(prev_label) OVER (PARTITION BY {USER} ORDER BY {o}
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS times_attributed
  FROM {name}_a)
, {name} AS (
  SELECT *, CAST(row_number() OVER w2 - 1 AS BIGINT) AS n_previous_clicks,
         abs({epoch_s('click_time')} - {epoch_s('first_value(click_time) OVER w2')}) / 60
           AS click_time_diff
  FROM {name}_b
  WINDOW w2 AS (PARTITION BY {USER}, times_attributed ORDER BY {o}))"""


def scores(src: str = "clicks", name: str = "scores", dims=DIMS) -> str:
    """dim, key, "0", "1", prcnt_1, custom_score (long form)."""
    union = "\n    UNION ALL ".join(
        f"SELECT '{d}' AS dim, CAST({d} AS BIGINT) AS key, is_attributed AS lab FROM {src}"
        for d in dims)
    rate = "CASE WHEN n0 IS NOT NULL AND n1 IS NOT NULL THEN (n1 / (n0 + n1)) * 100 END"
    return f""", {name}_c AS (
  SELECT dim, key,
         CASE WHEN n0 > 0 THEN n0 END AS n0, CASE WHEN n1 > 0 THEN n1 END AS n1
  FROM (SELECT dim, key, count(*) FILTER (WHERE lab = 0) AS n0,
               count(*) FILTER (WHERE lab = 1) AS n1
        FROM ({union}) u WHERE key IS NOT NULL GROUP BY dim, key) g)
, {name} AS (
  SELECT dim, key, n0 AS "0", n1 AS "1",
         coalesce({rate}, 0.0) / 100 AS prcnt_1,
         CAST(coalesce(n1, 0) AS BIGINT) * (coalesce({rate}, 0.0) / 100) AS custom_score
  FROM {name}_c)"""


def score_joins(left: str, table: str = "scores", dims=DIMS, how: str = "JOIN") -> str:
    return "\n".join(
        f"{how} {table} s_{d} ON s_{d}.dim = '{d}' AND s_{d}.key = {left}.{d}" for d in dims)


def score_cols(dims=DIMS) -> str:
    return ", ".join(f"s_{d}.custom_score AS {d}_custom_score" for d in dims)

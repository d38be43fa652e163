"""Letter bands for category scores.

The bands are checked in the listed order and the first match wins; a score
matching no band gets the fallback letter.  Gaps between bands (for example
app scores between 214 and 481) therefore fall to the fallback.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (letter, lower bound, lower inclusive, upper bound, upper inclusive),
# None = unbounded; then the fallback letter.
SCORE_BANDS = {
    "device": ([
        ("A", 50, False, None, False),
        ("B", 9, True, 50, True),
        ("C", 7, False, 9, True),
        ("D", 5.24, False, 7, True),
        ("E", 4.12, False, 5.24, True),
        ("F", 2.87, False, 4.12, True),
        ("G", 1.92, False, 2.87, True),
        ("H", 1.2, True, 1.92, True),
        ("I", 0.5, False, 1.2, False),
    ], "J"),
    "os": ([
        ("A", 105, False, None, False),
        ("B", 60, False, 105, True),
        ("C", 35, False, 60, True),
        ("D", 10, True, 35, True),
        ("E", 1, True, 10, False),
    ], "F"),
    "app": ([
        ("A", 481, True, None, False),
        ("B", 111, True, 214, True),
        ("C", 23, False, 51, True),
        ("D", 4, True, 13, True),
        ("E", 0.6, True, 3, False),
    ], "F"),
    "channel": ([
        ("A", 4279, True, None, False),
        ("B", 1319, True, 2356, True),
        ("C", 368, False, 627, True),
        ("D", 52, True, 202, True),
        ("E", 3, True, 26, False),
    ], "F"),
}


def _band_condition(score: Column, lo, lo_inc, hi, hi_inc) -> Column:
    cond = F.lit(True)
    if lo is not None:
        cond = cond & ((score >= lo) if lo_inc else (score > lo))
    if hi is not None:
        cond = cond & ((score <= hi) if hi_inc else (score < hi))
    return cond


def score_band(score: Column, dim: str) -> Column:
    bands, fallback = SCORE_BANDS[dim]
    expr = None
    for letter, lo, lo_inc, hi, hi_inc in bands:
        cond = _band_condition(score, lo, lo_inc, hi, hi_inc)
        expr = F.when(cond, letter) if expr is None else expr.when(cond, letter)
    return expr.otherwise(fallback)


def band_case_sql(score_sql: str, dim: str) -> str:
    """The same banding as a SQL CASE expression (used by the oracles)."""
    bands, fallback = SCORE_BANDS[dim]
    parts = []
    for letter, lo, lo_inc, hi, hi_inc in bands:
        conds = []
        if lo is not None:
            conds.append(f"{score_sql} {'>=' if lo_inc else '>'} {lo}")
        if hi is not None:
            conds.append(f"{score_sql} {'<=' if hi_inc else '<'} {hi}")
        parts.append(f"WHEN {' AND '.join(conds)} THEN '{letter}'")
    return f"CASE {' '.join(parts)} ELSE '{fallback}' END"

"""Calendar and time expressions.

All results depend on ``spark.sql.session.timeZone``; the loaders pin it to UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday abbreviations and their numbers (Monday = 1).
WEEKDAY_NUMBERS = {"Mon": 1, "Tue": 2, "Wed": 3, "Thu": 4, "Fri": 5, "Sat": 6, "Sun": 7}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def weekday_abbr(c: str | Column) -> Column:
    """Three-letter weekday name, ``Mon`` … ``Sun``."""
    return F.date_format(_col(c), "E")


def hour_of_day(c: str | Column) -> Column:
    """Hour as an unpadded string, ``"0"`` … ``"23"``."""
    return F.date_format(_col(c), "H")


def epoch_seconds(c: str | Column) -> Column:
    """Whole seconds since the epoch (floor), as bigint."""
    return _col(c).cast("timestamp").cast("long")


def weekday_number(c: str | Column) -> Column:
    """Map a weekday abbreviation to 1..7; anything else gives null."""
    col = _col(c)
    expr = None
    for name, num in WEEKDAY_NUMBERS.items():
        expr = (F.when(col == name, F.lit(num)) if expr is None
                else expr.when(col == name, F.lit(num)))
    return expr

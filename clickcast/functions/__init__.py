"""Column-level helpers built from Spark's built-in expressions (no UDFs)."""

from clickcast.functions.calendar import (
    epoch_seconds,
    hour_of_day,
    weekday_abbr,
    weekday_number,
)
from clickcast.functions.categories import SCORE_BANDS, score_band

__all__ = [
    "SCORE_BANDS",
    "epoch_seconds",
    "hour_of_day",
    "score_band",
    "weekday_abbr",
    "weekday_number",
]

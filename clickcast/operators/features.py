"""Feature preparation: fixed one-hot of the hour, min-max scaling,
vector assembly and the model matrices.

Scaling is fitted with one global aggregate (partial on every task, one
row to the driver: the bounds) and applied as literal arithmetic, so the
transform stays inside whole-stage codegen.  A constant column scales to 0.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOURS = tuple(range(24))
SCORE_COLS = ("device_custom_score", "os_custom_score", "app_custom_score",
              "channel_custom_score")
NUMERIC_COLS = SCORE_COLS + ("n_previous_clicks", "click_time_diff")
HOUR_FLAG_COLS = tuple(f"hour_{h}" for h in HOURS)


def one_hot_hour(df: DataFrame, col: str = "click_time_hour", prefix: str = "hour_") -> DataFrame:
    """24 int flags, one per hour 0..23 (all levels kept, none dropped)."""
    h = F.col(col).cast("int")
    return df.withColumns({f"{prefix}{i}": F.coalesce((h == i).cast("int"), F.lit(0))
                           for i in HOURS})


def min_max_fit(df: DataFrame, cols, zero_baseline: bool = False) -> dict[str, tuple]:
    """Bounds per column.  ``zero_baseline`` widens them to include 0 (the
    effect of appending zero rows before fitting)."""
    row = df.agg(*[F.min(c).cast("double").alias(f"lo_{c}") for c in cols],
                 *[F.max(c).cast("double").alias(f"hi_{c}") for c in cols]).first()
    out = {}
    for c in cols:
        lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
        if zero_baseline:
            lo = 0.0 if lo is None else min(lo, 0.0)
            hi = 0.0 if hi is None else max(hi, 0.0)
        out[c] = (lo, hi)
    return out


def min_max_transform(df: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    cols = {}
    for c, (lo, hi) in bounds.items():
        x = F.col(c).cast("double")
        if lo is None or hi is None or hi == lo:
            cols[c] = F.when(x.isNotNull(), F.lit(0.0))
        else:
            cols[c] = (x - F.lit(lo)) / (F.lit(hi) - F.lit(lo))
    return df.withColumns(cols)


def min_max_scale(df: DataFrame, cols=NUMERIC_COLS, zero_baseline: bool = False) -> DataFrame:
    return min_max_transform(df, min_max_fit(df, cols, zero_baseline))


def assemble(df: DataFrame, cols, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def model_matrix(extract: DataFrame, numeric=NUMERIC_COLS, keep=("click_id",)) -> DataFrame:
    """Scaled numerics followed by the 24 hour flags (flat columns)."""
    ids = [c for c in keep if c in extract.columns]
    return hour_flags(min_max_scale(extract, numeric), ids, numeric)


def hour_flags(scaled: DataFrame, ids, numeric=NUMERIC_COLS, more=()) -> DataFrame:
    """Ids, numerics, the 24 hour flags and more columns."""
    return one_hot_hour(scaled).select(*ids, *numeric, *HOUR_FLAG_COLS, *more)


def scoring_matrix(scoring: DataFrame, numeric=NUMERIC_COLS, keep=("click_id",)) -> DataFrame:
    """The scoring-side matrix: missing values 0, bounds widened to include
    0, then the 24 hour flags."""
    ids = [c for c in keep if c in scoring.columns]
    filled = scoring.na.fill(0, subset=list(numeric))
    scaled = min_max_scale(filled, numeric, zero_baseline=True)
    return hour_flags(scaled, ids, numeric)

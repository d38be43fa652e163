"""Scoring-side composites: features of an unlabelled click log, looked up
in fitted score tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickcast.functions.calendar import hour_of_day, weekday_abbr
from clickcast.operators.joins import DEFAULT_BROADCAST_ROWS, maybe_broadcast, measured_many
from clickcast.operators.scores import CATEGORY_COLS
from clickcast.operators.sequence import scoring_sequence_features

SCORE_JOIN_ORDER = ("os", "app", "channel", "device")


def only_wday_and_hours(clicks: DataFrame) -> DataFrame:
    return clicks.select("click_id",
                         weekday_abbr("click_time").alias("click_time_wday"),
                         hour_of_day("click_time").alias("click_time_hour"))


def only_n_previous_clicks(clicks: DataFrame) -> DataFrame:
    return scoring_sequence_features(clicks).select("click_id", "n_previous_clicks")


def only_clicktimediff(clicks: DataFrame) -> DataFrame:
    return scoring_sequence_features(clicks).select("click_id", "click_time_diff")


def score_lookup_tables(scores_long: DataFrame, as_text_keys: bool = False) -> dict[str, DataFrame]:
    """Per-dim lookup tables (key, custom_score) from a long score table.
    ``as_text_keys`` gives the text keys a CSV score file has.  The (small)
    long table is kept so the four lookups share one aggregation."""
    scores_long = scores_long.persist(StorageLevel.MEMORY_AND_DISK)
    out = {}
    for dim in CATEGORY_COLS:
        key = F.col("key").cast("string") if as_text_keys else F.col("key")
        out[dim] = (scores_long.where(F.col("dim") == dim)
                               .select(key.alias(dim), "custom_score"))
    return out


def scoring_features(clicks: DataFrame, lookups: dict[str, DataFrame], how: str = "inner",
                     fill_missing: bool = False,
                     broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Calendar + scoring sequence features + four score lookups.

    Lookup keys may be text (score files): they are converted with
    ``try_cast`` so one bad key cannot fail the job.  ``how="inner"`` drops
    clicks with unseen keys as the original workflow does; ``how="left"`` keeps them
    and, with ``fill_missing``, scores them 0.
    """
    base = clicks.select("click_id", "ip", "app", "device", "os", "channel", "click_time",
                         weekday_abbr("click_time").alias("click_time_wday"),
                         hour_of_day("click_time").alias("click_time_hour"))
    feats = scoring_sequence_features(base)
    types = dict(clicks.dtypes)
    typed = {dim: lookups[dim].select(F.col(dim).try_cast(types[dim]).alias(dim),
                                      F.col("custom_score").alias(f"{dim}_custom_score"))
             for dim in SCORE_JOIN_ORDER}
    typed, sizes = measured_many(typed)
    for dim in SCORE_JOIN_ORDER:
        lk = maybe_broadcast(typed[dim], sizes[dim], broadcast_rows)
        feats = feats.join(lk, on=dim, how=how).drop(dim)
    if fill_missing:
        feats = feats.na.fill(0.0, subset=[f"{d}_custom_score" for d in SCORE_JOIN_ORDER])
    return feats

"""Training-side composites: calendar features, the full feature table
(flagship) and the modelling extract."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from clickcast.functions.calendar import hour_of_day, weekday_abbr
from clickcast.operators.joins import DEFAULT_BROADCAST_ROWS, join_per_key, maybe_broadcast, measured
from clickcast.operators.scores import CATEGORY_COLS, label_counts, score_for, scores_from_counts
from clickcast.operators.sequence import sequence_features

TIME_FEATURE_COLS = (
    "ip", "app", "device", "os", "channel", "click_time", "click_time_wday",
    "attributed_time", "attributed_time_wday", "is_attributed", "click_time_hour",
)

EXTRACT_DROP = ("app", "device", "os", "ip", "channel", "click_time",
                "attributed_time", "attributed_time_wday")


def add_time_features(df: DataFrame) -> DataFrame:
    """Adds the weekday of click and install and the hour of click."""
    return df.withColumns({
        "click_time_wday": weekday_abbr("click_time"),
        "attributed_time_wday": weekday_abbr("attributed_time"),
        "click_time_hour": hour_of_day("click_time"),
    })


def time_features(clicks: DataFrame, keep_id: bool = True) -> DataFrame:
    """Weekday of click and install, hour of click (strings)."""
    ids = ["click_id"] if keep_id and "click_id" in clicks.columns else []
    return clicks.select(
        *ids, "ip", "app", "device", "os", "channel", "click_time",
        weekday_abbr("click_time").alias("click_time_wday"),
        "attributed_time",
        weekday_abbr("attributed_time").alias("attributed_time_wday"),
        "is_attributed",
        hour_of_day("click_time").alias("click_time_hour"),
    )


def training_features(clicks: DataFrame, chunk_seconds: int | None = None,
                      broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
                      scores: DataFrame | None = None,
                      target_chunk_rows: int = 1_000_000) -> DataFrame:
    """Calendar + sequence features + the four category scores.

    Unless a fitted long score table is given, one scan of ``clicks``
    yields the label counts of all four keys together with the log's size;
    that small table is kept, and one job reads from it both the log's size
    (which tells whether any user can be too heavy for one window) and the
    score table's row count, which decides the broadcast.  Inner joins drop clicks with null or
    unseen keys.
    """
    if scores is None:
        counts = label_counts(clicks, CATEGORY_COLS, time_col="click_time")
        counts = counts.persist(StorageLevel.MEMORY_AND_DISK)
        facts = {r["is_log"]: r for r in counts.groupBy(
            (F.col("dim") == "_log").alias("is_log")).agg(
                F.count(F.lit(1)).alias("rows"), F.max("_n").alias("n")).collect()}
        n_rows = facts[True]["n"] if True in facts else 0
        long = scores_from_counts(counts)
        n = facts[False]["rows"] if False in facts else 0
    else:
        long, n = measured(scores)
        n_rows = None
    long = maybe_broadcast(long, n, broadcast_rows)
    # Calendar strings are derived after the shuffle, so it moves raw columns only.
    seq = sequence_features(clicks, chunk_seconds=chunk_seconds,
                            target_chunk_rows=target_chunk_rows, n_rows=n_rows,
                            outputs=("n_previous_clicks", "click_time_diff"))
    feats = add_time_features(seq)
    for dim in CATEGORY_COLS:
        feats = feats.join(score_for(long, dim), on=dim, how="inner")
    return feats


def modelling_extract(features: DataFrame, keep_id: bool = False) -> DataFrame:
    """The columns handed to modelling (ids and raw keys dropped)."""
    drop = list(EXTRACT_DROP) + ([] if keep_id else ["click_id"])
    return features.drop(*drop)


def write_modelling_samples(clicks: DataFrame, out_dir: str, fractions=None,
                            seeds=None) -> DataFrame:
    """The sampling job: features → extract → four stratified samples,
    written as CSV (nulls as ``null``) in one distributed write, one folder
    per sample.  Returns the class balance of the full extract."""
    from clickcast.operators.explore import class_balance
    from clickcast.operators.sampling import SAMPLE_FRACTIONS, SAMPLE_SEEDS, stratified_samples
    from clickcast.sources.clicks import EXTRACT_SCHEMA

    fractions = fractions or SAMPLE_FRACTIONS
    seeds = seeds or SAMPLE_SEEDS
    extract = modelling_extract(training_features(clicks))
    samples = stratified_samples(extract, "is_attributed", fractions, seeds)
    (samples.select("sample_id", *[f.name for f in EXTRACT_SCHEMA.fields])
            .write.mode("overwrite").partitionBy("sample_id")
            .option("header", True).option("nullValue", "null").csv(out_dir))
    return class_balance(extract)


def read_modelling_samples(spark, out_dir: str, sample_ids=None) -> DataFrame:
    """Samples written by :func:`write_modelling_samples`; given ids prune the folders that are read."""
    from clickcast.sources.clicks import EXTRACT_SCHEMA, read_csv

    keep = None if sample_ids is None else F.col("sample_id").isin(*sample_ids)
    return read_csv(spark, out_dir, StructType([*EXTRACT_SCHEMA.fields, StructField("sample_id", IntegerType())]), where=keep)


def user_ever_attributed(clicks: DataFrame, user_cols=("ip", "device", "os"),
                         label_col: str = "is_attributed", id_col: str = "click_id", **bounds) -> DataFrame:
    """Conversions per user joined back to each click.

    The per-user sum is a partial aggregate (skew-safe).  The join back broadcasts it when its
    measured size allows; otherwise only the users of many clicks are split (``join_per_key``,
    whose bounds may be given).
    """
    per_user = (clicks.groupBy(*user_cols)
                      .agg(F.sum(label_col).cast("long").alias("ever_attributed"), F.count(F.lit(1)).alias("_n")))
    return join_per_key(clicks, per_user, user_cols, "_n", F.col(id_col), **bounds)

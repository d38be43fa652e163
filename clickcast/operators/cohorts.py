"""User cohorts and the path to conversion.

Users are (ip, device, os).  The original analysis answers these with
per-user windows and self-joins; here each is a grouped aggregate on the
map side first (so a user with a third of all clicks is never one task's
raw input) followed by joins on keys that include the click time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickcast.functions.calendar import epoch_seconds
from clickcast.operators.joins import join_per_key, join_small

USER = ("ip", "device", "os")
LABEL = "is_attributed"


def _user_not_null(df: DataFrame, user=USER) -> DataFrame:
    cond = F.lit(True)
    for c in user:
        cond = cond & F.col(c).isNotNull()
    return df.where(cond)


def channel_pairs_per_converting_user(clicks: DataFrame, user=USER) -> DataFrame:
    """Per user with both classes: |channels when converting| × |channels
    when not|, i.e. the number of (channel, channel) pairs the original
    join of the two distinct sets yields, computed without forming pairs."""
    d = (_user_not_null(clicks, user).where(F.col(LABEL).isin(0, 1))
         .select(*user, "channel", LABEL).distinct())
    g = d.groupBy(*user).agg(F.count(F.when(F.col(LABEL) == 1, 1)).alias("_a"),
                             F.count(F.when(F.col(LABEL) == 0, 1)).alias("_b"))
    return g.where((F.col("_a") > 0) & (F.col("_b") > 0)).select(
        *user, (F.col("_a") * F.col("_b")).alias("count"))


def _channels_by_user(clicks: DataFrame, user) -> DataFrame:
    """One row per (user, channel) with the user's conversions so far
    aggregated (max label of the pair)."""
    return clicks.groupBy(*user, "channel").agg(F.max(LABEL).alias("_m"))


def channels_per_converting_user(clicks: DataFrame, user=USER) -> DataFrame:
    """Distinct channels over all clicks of users who converted at least once."""
    g = _channels_by_user(clicks, user).groupBy(*user).agg(
        F.max("_m").alias("_conv"), F.count(F.lit(1)).alias("count"))
    return g.where(F.col("_conv") == 1).select(*user, "count")


def channels_per_never_converted_user(clicks: DataFrame, user=USER) -> DataFrame:
    """Distinct channels of users without any conversion."""
    g = (_channels_by_user(clicks, user).groupBy(*user)
         .agg(F.max("_m").alias("_conv"), F.count(F.lit(1)).alias("count")))
    return g.where(F.col("_conv") == 0).select(*user, "count")


def channels_per_nonconverting_click_user(clicks: DataFrame, user=USER) -> DataFrame:
    """The original "never attributed" count as it computes it: its
    running sum is ordered by the label, so every non-converting click
    passes the filter; the result is distinct channels over non-converting
    clicks, converters included."""
    return (clicks.where(F.col(LABEL) == 0).select(*user, "channel").distinct()
                  .groupBy(*user).count())


def channels_by_cohort(clicks: DataFrame, user=USER) -> DataFrame:
    """The two counts above, labelled ``yes`` / ``no`` and stacked."""
    yes = channel_pairs_per_converting_user(clicks, user).withColumn(LABEL, F.lit("yes"))
    no = channels_per_nonconverting_click_user(clicks, user).withColumn(LABEL, F.lit("no"))
    return yes.unionByName(no)


def first_click_and_first_conversion(clicks: DataFrame, user=USER,
                                     broadcast_rows: int | None = None) -> DataFrame:
    """Earliest non-converting click of each converting user plus each
    user's earliest conversion (ties on time kept), with the user's number
    of conversions.

    Per (user, label) the earliest time and the count are partial
    aggregates; the clicks are then matched on (user, label, time), a key
    that spreads even the heaviest user's rows.
    """
    firsts = _user_not_null(clicks, user).groupBy(*user, LABEL).agg(
        F.min("click_time").alias("_t0"), F.count(F.lit(1)).alias("_n"))
    per_user = Window.partitionBy(*user)  # at most three rows per user here
    firsts = firsts.withColumn(
        "ever_attributed",
        F.sum(F.when(F.col(LABEL) == 1, F.col("_n")).otherwise(0)).over(per_user).cast("long"))
    keep = firsts.where((F.col(LABEL) == 1) | ((F.col(LABEL) == 0) & (F.col("ever_attributed") > 0)))
    keep = keep.select(*user, LABEL, F.col("_t0").alias("click_time"), "ever_attributed")
    kwargs = {} if broadcast_rows is None else {"max_rows": broadcast_rows}
    return join_small(clicks, keep, on=[*user, LABEL, "click_time"], **kwargs)


_UNITS = {"days": None, "hours": 3600, "minutes": 60}


def _time_since(prev: Column, unit: str) -> Column:
    if unit == "days":  # day-of-year difference, as the original analysis takes it
        return F.abs(F.coalesce(F.dayofyear("click_time") - F.dayofyear(prev), F.lit(0)))
    if unit == "calendar_days":  # correct across year ends
        return F.abs(F.coalesce(F.datediff(F.col("click_time"), prev), F.lit(0)))
    return F.abs(F.coalesce(epoch_seconds("click_time") - epoch_seconds(prev), F.lit(0))) / F.lit(_UNITS[unit])


def click_to_conversion_units(path: DataFrame, units, user=USER) -> DataFrame:
    """``click_to_conversion`` in several units from one window: a row a path row and unit, time as double."""
    w = Window.partitionBy(*user).orderBy("click_time", "click_id")  # ≤ a few rows per user
    prev = F.col("_prev")
    times = [F.struct(F.lit(u).alias("unit"), _time_since(prev, u).cast("double").alias("click_time_diff")) for u in units]
    return path.withColumn("_prev", F.lag("click_time").over(w)).withColumn(
        "_time", F.explode(F.array(*times))).select(*path.columns, "_time.unit", "_time.click_time_diff")


def click_to_conversion(path: DataFrame, unit: str = "minutes", user=USER,
                        drop_first: bool = False) -> DataFrame:
    """Time from the previous row of the user's (first click, first
    conversion) rows, in days (day-of-year difference), calendar days,
    hours or minutes.
    The first row of each user gets 0 unless ``drop_first``."""
    w = Window.partitionBy(*user).orderBy("click_time", "click_id")  # ≤ a few rows per user
    prev = F.lag("click_time").over(w)
    out = path.withColumn("_has_prev", prev.isNotNull()).withColumn("click_time_diff", _time_since(prev, unit))
    if drop_first:
        out = out.where("_has_prev")
    return out.drop("_has_prev")


def rank_of_first_conversion(path: DataFrame, user=USER) -> DataFrame:
    """Rank by time of the first conversion among the user's path rows."""
    w = Window.partitionBy(*user).orderBy("click_time")  # ≤ a few rows per user
    return path.withColumn("index", F.rank().over(w)).where(F.col(LABEL) == 1)


def clicks_before_first_conversion(clicks: DataFrame, user=USER, **bounds) -> DataFrame:
    """Number of clicks up to and including the first conversion.

    Users of many clicks are split in the join (``join_per_key``, whose bounds may be given); the
    count after it is a partial aggregate.
    """
    first = (_user_not_null(clicks, user).groupBy(*user)
             .agg(F.min(F.when(F.col(LABEL) == 1, F.col("click_time"))).alias("_t1"), F.count(F.lit(1)).alias("_n"))
             .where("_t1 IS NOT NULL"))
    rows = clicks.select(*user, "click_time", "click_id")
    j = join_per_key(rows, first, user, "_n", F.col("click_id"), **bounds)
    return (j.where(F.col("click_time") <= F.col("_t1")).groupBy(*user)
             .agg(F.count(F.lit(1)).alias("n_clicks")))

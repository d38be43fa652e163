"""Queries: calendar and sequence features, category scores, feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickcast.functions.calendar import weekday_number
from clickcast.functions.categories import band_case_sql
from clickcast.operators import scores as sc
from clickcast.operators.ordering import with_positions
from clickcast.operators.sequence import sequence_features
from clickcast.plans import scoring, training
from clickcast.plans.catalog import register
from clickcast.plans.sqlbits import (
    DIMS,
    TIME_FEATURES,
    epoch_s,
    score_cols,
    score_joins,
    scores,
    sequence,
)
from clickcast.sources.clicks import clicks_from_events

# ---------------------------------------------------------------- calendar

TF_COLS = ("click_id, ip, app, device, os, channel, click_time, click_time_wday, "
           "attributed_time, attributed_time_wday, is_attributed, click_time_hour")


@register("time_features", TIME_FEATURES + "\nSELECT * FROM tf")
def time_features(spark, sf):
    return training.time_features(clicks_from_events(spark, sf))


@register("only_wday_and_hours", """
SELECT click_id, strftime(click_time, '%a') AS click_time_wday,
       CAST(hour(click_time) AS VARCHAR) AS click_time_hour
FROM clicks""")
def only_wday_and_hours(spark, sf):
    return scoring.only_wday_and_hours(clicks_from_events(spark, sf))


@register("weekday_number", """
SELECT click_id, strftime(click_time, '%a') AS click_time_wday,
       CAST(isodow(click_time) AS INTEGER) AS wday_number
FROM clicks""")
def weekday_number_q(spark, sf):
    wd = scoring.only_wday_and_hours(clicks_from_events(spark, sf))
    return wd.select("click_id", "click_time_wday",
                     weekday_number("click_time_wday").alias("wday_number"))


# ---------------------------------------------------------------- sequences

def _seq(spark, sf, outputs):
    return sequence_features(training.time_features(clicks_from_events(spark, sf)),
                             outputs=outputs)


@register("previous_label", TIME_FEATURES + sequence() +
          "\nSELECT click_id, ip, device, os, click_time, is_attributed, prev_label FROM seq")
def previous_label(spark, sf):
    return _seq(spark, sf, ("prev_label",)).select(
        "click_id", "ip", "device", "os", "click_time", "is_attributed", "prev_label")


@register("times_attributed", TIME_FEATURES + sequence() +
          "\nSELECT click_id, ip, device, os, click_time, is_attributed, times_attributed FROM seq")
def times_attributed(spark, sf):
    return _seq(spark, sf, ("times_attributed",)).select(
        "click_id", "ip", "device", "os", "click_time", "is_attributed", "times_attributed")


@register("n_previous_clicks", TIME_FEATURES + sequence() +
          "\nSELECT click_id, n_previous_clicks FROM seq")
def n_previous_clicks(spark, sf):
    return _seq(spark, sf, ("n_previous_clicks",)).select("click_id", "n_previous_clicks")


@register("click_time_diff", TIME_FEATURES + sequence() +
          "\nSELECT click_id, click_time_diff FROM seq")
def click_time_diff(spark, sf):
    return _seq(spark, sf, ("click_time_diff",)).select("click_id", "click_time_diff")


TRAINING_SQL = (TIME_FEATURES + sequence() + scores() + f"""
, features AS (
  SELECT seq.click_id, seq.ip, seq.app, seq.device, seq.os, seq.channel, seq.click_time,
         seq.click_time_wday, seq.attributed_time, seq.attributed_time_wday, seq.is_attributed,
         seq.click_time_hour, seq.n_previous_clicks, seq.click_time_diff, {score_cols()}
  FROM seq
  {score_joins('seq')})""")


@register("training_features", TRAINING_SQL + "\nSELECT * FROM features")
def training_features(spark, sf):
    return training.training_features(clicks_from_events(spark, sf))


EXTRACT_COLS = ("click_time_wday, is_attributed, click_time_hour, n_previous_clicks, "
                "click_time_diff, device_custom_score, os_custom_score, app_custom_score, "
                "channel_custom_score")


@register("modelling_extract", TRAINING_SQL + f"\nSELECT {EXTRACT_COLS} FROM features")
def modelling_extract(spark, sf):
    return training.modelling_extract(training_features(spark, sf))


@register("user_ever_attributed", """
SELECT c.click_id, c.ip, c.device, c.os, u.ever_attributed
FROM clicks c JOIN (SELECT ip, device, os, CAST(sum(is_attributed) AS BIGINT) AS ever_attributed
                    FROM clicks GROUP BY ip, device, os) u USING (ip, device, os)""")
def user_ever_attributed(spark, sf):
    return training.user_ever_attributed(clicks_from_events(spark, sf)).select(
        "click_id", "ip", "device", "os", "ever_attributed")


# ---------------------------------------------------------------- scores

def _pivot_sql(key: str) -> str:
    return f"""
SELECT {key}, CASE WHEN n0 > 0 THEN n0 END AS "0", CASE WHEN n1 > 0 THEN n1 END AS "1"
FROM (SELECT {key}, count(*) FILTER (WHERE is_attributed = 0) AS n0,
             count(*) FILTER (WHERE is_attributed = 1) AS n1
      FROM clicks WHERE {key} IS NOT NULL GROUP BY {key}) g"""


def _rate_sql(key: str) -> str:
    both = 'CASE WHEN "0" IS NOT NULL AND "1" IS NOT NULL THEN'
    return f"""
SELECT {key}, "0", "1",
       {both} ("0" / ("0" + "1")) * 100 END AS prcnt_0,
       {both} ("1" / ("0" + "1")) * 100 END AS prcnt_1
FROM ({_pivot_sql(key)}) p"""


def _score_sql(key: str) -> str:
    rate = 'CASE WHEN "0" IS NOT NULL AND "1" IS NOT NULL THEN ("1" / ("0" + "1")) * 100 END'
    return f"""
SELECT {key}, coalesce({rate}, 0.0) / 100 AS prcnt_1,
       CAST(coalesce("1", 0) AS BIGINT) AS "1",
       CAST(coalesce("1", 0) AS BIGINT) * (coalesce({rate}, 0.0) / 100) AS custom_score
FROM ({_pivot_sql(key)}) p"""


def _make_pivot(key):
    return lambda spark, sf: sc.label_pivot(clicks_from_events(spark, sf), key)


def _make_score(key):
    return lambda spark, sf: sc.category_score(clicks_from_events(spark, sf), key)


for _key in DIMS:
    register(f"label_pivot_{_key}", _pivot_sql(_key))(_make_pivot(_key))
    register(f"score_{_key}", _score_sql(_key))(_make_score(_key))


@register("conversion_rate_device", _rate_sql("device"))
def conversion_rate_device(spark, sf):
    return sc.conversion_rate(clicks_from_events(spark, sf), "device")


@register("conversion_rate_os", _rate_sql("os"))
def conversion_rate_os(spark, sf):
    return sc.conversion_rate(clicks_from_events(spark, sf), "os")


MIN_SUPPORT = 1000


MIN_SUPPORT_SQL = "\n UNION ALL ".join(
    f"SELECT '{d}' AS dim, CAST({d} AS BIGINT) AS key, \"0\", \"1\", prcnt_1 "
    f"FROM ({_rate_sql(d)}) r WHERE {d} IS NOT NULL AND \"0\" + \"1\" >= {MIN_SUPPORT}" for d in DIMS)


@register("conversion_rate_min_support", MIN_SUPPORT_SQL)
def conversion_rate_min_support(spark, sf):
    """The rates of all four keys from one read of the log."""
    counts = sc.label_counts(clicks_from_events(spark, sf), DIMS)
    return sc.min_support(sc.rates_from_counts(counts), MIN_SUPPORT)


@register("conversion_rate_positions", "SELECT *, row_number() OVER (ORDER BY prcnt_1 DESC, dim, key) AS position "
                                       f"FROM ({MIN_SUPPORT_SQL}) s")
def conversion_rate_positions(spark, sf):
    """The same, highest rate first, the order kept as a column."""
    return with_positions(conversion_rate_min_support(spark, sf), F.col("prcnt_1").desc(), "dim", "key")


@register("score_sparse_key", """
SELECT sparse_key, coalesce(r, 0.0) / 100 AS prcnt_1, CAST(coalesce(n1, 0) AS BIGINT) AS "1",
       CAST(coalesce(n1, 0) AS BIGINT) * (coalesce(r, 0.0) / 100) AS custom_score
FROM (SELECT sparse_key, n1,
             CASE WHEN n0 > 0 AND n1 > 0 THEN (n1 / (n0 + n1)) * 100 END AS r
      FROM (SELECT ip * 100 + channel AS sparse_key,
                   count(*) FILTER (WHERE is_attributed = 0) AS n0,
                   CASE WHEN count(*) FILTER (WHERE is_attributed = 1) > 0
                        THEN count(*) FILTER (WHERE is_attributed = 1) END AS n1
            FROM clicks GROUP BY 1) g) s""")
def score_sparse_key(spark, sf):
    clicks = clicks_from_events(spark, sf).withColumn(
        "sparse_key", F.col("ip") * 100 + F.col("channel"))
    return sc.category_score(clicks, "sparse_key")


@register("score_tables", scores() + "\nSELECT * FROM scores")
def score_tables_q(spark, sf):
    return sc.score_tables(clicks_from_events(spark, sf))


@register("score_category", scores() + "\nSELECT dim, key, custom_score, CASE " + " ".join(
    f"WHEN dim = '{d}' THEN {band_case_sql('custom_score', d)}" for d in DIMS) +
    " END AS category FROM scores")
def score_category(spark, sf):
    return sc.score_categories(sc.score_tables(clicks_from_events(spark, sf)))


# ---------------------------------------------------------------- scoring side

SCORING_SEQ = f""", sseq AS (
  SELECT *, CAST(row_number() OVER w - 1 AS BIGINT) AS n_previous_clicks,
         abs({epoch_s('click_time')} - {epoch_s('first_value(click_time) OVER w')}) / 60
           AS click_time_diff
  FROM clicks WINDOW w AS (PARTITION BY ip, device, os, click_time ORDER BY click_id))"""


@register("scoring_sequence_features", SCORING_SEQ +
          "\nSELECT click_id, n_previous_clicks, click_time_diff FROM sseq")
def scoring_sequence_features(spark, sf):
    from clickcast.operators.sequence import scoring_sequence_features as ssf
    return ssf(clicks_from_events(spark, sf)).select(
        "click_id", "n_previous_clicks", "click_time_diff")


@register("scoring_sequence_features_consistent", sequence("clicks", "cseq", label=None) +
          "\nSELECT click_id, n_previous_clicks, click_time_diff FROM cseq")
def scoring_sequence_features_consistent(spark, sf):
    return sequence_features(clicks_from_events(spark, sf), label_col=None,
                             outputs=("n_previous_clicks", "click_time_diff")).select(
        "click_id", "n_previous_clicks", "click_time_diff")


@register("only_n_previous_clicks", SCORING_SEQ + "\nSELECT click_id, n_previous_clicks FROM sseq")
def only_n_previous_clicks(spark, sf):
    return scoring.only_n_previous_clicks(clicks_from_events(spark, sf))


@register("only_clicktimediff", SCORING_SEQ + "\nSELECT click_id, click_time_diff FROM sseq")
def only_clicktimediff(spark, sf):
    return scoring.only_clicktimediff(clicks_from_events(spark, sf))


SCORING_JOIN_DIMS = ("os", "app", "channel", "device")
SCORING_OUT = ("sseq.click_id, sseq.ip, sseq.click_time, strftime(sseq.click_time, '%a') AS "
               "click_time_wday, CAST(hour(sseq.click_time) AS VARCHAR) AS click_time_hour, "
               "sseq.n_previous_clicks, sseq.click_time_diff")


def _scoring_sql(how: str, fill: bool) -> str:
    if fill:
        cols = ", ".join(f"coalesce(s_{d}.custom_score, 0.0) AS {d}_custom_score"
                         for d in SCORING_JOIN_DIMS)
    else:
        cols = score_cols(SCORING_JOIN_DIMS)
    return (scores() + SCORING_SEQ +
            f"\nSELECT {SCORING_OUT}, {cols} FROM sseq\n" +
            score_joins("sseq", "scores", SCORING_JOIN_DIMS, how))


@register("scoring_features", _scoring_sql("JOIN", False))
def scoring_features(spark, sf):
    clicks = clicks_from_events(spark, sf)
    lookups = scoring.score_lookup_tables(sc.score_tables(clicks), as_text_keys=True)
    return scoring.scoring_features(clicks, lookups)


@register("scoring_features_left", _scoring_sql("LEFT JOIN", True))
def scoring_features_left(spark, sf):
    clicks = clicks_from_events(spark, sf)
    lookups = scoring.score_lookup_tables(sc.score_tables(clicks), as_text_keys=True)
    return scoring.scoring_features(clicks, lookups, how="left", fill_missing=True)


# Scores only for keys with enough support; other keys are unseen → filled with 0.
SUPPORTED_SCORES = scores() + f""", supported AS (
  SELECT * FROM scores WHERE coalesce("0", 0) + coalesce("1", 0) >= {MIN_SUPPORT})"""


@register("fill_missing_features", SUPPORTED_SCORES + SCORING_SEQ +
          f"\nSELECT {SCORING_OUT}, " +
          ", ".join(f"coalesce(s_{d}.custom_score, 0.0) AS {d}_custom_score"
                    for d in SCORING_JOIN_DIMS) +
          " FROM sseq\n" + score_joins("sseq", "supported", SCORING_JOIN_DIMS, "LEFT JOIN"))
def fill_missing_features(spark, sf):
    clicks = clicks_from_events(spark, sf)
    long = sc.score_tables(clicks)
    supported = long.where(
        (F.coalesce(F.col("0"), F.lit(0)) + F.coalesce(F.col("1"), F.lit(0))) >= MIN_SUPPORT)
    lookups = scoring.score_lookup_tables(supported)
    return scoring.scoring_features(clicks, lookups, how="left", fill_missing=True)

"""Queries: exploration, user cohorts, path to conversion, sorted reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickcast.operators import cohorts as co
from clickcast.operators import explore as ex
from clickcast.operators import sketches as sk
from clickcast.operators.ordering import with_positions
from clickcast.operators.ranges import ValueRange, range_histograms
from clickcast.plans import training
from clickcast.plans.catalog import register
from clickcast.plans.sqlbits import TIME_FEATURES, epoch_s
from clickcast.sources.clicks import clicks_from_events


def _clicks(spark, sf):
    return clicks_from_events(spark, sf)


def _tf(spark, sf):
    return training.time_features(_clicks(spark, sf))


# ---------------------------------------------------------------- counts

@register("clicks_per_ip", "SELECT ip, count(*) AS count FROM clicks GROUP BY ip")
def clicks_per_ip(spark, sf):
    return ex.group_count(_clicks(spark, sf), "ip")


@register("clicks_per_device", "SELECT device, count(*) AS count FROM clicks GROUP BY device")
def clicks_per_device(spark, sf):
    return ex.group_count(_clicks(spark, sf), "device")


@register("clicks_per_device_os",
          "SELECT device, os, count(*) AS count FROM clicks GROUP BY device, os")
def clicks_per_device_os(spark, sf):
    return ex.group_count(_clicks(spark, sf), "device", "os")


@register("clicks_per_device_label", "SELECT device, is_attributed, count(*) AS count "
                                     "FROM clicks GROUP BY device, is_attributed")
def clicks_per_device_label(spark, sf):
    return ex.group_count(_clicks(spark, sf), "device", "is_attributed")


@register("clicks_per_wday_label", TIME_FEATURES + """
SELECT click_time_wday, is_attributed, count(*) AS count FROM tf
GROUP BY click_time_wday, is_attributed""")
def clicks_per_wday_label(spark, sf):
    return ex.group_count(_tf(spark, sf), "click_time_wday", "is_attributed")


@register("clicks_per_hour_label", TIME_FEATURES + """
SELECT click_time_hour, is_attributed, count(*) AS count FROM tf
GROUP BY click_time_hour, is_attributed""")
def clicks_per_hour_label(spark, sf):
    return ex.group_count(_tf(spark, sf), "click_time_hour", "is_attributed")


@register("class_balance", """
SELECT is_attributed, count, count * 100 / sum(count) OVER () AS pct
FROM (SELECT is_attributed, count(*) AS count FROM clicks GROUP BY is_attributed) g""")
def class_balance(spark, sf):
    return ex.class_balance(_clicks(spark, sf))


DEVICES_PER_IP = "SELECT ip, count(*) AS count FROM (SELECT DISTINCT ip, device, os FROM clicks) d GROUP BY ip"
CHANNELS_PER_APP = ("SELECT app, count(*) AS count FROM (SELECT DISTINCT app, channel FROM clicks) d "
                    "GROUP BY app")


@register("devices_per_ip", DEVICES_PER_IP)
def devices_per_ip(spark, sf):
    return ex.distinct_count_per(_clicks(spark, sf), "ip", ["device", "os"])


@register("channels_per_app", CHANNELS_PER_APP)
def channels_per_app(spark, sf):
    return ex.distinct_count_per(_clicks(spark, sf), "app", ["channel"])


@register("distinct_user_channel", "SELECT DISTINCT ip, device, os, channel FROM clicks")
def distinct_user_channel(spark, sf):
    return _clicks(spark, sf).select("ip", "device", "os", "channel").distinct()


# ---------------------------------------------------------------- cohorts

PAIRS_SQL = """
SELECT ip, device, os, count(*) AS count
FROM (SELECT DISTINCT a.ip, a.device, a.os, a.channel AS c1, b.channel AS c2
      FROM (SELECT DISTINCT ip, device, os, channel FROM clicks WHERE is_attributed = 1) a
      JOIN (SELECT DISTINCT ip, device, os, channel FROM clicks WHERE is_attributed = 0) b
      USING (ip, device, os)) j
GROUP BY ip, device, os"""

NONCONV_CLICK_SQL = """
SELECT ip, device, os, count(*) AS count
FROM (SELECT DISTINCT ip, device, os, channel
      FROM (SELECT *, sum(is_attributed) OVER (PARTITION BY ip, device, os ORDER BY is_attributed)
                      AS ever FROM clicks) w
      WHERE ever = 0) d
GROUP BY ip, device, os"""


@register("channel_pairs_per_converting_user", PAIRS_SQL)
def channel_pairs_per_converting_user(spark, sf):
    return co.channel_pairs_per_converting_user(_clicks(spark, sf))


@register("channels_per_converting_user", """
SELECT ip, device, os, count(*) AS count
FROM (SELECT DISTINCT ip, device, os, channel FROM clicks
      WHERE (ip, device, os) IN (SELECT ip, device, os FROM clicks WHERE is_attributed = 1)) d
GROUP BY ip, device, os""")
def channels_per_converting_user(spark, sf):
    return co.channels_per_converting_user(_clicks(spark, sf))


@register("channels_per_nonconverting_click_user", NONCONV_CLICK_SQL)
def channels_per_nonconverting_click_user(spark, sf):
    return co.channels_per_nonconverting_click_user(_clicks(spark, sf))


@register("channels_per_never_converted_user", """
SELECT ip, device, os, count(*) AS count
FROM (SELECT DISTINCT ip, device, os, channel
      FROM (SELECT *, sum(is_attributed) OVER (PARTITION BY ip, device, os) AS ever FROM clicks) w
      WHERE ever = 0) d
GROUP BY ip, device, os""")
def channels_per_never_converted_user(spark, sf):
    return co.channels_per_never_converted_user(_clicks(spark, sf))


COHORTS_SQL = f""", cohorts AS (
  SELECT *, 'yes' AS is_attributed FROM ({PAIRS_SQL}) y
  UNION ALL SELECT *, 'no' AS is_attributed FROM ({NONCONV_CLICK_SQL}) n)"""


@register("channels_by_cohort", COHORTS_SQL + "\nSELECT * FROM cohorts")
def channels_by_cohort(spark, sf):
    return co.channels_by_cohort(_clicks(spark, sf))


@register("describe_channels_by_cohort", COHORTS_SQL + """
SELECT is_attributed, count(count) AS n, round(avg(count), 9) AS mean,
       round(stddev_samp(count), 6) AS stddev, min(count) AS min, max(count) AS max
FROM cohorts GROUP BY is_attributed""")
def describe_channels_by_cohort(spark, sf):
    return _round(ex.describe(co.channels_by_cohort(_clicks(spark, sf)), "count",
                              by=["is_attributed"]))


@register("median_channels_by_cohort", COHORTS_SQL + """
SELECT is_attributed, median(count) AS median FROM cohorts GROUP BY is_attributed""")
def median_channels_by_cohort(spark, sf):
    return ex.median(co.channels_by_cohort(_clicks(spark, sf)), "count", by=["is_attributed"])


@register("box_stats_channels_by_cohort", COHORTS_SQL + """
, b AS (SELECT * FROM cohorts WHERE count <= 500)
, q AS (SELECT is_attributed, quantile_cont(count, 0.25) AS q1, quantile_cont(count, 0.5) AS median,
               quantile_cont(count, 0.75) AS q3 FROM b GROUP BY is_attributed)
SELECT q.is_attributed, q1, median, q3,
       min(count) FILTER (WHERE count BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))
         AS lower_whisker,
       max(count) FILTER (WHERE count BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))
         AS upper_whisker,
       count(*) FILTER (WHERE NOT count BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))
         AS n_outliers
FROM b JOIN q USING (is_attributed) GROUP BY q.is_attributed, q1, median, q3""")
def box_stats_channels_by_cohort(spark, sf):
    cohorts = co.channels_by_cohort(_clicks(spark, sf)).where(F.col("count") <= 500)
    return ex.box_stats(cohorts, "count", by=["is_attributed"])


# ---------------------------------------------------------------- path to conversion

PATH_SQL = """, ea AS (
  SELECT c.*, CAST(u.ever_attributed AS BIGINT) AS ever_attributed
  FROM clicks c JOIN (SELECT ip, device, os, sum(is_attributed) AS ever_attributed
                      FROM clicks GROUP BY ip, device, os) u USING (ip, device, os))
, path AS (
  SELECT * EXCLUDE (idx) FROM (
    SELECT *, rank() OVER (PARTITION BY ip, device, os ORDER BY click_time) AS idx
    FROM ea WHERE ever_attributed > 0 AND is_attributed = 0) f WHERE idx = 1
  UNION ALL
  SELECT * EXCLUDE (idx) FROM (
    SELECT *, rank() OVER (PARTITION BY ip, device, os ORDER BY click_time) AS idx
    FROM ea WHERE is_attributed = 1) a WHERE idx = 1)"""

PATH_COLS = ("click_id", "ip", "device", "os", "app", "channel", "click_time",
             "attributed_time", "is_attributed", "ever_attributed")


def _path(spark, sf):
    return co.first_click_and_first_conversion(_clicks(spark, sf)).select(*PATH_COLS)


@register("first_click_and_first_conversion", PATH_SQL + f"\nSELECT {', '.join(PATH_COLS)} FROM path")
def first_click_and_first_conversion(spark, sf):
    return _path(spark, sf)


def _diff_sql(unit: str) -> str:
    prev = "lag(click_time) OVER (PARTITION BY ip, device, os ORDER BY click_time, click_id)"
    if unit == "days":
        expr = f"abs(coalesce(dayofyear(click_time) - dayofyear({prev}), 0))"
    elif unit == "calendar_days":
        expr = f"abs(coalesce(datediff('day', {prev}, click_time), 0))"
    else:
        div = 3600 if unit == "hours" else 60
        expr = f"abs(coalesce({epoch_s('click_time')} - {epoch_s(prev)}, 0)) / {div}"
    return expr


DIFF_OUT = "click_id, ip, device, os, click_time, is_attributed, click_time_diff"
DIFFS_SQL = PATH_SQL + ", diffs AS (" + "\n  UNION ALL ".join(
    f"SELECT '{u}' AS unit, click_id, ip, device, os, click_time, is_attributed, "
    f"CAST({_diff_sql(u)} AS DOUBLE) AS click_time_diff FROM path"
    for u in ("days", "hours", "minutes")) + ")"


def _diffs(path, unit):
    out = co.click_to_conversion(path, unit).select(*DIFF_OUT.split(", "))
    return out.withColumn("click_time_diff", F.col("click_time_diff").cast("double"))


for _unit in ("days", "hours", "minutes"):
    def _make(unit):
        def q(spark, sf):
            return _diffs(_path(spark, sf), unit)
        return q
    register(f"click_to_conversion_{_unit}",
             DIFFS_SQL + f"\nSELECT {DIFF_OUT} FROM diffs WHERE unit = '{_unit}'")(_make(_unit))


register("click_to_conversion_calendar_days", PATH_SQL + ", cal AS (SELECT click_id, ip, device, os, "
         "click_time, is_attributed, CAST(" + _diff_sql("calendar_days") + " AS DOUBLE) AS "
         "click_time_diff FROM path)\nSELECT " + DIFF_OUT + " FROM cal")(_make("calendar_days"))


def _all_diffs(spark, sf):
    """Every unit from one pass over the path rows."""
    return co.click_to_conversion_units(_path(spark, sf), ("days", "hours", "minutes")).select(
        *DIFF_OUT.split(", "), "unit")


def _round(df, mean_digits=9, std_digits=6):
    return (df.withColumn("mean", F.round("mean", mean_digits))
              .withColumn("stddev", F.round("stddev", std_digits)))


@register("describe_click_diffs", DIFFS_SQL + """
SELECT unit, count(click_time_diff) AS n, round(avg(click_time_diff), 9) AS mean,
       round(stddev_samp(click_time_diff), 6) AS stddev,
       min(click_time_diff) AS min, max(click_time_diff) AS max
FROM diffs GROUP BY unit""")
def describe_click_diffs(spark, sf):
    return _round(ex.describe(_all_diffs(spark, sf), "click_time_diff", by=["unit"]))


@register("median_click_diff", DIFFS_SQL + """
SELECT unit, median(click_time_diff) AS median FROM diffs GROUP BY unit""")
def median_click_diff(spark, sf):
    return ex.median(_all_diffs(spark, sf), "click_time_diff", by=["unit"])


@register("histogram_bounded", DIFFS_SQL + """
SELECT CAST(floor(click_time_diff / 5) AS BIGINT) AS bin, count(*) AS count,
       CAST(CAST(floor(click_time_diff / 5) AS BIGINT) * 5.0 AS DOUBLE) AS bin_lo
FROM diffs WHERE unit = 'minutes' AND click_time_diff > 0 AND click_time_diff < 60
GROUP BY 1""")
def histogram_bounded(spark, sf):
    minutes = _diffs(_path(spark, sf), "minutes")
    return ex.histogram(minutes, "click_time_diff", 5, lo=0, hi=60)


AUTO_HISTOGRAM_SQL = DIFFS_SQL + """
, m AS (SELECT click_time_diff AS x FROM diffs WHERE unit = 'minutes')
, st AS (SELECT count(x) AS n, min(x) AS lo, max(x) AS hi,
                quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM m)
, nb AS (SELECT *, greatest(1, least({max_bins}, CASE
           WHEN iqr > 0 THEN CASE WHEN hi > lo
                THEN CAST(ceil((hi - lo) / (2 * iqr * pow(n, -1 / 3))) AS BIGINT) ELSE 1 END
           ELSE CAST(floor(sqrt(n)) AS BIGINT) END)) AS bins FROM st)
, w AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) / bins ELSE 1.0 END AS width FROM nb)
SELECT CAST(least(floor((x - lo) / width), bins - 1) AS BIGINT) AS bin,
       lo + CAST(least(floor((x - lo) / width), bins - 1) AS BIGINT) * width AS bin_lo,
       count(*) AS count
FROM m, w WHERE x IS NOT NULL GROUP BY 1, 2"""


@register("histogram_auto_click_diffs", AUTO_HISTOGRAM_SQL.replace("{max_bins}", "50"))
def histogram_auto_click_diffs(spark, sf):
    """Minutes from first click to first conversion, automatic bin width, at
    most 50 bins as in the distribution plots."""
    return ex.auto_histogram(_diffs(_path(spark, sf), "minutes"), "click_time_diff", max_bins=50)


@register("histogram_auto_click_diffs_uncapped",
          AUTO_HISTOGRAM_SQL.replace("{max_bins}", "9223372036854775807"))
def histogram_auto_click_diffs_uncapped(spark, sf):
    """The same with as many bins as the rule gives."""
    return ex.auto_histogram(_diffs(_path(spark, sf), "minutes"), "click_time_diff")


@register("recent_small_click_diffs", DIFFS_SQL + f"""
SELECT {DIFF_OUT} FROM diffs
WHERE unit = 'minutes' AND click_time_diff > 0 AND click_time_diff < 60
ORDER BY click_time DESC, click_id LIMIT 10""")
def recent_small_click_diffs(spark, sf):
    minutes = _diffs(_path(spark, sf), "minutes")
    return (minutes.where((F.col("click_time_diff") > 0) & (F.col("click_time_diff") < 60))
                   .orderBy(F.col("click_time").desc(), "click_id").limit(10))


RANK_SQL = PATH_SQL + """, ranked AS (
  SELECT click_id, ip, device, os, click_time,
         CAST(rank() OVER (PARTITION BY ip, device, os ORDER BY click_time) AS BIGINT) AS "index",
         is_attributed
  FROM path)"""


def _ranked(spark, sf):
    r = co.rank_of_first_conversion(_path(spark, sf))
    return r.select("click_id", "ip", "device", "os", "click_time",
                    F.col("index").cast("long").alias("index"))


@register("rank_of_first_conversion", RANK_SQL +
          '\nSELECT click_id, ip, device, os, click_time, "index" FROM ranked WHERE is_attributed = 1')
def rank_of_first_conversion(spark, sf):
    return _ranked(spark, sf)


@register("describe_rank_of_first_conversion", RANK_SQL + """
SELECT count("index") AS n, round(avg("index"), 9) AS mean, round(stddev_samp("index"), 6) AS stddev,
       min("index") AS min, max("index") AS max
FROM ranked WHERE is_attributed = 1""")
def describe_rank_of_first_conversion(spark, sf):
    return _round(ex.describe(_ranked(spark, sf), "index"))


@register("clicks_before_first_conversion", """
SELECT ip, device, os, count(*) AS n_clicks
FROM clicks c JOIN (SELECT ip, device, os, min(click_time) AS t1 FROM clicks
                    WHERE is_attributed = 1 GROUP BY ip, device, os) f USING (ip, device, os)
WHERE c.click_time <= f.t1 GROUP BY ip, device, os""")
def clicks_before_first_conversion(spark, sf):
    return co.clicks_before_first_conversion(_clicks(spark, sf))


# ---------------------------------------------------------------- summaries of counts

def _describe_sql(src: str) -> str:
    return f"""
SELECT count(count) AS n, round(avg(count), 9) AS mean, round(stddev_samp(count), 6) AS stddev,
       min(count) AS min, max(count) AS max FROM ({src}) s"""


@register("describe_clicks_per_ip", _describe_sql(
    "SELECT ip, count(*) AS count FROM clicks GROUP BY ip"))
def describe_clicks_per_ip(spark, sf):
    return _round(ex.describe(clicks_per_ip(spark, sf), "count"))


@register("describe_devices_per_ip", _describe_sql(DEVICES_PER_IP))
def describe_devices_per_ip(spark, sf):
    return _round(ex.describe(devices_per_ip(spark, sf), "count"))


@register("describe_channels_per_app", _describe_sql(CHANNELS_PER_APP))
def describe_channels_per_app(spark, sf):
    return _round(ex.describe(channels_per_app(spark, sf), "count"))


@register("quartiles_clicks_per_ip", """
SELECT percentile_disc(0.25) WITHIN GROUP (ORDER BY count) AS q25,
       percentile_disc(0.5) WITHIN GROUP (ORDER BY count) AS q50,
       percentile_disc(0.75) WITHIN GROUP (ORDER BY count) AS q75
FROM (SELECT ip, count(*) AS count FROM clicks GROUP BY ip) g""")
def quartiles_clicks_per_ip(spark, sf):
    return ex.quantiles_exact(clicks_per_ip(spark, sf), "count")


@register("approx_quartiles")
def approx_quartiles(spark, sf):
    """The original analysis's approxQuantile(…, 0.25) on three count tables."""
    parts = [
        ex.approx_quantiles(clicks_per_ip(spark, sf), "count", (0.5,), 0.25)
          .select(F.lit("clicks_per_ip").alias("table"), F.lit(None).cast("long").alias("q25"),
                  "q50", F.lit(None).cast("long").alias("q75")),
        ex.approx_quantiles(devices_per_ip(spark, sf), "count", relative_error=0.25)
          .select(F.lit("devices_per_ip").alias("table"), "q25", "q50", "q75"),
        ex.approx_quantiles(channels_per_app(spark, sf), "count", relative_error=0.25)
          .select(F.lit("channels_per_app").alias("table"), "q25", "q50", "q75"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("histogram_channels_per_app", f"""
SELECT CAST(floor(count / 1) AS BIGINT) AS bin, count(*) AS count,
       CAST(CAST(floor(count / 1) AS BIGINT) * 1.0 AS DOUBLE) AS bin_lo
FROM ({CHANNELS_PER_APP}) s GROUP BY 1""")
def histogram_channels_per_app(spark, sf):
    return ex.histogram(channels_per_app(spark, sf), "count", 1)


#: The ranges that the distribution plots look at.
RANGES = [
    ValueRange("channels per app", 1, source="app"),
    ValueRange("channels per app under 20", 1, hi=20, source="app"),
    ValueRange("channels per app under 5", 1, hi=5, source="app"),
    ValueRange("channels per converting user under 20", 1, hi=20, source="yes"),
    ValueRange("channels per other user under 80", 2, hi=80, source="no"),
    ValueRange("channels per other user under 40", 1, hi=40, source="no"),
    ValueRange("channels per user up to 500", 10, hi=500, hi_inclusive=True, source=("yes", "no")),
    ValueRange("channels per user up to 100", 2, hi=100, hi_inclusive=True, source=("yes", "no")),
    ValueRange("hours over 0", 24, lo=0, source="hours"),
    ValueRange("hours from 1", 24, lo=1, lo_inclusive=True, source="hours"),
    ValueRange("hours under 1", 0.0625, lo=0, hi=1, source="hours"),
    ValueRange("hours under 0.025", 0.00390625, lo=0, hi=0.025, source="hours"),
    ValueRange("hours under 0.01666", 0.00390625, lo=0, hi=0.01666, source="hours"),
]

def _range_sql(r) -> str:
    return (f"SELECT '{r.name}' AS \"range\", CAST(floor(x / {float(r.width)}) AS BIGINT) AS bin, count(*) AS count, "
            f"CAST(floor(x / {float(r.width)}) AS BIGINT) * CAST({float(r.width)} AS DOUBLE) AS bin_lo "
            f"FROM vals WHERE {r.sql('x', 'source')} GROUP BY 2")


@register("histograms_all_ranges", COHORTS_SQL + DIFFS_SQL + f""", vals AS (
  SELECT 'app' AS source, CAST(count AS DOUBLE) AS x FROM ({CHANNELS_PER_APP}) a
  UNION ALL SELECT is_attributed, CAST(count AS DOUBLE) FROM cohorts
  UNION ALL SELECT 'hours', click_time_diff FROM diffs WHERE unit = 'hours')
""" + "\nUNION ALL ".join(_range_sql(r) for r in RANGES))
def histograms_all_ranges(spark, sf):
    """All ranges of the distribution plots, from one pass over the plotted values."""
    app = channels_per_app(spark, sf).select(F.lit("app").alias("source"), F.col("count").cast("double").alias("x"))
    users = co.channels_by_cohort(_clicks(spark, sf)).select(
        F.col("is_attributed").alias("source"), F.col("count").cast("double").alias("x"))
    hours = _diffs(_path(spark, sf), "hours").select(F.lit("hours").alias("source"), F.col("click_time_diff").alias("x"))
    return range_histograms(app.unionByName(users).unionByName(hours), "x", RANGES, "source")


SKETCHED = f"""
SELECT 'clicks_per_ip' AS "table", count FROM (SELECT ip, count(*) AS count FROM clicks GROUP BY ip) a
UNION ALL SELECT 'devices_per_ip', count FROM ({DEVICES_PER_IP}) b
UNION ALL SELECT 'channels_per_app', count FROM ({CHANNELS_PER_APP}) c"""


@register("sketch_quartile_errors", f"""
SELECT "table", p, count(count) AS n, true AS within_bound
FROM ({SKETCHED}) s, (VALUES (CAST(0.25 AS DOUBLE)), (0.5), (0.75)) t(p) GROUP BY "table", p""")
def sketch_quartile_errors(spark, sf):
    """Quartiles of the three count tables from kept sketches of their slices, merged; whether each lies
    within the sketch's rank error, counted against all values."""
    tables = {"clicks_per_ip": clicks_per_ip, "devices_per_ip": devices_per_ip, "channels_per_app": channels_per_app}
    rows = [of(spark, sf).select(F.lit(name).alias("table"), F.col(of_key).alias("key"), "count")
            for (name, of), of_key in zip(tables.items(), ("ip", "ip", "app"), strict=True)]
    values = rows[0].unionByName(rows[1]).unionByName(rows[2])
    kept = sk.value_sketches(values.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(16))), "count", ["table", "slice"])
    found = sk.sketch_quantiles(sk.merged_sketches(kept, ["table"]), by=["table"])
    errors = sk.rank_errors(found, values, "count", ["table"])
    return errors.select("table", "p", "n", (F.col("rank_error") <= sk.RANK_ERROR).alias("within_bound"))


# ---------------------------------------------------------------- sorted reports

def _positions_sql(src: str, cols: str, order: str) -> str:
    return f"SELECT {cols}, row_number() OVER (ORDER BY {order}) AS position FROM ({src}) s"


@register("device_os_by_count_positions", _positions_sql(
    "SELECT device, os, count(*) AS count FROM clicks GROUP BY device, os", "device, os, count",
    "count DESC, device NULLS FIRST, os NULLS FIRST"))
def device_os_by_count_positions(spark, sf):
    counts = ex.group_count(_clicks(spark, sf), "device", "os")
    return with_positions(counts, F.col("count").desc(), "device", "os")


@register("device_labels_by_device_positions", _positions_sql(
    "SELECT device, is_attributed, count(*) AS count FROM clicks GROUP BY device, is_attributed",
    "device, is_attributed, count", "device NULLS FIRST, is_attributed NULLS FIRST"))
def device_labels_by_device_positions(spark, sf):
    return with_positions(ex.group_count(_clicks(spark, sf), "device", "is_attributed"), "device", "is_attributed")


@register("clicks_newest_first_positions", _positions_sql(
    "SELECT click_id, click_time FROM clicks", "click_id, click_time", "click_time DESC NULLS LAST, click_id NULLS FIRST"))
def clicks_newest_first_positions(spark, sf):
    return with_positions(_clicks(spark, sf).select("click_id", "click_time"), F.col("click_time").desc(), "click_id")


@register("top_devices", """
SELECT device, count(*) AS count FROM clicks GROUP BY device ORDER BY count DESC, device""")
def top_devices(spark, sf):
    return (ex.group_count(_clicks(spark, sf), "device")
              .orderBy(F.col("count").desc(), "device"))


@register("top_device_labels", """
SELECT device, is_attributed, count(*) AS count FROM clicks GROUP BY device, is_attributed
ORDER BY count DESC, device""")
def top_device_labels(spark, sf):
    return (ex.group_count(_clicks(spark, sf), "device", "is_attributed")
              .orderBy(F.col("count").desc(), "device"))


@register("conversions_by_hour_ranked", TIME_FEATURES + """
SELECT click_time_hour, count(*) AS count FROM tf WHERE is_attributed = 1
GROUP BY click_time_hour ORDER BY count DESC, click_time_hour""")
def conversions_by_hour_ranked(spark, sf):
    return (ex.group_count(_tf(spark, sf).where(F.col("is_attributed") == 1), "click_time_hour")
              .orderBy(F.col("count").desc(), "click_time_hour"))

"""Hand-made fixtures (FIXTURES.md §3) and the edge cases listed there."""

import datetime as dt

from pyspark.sql import functions as F

from clickcast.operators import cohorts as co
from clickcast.operators import features as fe
from clickcast.operators import scores as sc
from clickcast.operators.explore import describe
from clickcast.plans.training import training_features
from clickcast.session import scratch_path
from clickcast.sources.clicks import read_clicks_csv

ROWS = [  # ip, device, os, channel, click_time, is_attributed
    (1, 1, 1, 10, "2017-11-06 00:00:00", 0),
    (1, 1, 1, 11, "2017-11-06 00:01:00", 0),
    (1, 1, 1, 12, "2017-11-06 00:02:00", 1),
    (1, 1, 1, 13, "2017-11-06 00:05:00", 0),
    (1, 1, 1, 13, "2017-11-06 00:07:30", 0),
    (2, 2, 1, 10, "2017-11-06 00:00:00", 0),
    (2, 2, 1, 10, "2017-11-06 00:00:00", 0),
    (2, 2, 1, 11, "2017-11-06 00:09:00", 0),
    (3, 3, 2, 10, "2017-11-07 10:00:00", 1),
]

SCHEMA = ("click_id long, ip int, app int, device int, os int, channel int, click_time timestamp, "
          "attributed_time timestamp, is_attributed int")


def micro(spark, rows=ROWS):
    data = []
    for i, (ip, d, o, ch, t, y) in enumerate(rows):
        ts = dt.datetime.fromisoformat(t)
        data.append((i + 1, ip, 1, d, o, ch, ts, ts + dt.timedelta(seconds=5) if y else None, y))
    return spark.createDataFrame(data, SCHEMA)


def as_map(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_device_scores(spark):
    s = as_map(sc.category_score(micro(spark), "device"), "device", "custom_score")
    assert s == {1: 0.2, 2: 0.0, 3: 0.0}


def test_one_pass_scores_equal_per_key(spark):
    long = sc.score_tables(micro(spark))
    dev = as_map(long.where("dim = 'device'"), "key", "custom_score")
    assert dev == {1: 0.2, 2: 0.0, 3: 0.0}


def test_channel_pairs(spark):
    got = as_map(co.channel_pairs_per_converting_user(micro(spark)), "ip", "count")
    assert got == {1: 3}


def test_never_converted_as_written_and_strict(spark):
    assert as_map(co.channels_per_nonconverting_click_user(micro(spark)), "ip", "count") == \
        {1: 3, 2: 2}
    assert as_map(co.channels_per_never_converted_user(micro(spark)), "ip", "count") == {2: 2}


def test_rank_of_first_conversion(spark):
    path = co.first_click_and_first_conversion(micro(spark))
    assert as_map(co.rank_of_first_conversion(path), "ip", "index") == {1: 2, 3: 1}


def test_clicks_before_first_conversion(spark):
    assert as_map(co.clicks_before_first_conversion(micro(spark)), "ip", "n_clicks") == \
        {1: 3, 3: 1}


def test_null_key_does_not_double_key_zero(spark):
    rows = [(1, 0, 1, 10, "2017-11-06 00:00:00", 0), (1, 0, 1, 11, "2017-11-06 00:01:00", 1),
            (2, None, 1, 10, "2017-11-06 00:02:00", 1)]
    df = micro(spark, rows)
    scores = sc.category_score(df, "device").collect()
    assert [r.device for r in scores] == [0]
    feats = training_features(df, chunk_seconds=60)
    assert feats.count() == 2  # the null-device click has no score (inner join)


def test_constant_column_scales_to_zero(spark):
    df = micro(spark).withColumn("c", F.lit(7.0))
    out = fe.min_max_scale(df, ["c", "channel"])
    assert {r.c for r in out.collect()} == {0.0}
    assert {r.channel for r in out.collect()} == {0.0, 1 / 3, 2 / 3, 1.0}


def test_zero_baseline_widens_bounds(spark):
    df = micro(spark).withColumn("c", F.col("channel").cast("double"))
    out = fe.min_max_scale(df, ["c"], zero_baseline=True)
    assert sorted({r.c for r in out.collect()}) == [10 / 13, 11 / 13, 12 / 13, 1.0]


def test_day_of_year_difference_across_new_year(spark):
    rows = [(5, 1, 1, 10, "2017-12-31 23:00:00", 0), (5, 1, 1, 11, "2018-01-01 01:00:00", 1)]
    path = co.first_click_and_first_conversion(micro(spark, rows))
    days = co.click_to_conversion(path, "days").where("is_attributed = 1").first()
    assert days.click_time_diff == 364  # as the original analysis computes it (day of year)


def test_csv_scan_drops_malformed_rows(spark):
    path = scratch_path(spark, "malformed") + ".csv"
    lines = [
        "ip,app,device,os,channel,click_time,attributed_time,is_attributed",
        "1,2,3,4,5,2017-11-06 00:00:00,,0",
        "x,2,3,4,5,2017-11-06 00:00:00,,0",
        "1,2,3,4,5,not-a-time,,0",
        "1,2,3,4,5,2017-11-06 00:00:00,,zero",
        "1,2,3,oops,5,2017-11-06 00:00:00,,0",
        "6,7,8,9,10,2017-11-06 00:00:01,2017-11-06 00:01:00,1",
    ]
    spark.sparkContext.parallelize(lines, 1).saveAsTextFile(path)
    df = read_clicks_csv(spark, path)
    assert df.count() == 2
    assert df.select("ip").count() == 2  # narrow queries see the same rows


def test_describe_sample_stddev(spark):
    out = describe(micro(spark), "channel").first()
    assert out.n == 9 and out.min == 10 and out.max == 13


def test_submission_and_score_files_roundtrip(spark):
    from clickcast.sources.clicks import read_score_files, write_score_files, write_submission
    df = micro(spark)
    sub = write_submission(df.select("click_id", F.col("is_attributed")), scratch_path(spark, "sub"))
    back = spark.read.option("header", True).csv(sub)
    assert back.columns == ["click_id", "is_attributed"] and back.count() == 9
    root = scratch_path(spark, "scores")
    paths = write_score_files(sc.score_tables(df), root)
    files = read_score_files(spark, paths)
    assert set(files) == {"device", "os", "app", "channel"}
    assert files["device"].columns == ["device", "prcnt_1", "1", "custom_score"]
    assert files["app"].columns == ["app", "custom_score", "count"]
    dev = {r.device: r.custom_score for r in files["device"].collect()}
    assert dev == {"1": 0.2, "2": 0.0, "3": 0.0}  # text keys, as in score files

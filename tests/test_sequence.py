"""Sequence features: the chunked scan equals one window per user."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from clickcast.operators.sequence import sequence_features, scoring_sequence_features
from clickcast.plans.catalog import ORACLES
from clickcast.plans.training import time_features
from clickcast.sources.clicks import clicks_from_events
from tests.conftest import SF01
from tools.oracle_check import compare

OUT = ("prev_label", "times_attributed", "n_previous_clicks", "click_time_diff")


@pytest.mark.parametrize("chunk", [1, 60, 3600, 6 * 3600, 10 ** 9])
def test_chunked_equals_single_window(spark, duck, chunk):
    clicks = time_features(clicks_from_events(spark, SF01))
    got = (sequence_features(clicks, chunk_seconds=chunk, outputs=OUT)
           .select("click_id", *OUT).toPandas())
    sql = ORACLES["previous_label"].rsplit("SELECT", 1)[0] + \
        "SELECT click_id, prev_label, times_attributed, n_previous_clicks, click_time_diff FROM seq"
    want = duck.sql(sql).df()
    assert compare(got, want) == "EQUAL"


def test_no_reset_without_label(spark, duck):
    clicks = clicks_from_events(spark, SF01)
    got = (sequence_features(clicks, label_col=None, chunk_seconds=3600,
                             outputs=("n_previous_clicks", "click_time_diff"))
           .select("click_id", "n_previous_clicks", "click_time_diff").toPandas())
    want = duck.sql(ORACLES["scoring_sequence_features_consistent"]).df()
    assert compare(got, want) == "EQUAL"


ROWS = [  # ip, device, os, channel, click_time, is_attributed (FIXTURES.md §3)
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


def micro(spark):
    data = [(i + 1, ip, d, o, ch, dt.datetime.fromisoformat(t), y)
            for i, (ip, d, o, ch, t, y) in enumerate(ROWS)]
    return spark.createDataFrame(
        data, "click_id long, ip int, device int, os int, channel int, "
              "click_time timestamp, is_attributed int")


@pytest.mark.parametrize("chunk", [1, 60, 150, 86400])
def test_micro_fixture(spark, chunk):
    got = {r.click_id: r for r in sequence_features(micro(spark), chunk_seconds=chunk).collect()}
    assert [got[i].n_previous_clicks for i in range(1, 10)] == [0, 1, 2, 0, 1, 0, 1, 2, 0]
    assert [got[i].click_time_diff for i in range(1, 10)] == [0.0, 1.0, 2.0, 0.0, 2.5,
                                                               0.0, 0.0, 9.0, 0.0]
    assert [got[i].times_attributed for i in range(1, 10)] == [0, 0, 0, 1, 1, 0, 0, 0, 0]
    assert got[4].prev_label == 1 and got[1].prev_label is None


def test_null_user_key_is_own_group(spark):
    df = micro(spark).withColumn(
        "ip", F.when(F.col("ip") == 2, F.lit(None)).otherwise(F.col("ip")))
    got = {r.click_id: r for r in sequence_features(df, chunk_seconds=60).collect()}
    assert len(got) == 9
    assert [got[i].n_previous_clicks for i in (6, 7, 8)] == [0, 1, 2]


def test_scoring_variant_counts_ties_only(spark):
    got = {r.click_id: r for r in scoring_sequence_features(micro(spark)).collect()}
    assert sorted(r.n_previous_clicks for r in got.values()) == [0] * 8 + [1]
    assert {r.click_time_diff for r in got.values()} == {0.0}


def test_single_hot_user_is_split_and_exact(spark, duck):
    """Every click belongs to one user: the scan still splits the user into
    many chunks (tasks) and matches the one-window result."""
    from clickcast.operators.sequence import auto_chunk_seconds
    from clickcast.plans.catalog import with_clicks
    from clickcast.plans.sqlbits import sequence

    hot = (clicks_from_events(spark, SF01).withColumn("ip", F.lit(1).cast("long"))
           .withColumn("device", F.lit(0)).withColumn("os", F.lit(0)))
    width = auto_chunk_seconds(hot, target_chunk_rows=500)
    chunks = hot.select(F.floor(F.col("click_time").cast("long") / width)).distinct().count()
    assert chunks >= 15
    got = (sequence_features(hot, chunk_seconds=width, outputs=OUT)
           .select("click_id", *OUT).toPandas())
    sql = with_clicks(
        ", hot AS (SELECT click_id, CAST(1 AS BIGINT) AS ip, 0 AS device, 0 AS os, click_time, "
        "is_attributed FROM clicks)" + sequence("hot", "seq") +
        "\nSELECT click_id, prev_label, times_attributed, n_previous_clicks, click_time_diff FROM seq")
    assert compare(got, duck.sql(sql).df()) == "EQUAL"


def test_burst_of_one_user_is_split_and_exact(spark, duck):
    """One user, all clicks within ~3 hours, one coarse chunk: the burst is
    cut into finer slices and the result still matches one window."""
    from clickcast.plans.catalog import with_clicks
    from clickcast.plans.sqlbits import sequence

    burst = (clicks_from_events(spark, SF01).withColumn("ip", F.lit(1).cast("long"))
             .withColumn("device", F.lit(0)).withColumn("os", F.lit(0))
             .withColumn("click_time", F.expr(
                 "timestampadd(SECOND, CAST(click_id AS INT), TIMESTAMP'2024-01-01 00:00:00')")))
    got = (sequence_features(burst, chunk_seconds=86_400, target_chunk_rows=500, outputs=OUT)
           .select("click_id", *OUT).toPandas())
    sql = with_clicks(
        ", hot AS (SELECT click_id, CAST(1 AS BIGINT) AS ip, 0 AS device, 0 AS os, "
        "TIMESTAMP '2024-01-01 00:00:00' + to_seconds(click_id) AS click_time, "
        "is_attributed FROM clicks)" + sequence("hot", "seq") +
        "\nSELECT click_id, prev_label, times_attributed, n_previous_clicks, click_time_diff FROM seq")
    assert compare(got, duck.sql(sql).df()) == "EQUAL"
    # the single coarse chunk became about count / target slices
    from clickcast.operators import sequence as seqmod
    keyed = burst.withColumns({"_k0": F.col("ip"), "_chunk": F.lit(0).cast("long")})
    cut = seqmod._split_bursts(keyed, ["_k0"], "click_time", 86_400, 500)
    assert cut.select("_chunk").distinct().count() >= 15


@pytest.mark.parametrize("target", [3, 12])
def test_heavy_users_equal_the_single_window(spark, target):
    """Some users above the target, some not: the same rows as one window per user."""
    clicks = clicks_from_events(spark, SF01)
    sizes = [r["count"] for r in clicks.groupBy("ip", "device", "os").count().collect()]
    assert max(sizes) > target >= min(sizes)

    def rows(**options):
        out = sequence_features(clicks, outputs=OUT, **options).select(
            "click_id", *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in OUT])
        return sorted(tuple(r) for r in out.collect())

    assert rows(target_chunk_rows=target) == rows(n_rows=0)

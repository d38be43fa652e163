"""Per-user joins with one user's clicks in most rows: the same rows, dealt over tasks."""

import pytest
from pyspark.sql import functions as F

from clickcast.operators import cohorts
from clickcast.operators.joins import join_per_key
from clickcast.plans.training import user_ever_attributed

BOUNDS = ({}, {"max_rows": 0}, {"max_rows": 0, "target": 100})


@pytest.fixture(scope="module")
def clicks(spark):
    """6,000 clicks: 4,000 of one user, a few of 400 others, some with a null key."""
    i = F.col("id")
    user = F.when(i < 4000, 1).when(i < 5900, 2 + i % 400)
    return spark.range(6000).select(
        i.alias("click_id"), user.cast("int").alias("ip"), F.lit(1).alias("device"), F.lit(2).alias("os"),
        F.timestamp_seconds(1_500_000_000 + F.pmod(i * 7919, F.lit(3600))).alias("click_time"),
        (F.pmod(i, F.lit(13)) == 5).cast("int").alias("is_attributed")).repartition(5)


def test_conversions_per_user_are_the_same_for_any_bound(clicks):
    sums = {}
    for r in clicks.where("ip IS NOT NULL").collect():
        sums[r.ip] = sums.get(r.ip, 0) + r.is_attributed
    want = sorted((r.click_id, sums[r.ip]) for r in clicks.where("ip IS NOT NULL").collect())
    for bounds in BOUNDS:
        got = user_ever_attributed(clicks, **bounds)
        assert sorted((r.click_id, r.ever_attributed) for r in got.select("click_id", "ever_attributed").collect()) == want
        assert got.columns == ["ip", "device", "os", "click_id", "click_time", "is_attributed", "ever_attributed"]


def test_clicks_until_conversion_are_the_same_for_any_bound(clicks):
    rows = clicks.where("ip IS NOT NULL").collect()
    first = {}
    for r in rows:
        if r.is_attributed:
            first[r.ip] = min(first.get(r.ip, r.click_time), r.click_time)
    want = {u: sum(r.ip == u and r.click_time <= t for r in rows) for u, t in first.items()}
    for bounds in BOUNDS:
        got = cohorts.clicks_before_first_conversion(clicks, **bounds).collect()
        assert {r.ip: r.n_clicks for r in got} == want and len(got) == len(want)


def test_a_heavy_user_is_dealt_over_tasks_and_others_are_not_copied(spark, clicks):
    per_user = clicks.groupBy("ip").agg(F.count("*").alias("n"), F.first("device").alias("d"))

    def largest(**bounds):
        joined = join_per_key(clicks.select("ip", "click_id"), per_user, ["ip"], "n", F.col("click_id"), max_rows=0, **bounds)
        sizes = joined.groupBy(F.spark_partition_id().alias("task"), "ip").count()
        return joined.count(), sizes.where("ip = 1").agg(F.max("count")).first()[0]

    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    kept = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        rows, whole = largest()
        again, split = largest(target=100)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert rows == again == 5900 and whole == 4000 and split < 1600

"""Kept orders, mergeable sketches, overlapping ranges, partitioned samples."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from clickcast.operators.ordering import with_positions
from clickcast.operators.ranges import ValueRange, range_histograms
from clickcast.operators.sketches import RANK_ERROR, merged_sketches, rank_errors, sketch_quantiles, value_sketches
from clickcast.plans import training
from clickcast.session import scratch_path
from clickcast.sources.clicks import clicks_from_events


def test_positions_equal_a_sorted_list(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 1, 2, 2, 2, 7])) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, v int").repartition(7)
    got = {r["i"]: r["position"] for r in with_positions(df, F.col("v").desc(), "i", ranges=5).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: k for k, r in enumerate(want, 1)}


def test_positions_of_equal_and_of_no_rows(spark):
    df = spark.createDataFrame([(3,)] * 40, "v int")
    assert sorted(r["position"] for r in with_positions(df, "v", ranges=4).collect()) == list(range(1, 41))
    assert with_positions(df.where("v > 3"), "v", ranges=4).collect() == []


def test_rows_are_ranked_by_range(spark):
    rows = with_positions(spark.range(2000), F.col("id").desc(), ranges=8)
    assert rows.where("position != 2000 - id").isEmpty()
    plan = rows._jdf.queryExecution().toString()
    assert "windowspecdefinition(_range" in plan and "hashpartitioning(_range" in plan


def test_merged_sketches_keep_the_rank_error(spark):
    df = spark.range(60_000).select(
        (F.col("id") % 3).alias("g"), (F.col("id") % 40).alias("slice"), F.exp(F.col("id") % 7919 / 500).alias("x"))
    df = df.unionByName(spark.createDataFrame([(9, 0, None)], "g long, slice long, x double"))
    kept = value_sketches(df, "x", ["g", "slice"])
    found = sketch_quantiles(merged_sketches(kept, ["g"]), (0.01, 0.25, 0.5, 0.99), ["g"])
    got = rank_errors(found, df, "x", ["g"]).collect()
    assert sorted((r["g"], r["p"]) for r in got) == [(g, p) for g in range(3) for p in (0.01, 0.25, 0.5, 0.99)]
    assert all(r["n"] == 20_000 and r["rank_error"] <= RANK_ERROR for r in got)


def test_rank_error_of_a_wrong_quantile_is_seen(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("x"))
    found = spark.createDataFrame([(0.5, 100, 80.0)], "p double, n long, value double")
    assert math.isclose(rank_errors(found, df, "x").first()["rank_error"], 0.29)


def test_ranges_equal_a_plain_count_of_each(spark):
    ranges = [ValueRange("all", 3), ValueRange("low", 0.5, lo=0, hi=5, source="a"),
              ValueRange("closed", 1, lo=2, hi=8, lo_inclusive=True, hi_inclusive=True, source=("a", "b"))]
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([None, -1.0, 0.0, 2.0, 5.0, 8.0, rng.uniform(-2, 9)]))
            for _ in range(400)]
    want = Counter()
    for source, x in rows:
        if x is None:
            continue
        want["all", math.floor(x / 3)] += 1
        if source == "a" and 0 < x < 5:
            want["low", math.floor(x / 0.5)] += 1
        if source in ("a", "b") and 2 <= x <= 8:
            want["closed", math.floor(x)] += 1
    df = spark.createDataFrame(rows, "source string, x double")
    got = {(r["range"], r["bin"]): r["count"] for r in range_histograms(df, "x", ranges, "source").collect()}
    assert got == dict(want)
    assert range_histograms(df.where("false"), "x", ranges, "source").collect() == []


def test_one_sample_reads_its_folder_only(spark):
    path = scratch_path(spark, "samples")
    training.write_modelling_samples(clicks_from_events(spark, "/root/testdata/sf0.01"), path)
    back = training.read_modelling_samples(spark, path, [2])
    every = training.read_modelling_samples(spark, path)
    assert {r[0] for r in back.select("sample_id").distinct().collect()} == {2}
    assert back.count() == every.where("sample_id = 2").count() > 0
    plan = spark.read.option("header", True).csv(path).where(F.col("sample_id").isin(2))
    assert re.search(r"PartitionFilters: \[[^]]*sample_id", plan._jdf.queryExecution().toString())

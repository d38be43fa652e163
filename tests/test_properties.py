"""Properties of sampling, splitting, evaluation and models on sf0.01."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from clickcast.operators import evaluate as ev
from clickcast.operators import sampling as sa
from clickcast.operators.sequence import sequence_features
from clickcast.sources.clicks import clicks_from_events
from tests.conftest import SF01

Q = entry.queries()


@pytest.fixture(scope="module")
def clicks(spark):
    return clicks_from_events(spark, SF01)


def test_split_sizes_and_shares(clicks):
    s = sa.stratified_split(clicks).groupBy("is_attributed", "split").count().collect()
    by = {}
    for r in s:
        by.setdefault(r.is_attributed, {})[r.split] = r["count"]
    for label, parts in by.items():
        n = sum(parts.values())
        for name, lo, hi in (("train", 0, 72), ("train_dev", 72, 80), ("dev", 80, 90),
                             ("test", 90, 100)):
            assert abs(parts[name] - n * (hi - lo) / 100) <= 1
    assert sum(sum(p.values()) for p in by.values()) == clicks.count()


def test_ranks_are_a_permutation(clicks):
    r = sa.stratum_rank(clicks, "is_attributed", prefix_hex=2)
    agg = r.groupBy("is_attributed").agg(F.count("*").alias("c"), F.min("_rn").alias("lo"),
                                         F.max("_rn").alias("hi"),
                                         F.count_distinct("_rn").alias("d")).collect()
    for a in agg:
        assert a.lo == 1 and a.hi == a.c == a.d


def test_undersample_balances(clicks):
    counts = {r.is_attributed: r["count"]
              for r in sa.undersample(clicks).groupBy("is_attributed").count().collect()}
    assert counts[0] == counts[1]


def test_sample_by_keeps_all_conversions(spark, clicks):
    s = Q["stratified_sample"](spark, SF01)
    ones = clicks.where("is_attributed = 1").count()
    assert s.where("is_attributed = 1").count() == ones
    zeros = s.where("is_attributed = 0").count()
    assert 0 < zeros < 0.03 * clicks.count()


def test_four_samples(spark):
    ids = {r.sample_id for r in Q["stratified_samples_multi"](spark, SF01)
           .select("sample_id").distinct().collect()}
    assert ids == {1, 2, 3, 4}


def test_approx_quartiles_within_rank_error(spark):
    rows = Q["approx_quartiles"](spark, SF01).collect()
    exact = sorted(r["count"] for r in Q["devices_per_ip"](spark, SF01).collect())
    n = len(exact)
    dev = [r for r in rows if r.table == "devices_per_ip"][0]
    for p, v in ((0.25, dev.q25), (0.5, dev.q50), (0.75, dev.q75)):
        lo = exact[max(0, int((p - 0.25) * n))]
        hi = exact[min(n - 1, int((p + 0.25) * n))]
        assert lo <= v <= hi


def test_roc_monotone_and_auc_symmetry(spark, clicks):
    scored = sequence_features(clicks, outputs=("n_previous_clicks",)).withColumn(
        "score", F.col("n_previous_clicks").cast("double"))
    roc = ev.roc_curve(scored).orderBy(F.col("threshold").desc()).collect()
    tprs = [r.tpr for r in roc]
    fprs = [r.fpr for r in roc]
    assert tprs == sorted(tprs) and fprs == sorted(fprs)
    assert tprs[-1] == 1.0 and fprs[-1] == 1.0
    a = ev.roc_auc(scored).first().roc_auc
    b = ev.roc_auc(scored.withColumn("score", -F.col("score"))).first().roc_auc
    assert abs(a + b - 1) < 1e-12


def test_running_totals_bucketed_equals_single_window(spark, clicks):
    df = clicks.withColumn("s", (F.col("click_id") % 97).cast("double"))
    sums = {"n": F.count(F.lit(1))}
    few = {r.s: r.cum_n for r in ev.running_totals(df, "s", sums, n_buckets=2).collect()}
    many = {r.s: r.cum_n for r in ev.running_totals(df, "s", sums, n_buckets=64).collect()}
    assert few == many and few[96.0] == clicks.count()


def test_scores_within_bounds(spark):
    for r in Q["score_tables"](spark, SF01).collect():
        n1 = r["1"] or 0
        assert 0 <= r.custom_score <= n1


def test_attempt_starts_have_zero_counters(spark):
    f = Q["training_features"](spark, SF01)
    assert f.where("click_time_diff < 0").count() == 0
    starts = sequence_features(Q["time_features"](spark, SF01),
                               outputs=("prev_label", "n_previous_clicks"))
    assert starts.where("prev_label = 1 AND n_previous_clicks <> 0").count() == 0


def test_assembled_vector_width(spark):
    v = Q["assembled_features"](spark, SF01).first().features
    assert v.size == 30


def test_sampling_job_writes_four_samples(spark):
    from clickcast.plans.training import write_modelling_samples
    from clickcast.session import scratch_path
    from clickcast.sources.clicks import EXTRACT_SCHEMA
    out = scratch_path(spark, "samples")
    bal = {r.is_attributed: r["count"] for r in
           write_modelling_samples(clicks_from_events(spark, SF01), out).collect()}
    from pyspark.sql.types import IntegerType, StructField, StructType
    schema = StructType(EXTRACT_SCHEMA.fields + [StructField("sample_id", IntegerType())])
    back = spark.read.option("header", True).option("nullValue", "null").schema(schema).csv(out)
    ids = {r.sample_id for r in back.select("sample_id").distinct().collect()}
    assert ids == {1, 2, 3, 4}
    assert back.where("sample_id = 1 AND is_attributed = 1").count() == bal[1]


def test_running_totals_on_empty_input(spark, clicks):
    empty = clicks.withColumn("s", F.lit(1.0)).where("click_id < 0")
    assert ev.running_totals(empty, "s", {"n": F.count(F.lit(1))}).count() == 0

"""Exact quantiles by selection against numpy, for any range size, with null groups and heavy ties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickcast.operators import explore as ex
from clickcast.operators.quantiles import quantiles, value_counts

PROBS, NAMES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0), tuple("abcdefh")


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(4)
    out = [("hot", rnd.gauss(0, 100)) for _ in range(900)] + [("ties", float(rnd.randrange(3))) for _ in range(300)]
    out += [(None, rnd.random()) for _ in range(50)] + [("one", 7.0), ("null", None), ("hot", None)]
    out += [(f"g{k}", float(rnd.randrange(50))) for k in range(40) for _ in range(rnd.randrange(1, 6))]
    return spark.createDataFrame(out, "g string, x double").repartition(6), out


def by_group(out):
    groups = {}
    for g, x in out:
        groups.setdefault(g, [])
        if x is not None:
            groups[g].append(x)
    return groups


@pytest.mark.parametrize("size", [5, 64, 100_000])
def test_quantiles_equal_numpy(rows, size):
    df, out = rows
    groups = by_group(out)
    got = {r.g: r for r in quantiles(value_counts(df, "x", ["g"]), PROBS, NAMES, ["g"], range_values=size).collect()}
    assert set(got) == set(groups)
    disc = {r.g: r for r in quantiles(value_counts(df, "x", ["g"]), PROBS, NAMES, ["g"], True, size).collect()}
    for g, xs in groups.items():
        if not xs:
            assert all(got[g][n] is None and disc[g][n] is None for n in NAMES)
            continue
        assert [got[g][n] for n in NAMES] == pytest.approx(list(np.quantile(xs, PROBS)))
        assert [disc[g][n] for n in NAMES] == list(np.quantile(xs, PROBS, method="inverted_cdf"))
    whole = [x for xs in groups.values() for x in xs]
    one = quantiles(value_counts(df, "x"), PROBS, NAMES, range_values=size).collect()
    assert len(one) == 1 and [one[0][n] for n in NAMES] == pytest.approx(list(np.quantile(whole, PROBS)))


def test_weights_count(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (9.0, 4), (None, 5)], "x double, w long")
    got = quantiles(value_counts(df, "x", weight="w"), [0.25, 0.5], ["a", "b"]).first()
    assert [got.a, got.b] == pytest.approx(list(np.quantile([1, 1, 1, 2, 9, 9, 9, 9], [0.25, 0.5])))


def test_box_stats_keep_the_null_group_and_no_plan_has_a_buffer_per_group(rows):
    df, out = rows
    got = {r.g: r for r in ex.box_stats(df, "x", ["g"]).collect()}
    for g, xs in by_group(out).items():
        if xs:
            q1, q2, q3 = np.quantile(xs, [0.25, 0.5, 0.75])
            inside = [x for x in xs if q1 - 1.5 * (q3 - q1) <= x <= q3 + 1.5 * (q3 - q1)]
            want = [q1, q2, q3, min(inside), max(inside), len(xs) - len(inside)]
            r = got[g]
            assert [r.q1, r.median, r.q3, r.lower_whisker, r.upper_whisker, r.n_outliers] == pytest.approx(want)
    for plan in (ex.box_stats(df, "x", ["g"]), ex.median(df, "x", ["g"]), ex.profile(df, ["g", "x"]),
                 ex.quantiles_exact(df, "x", by=["g"])):
        text = plan._jdf.queryExecution().toString().lower()
        assert "percentile(" not in text and "median(" not in text and "percentile_disc" not in text


def test_nothing_gives_nothing(spark):
    none = spark.createDataFrame([], "g string, x double")
    assert ex.median(none, "x", ["g"]).count() == 0 and ex.median(none, "x").first()["median"] is None
    assert ex.box_stats(none, "x", ["g"]).count() == 0
    nulls = spark.createDataFrame([("a", None)], "g string, x double")
    assert ex.median(nulls, "x").where(F.col("median").isNull()).count() == 1

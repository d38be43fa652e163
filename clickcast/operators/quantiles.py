"""Exact quantiles of many groups and probabilities at once, by selection.

Spark's ``percentile`` keeps all distinct values of a group in one buffer, so one group of continuous
values is one task's memory.  Here nothing is gathered: the values are counted (a partial
aggregate), cut into ranges of about ``RANGE_VALUES`` distinct values at approximate cut points, and the
ranges' totals tell which range holds a wanted rank.  Only those ranges are ordered, each in a
window of its own.  The cut points move work about, not results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickcast.session import materialised

#: Distinct values that one window task is to hold.
RANGE_VALUES = 100_000


def same_group(left: DataFrame, right: DataFrame, by, how: str = "inner") -> DataFrame:
    """Join on the columns ``by``, nulls being equal; they are kept once."""
    names = [f"_right_{c}" for c in by]
    other = right.withColumnsRenamed(dict(zip(by, names)))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names)], F.lit(True))
    return left.join(other, on, how).drop(*names)


def value_counts(df: DataFrame, col: str, by=(), weight: str | None = None) -> DataFrame:
    """by…, _v (double, null among them), _n: the distinct values of each group and how often they occur; written."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return materialised(df.groupBy(*by, F.col(col).cast("double").alias("_v")).agg(n.cast("long").alias("_n")), "values")


def quantiles(counts: DataFrame, probs, names, by=(), discrete: bool = False,
              range_values: int = RANGE_VALUES) -> DataFrame:
    """by… and the quantiles of ``counts`` (see :func:`value_counts`), null for a group without a value.

    Interpolated between the values at the ranks around ``p * (n - 1)``; ``discrete`` takes the smallest
    value whose cumulative share reaches p.
    """
    by = list(by)
    known = counts.where("_v IS NOT NULL")
    pieces = known.count() // range_values + 1
    cuts = [] if pieces == 1 else known.agg(F.percentile_approx(
        "_v", [k / pieces for k in range(1, pieces)], max(10_000, 10 * pieces)).alias("q")).first()["q"]
    splits = [float("-inf"), *(sorted(set(cuts or [])) or [0.0]), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="_v", outputCol="_b").transform(known)
    in_order = Window.partitionBy(*by).orderBy("_b")  # a row a range: bounded by the number of ranges
    total = F.sum("_m").over(Window.partitionBy(*by))
    sums = ranged.groupBy(*by, "_b").agg(F.sum("_n").alias("_m")).select(
        *by, "_b", "_m", (F.sum("_m").over(in_order) - F.col("_m")).alias("_before"), total.alias("_total"))
    wanted = []
    for k, p in enumerate(probs):
        place = F.greatest(F.ceil(F.lit(float(p)) * F.col("_total")) - 1, F.lit(0)).cast("double") if discrete else (
            F.lit(float(p)) * (F.col("_total") - 1))
        for side, rank in enumerate((F.floor(place), F.ceil(place))):
            wanted.append(F.struct(F.lit(2 * k + side).alias("k"), rank.cast("long").alias("rank"),
                                   (place - F.floor(place)).alias("part")))
    here = F.filter(F.array(*wanted), lambda w: (w["rank"] >= F.col("_before")) & (
        w["rank"] < F.col("_before") + F.col("_m")))
    located = sums.withColumn("_wanted", here).where(F.size("_wanted") > 0).select(*by, "_b", "_before", "_wanted")
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_b").orderBy("_v"))
    ranked = same_group(ranged, located, [*by, "_b"]).withColumn("_upto", upto)
    found = ranked.select(*by, "_v", F.explode(F.filter("_wanted", lambda w: (w["rank"] < F.col("_upto")) & (
        w["rank"] >= F.col("_upto") - F.col("_n")))).alias("w"))

    def at(k: int, what):
        return F.max(F.when(F.col("w.k") == k, what))

    out = []
    for k, name in enumerate(names):
        low, high, part = at(2 * k, F.col("_v")), at(2 * k + 1, F.col("_v")), at(2 * k, F.col("w.part"))
        out.append(F.when(low == high, low).otherwise((1 - part) * low + part * high).alias(name))
    result = found.groupBy(*by).agg(*out)
    # A group of nulls alone has a row too.
    return same_group(counts.select(*by).distinct(), result, by, "left") if by else result


def around_steps(counts: DataFrame, steps: int, by, range_values: int = RANGE_VALUES) -> DataFrame:
    """by…, _v, _upto, _total, _values: the values of ``counts`` at and next to the ranks ``k / steps * (n - 1)``, all k up to ``steps``.

    ``_upto`` is the number of rows up to the value, ``_total`` that of all, ``_values`` that of the group's values: if they
    are at most ``steps``, all are there.
    """
    by = list(by)
    known = counts.where("_v IS NOT NULL")
    pieces = known.count() // range_values + 1
    cuts = [] if pieces == 1 else known.agg(F.percentile_approx(
        "_v", [k / pieces for k in range(1, pieces)], max(10_000, 10 * pieces)).alias("q")).first()["q"]
    splits = [float("-inf"), *(sorted(set(cuts or [])) or [0.0]), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="_v", outputCol="_b").transform(known)
    whole = Window.partitionBy(*by)  # a row a range: bounded by the number of ranges
    sums = ranged.groupBy(*by, "_b").agg(F.sum("_n").alias("_m"), F.count(F.lit(1)).alias("_k")).select(
        *by, "_b", (F.sum("_m").over(whole.orderBy("_b")) - F.col("_m")).alias("_before"),
        F.sum("_m").over(whole).alias("_total"), F.sum("_k").over(whole).alias("_values"))
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_b").orderBy("_v"))
    ranked = same_group(ranged, sums, [*by, "_b"]).withColumn("_upto", upto)
    step = F.lit(float(steps)) / F.greatest(F.col("_total") - 1, F.lit(1))
    near = F.floor((F.col("_upto") + 1) * step) >= F.ceil((F.col("_upto") - F.col("_n") - 1) * step)
    return ranked.where(near | (F.col("_values") <= steps)).select(*by, "_v", "_upto", "_total", "_values")

"""Exploration: counts, distinct counts, summaries, quantiles, histograms,
box statistics, profiles and correlations.

Everything is a grouped aggregate (partial aggregation on the map side, so a
heavy key never reaches one task as raw rows).  Exact quantiles are found by
selection over value ranges (``quantiles``), so no group's values meet in one
buffer; ``approx_quantiles`` is the bounded-memory sketch.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickcast.operators.quantiles import quantiles, same_group, value_counts
from clickcast.session import scratch_path


def group_count(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count()


def distinct_count_per(df: DataFrame, key, cols) -> DataFrame:
    """Number of distinct ``cols`` tuples per ``key`` (null tuples count,
    as with distinct + count)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.select(*keys, *cols).distinct().groupBy(*keys).count()


def class_balance(df: DataFrame, label_col: str = "is_attributed") -> DataFrame:
    """Clicks per label and their share of all clicks in percent."""
    counts = df.groupBy(label_col).count()
    # One row per label: an unpartitioned window over it is tiny.
    total = F.sum("count").over(Window.partitionBy())
    return counts.select(label_col, "count", (F.col("count") * 100 / total).alias("pct"))


def describe(df: DataFrame, col: str, by=()) -> DataFrame:
    """count, mean, sample stddev, min, max of ``col`` (numeric form of
    ``DataFrame.describe``)."""
    c = F.col(col)
    return df.groupBy(*by).agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("stddev"),
        F.min(c).alias("min"), F.max(c).alias("max"))


def quantiles_exact(df: DataFrame, col: str, probs=(0.25, 0.5, 0.75), by=(),
                    names=None) -> DataFrame:
    """Discrete quantiles: the smallest value whose cumulative share reaches p."""
    names = names or [f"q{int(round(p * 100))}" for p in probs]
    dtype = dict(df.dtypes)[col]  # the result is an element of the column
    found = quantiles(value_counts(df, col, by), probs, names, by, discrete=True)
    return found.select(*by, *[F.col(n).cast(dtype).alias(n) for n in names])


def approx_quantiles(df: DataFrame, col: str, probs=(0.25, 0.5, 0.75),
                     relative_error: float = 0.25, by=()) -> DataFrame:
    """Approximate quantiles with the given relative rank error (GK sketch)."""
    accuracy = max(1, int(round(1 / relative_error))) if relative_error > 0 else 1_000_000
    q = F.percentile_approx(col, list(probs), accuracy)
    return df.groupBy(*by).agg(q.alias("_q")).select(
        *by, *[F.col("_q")[i].alias(f"q{int(round(p * 100))}") for i, p in enumerate(probs)])


def median(df: DataFrame, col: str, by=()) -> DataFrame:
    """Interpolated median."""
    return quantiles(value_counts(df, col, by), [0.5], ["median"], by)


def histogram(df: DataFrame, col: str, width: float, lo=None, hi=None, by=(),
              lo_inclusive: bool = False, hi_inclusive: bool = False) -> DataFrame:
    """Fixed-width bins ``floor(x / width)``; optional open/closed range filter."""
    c = F.col(col)
    cond = c.isNotNull()
    if lo is not None:
        cond = cond & ((c >= lo) if lo_inclusive else (c > lo))
    if hi is not None:
        cond = cond & ((c <= hi) if hi_inclusive else (c < hi))
    b = F.floor(c / F.lit(width)).cast("long")
    return (df.where(cond).groupBy(*by, b.alias("bin")).count()
              .withColumn("bin_lo", F.col("bin") * F.lit(float(width))))


def auto_histogram(df: DataFrame, col: str, max_bins: int | None = None) -> DataFrame:
    """Equal-width bins over [min, max] with the Freedman–Diaconis count
    (``ceil(range / (2 IQR n^-1/3))``, at most ``max_bins`` if given; ``sqrt(n)`` when
    the IQR is 0), the default of the distribution plots.  The five numbers come from
    the counted values; the binning is a plain grouped count."""
    c = F.col(col)
    counts = value_counts(df, col)
    ends = counts.where("_v IS NOT NULL").agg(F.sum("_n").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).first()
    n, lo, hi = ends["n"], ends["lo"], ends["hi"]
    st = quantiles(counts, [0.25, 0.75], ["q1", "q3"]).first()
    if not n:
        return df.where(F.lit(False)).select(F.lit(0).cast("long").alias("bin"),
                                             F.lit(0.0).alias("bin_lo"),
                                             F.lit(0).cast("long").alias("count"))
    iqr = st["q3"] - st["q1"]
    if iqr > 0:
        h = 2 * iqr * n ** (-1 / 3)
        bins = int(math.ceil((hi - lo) / h)) if hi > lo else 1
    else:
        bins = int(math.sqrt(n))
    bins = max(1, bins if max_bins is None else min(bins, max_bins))
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((c - F.lit(float(lo))) / F.lit(width)), F.lit(bins - 1)).cast("long")
    return (df.where(c.isNotNull()).groupBy(b.alias("bin")).count()
              .select("bin", (F.lit(float(lo)) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                      "count"))


def box_stats(df: DataFrame, col: str, by=()) -> DataFrame:
    """Box-plot numbers per group: quartiles (interpolated), whiskers at the
    most extreme values within 1.5 IQR, and the number of outliers."""
    dtype = dict(df.dtypes)[col]
    counts = value_counts(df, col, by)
    x, n = F.col("_v"), F.col("_n")
    iqr = F.col("q3") - F.col("q1")
    qs = quantiles(counts, [0.25, 0.5, 0.75], ["q1", "median", "q3"], by)
    inside = (x >= F.col("q1") - 1.5 * iqr) & (x <= F.col("q3") + 1.5 * iqr)
    # Whiskers and outliers need the counted values only, not the rows.
    return same_group(counts.where("_v IS NOT NULL"), qs, by).groupBy(*by).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, x)).cast(dtype).alias("lower_whisker"),
        F.max(F.when(inside, x)).cast(dtype).alias("upper_whisker"),
        F.sum(F.when(inside, 0).otherwise(n)).cast("long").alias("n_outliers"))


def unpivot(df: DataFrame, cols, keep=(), name: str = "feature", value: str = "value",
            cast: str | None = None) -> DataFrame:
    """Long form (keep…, feature, value) of the given columns."""
    vals = [F.col(c).cast(cast) if cast else F.col(c) for c in cols]
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), v.alias("v")) for c, v in zip(cols, vals)])
    return (df.select(*keep, F.explode(pairs).alias("_kv"))
              .select(*keep, F.col("_kv.k").alias(name), F.col("_kv.v").alias(value)))


def profile(df: DataFrame, cols) -> DataFrame:
    """Per column: count, distinct, most frequent value (ties: smallest text)
    and its frequency, and for numeric columns mean, std, min, quartiles, max.

    One unpivot and one count per (feature, value); every statistic is then
    taken from that count table (weighted), which holds one row per distinct
    value instead of one per click.  Quartiles are exact (interpolated).
    """
    types = dict(df.dtypes)
    numeric = {c for c in cols if types[c] in ("int", "bigint", "double", "float", "smallint")}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("text"),
                 (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double"))
                 .alias("num"))
        for c in cols])).alias("_r")).select("_r.*")
    freq = long.where(F.col("text").isNotNull()).groupBy("feature", "text", "num").count()
    path = scratch_path(df.sparkSession, "profile-counts")
    freq.write.parquet(path)
    freq = df.sparkSession.read.schema(freq.schema).parquet(path)
    c, x = F.col("count"), F.col("num")
    n = F.sum(c)
    # deviations are taken from the mean: sums of squares cancel for columns with a large mean
    means = freq.groupBy("feature").agg((F.sum(c * x) / F.sum(c)).alias("mean"))
    freq = freq.join(F.broadcast(means), "feature")  # a row per profiled column
    squares = F.sum(c * (x - F.col("mean")) * (x - F.col("mean")))
    stats = freq.groupBy("feature").agg(
        n.alias("n"), F.count(F.lit(1)).alias("n_distinct"),
        F.first("mean").alias("mean"),
        F.when(n > 1, F.sqrt(squares / F.greatest(n - 1, F.lit(1)))).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"),
        F.min_by(F.struct(F.col("text"), c), F.struct(-c, F.col("text"))).alias("_top"))
    quarters = quantiles(value_counts(freq, "num", ["feature"], "count"), [0.25, 0.5, 0.75], ["p25", "p50", "p75"], ["feature"])
    stats = stats.join(F.broadcast(quarters), "feature")  # a row per profiled column
    return stats.select("feature", "n", "n_distinct", "mean", "std", "min", "p25", "p50", "p75",
                        "max", F.col("_top.text").alias("top"), F.col("_top.count").alias("freq"))


def correlation_pairs(df: DataFrame, cols) -> DataFrame:
    """Pearson correlation of every pair below the diagonal, long form."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return unpivot(wide, [f"{a}|{b}" for a, b in pairs], name="_pair", value="corr").select(
        F.split("_pair", r"\|")[0].alias("col_a"), F.split("_pair", r"\|")[1].alias("col_b"),
        "corr")

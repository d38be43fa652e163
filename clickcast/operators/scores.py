"""Target-encoded category scores.

For a category key with n0 non-converting and n1 converting clicks:

* pivot            key, "0" = n0, "1" = n1 (null when a class is absent)
* conversion rate  prcnt_0 / prcnt_1 in percent, null unless both classes occur
* score            custom_score = n1 * (prcnt_1 / 100) = n1² / (n0 + n1),
                   0 when only one class occurs (also when every click converted)

All four category scores come from one scan: the four keys are unpivoted to
(dim, key) rows and aggregated together; the partial aggregation collapses
them map-side, so the shuffle carries one row per (dim, key, task).
Null keys are dropped (an inner join can never match them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickcast.functions.categories import score_band

CATEGORY_COLS = ("device", "os", "app", "channel")


def label_pivot(df: DataFrame, key: str, label_col: str = "is_attributed") -> DataFrame:
    """Clicks per key and label; values are given so no extra job runs."""
    return (df.select(key, label_col).where(F.col(key).isNotNull())
              .groupBy(key).pivot(label_col, [0, 1]).count())


def _rates(n0, n1):
    both = n0.isNotNull() & n1.isNotNull()
    total = n0 + n1
    prcnt_0 = F.when(both, (n0 / total) * 100)
    prcnt_1 = F.when(both, (n1 / total) * 100)
    return prcnt_0, prcnt_1


def conversion_rate(df: DataFrame, key: str, label_col: str = "is_attributed") -> DataFrame:
    """Pivot plus prcnt_0 / prcnt_1 (percent; null unless both classes occur)."""
    piv = label_pivot(df, key, label_col)
    prcnt_0, prcnt_1 = _rates(F.col("0"), F.col("1"))
    return piv.select(key, "0", "1", prcnt_0.alias("prcnt_0"), prcnt_1.alias("prcnt_1"))


def rates_from_counts(counts: DataFrame) -> DataFrame:
    """dim, key, 0, 1, prcnt_1 (percent; null unless both classes occur) from ``label_counts``."""
    n0, n1 = (F.when(F.col(c) > 0, F.col(c)) for c in ("_n0", "_n1"))
    return counts.select("dim", "key", n0.alias("0"), n1.alias("1"), _rates(n0, n1)[1].alias("prcnt_1"))


def min_support(rates: DataFrame, min_clicks: int) -> DataFrame:
    """Keys with at least ``min_clicks`` clicks; keys missing a class drop out."""
    return rates.where((F.col("0") + F.col("1")) >= min_clicks)


def _score_cols(n0, n1):
    """prcnt_1 (as a fraction), n1 and custom_score with nulls filled by 0."""
    _, prcnt_1 = _rates(n0, n1)
    frac = F.coalesce(prcnt_1, F.lit(0.0)) / 100
    ones = F.coalesce(n1, F.lit(0)).cast("long")
    return frac, ones, ones * frac


def category_score(df: DataFrame, key: str, label_col: str = "is_attributed") -> DataFrame:
    """key, prcnt_1 (fraction), "1" (= n1), custom_score for one key."""
    piv = label_pivot(df, key, label_col)
    frac, ones, score = _score_cols(F.col("0"), F.col("1"))
    return piv.select(key, frac.alias("prcnt_1"), ones.alias("1"), score.alias("custom_score"))


def label_counts(df: DataFrame, dims=CATEGORY_COLS, label_col: str = "is_attributed",
                 time_col: str | None = None) -> DataFrame:
    """Clicks per (dim, key) and label, from one scan: dim, key, _n0, _n1.

    With ``time_col`` a pseudo-dim ``_log`` (key 0) is added whose row holds
    the whole log's size (``_n``) and time range (``_lo``, ``_hi``, epoch
    seconds), so one pass also sizes later stages.
    """
    entries = [f"'{d}', CAST(`{d}` AS BIGINT)" for d in dims]
    if time_col:
        entries.append("'_log', CAST(0 AS BIGINT)")
    cols = [F.expr(f"stack({len(entries)}, {', '.join(entries)}) AS (dim, key)"),
            F.col(label_col).alias("_label")]
    aggs = [F.count(F.when(F.col("_label") == 0, 1)).alias("_n0"),
            F.count(F.when(F.col("_label") == 1, 1)).alias("_n1")]
    if time_col:
        cols.append(F.col(time_col).cast("timestamp").cast("long").alias("_t"))
        aggs += [F.count(F.lit(1)).alias("_n"), F.min("_t").alias("_lo"),
                 F.max("_t").alias("_hi")]
    return (df.select(*cols).where(F.col("key").isNotNull())
              .groupBy("dim", "key").agg(*aggs))


def scores_from_counts(counts: DataFrame) -> DataFrame:
    """Long score table from ``label_counts`` (the ``_log`` row excluded)."""
    n0 = F.when(F.col("_n0") > 0, F.col("_n0"))
    n1 = F.when(F.col("_n1") > 0, F.col("_n1"))
    frac, ones, score = _score_cols(n0, n1)
    return counts.where(F.col("dim") != "_log").select(
        "dim", "key", n0.alias("0"), n1.alias("1"),
        frac.alias("prcnt_1"), score.alias("custom_score"))


def score_tables(df: DataFrame, dims=CATEGORY_COLS, label_col: str = "is_attributed") -> DataFrame:
    """Scores of several keys in one pass, long form:
    dim, key (bigint), 0, 1, prcnt_1, custom_score."""
    return scores_from_counts(label_counts(df, dims, label_col))


def score_for(scores_long: DataFrame, dim: str, name: str | None = None) -> DataFrame:
    """One dim of ``score_tables`` as (dim, <dim>_custom_score)."""
    return (scores_long.where(F.col("dim") == dim)
                       .select(F.col("key").alias(dim),
                               F.col("custom_score").alias(name or f"{dim}_custom_score")))


def score_categories(scores_long: DataFrame) -> DataFrame:
    """Letter band of every score (dim, key, custom_score, category)."""
    cat = None
    for dim in CATEGORY_COLS:
        band = score_band(F.col("custom_score"), dim)
        cat = (F.when(F.col("dim") == dim, band) if cat is None
               else cat.when(F.col("dim") == dim, band))
    return scores_long.select("dim", "key", "custom_score", cat.alias("category"))

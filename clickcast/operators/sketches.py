"""Approximate quantiles from stored, mergeable sketches.

A KLL sketch of each group is built once by a partial aggregate and kept as a table.  Coarser
groups, or a log to which days are added, merge the kept sketches and never read the values
again.  A sketch's size is bounded by ``k`` whatever it has seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickcast.operators.quantiles import same_group
from clickcast.session import materialised

#: Items of a sketch's widest level, and the rank error that holds at this size in 99 of 100 sketches.
SKETCH_K = 800
RANK_ERROR = 0.01


def value_sketches(df: DataFrame, col: str, by=(), k: int = SKETCH_K) -> DataFrame:
    """by…, sketch: a KLL sketch of ``col`` for each group (nulls are not counted); written."""
    return materialised(df.groupBy(*by).agg(
        F.kll_sketch_agg_double(F.col(col).cast("double"), k).alias("sketch")), "sketches")


def merged_sketches(sketches: DataFrame, by=(), k: int = SKETCH_K) -> DataFrame:
    """by…, sketch: the kept sketches of each coarser group as one."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, probs=(0.25, 0.5, 0.75), by=()) -> DataFrame:
    """by…, p, n, value: a row for each group and probability; no row for a group without a value."""
    n = F.kll_sketch_get_n_double("sketch")
    found = [F.struct(p.alias("p"), F.kll_sketch_get_quantile_double("sketch", p).alias("value"))
             for p in (F.lit(float(p)) for p in probs)]
    return sketches.where(n > 0).select(*by, n.alias("n"), F.explode(F.array(*found)).alias("_q")).select(
        *by, "_q.p", "n", "_q.value")


def rank_errors(found: DataFrame, df: DataFrame, col: str, by=()) -> DataFrame:
    """``found`` (of :func:`sketch_quantiles`) plus ``rank_error``: how far p lies outside the value's ranks.

    One pass over ``df``; per group the few quantiles are gathered and counted against each row.
    """
    wanted = found.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("p", "n", "value"))).alias("_wanted"))
    x = F.col(col).cast("double")
    rows = same_group(df.where(x.isNotNull()).select(*by, x.alias("_x")), F.broadcast(wanted), by)  # a row a group
    rows = rows.select(*by, "_x", F.explode("_wanted").alias("_w"))
    low = F.count(F.when(F.col("_x") < F.col("value"), 1)) / F.col("n")
    high = F.count(F.when(F.col("_x") <= F.col("value"), 1)) / F.col("n")
    return rows.select(*by, "_x", "_w.*").groupBy(*by, "p", "n", "value").agg(
        F.greatest(F.lit(0.0), low - F.col("p"), F.col("p") - high).alias("rank_error"))

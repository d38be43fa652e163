"""Sampling, splitting, under-sampling and fold assignment.

* ``stratified_sample`` is Spark's ``sampleBy`` (Bernoulli per row; depends
  on seed and partitioning; labels not listed are dropped).
* ``stratified_sample_hash`` keeps a row when a hash of (seed, id) falls
  below the label's fraction: reproducible on any partitioning.
* ``stratum_rank`` gives every row its exact position within its label,
  in a seeded pseudo-random order (md5 of "seed:id", then id).  A plain
  ``row_number()`` over a label window would put a whole class — 99.7 % of
  the log — into one task.  Instead rows are bucketed by a hex prefix of the
  hash, bucket sizes are counted (partial aggregate), prefix sums over the
  buckets give each bucket's offset, and ``row_number`` runs per
  (label, bucket).  Positions are identical to the single-window form.
* Split bands, under-sampling and folds are arithmetic on that position.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickcast.operators.joins import join_small

# The seed, the seeds of the four samples, the sampling
# fractions per label, and the split (80/20, then 50/50 of the 20, then 90/10
# of the 80 → bands of the position within each label, percent upper bounds).
SEED = 16121993
SAMPLE_SEEDS = (16121993, 1, 2, 3)
SAMPLE_FRACTIONS = {1: 1.0, 0: 0.0080}
SPLIT_BANDS = (("train", 72), ("train_dev", 80), ("dev", 90), ("test", 100))

TWO_32 = 2 ** 32

#: Hex digits of a bucket of the seeded order: 4,096 buckets a label, so a label of a billion rows has some 250,000 in one.
PREFIX_HEX = 3


def stratified_sample(df: DataFrame, label_col: str, fractions: dict, seed: int = SEED) -> DataFrame:
    return df.sampleBy(label_col, fractions, seed)


def stratified_samples(df: DataFrame, label_col: str, fractions: dict,
                       seeds=SAMPLE_SEEDS) -> DataFrame:
    parts = [stratified_sample(df, label_col, fractions, s).withColumn("sample_id", F.lit(i + 1))
             for i, s in enumerate(seeds)]
    return reduce(DataFrame.unionByName, parts)


def seeded_hash(id_col: str, seed: int = SEED):
    """Lower-case md5 hex of "seed:id"."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def hash_unit(id_col: str, seed: int = SEED):
    """First 32 bits of the seeded hash as an integer in [0, 2^32)."""
    return F.conv(F.substring(seeded_hash(id_col, seed), 1, 8), 16, 10).cast("long")


def stratified_sample_hash(df: DataFrame, label_col: str, fractions: dict,
                           seed: int = SEED, id_col: str = "click_id") -> DataFrame:
    limit = None
    for value, frac in fractions.items():
        thr = F.lit(int(frac * TWO_32))
        limit = (F.when(F.col(label_col) == value, thr) if limit is None
                 else limit.when(F.col(label_col) == value, thr))
    return df.where(hash_unit(id_col, seed) < limit.otherwise(F.lit(0)))


def stratum_rank(df: DataFrame, label_col: str, seed: int = SEED, id_col: str = "click_id",
                 prefix_hex: int = PREFIX_HEX) -> DataFrame:
    """Adds ``_rn`` (1-based position within the label) and ``_n`` (label size),
    plus ``_nmin`` (size of the smallest label)."""
    h = seeded_hash(id_col, seed)
    # Null labels form their own stratum (equi-joins would drop them).
    stratum = F.coalesce(F.col(label_col).cast("string"), F.lit("<null>"))
    df = (df.withColumn("_s", stratum).withColumn("_h", h)
            .withColumn("_bucket", F.substring("_h", 1, prefix_hex)))
    sizes = df.groupBy("_s", "_bucket").count()
    per_label = Window.partitionBy("_s").orderBy("_bucket")  # ≤ 16^prefix rows per label
    sizes = sizes.select(
        "_s", "_bucket",
        F.coalesce(F.sum("count").over(
            per_label.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("count").over(Window.partitionBy("_s")).alias("_n"))
    totals = sizes.groupBy("_s").agg(F.first("_n").alias("_n"))
    # One row per label: an unpartitioned window over it is tiny.
    nmin = totals.select("_s", F.min("_n").over(Window.partitionBy()).alias("_nmin"))
    offsets = sizes.join(nmin, on="_s", how="inner")
    ranked = join_small(df, offsets, on=["_s", "_bucket"], max_rows=200_000)
    # The bucket first: Spark sorts by the first column's leading bytes, which are one for all rows of a label.
    w = Window.partitionBy("_bucket", "_s").orderBy("_h", id_col)
    return (ranked.withColumn("_rn", F.col("_before") + F.row_number().over(w))
                  .drop("_s", "_h", "_bucket", "_before"))


def stratified_split(df: DataFrame, label_col: str = "is_attributed", seed: int = SEED,
                     id_col: str = "click_id", bands=SPLIT_BANDS, position: str | None = None) -> DataFrame:
    """``split`` column: exact per-label shares (train 72 %, train_dev 8 %,
    dev 10 %, test 10 %).  ``position`` names a column for the position within the label;
    the rows of the first split are the first positions, without gaps."""
    r = stratum_rank(df, label_col, seed, id_col)
    expr = None
    for name, pct in bands[:-1]:
        cond = F.col("_rn") * 100 <= F.col("_n") * pct
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    out = r.withColumn("split", expr.otherwise(bands[-1][0]))
    return (out.withColumnRenamed("_rn", position) if position else out.drop("_rn")).drop("_n", "_nmin")


def undersample(df: DataFrame, label_col: str = "is_attributed", seed: int = SEED,
                id_col: str = "click_id") -> DataFrame:
    """Keep as many rows of each label as the smallest label has."""
    r = stratum_rank(df, label_col, seed, id_col)
    return r.where(F.col("_rn") <= F.col("_nmin")).drop("_rn", "_n", "_nmin")


def stratified_folds(df: DataFrame, k: int = 5, label_col: str = "is_attributed",
                     seed: int = SEED, id_col: str = "click_id") -> DataFrame:
    """``fold`` in 0..k-1, dealt round-robin along each label's order."""
    r = stratum_rank(df, label_col, seed, id_col)
    return r.withColumn("fold", F.pmod(F.col("_rn") - 1, F.lit(k)).cast("int")).drop(
        "_rn", "_n", "_nmin")


def undersampled_folds(ranked: DataFrame, position: str, k: int = 5, label_col: str = "is_attributed") -> DataFrame:
    """The folds of the under-sampled rows.

    ``position`` numbers the rows of each label from 1 in the seeded order, so under-sampling keeps the first of them
    and deals folds along them; it is not in the result.
    """
    sizes = ranked.groupBy(label_col).count().agg(F.min("count")).first()[0] or 0
    return ranked.where(F.col(position) <= sizes).withColumn(
        "fold", F.pmod(F.col(position) - 1, F.lit(k)).cast("int")).drop(position)

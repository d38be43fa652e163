"""Evaluation of scores and predictions: ROC, AUC, cut-off, confusion
matrix, classification report, per-fold metrics.

ROC and AUC need running totals over the score order.  An unpartitioned
window would run in one task, so ``running_totals`` first aggregates to one
row per distinct score, cuts the score range at approximate quantiles into
ranges of about ``BUCKET_ROWS`` distinct scores, takes prefix sums of
the per-range totals, and finishes with a window per range.  The totals are
exact; only the work split depends on the approximation.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickcast.operators.joins import join_small
from clickcast.session import materialised

LABEL = "is_attributed"
BUCKET_ROWS = 100_000  # distinct scores that one window task is to hold


def running_totals(df: DataFrame, score: str, sums: dict, by=(), descending: bool = False,
                   n_buckets: int | None = None) -> DataFrame:
    """One row per (by…, score) with the given sums and their running totals
    ``cum_<name>`` (rows with a lower score first, or higher with
    ``descending``; the current score included)."""
    key = F.col(score).cast("double")
    ordered = -key if descending else key
    # One row per distinct score, written once: the cut points and the totals both read it.
    distinct = materialised(df.withColumn("_o", ordered).where(F.col("_o").isNotNull())
                              .groupBy(*by, "_o").agg(*[e.alias(n) for n, e in sums.items()]), "distinct-scores")
    if n_buckets is None:
        n_buckets = distinct.count() // BUCKET_ROWS + 1
    cuts = [] if n_buckets == 1 else distinct.agg(F.percentile_approx(
        "_o", [i / n_buckets for i in range(1, n_buckets)], max(10_000, 10 * n_buckets)).alias("q")).first()["q"]
    inner = sorted(set(cuts or [])) or [0.0]  # Bucketizer needs at least one inner split
    splits = [float("-inf")] + inner + [float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="_o", outputCol="_b").transform(distinct)
    per_bucket = bucketed.groupBy(*by, "_b").agg(*[F.sum(n).alias(f"_bt_{n}") for n in sums])
    wb = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(*by, "_b", *[
        F.coalesce(F.sum(f"_bt_{n}").over(wb), F.lit(0)).alias(f"_off_{n}") for n in sums])
    # Without groups the offsets have at most n_buckets rows: a proven bound.
    joined = (bucketed.join(F.broadcast(offsets), on=[*by, "_b"]) if not by
              else join_small(bucketed, offsets, on=[*by, "_b"]))
    wr = Window.partitionBy(*by, "_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    out = joined.select(*by, "_o", *sums.keys(), *[
        (F.col(f"_off_{n}") + F.sum(n).over(wr)).alias(f"cum_{n}") for n in sums])
    return out.withColumn(score, -F.col("_o") if descending else F.col("_o")).drop("_o")


def _pos_neg(label: str):
    return {"pos": F.count(F.when(F.col(label) == 1, 1)),
            "neg": F.count(F.when(F.col(label) == 0, 1))}


def roc_curve(df: DataFrame, score: str = "score", label: str = LABEL, by=()) -> DataFrame:
    """One point per distinct score (threshold): tpr, fpr of ``score >= threshold``."""
    rt = running_totals(df, score, _pos_neg(label), by=by, descending=True)
    totals = rt.groupBy(*by).agg(*[F.sum(n).alias(f"_tot_{n}") for n in ("pos", "neg")])
    if by:
        rt = join_small(rt, totals, on=list(by))
    else:  # one row of two counts
        row = totals.first()
        rt = rt.withColumns({"_tot_pos": F.lit(row["_tot_pos"]), "_tot_neg": F.lit(row["_tot_neg"])})
    return rt.select(*by, F.col(score).alias("threshold"),
                     (F.col("cum_pos") / F.col("_tot_pos")).alias("tpr"),
                     (F.col("cum_neg") / F.col("_tot_neg")).alias("fpr"))


def roc_auc(df: DataFrame, score: str = "score", label: str = LABEL, by=()) -> DataFrame:
    """Area under the ROC curve (Mann–Whitney with ties counted half),
    computed with exact integer sums."""
    rt = running_totals(df, score, _pos_neg(label), by=by)
    dec = "decimal(38,0)"
    below = (F.col("cum_neg") - F.col("neg")).cast(dec)
    g = rt.groupBy(*by).agg(
        F.sum(F.col("pos").cast(dec) * below * 2 + F.col("pos").cast(dec) * F.col("neg").cast(dec))
         .alias("_num"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return g.select(*by, (F.col("_num").cast("double") /
                          (F.col("_p").cast(dec) * F.col("_n").cast(dec) * 2).cast("double"))
                    .alias("roc_auc"))


def best_cutoff(roc: DataFrame) -> DataFrame:
    """The threshold whose tpr is closest to 1 - fpr (ties: higher threshold)."""
    return (roc.withColumn("tf", F.col("tpr") - (F.lit(1) - F.col("fpr")))
               .orderBy(F.abs("tf"), F.col("threshold").desc()).limit(1))


def apply_cutoff(df: DataFrame, cutoff: float, score: str = "score",
                 out: str = "predicted") -> DataFrame:
    """1 when the score is strictly above the cut-off."""
    return df.withColumn(out, F.when(F.col(score) > F.lit(cutoff), 1).otherwise(0))


def _as_text(c: str):
    return F.when(F.col(c) == 1, "1").otherwise("0")


def confusion_matrix(df: DataFrame, actual: str = LABEL, predicted: str = "predicted") -> DataFrame:
    """Counts by (actual, predicted) with 'All' margins (a cube)."""
    t = df.select(_as_text(actual).alias("actual"), _as_text(predicted).alias("predicted"))
    return (t.cube("actual", "predicted").count()
             .select(F.coalesce("actual", F.lit("All")).alias("actual"),
                     F.coalesce("predicted", F.lit("All")).alias("predicted"), "count"))


def _counts(df: DataFrame, actual: str, predicted: str, by=()) -> DataFrame:
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    return df.groupBy(*by).agg(
        F.count(F.when(a & p, 1)).alias("tp"), F.count(F.when(~a & p, 1)).alias("fp"),
        F.count(F.when(a & ~p, 1)).alias("fn"), F.count(F.when(~a & ~p, 1)).alias("tn"))


def _ratio(num, den):
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def _f1(p, r):
    return F.when((p + r) > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def classification_report(df: DataFrame, actual: str = LABEL,
                          predicted: str = "predicted") -> DataFrame:
    """precision / recall / f1 / support per class, accuracy, macro and
    weighted averages (long form)."""
    c = _counts(df, actual, predicted)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    p1, r1 = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    p0, r0 = _ratio(tn, tn + fn), _ratio(tn, tn + fp)
    f1, f0 = _f1(p1, r1), _f1(p0, r0)
    s1, s0 = tp + fn, tn + fp
    def row(cls, p, r, f, sup):
        return F.struct(F.lit(cls).alias("class"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1"),
                        sup.cast("long").alias("support"))

    none = F.lit(None)
    rows = F.array(
        row("0", p0, r0, f0, s0),
        row("1", p1, r1, f1, s1),
        row("accuracy", none, none, _ratio(tp + tn, n), n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", _ratio(p0 * s0 + p1 * s1, n), _ratio(r0 * s0 + r1 * s1, n),
            _ratio(f0 * s0 + f1 * s1, n), n))
    return c.select(F.explode(rows).alias("r")).select("r.*")


def fold_metrics(df: DataFrame, fold: str = "fold", score: str = "score", actual: str = LABEL,
                 predicted: str = "predicted") -> DataFrame:
    """Per fold: roc_auc, accuracy, precision, recall, f1 of the positive class."""
    c = _counts(df, actual, predicted, by=[fold])
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    m = c.select(fold, _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                 p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"))
    auc = roc_auc(df, score, actual, by=[fold])
    return m.join(auc, on=fold, how="inner")


METRICS = ("roc_auc", "accuracy", "f1", "precision", "recall")


def fold_metrics_summary(per_fold: DataFrame) -> DataFrame:
    """Mean and population standard deviation over folds, per metric."""
    long = per_fold.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS]))
        .alias("r")).select("r.*")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"),
                                      F.stddev_pop("value").alias("std"))

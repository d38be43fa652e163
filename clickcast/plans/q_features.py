"""Queries: sampling and splitting, feature preparation, evaluation, models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clickcast.operators import boosting as bo
from clickcast.operators import evaluate as ev
from clickcast.operators import explore as ex
from clickcast.operators import features as fe
from clickcast.operators import forest as fo
from clickcast.operators import model_store as ms
from clickcast.operators import sampling as sa
from clickcast.operators import scores as sc
from clickcast.plans import scoring, training
from clickcast.plans.catalog import register
from clickcast.plans.q_sequence import TRAINING_SQL, _scoring_sql
from clickcast.plans.sqlbits import TIME_FEATURES, score_cols, score_joins, scores, sequence
from clickcast.session import materialised
from clickcast.sources.clicks import clicks_from_events

SEED = sa.SEED
FRACTIONS = sa.SAMPLE_FRACTIONS
SCORES = ("device_custom_score", "os_custom_score", "app_custom_score", "channel_custom_score")
NUMERIC = fe.NUMERIC_COLS


def _features(spark, sf):
    return training.training_features(clicks_from_events(spark, sf))


def _extract(spark, sf):
    return training.modelling_extract(_features(spark, sf), keep_id=True)


# ---------------------------------------------------------------- sampling

@register("stratified_sample")
def stratified_sample(spark, sf):
    """sampleBy: every conversion, 0.8 % of the other clicks."""
    return sa.stratified_sample(_extract(spark, sf), "is_attributed", FRACTIONS, SEED)


@register("stratified_samples_multi")
def stratified_samples_multi(spark, sf):
    return sa.stratified_samples(_extract(spark, sf), "is_attributed", FRACTIONS)


def _hash_sql(seed=SEED):
    return f"('0x' || substr(md5('{seed}:' || CAST(click_id AS VARCHAR)), 1, 8))::BIGINT"


@register("stratified_sample_hash", f"""
SELECT click_id, ip, is_attributed FROM clicks
WHERE {_hash_sql()} < CASE WHEN is_attributed = 1 THEN {int(FRACTIONS[1] * sa.TWO_32)}
                           WHEN is_attributed = 0 THEN {int(FRACTIONS[0] * sa.TWO_32)}
                           ELSE 0 END""")
def stratified_sample_hash(spark, sf):
    c = clicks_from_events(spark, sf)
    return sa.stratified_sample_hash(c, "is_attributed", FRACTIONS).select(
        "click_id", "ip", "is_attributed")


def _rank_sql(src: str, name: str = "ranked") -> str:
    return f""", {name} AS (
  SELECT *, row_number() OVER (PARTITION BY is_attributed
                               ORDER BY md5('{SEED}:' || CAST(click_id AS VARCHAR)), click_id) AS rn,
         count(*) OVER (PARTITION BY is_attributed) AS n
  FROM {src})"""


SPLIT_CASE = ("CASE WHEN rn * 100 <= n * 72 THEN 'train' WHEN rn * 100 <= n * 80 THEN 'train_dev' "
              "WHEN rn * 100 <= n * 90 THEN 'dev' ELSE 'test' END")


@register("stratified_split", _rank_sql("clicks") +
          f"\nSELECT click_id, is_attributed, {SPLIT_CASE} AS split FROM ranked")
def stratified_split(spark, sf):
    return sa.stratified_split(clicks_from_events(spark, sf)).select(
        "click_id", "is_attributed", "split")


@register("class_balance_by_split", _rank_sql("clicks") + f"""
, s AS (SELECT is_attributed, {SPLIT_CASE} AS split FROM ranked)
SELECT split, is_attributed, count, count * 100 / sum(count) OVER (PARTITION BY split) AS pct
FROM (SELECT split, is_attributed, count(*) AS count FROM s GROUP BY ALL) g""")
def class_balance_by_split(spark, sf):
    """Clicks per label within each split, and their share of the split."""
    split = sa.stratified_split(clicks_from_events(spark, sf))
    counts = split.groupBy("split", "is_attributed").count()
    # At most (splits × labels) rows: a window per split over them is tiny.
    share = F.col("count") * 100 / F.sum("count").over(Window.partitionBy("split"))
    return counts.select("split", "is_attributed", "count", share.alias("pct"))


@register("undersample", _rank_sql("clicks") + """
SELECT click_id, is_attributed FROM ranked
WHERE rn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM clicks GROUP BY is_attributed) t)""")
def undersample(spark, sf):
    return sa.undersample(clicks_from_events(spark, sf)).select("click_id", "is_attributed")


@register("stratified_folds", _rank_sql("clicks") +
          "\nSELECT click_id, is_attributed, CAST((rn - 1) % 5 AS INTEGER) AS fold FROM ranked")
def stratified_folds(spark, sf):
    return sa.stratified_folds(clicks_from_events(spark, sf)).select(
        "click_id", "is_attributed", "fold")


@register("training_features_train_fitted", _rank_sql("clicks") + f"""
, trainc AS (SELECT * FROM ranked WHERE {SPLIT_CASE} = 'train')""" + TIME_FEATURES +
          sequence() + scores("trainc") + f"""
SELECT seq.click_id, seq.ip, seq.app, seq.device, seq.os, seq.channel, seq.click_time,
       seq.click_time_wday, seq.attributed_time, seq.attributed_time_wday, seq.is_attributed,
       seq.click_time_hour, seq.n_previous_clicks, seq.click_time_diff, {score_cols()}
FROM seq
{score_joins('seq')}""")
def training_features_train_fitted(spark, sf):
    """Scores fitted on the train split only, applied to every click (no
    target leakage into train_dev / dev / test)."""
    clicks = clicks_from_events(spark, sf)
    train = sa.stratified_split(clicks).where(F.col("split") == "train")
    return training.training_features(clicks, scores=sc.score_tables(train))


# ---------------------------------------------------------------- feature preparation

HOUR_FLAGS_SQL = ", ".join(f"CAST(coalesce(CAST(click_time_hour AS INTEGER) = {h}, false) AS INTEGER)"
                           f" AS hour_{h}" for h in fe.HOURS)


@register("one_hot_hour", TIME_FEATURES +
          f"\nSELECT click_id, {HOUR_FLAGS_SQL} FROM tf")
def one_hot_hour(spark, sf):
    tf = training.time_features(clicks_from_events(spark, sf))
    return fe.one_hot_hour(tf).select("click_id", *fe.HOUR_FLAG_COLS)


def _scale_sql(src: str, cols=NUMERIC, zero: bool = False) -> str:
    lo = {c: (f"least(min({c}), 0)" if zero else f"min({c})") for c in cols}
    hi = {c: (f"greatest(max({c}), 0)" if zero else f"max({c})") for c in cols}
    bounds = ", ".join(f"CAST({lo[c]} AS DOUBLE) AS lo_{c}, CAST({hi[c]} AS DOUBLE) AS hi_{c}"
                       for c in cols)
    scaled = ", ".join(
        f"CASE WHEN {c} IS NULL THEN NULL WHEN hi_{c} = lo_{c} THEN 0.0 "
        f"ELSE (CAST({c} AS DOUBLE) - lo_{c}) / (hi_{c} - lo_{c}) END AS {c}" for c in cols)
    return f""", bounds AS (SELECT {bounds} FROM {src})
, scaled AS (SELECT {src}.* EXCLUDE ({', '.join(cols)}), {scaled} FROM {src}, bounds)"""


@register("min_max_scale", TRAINING_SQL + _scale_sql("features") +
          f"\nSELECT click_id, {', '.join(NUMERIC)} FROM scaled")
def min_max_scale(spark, sf):
    return fe.min_max_scale(_features(spark, sf), NUMERIC).select("click_id", *NUMERIC)


@register("model_matrix", TRAINING_SQL + _scale_sql("features") +
          f"\nSELECT click_id, {', '.join(NUMERIC)}, {HOUR_FLAGS_SQL} FROM scaled")
def model_matrix(spark, sf):
    return fe.model_matrix(_extract(spark, sf))


def _scoring_features(spark, sf):
    clicks = clicks_from_events(spark, sf)
    lookups = scoring.score_lookup_tables(sc.score_tables(clicks), as_text_keys=True)
    return scoring.scoring_features(clicks, lookups)


SCORING_FEATURES_SQL = _scoring_sql("JOIN", False).replace("\nSELECT ", "\n, sfeat AS (SELECT ", 1) + ")"
FILLED_SQL = SCORING_FEATURES_SQL + ", filled AS (SELECT sfeat.* EXCLUDE ({0}), {1} FROM sfeat)".format(
    ", ".join(NUMERIC), ", ".join(f"coalesce({c}, 0) AS {c}" for c in NUMERIC))


@register("scale_with_zero_baseline", FILLED_SQL + _scale_sql("filled", zero=True) +
          f"\nSELECT click_id, {', '.join(NUMERIC)} FROM scaled")
def scale_with_zero_baseline(spark, sf):
    filled = _scoring_features(spark, sf).na.fill(0, subset=list(NUMERIC))
    return fe.min_max_scale(filled, NUMERIC, zero_baseline=True).select("click_id", *NUMERIC)


@register("scoring_matrix", FILLED_SQL + _scale_sql("filled", zero=True) +
          f"\nSELECT click_id, {', '.join(NUMERIC)}, {HOUR_FLAGS_SQL} FROM scaled")
def scoring_matrix(spark, sf):
    return fe.scoring_matrix(_scoring_features(spark, sf))


@register("assembled_features")
def assembled_features(spark, sf):
    return fe.assemble(fe.model_matrix(_extract(spark, sf)), fo.FEATURE_COLS).select(
        "click_id", "features")


# ---------------------------------------------------------------- profiles of the extract

PROFILE_COLS = ("click_time_wday", "is_attributed", "click_time_hour", "n_previous_clicks",
                "click_time_diff") + SCORES


def _profile_sql() -> str:
    numeric = {"is_attributed", "n_previous_clicks", "click_time_diff", *SCORES}
    union = "\n  UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS text, "
        f"{'CAST(' + c + ' AS DOUBLE)' if c in numeric else 'CAST(NULL AS DOUBLE)'} AS num "
        f"FROM features" for c in PROFILE_COLS)
    return TRAINING_SQL + f""", long AS ({union})
, stats AS (
  SELECT feature, count(text) AS n, count(DISTINCT text) AS n_distinct,
         round(avg(num), 9) AS mean, round(stddev_samp(num), 6) AS std, min(num) AS min,
         round(quantile_cont(num, 0.25), 9) AS p25, round(quantile_cont(num, 0.5), 9) AS p50,
         round(quantile_cont(num, 0.75), 9) AS p75, max(num) AS max
  FROM long GROUP BY feature)
, freq AS (SELECT feature, text, count(*) AS c FROM long WHERE text IS NOT NULL GROUP BY ALL)
, top AS (SELECT feature, arg_min(text, (-c, text)) AS top, max(c) AS freq FROM freq GROUP BY feature)
SELECT stats.*, top.top, top.freq FROM stats LEFT JOIN top USING (feature)"""


@register("profile_features", _profile_sql())
def profile_features(spark, sf):
    p = ex.profile(training.modelling_extract(_features(spark, sf)), list(PROFILE_COLS))
    return p.withColumns({"mean": F.round("mean", 9), "std": F.round("std", 6),
                          "p25": F.round("p25", 9), "p50": F.round("p50", 9),
                          "p75": F.round("p75", 9)})


def _corr_sql(cols) -> str:
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    return TRAINING_SQL + "\n" + "\nUNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM features"
        for a, b in pairs)


CORR_COLS = SCORES + ("is_attributed",)


@register("correlation_pairs", _corr_sql(CORR_COLS))
def correlation_pairs(spark, sf):
    c = ex.correlation_pairs(_features(spark, sf), list(CORR_COLS))
    return c.withColumn("corr", F.round("corr", 6))


def _box_sql() -> str:
    union = "\n  UNION ALL ".join(
        f"SELECT '{c}' AS feature, is_attributed, {c} AS x FROM features" for c in SCORES)
    fence = "x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
    return TRAINING_SQL + f""", long AS ({union})
, q AS (SELECT feature, is_attributed, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
               quantile_cont(x, 0.75) AS q3 FROM long GROUP BY ALL)
SELECT feature, is_attributed, q1, median, q3,
       min(x) FILTER (WHERE {fence}) AS lower_whisker, max(x) FILTER (WHERE {fence}) AS upper_whisker,
       count(*) FILTER (WHERE NOT {fence}) AS n_outliers
FROM long JOIN q USING (feature, is_attributed) GROUP BY feature, is_attributed, q1, median, q3"""


@register("box_stats_by_label", _box_sql())
def box_stats_by_label(spark, sf):
    long = ex.unpivot(_features(spark, sf), list(SCORES), keep=("is_attributed",),
                      name="feature", value="x")
    return ex.box_stats(long, "x", by=["feature", "is_attributed"])


# ---------------------------------------------------------------- evaluation

SCORE_EXPR = " + ".join(SCORES)
SCORED_SQL = TRAINING_SQL + f", scored AS (SELECT *, {SCORE_EXPR} AS score FROM features)"
ROC_SQL = SCORED_SQL + """
, per_score AS (SELECT score, count(*) FILTER (WHERE is_attributed = 1) AS pos,
                       count(*) FILTER (WHERE is_attributed = 0) AS neg
                FROM scored WHERE score IS NOT NULL GROUP BY score)
, roc AS (
  SELECT score AS threshold,
         sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           / (SELECT sum(pos) FROM per_score) AS tpr,
         sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           / (SELECT sum(neg) FROM per_score) AS fpr
  FROM per_score)
, best AS (SELECT threshold, tpr, fpr, tpr - (1 - fpr) AS tf FROM roc
           ORDER BY abs(tpr - (1 - fpr)), threshold DESC LIMIT 1)
, predicted AS (SELECT *, CASE WHEN score > (SELECT threshold FROM best) THEN 1 ELSE 0 END
                          AS predicted FROM scored)"""


def _scored(spark, sf):
    f = _features(spark, sf)
    s = F.col(SCORES[0])
    for c in SCORES[1:]:
        s = s + F.col(c)
    # Written once: the cut-off, the predictions and every metric read it.
    return materialised(f.select("click_id", "is_attributed", s.alias("score")), "scored")


def _predicted(scored):
    roc = ev.roc_curve(scored)
    cutoff = ev.best_cutoff(roc).first()["threshold"]
    return ev.apply_cutoff(scored, cutoff)


@register("roc_curve", ROC_SQL + "\nSELECT * FROM roc")
def roc_curve(spark, sf):
    return ev.roc_curve(_scored(spark, sf))


AUC_SQL = """
SELECT CAST(sum(CAST(pos AS HUGEINT) * coalesce(below, 0) * 2 + CAST(pos AS HUGEINT) * neg) AS DOUBLE)
       / CAST(CAST(sum(pos) AS HUGEINT) * sum(neg) * 2 AS DOUBLE) AS roc_auc
FROM (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                AS below FROM per_score) t"""


@register("roc_auc", ROC_SQL + AUC_SQL)
def roc_auc(spark, sf):
    return ev.roc_auc(_scored(spark, sf))


@register("best_cutoff", ROC_SQL + "\nSELECT * FROM best")
def best_cutoff(spark, sf):
    return ev.best_cutoff(ev.roc_curve(_scored(spark, sf)))


@register("apply_cutoff", ROC_SQL + "\nSELECT click_id, score, predicted FROM predicted")
def apply_cutoff(spark, sf):
    return _predicted(_scored(spark, sf)).select("click_id", "score", "predicted")


@register("confusion_matrix", ROC_SQL + """
SELECT coalesce(actual, 'All') AS actual, coalesce(pred, 'All') AS predicted, count(*) AS count
FROM (SELECT CASE WHEN is_attributed = 1 THEN '1' ELSE '0' END AS actual,
             CASE WHEN predicted = 1 THEN '1' ELSE '0' END AS pred FROM predicted) t
GROUP BY CUBE (actual, pred)""")
def confusion_matrix(spark, sf):
    return ev.confusion_matrix(_predicted(_scored(spark, sf)))


def _report_sql(src: str) -> str:
    return f"""
, cnt AS (SELECT count(*) FILTER (WHERE is_attributed = 1 AND predicted = 1) AS tp,
                 count(*) FILTER (WHERE is_attributed <> 1 AND predicted = 1) AS fp,
                 count(*) FILTER (WHERE is_attributed = 1 AND predicted <> 1) AS fn,
                 count(*) FILTER (WHERE is_attributed <> 1 AND predicted <> 1) AS tn FROM {src})
, m AS (SELECT *, tp + fp + fn + tn AS n, tp + fn AS s1, tn + fp AS s0,
               CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p1,
               CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r1,
               CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0.0 END AS p0,
               CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS r0 FROM cnt)
, m2 AS (SELECT *, CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END AS f1,
                   CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0.0 END AS f0 FROM m)
, report AS (
  SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM m2
  UNION ALL SELECT '1', p1, r1, f1, s1 FROM m2
  UNION ALL SELECT 'accuracy', NULL, NULL, CASE WHEN n > 0 THEN (tp + tn) / n ELSE 0.0 END, n FROM m2
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM m2
  UNION ALL SELECT 'weighted avg',
    CASE WHEN n > 0 THEN (p0 * s0 + p1 * s1) / n ELSE 0.0 END,
    CASE WHEN n > 0 THEN (r0 * s0 + r1 * s1) / n ELSE 0.0 END,
    CASE WHEN n > 0 THEN (f0 * s0 + f1 * s1) / n ELSE 0.0 END, n FROM m2)"""


@register("classification_report", ROC_SQL + _report_sql("predicted") + "\nSELECT * FROM report")
def classification_report(spark, sf):
    return ev.classification_report(_predicted(_scored(spark, sf)))


FOLDS_SQL = ROC_SQL + _rank_sql("predicted", "pranked") + """
, folded AS (SELECT *, CAST((rn - 1) % 5 AS INTEGER) AS fold FROM pranked)
, fcnt AS (SELECT fold, count(*) FILTER (WHERE is_attributed = 1 AND predicted = 1) AS tp,
                  count(*) FILTER (WHERE is_attributed <> 1 AND predicted = 1) AS fp,
                  count(*) FILTER (WHERE is_attributed = 1 AND predicted <> 1) AS fn,
                  count(*) FILTER (WHERE is_attributed <> 1 AND predicted <> 1) AS tn
           FROM folded GROUP BY fold)
, fm AS (SELECT fold, CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 0.0 END
                AS accuracy,
                CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
                CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM fcnt)
, fps AS (SELECT fold, score, count(*) FILTER (WHERE is_attributed = 1) AS pos,
                 count(*) FILTER (WHERE is_attributed = 0) AS neg
          FROM folded WHERE score IS NOT NULL GROUP BY fold, score)
, fauc AS (SELECT fold,
             CAST(sum(CAST(pos AS HUGEINT) * coalesce(below, 0) * 2 + CAST(pos AS HUGEINT) * neg) AS DOUBLE)
             / CAST(CAST(sum(pos) AS HUGEINT) * sum(neg) * 2 AS DOUBLE) AS roc_auc
           FROM (SELECT *, sum(neg) OVER (PARTITION BY fold ORDER BY score
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
                 FROM fps) t GROUP BY fold)
, per_fold AS (
  SELECT fold, accuracy, precision, recall,
         CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
              ELSE 0.0 END AS f1, roc_auc
  FROM fm JOIN fauc USING (fold))"""


def _per_fold(spark, sf):
    folded = sa.stratified_folds(_predicted(_scored(spark, sf)))
    return ev.fold_metrics(folded)


@register("fold_metrics", FOLDS_SQL + "\nSELECT * FROM per_fold")
def fold_metrics(spark, sf):
    return _per_fold(spark, sf)


@register("fold_metrics_summary", FOLDS_SQL + """
SELECT metric, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS std
FROM (UNPIVOT per_fold ON roc_auc, accuracy, f1, precision, recall INTO NAME metric VALUE value) u
GROUP BY metric""")
def fold_metrics_summary(spark, sf):
    s = ev.fold_metrics_summary(_per_fold(spark, sf))
    return s.withColumn("mean", F.round("mean", 9)).withColumn("std", F.round("std", 9))


EVAL_SQL = ROC_SQL + _rank_sql("predicted", "dranked") + f"""
, dev AS (SELECT * FROM dranked WHERE {SPLIT_CASE} = 'dev')""" + _report_sql("dev") + """
, dps AS (SELECT score, count(*) FILTER (WHERE is_attributed = 1) AS pos,
                 count(*) FILTER (WHERE is_attributed = 0) AS neg
          FROM dev WHERE score IS NOT NULL GROUP BY score)
, dauc AS (SELECT CAST(sum(CAST(pos AS HUGEINT) * coalesce(below, 0) * 2 + CAST(pos AS HUGEINT) * neg)
                       AS DOUBLE) / CAST(CAST(sum(pos) AS HUGEINT) * sum(neg) * 2 AS DOUBLE) AS v
           FROM (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING
                                           AND 1 PRECEDING) AS below FROM dps) t)
SELECT 'accuracy' AS metric, f1 AS value FROM report WHERE class = 'accuracy'
UNION ALL SELECT 'precision', precision FROM report WHERE class = '1'
UNION ALL SELECT 'recall', recall FROM report WHERE class = '1'
UNION ALL SELECT 'f1', f1 FROM report WHERE class = '1'
UNION ALL SELECT 'support', CAST(support AS DOUBLE) FROM report WHERE class = 'accuracy'
UNION ALL SELECT 'roc_auc', v FROM dauc"""


@register("evaluation_report", EVAL_SQL)
def evaluation_report(spark, sf):
    """Hold-out report on the dev split: accuracy, positive-class precision,
    recall and f1, support and ROC AUC (long form)."""
    pred = _predicted(_scored(spark, sf))
    dev = sa.stratified_split(pred).where(F.col("split") == "dev")
    rep = ev.classification_report(dev)

    def lines(*names):
        return F.array(*[F.struct(F.lit(name).alias("metric"), F.col(c).cast("double").alias("value"))
                         for name, c in names])

    picked = F.when(F.col("class") == "accuracy", lines(("accuracy", "f1"), ("support", "support"))).when(
        F.col("class") == "1", lines(("precision", "precision"), ("recall", "recall"), ("f1", "f1")))
    return rep.select(F.inline(picked)).unionByName(
        ev.roc_auc(dev).select(F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value")))


# ---------------------------------------------------------------- models

def _made_from(spark, sf):
    """The signature of the log."""
    return ms.signature(clicks_from_events(spark, sf))


def _train_dev(spark, sf, made_from):
    """The under-sampled, folded training rows and the dev rows; made once for a log."""

    def split():
        # Read for the bounds, the sizes and the split.  Flags are set after the split, which then moves narrow rows.
        extract = materialised(_extract(spark, sf), "extract")
        return fe.hour_flags(sa.stratified_split(fe.min_max_scale(extract, NUMERIC), position="position"),
                             ("click_id", "is_attributed"), more=("split", "position"))

    rows = ms.stored_table(spark, "split", {"bands": sa.SPLIT_BANDS, "seed": sa.SEED}, made_from, split)
    train = ms.stored_table(spark, "train", {"bands": sa.SPLIT_BANDS, "seed": sa.SEED}, made_from,
                            lambda: sa.undersampled_folds(rows.where(F.col("split") == "train"), "position"))
    return train, rows.where(F.col("split") == "dev").drop("position")


def _forest_scores(spark, sf, made_from):
    """Out-of-fold scores of all grid points and which points share them; the 15 forests are grown once for a log."""

    def make(folder):
        scores, same = fo.out_of_fold_variants(_train_dev(spark, sf, made_from)[0], fo.GRID, folder)
        same.coalesce(1).write.parquet(f"{folder}/same")

    return ms.stored(spark, "forest-variants", fo.GRID, made_from, make,
                     lambda folder: (spark.read.parquet(f"{folder}/scores-*"), spark.read.parquet(f"{folder}/same")))


def _forest_metrics(spark, sf, made_from):
    def make():
        scores, same = _forest_scores(spark, sf, made_from)
        return fo.grid_metrics(scores, fo.GRID, same)

    return ms.stored_table(spark, "forest-metrics", fo.GRID, made_from, make)


def _best(metrics):
    """Number of the best grid point, the first among equals."""
    return metrics.orderBy(F.col("roc_auc").desc(), "point").first()["point"]


def _best_forest(spark, sf):
    """The best point's forest, grown on all training rows once for a log; and the dev rows."""
    made_from = _made_from(spark, sf)
    train, dev = _train_dev(spark, sf, made_from)
    point = fo.grid_points(fo.GRID)[_best(_forest_metrics(spark, sf, made_from))]
    model = ms.stored(spark, "forest", point, made_from, lambda folder: fo.CutForest.fit(train, point, folder),
                      lambda folder: fo.CutForest(spark, folder))
    return model, dev


def _fold_table(scored):
    """roc_auc, accuracy, f1, precision and recall per fold, and their mean and population std."""
    per_fold = materialised(ev.fold_metrics(scored.withColumn("predicted", (F.col("score") > 0.5).cast("int"))), "fold-metrics")
    summary = ev.fold_metrics_summary(per_fold)
    return (per_fold.select(F.col("fold").cast("string").alias("fold"), *ev.METRICS)
            .unionByName(summary.groupBy().pivot("metric", list(ev.METRICS)).agg(F.first("mean"))
                         .select(F.lit("mean").alias("fold"), *ev.METRICS))
            .unionByName(summary.groupBy().pivot("metric", list(ev.METRICS)).agg(F.first("std"))
                         .select(F.lit("std").alias("fold"), *ev.METRICS)))


@register("rf_grid_search")
def rf_grid_search(spark, sf):
    """All 27 points of the forest grid: parameters, mean and deviation of the folds' ROC AUC."""
    return _forest_metrics(spark, sf, _made_from(spark, sf)).drop("point")


@register("rf_predictions")
def rf_predictions(spark, sf):
    model, dev = _best_forest(spark, sf)
    return model.predict(dev)


@register("rf_fold_metrics")
def rf_fold_metrics(spark, sf):
    """Fold metrics of the best forest's parameters: the search has grown these very forests already."""
    made_from = _made_from(spark, sf)
    best = _best(_forest_metrics(spark, sf, made_from))
    scores, same = _forest_scores(spark, sf, made_from)
    return _fold_table(fo.every_point(scores, same.where(F.col("point") == best)))


@register("feature_importances")
def feature_importances(spark, sf):
    model, _ = _best_forest(spark, sf)
    return model.importances()


@register("submission")
def submission(spark, sf):
    """Scoring log → features → matrix → forest → (click_id, is_attributed)."""
    model, _ = _best_forest(spark, sf)
    # Read for the bounds and for the matrix.
    scoring_rows = _scoring_features(spark, sf).select("click_id", *NUMERIC, "click_time_hour")
    matrix = fe.scoring_matrix(materialised(scoring_rows, "scoring"))
    return model.predict(matrix).select("click_id", F.col("predicted").alias("is_attributed"))


def _boosted_scores(spark, sf):
    """Out-of-fold scores of every point of the boosted grid, made once for a log."""
    made_from = _made_from(spark, sf)
    train, _ = _train_dev(spark, sf, made_from)
    return ms.stored_table(spark, "boosted-scores", {**bo.GRID, "rows": "all"}, made_from,
                           lambda: bo.out_of_fold_scores(train, bo.GRID))


def _boosted_metrics(spark, sf):
    return bo.grid_metrics(_boosted_scores(spark, sf), bo.GRID)


def _best_boosted(spark, sf):
    made_from = _made_from(spark, sf)
    train, dev = _train_dev(spark, sf, made_from)
    point = bo.grid_points(bo.GRID)[_best(_boosted_metrics(spark, sf))]
    return ms.stored_table(spark, "boosted", {**point, "rows": "all"}, made_from, lambda: bo.fit_nodes(train, point)), dev


@register("gbt_grid_search")
def gbt_grid_search(spark, sf):
    """All points of the boosted grid: parameters, mean and deviation of the folds' ROC AUC."""
    return _boosted_metrics(spark, sf).drop("point")


@register("gbt_predictions")
def gbt_predictions(spark, sf):
    nodes, dev = _best_boosted(spark, sf)
    return bo.predict(spark, nodes, dev)


@register("gbt_fold_metrics")
def gbt_fold_metrics(spark, sf):
    best = _best(_boosted_metrics(spark, sf))
    return _fold_table(_boosted_scores(spark, sf).where(F.col("point") == best))

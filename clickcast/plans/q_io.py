"""Queries: sources and sinks (CSV scan, extract and score-table round
trips, model persistence).  Files go to a fresh folder under the shared
``spark.checkpoint.dir``."""

from __future__ import annotations

from pyspark.sql import functions as F


from clickcast.operators import scores as sc
from clickcast.operators.forest import CutForest
from clickcast.plans import scoring, training
from clickcast.plans.catalog import register
from clickcast.plans.q_features import _best_forest
from clickcast.plans.q_sequence import EXTRACT_COLS, TRAINING_SQL, _scoring_sql
from clickcast.plans.sqlbits import scores
from clickcast.session import scratch_path
from clickcast.sources.clicks import (
    CLICK_SCHEMA,
    EXTRACT_SCHEMA,
    TIMESTAMP_FORMAT,
    clicks_from_events,
    read_clicks_csv,
    read_csv,
    read_score_files,
    write_csv,
    write_score_files,
)

RAW_COLS = [f.name for f in CLICK_SCHEMA.fields]


@register("scan_clicks_csv", """
SELECT CAST(ip AS INTEGER) AS ip, app, device, os, channel,
       date_trunc('second', click_time) AS click_time,
       date_trunc('second', attributed_time) AS attributed_time, is_attributed
FROM clicks""")
def scan_clicks_csv(spark, sf):
    """The log written as a raw click CSV (second precision, empty = null),
    then read back with the typed, malformed-dropping scan."""
    path = scratch_path(spark, "clicks-csv")
    raw = clicks_from_events(spark, sf).select(
        *[F.date_format(c, TIMESTAMP_FORMAT).alias(c) if c in ("click_time", "attributed_time")
          else F.col(c) for c in RAW_COLS])
    raw.write.option("header", True).csv(path)
    return read_clicks_csv(spark, path)


@register("extract_csv_roundtrip", TRAINING_SQL + f"\nSELECT {EXTRACT_COLS} FROM features")
def extract_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "extract-csv")
    extract = training.modelling_extract(
        training.training_features(clicks_from_events(spark, sf)))
    write_csv(extract.select(*[f.name for f in EXTRACT_SCHEMA.fields]), path)
    return read_csv(spark, path, EXTRACT_SCHEMA)


def _score_files(spark, clicks):
    root = scratch_path(spark, "score-files")
    return read_score_files(spark, write_score_files(sc.score_tables(clicks), root))


@register("scoring_features_from_files", _scoring_sql("JOIN", False))
def scoring_features_from_files(spark, sf):
    """Scoring features looked up in the persisted score files, as a scoring job has them."""
    clicks = clicks_from_events(spark, sf)
    return scoring.scoring_features(clicks, _score_files(spark, clicks))


@register("score_table_roundtrip", scores() + """
SELECT dim, key, custom_score FROM scores""")
def score_table_roundtrip(spark, sf):
    """Score tables written as one CSV per category (text keys), read back
    with their typed schemas and stacked (dim, key, custom_score)."""
    parts = [df.select(F.lit(dim).alias("dim"), F.col(dim).try_cast("long").alias("key"),
                       "custom_score")
             for dim, df in _score_files(spark, clicks_from_events(spark, sf)).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("modelling_samples_roundtrip", """
SELECT sample_id, count(*) AS positives
FROM clicks, (VALUES (1), (2), (3), (4)) s(sample_id) WHERE is_attributed = 1 GROUP BY sample_id""")
def modelling_samples_roundtrip(spark, sf):
    """The sampling job written in folders by sample and read back: every sample keeps all conversions
    (the share of the other clicks is random)."""
    path = scratch_path(spark, "modelling-samples")
    training.write_modelling_samples(clicks_from_events(spark, sf), path)
    back = training.read_modelling_samples(spark, path)
    return back.where(F.col("is_attributed") == 1).groupBy("sample_id").agg(F.count(F.lit(1)).alias("positives"))


@register("model_roundtrip")
def model_roundtrip(spark, sf):
    """Save, load, score: predictions of the loaded model on dev."""
    model, dev = _best_forest(spark, sf)
    path = scratch_path(spark, "forest-model")
    model.save(path)
    return CutForest(spark, path).predict(dev)

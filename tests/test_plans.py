"""Physical-plan shape: the scale properties the operators promise."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as entry
from clickcast.operators.sequence import sequence_features
from clickcast.sources.clicks import clicks_from_events
from tests.conftest import SF01

Q = entry.queries()


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def no_aqe(spark):
    """Static plans (AQE off) show every exchange and join strategy."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("name", sorted(Q))
def test_no_cartesian_or_nested_loop_joins(no_aqe, name):
    if name in ("rf_grid_search", "rf_predictions", "gbt_predictions", "feature_importances",
                "submission", "model_roundtrip", "rf_fold_metrics", "gbt_grid_search", "gbt_fold_metrics"):
        pytest.skip("model fitting queries")
    p = plan(Q[name](no_aqe, SF01))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def window_nodes(p: str):
    """(input columns, partition spec) of every Window node."""
    out = []
    for block in re.findall(r"\(\d+\) Window\n(.*?)\n\n", p, re.S):
        inp = re.search(r"Input \[\d+\]: \[(.*?)\]\n", block).group(1)
        args = block.split("Arguments: ", 1)[1].strip()
        part = re.search(r"\], \[([^\]]*)\], \[[^\]]*\]$", args).group(1)
        out.append((inp, part))
    return out


def heavy_plan(spark, **options):
    return plan(sequence_features(clicks_from_events(spark, SF01), **options))


def test_sequence_windows_of_cut_users_never_span_a_whole_user(no_aqe):
    nodes = window_nodes(heavy_plan(no_aqe, chunk_seconds=86_400))
    row_level = [(i, p) for i, p in nodes if "click_id" in i]
    per_user = [(i, p) for i, p in nodes if "_chunk" not in p]
    assert row_level and per_user
    # Windows over click rows are keyed by (user, chunk) ...
    assert all("_chunk" in p for _, p in row_level)
    # ... and the per-user windows only see the one-row-per-chunk summary.
    assert all("click_id" not in i for i, _ in per_user)


def test_only_heavy_users_are_cut(no_aqe):
    """Users within the target take one window without summary and join; those above take the chunk path."""
    light = heavy_plan(no_aqe, target_chunk_rows=1_000_000)
    assert "_chunk" not in light and "Join" not in light
    both = heavy_plan(no_aqe, target_chunk_rows=15)
    assert "LeftAnti" in both and "_chunk" in both


def test_flagship_scan_is_pruned_and_scores_broadcast(no_aqe):
    p = plan(Q["training_features"](no_aqe, SF01))
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", p)
    assert schemas and all("value" not in s for s in schemas)  # unused column never read
    assert p.count("BroadcastHashJoin") >= 4  # four measured score lookups


def test_channel_pairs_form_no_pairs(no_aqe):
    p = plan(Q["channel_pairs_per_converting_user"](no_aqe, SF01))
    assert "Join" not in p.split("== Physical Plan ==")[1].split("\n\n")[0]


def test_split_ranks_per_label_bucket(no_aqe):
    p = plan(Q["stratified_split"](no_aqe, SF01))
    assert "_bucket" in p
    # the row-level row_number is partitioned by (label, bucket), never by label alone
    for m in re.findall(r"row_number\(\) windowspecdefinition\((.*?)\)", p):
        assert "_bucket" in m

"""The forest search in shared passes: the same cells, trees, folds and areas as one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickcast.operators import features as fe
from clickcast.operators import forest as fo
from clickcast.operators import sampling as sa
from clickcast.operators import tree_levels as tl
from clickcast.session import scratch_path

COLS = ["a", "b", "c", "d"]
RULES = [{"max_depth": depth, "min_samples_leaf": leaf, "min_samples_split": 0.02, "min_impurity_decrease": 0.001}
         for leaf, depth in ((0.01, 30), (0.05, 30), (0.2, 30), (0.05, 1))]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = np.random.default_rng(8)
    a, b = rnd.random(3000), rnd.integers(0, 5, 3000)
    label = rnd.random(3000) < 1 / (1 + np.exp(-6 * (a - 0.5) - (b - 2) * (a > 0.3)))
    return spark.createDataFrame(
        [(i, int(y), i % 3, float(x) if i % 50 else float("nan"), float(z), float(x * z), float(i % 2))
         for i, (y, x, z) in enumerate(zip(label, a, b))],
        "click_id long, is_attributed int, fold int, a double, b double, c double, d double")


def same_nodes(one, other):
    return one.reset_index(drop=True).equals(other.reset_index(drop=True))


def test_forests_grown_together_equal_those_grown_alone(rows, monkeypatch):
    cells = fo.training_cells(rows, COLS)
    alone = [tl.grow_trees(cells, 6, rule, 5) for rule in RULES]
    passes, level_splits = [], tl.level_splits
    monkeypatch.setattr(tl, "level_splits", lambda blocks, level, depth: passes.append(len(level.trees)) or level_splits(
        blocks, level, depth))
    together = tl.grow_forests(cells, 6, RULES, 5)
    assert all(same_nodes(x, y) for x, y in zip(alone, together))
    assert max(len(x) for x in alone) > 6 * 5 and not same_nodes(alone[0], alone[1])
    # One tree of all four forests is summed for at the root, and the trees that part later are not more than theirs.
    assert passes[0] == 6 and passes[1] < 24 and len(passes) < 20


def test_cells_of_all_folds_equal_those_of_each(rows):
    train = fo._labelled(rows, COLS, "fold")
    for k, found in zip((0, 1, 2, None), tl.fold_cells(train, fo.LABEL, "fold", [0, 1, 2, None])):
        want = fo.training_cells(rows if k is None else rows.where(F.col("fold") != k), COLS)
        assert found.n == want.n and found.cols == want.cols
        assert all(np.array_equal(x, y) for x, y in zip(found.cuts, want.cuts))
        assert sorted(found.blocks.collect()) == sorted(want.blocks.collect())


def test_a_column_of_few_values_in_some_folds_only(spark):
    # Fold 0 has 100 values of its own, the others have two.
    rows = spark.range(900).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 3).cast("int").alias("fold"),
                                   F.when(F.col("id") % 3 == 0, F.col("id") % 100).otherwise(F.col("id") % 2).cast("double").alias("a"))
    cuts = tl.fold_cuts(rows, ["a"], "fold", [0, 1])
    assert cuts[0][0].tolist() == [0.5] and len(cuts[1][0]) > 10


def test_points_that_cut_alike_are_scored_once(spark, rows):
    grid = {"n_trees": 6, "max_depth": [1, 16, 32], "min_samples_split": [0.02, 0.3], "min_samples_leaf": [0.05, 0.2],
            "min_impurity_decrease": 0.001}
    scores, same = fo.out_of_fold_variants(rows, grid, scratch_path(spark, "variants"), n_folds=3, cols=COLS)
    assert same.count() == 36 and scores.count() < 12 * 3000
    every = fo.every_point(scores, same)
    assert [r["count"] for r in every.groupBy("point").count().collect()] == [3000] * 12
    got = {r.point: r for r in fo.grid_metrics(scores, grid, same).collect()}
    want = {r.point: r for r in fo.grid_metrics(every, grid).collect()}
    assert len(got) == 12 and len({round(r.roc_auc, 9) for r in got.values()}) > 2
    for point, r in want.items():
        assert tuple(got[point]) == pytest.approx(tuple(r), abs=1e-12)


def test_folds_from_the_position_of_the_split_equal_a_new_ranking(spark):
    rows = spark.range(1000).select(F.col("id").alias("click_id"), F.when(F.col("id") % 10 < 3, 1).when(
        F.col("id") % 10 < 9, 0).cast("int").alias("is_attributed"))
    train = sa.stratified_split(rows, position="at").where("split = 'train'")
    want = sa.stratified_folds(sa.undersample(sa.stratified_split(rows).where("split = 'train'")))
    got = sa.undersampled_folds(train, "at")
    assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert got.count() == 3 * 72


def walked(nodes, x, tree, point):
    """The share where a row stops, node by node."""
    nodes, at = nodes[nodes["tree"] == tree].reset_index(drop=True), 0
    ok = fo.splits(nodes, point)
    while ok[at]:
        n = nodes.iloc[at]
        at = int(n["left"] if x[int(n["feature"])] <= n["threshold"] else n["right"])
    return nodes["share"][at]


@pytest.mark.parametrize("dense", [0, 1000])
def test_shares_of_grown_nodes_equal_those_saved_and_a_walk(spark, rows, monkeypatch, dense):
    monkeypatch.setattr(fo, "DENSE", dense)
    monkeypatch.setattr(tl, "SUMMED_TREES", 2)  # several tasks add up sums
    nodes = tl.grow_trees(fo.training_cells(rows, COLS), 5, RULES[0], 5)
    folder = scratch_path(spark, "saved")
    fo.grow(rows, 5, 0.01, cols=COLS, nodes=nodes, folder=folder)
    points = [{"max_depth": d, "min_samples_split": s, "min_impurity_decrease": 0.001} for d in (1, 3, 30) for s in (0.02, 0.3)]
    saved = fo.read_nodes(spark, folder)
    found, want = fo.share_table(fo.grown_nodes(nodes), points), fo.share_table(saved, points)
    assert np.array_equal(found.table, want.table) and found.place == want.place and found.first == want.first
    by_leaf = {(r.tree, r.leaf): r.shares for r in fo.stop_shares(saved, points).collect()}
    assert all(list(found.table[found.place, t, leaf]) == shares for (t, leaf), shares in by_leaf.items())
    x = np.array([[r[c] for c in COLS] for r in rows.limit(60).collect()]).T
    got, table = found.scores(x), saved.toPandas().sort_values(["tree", "node"])
    assert np.isnan(x).any()
    for k, point in enumerate(points):
        shares = [np.mean([walked(table, x[:, i], t, point) for t in range(5)]) for i in range(x.shape[1])]
        assert got[found.place[k]] == pytest.approx(shares, abs=1e-12)


def test_all_folds_are_scored_in_one_pass_by_their_own_forests(spark, rows, monkeypatch):
    grid = {"n_trees": 4, "max_depth": [1, 16], "min_samples_split": [0.02], "min_samples_leaf": [0.05, 0.2],
            "min_impurity_decrease": 0.001}
    passes, shares, folder = [], fo.fold_mean_shares, scratch_path(spark, "variants")
    monkeypatch.setattr(fo, "fold_mean_shares", lambda *a: passes.append(1) or shares(*a))
    got = fo.out_of_fold_scores(rows, grid, folder, n_folds=3, cols=COLS)
    assert len(passes) == 1
    points = fo.grid_points(grid)
    for k in range(3):
        for leaf in grid["min_samples_leaf"]:
            mine = [p for p, point in enumerate(points) if point["min_samples_leaf"] == leaf]
            table = fo.share_table(fo.read_nodes(spark, f"{folder}/forest-{leaf}-{k}"), [points[p] for p in mine])
            want = fo.point_scores(None, table, rows.where(F.col("fold") == k), COLS).collect()
            for at, p in enumerate(mine):
                have = got.where((F.col("fold") == k) & (F.col("point") == p)).collect()
                assert sorted((r.is_attributed, r.score) for r in have) == sorted((r.is_attributed, r.scores[at]) for r in want)


def test_submission_reads_its_scoring_rows_from_one_copy(spark, monkeypatch):
    from clickcast.plans.catalog import QUERIES
    from clickcast.plans import q_features as qf

    kept, materialised = [], qf.materialised
    monkeypatch.setattr(qf, "materialised", lambda df, name: kept.append(df.columns) or materialised(df, name))

    class Model:
        def predict(self, df):
            assert df.columns == fe.scoring_matrix(features).columns
            assert sorted(df.collect()) == sorted(fe.scoring_matrix(features).collect())
            return df.select("click_id", F.lit(1).alias("predicted"))

    features = spark.range(50).select(
        F.col("id").alias("click_id"), *[F.when(F.col("id") % 7 > 0, F.col("id") * 0.5).alias(c) for c in fe.NUMERIC_COLS],
        (F.col("id") % 24).cast("string").alias("click_time_hour"), F.lit(1).alias("ip"))
    monkeypatch.setattr(qf, "_best_forest", lambda *a: (Model(), None))
    monkeypatch.setattr(qf, "_scoring_features", lambda *a: features)
    assert QUERIES["submission"](spark, "").count() == 50
    assert kept == [["click_id", *fe.NUMERIC_COLS, "click_time_hour"]]

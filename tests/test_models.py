"""Forest cuts against a walk, leaf weights against SQL, the store, and the registered model queries."""

import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clickcast.operators import boosting as bo
from clickcast.operators import evaluate as ev
from clickcast.operators import forest as fo
from clickcast.operators import model_store as ms
from clickcast.plans.catalog import QUERIES as Q
from clickcast.session import scratch_path
from clickcast.sources.clicks import clicks_from_events
from tests.conftest import SF01

COLS = ("a", "b", "c", "d")


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(1)
    out = []
    for i in range(600):
        x = [rnd.random(), rnd.choice([0.0, 0.5, 1.0]), rnd.random(), float(rnd.random() < 0.3)]
        p = 1 / (1 + math.exp(-4 * (x[0] - 0.5) - 2 * (x[1] - 0.5) * x[3]))
        out.append((i, *x, int(rnd.random() < p), i % 5))
    return spark.createDataFrame(out, "click_id long, a double, b double, c double, d double, is_attributed int, fold int")


def walk(nodes, x, point):
    """The share of label 1 where one row stops in one tree."""
    at, depth, total = nodes[0], 0, nodes[0].rows
    while (at.left >= 0 and depth < point["max_depth"] and at.rows >= math.ceil(point["min_samples_split"] * total)
           and at.gain * at.rows / total >= point["min_impurity_decrease"]):
        at, depth = nodes[at.left if x[at.feature] <= at.threshold else at.right], depth + 1
    return at.share


def test_cut_forests_equal_a_walk(spark, rows):
    folder = scratch_path(spark, "forest-test")
    model = fo.grow(rows, 12, 0.02, cols=COLS)
    model.save(folder)
    table = fo.read_nodes(spark, folder)
    trees = {}
    for n in table.orderBy("tree", "node").collect():
        trees.setdefault(n.tree, []).append(n)
    assert len(trees) == 12 and all(n.node == k for t in trees.values() for k, n in enumerate(t))
    points = [{"max_depth": d, "min_samples_split": s, "min_impurity_decrease": m}
              for d in (1, 3, 16) for s in (0.0, 0.1, 0.4) for m in (0.0, 0.02)]
    points.append({"max_depth": 0, "min_samples_split": 0.0, "min_impurity_decrease": 0.0})
    got = fo.point_scores(model, fo.share_table(table, points), rows, COLS).collect()
    for r in random.Random(2).sample(got, 80):
        x = [r[c] for c in COLS]
        want = [sum(walk(t, x, p) for t in trees.values()) / len(trees) for p in points]
        assert r.scores == pytest.approx(want, abs=1e-12)
    # Uncut, the scores are those of pyspark.ml.
    whole = [{"max_depth": 30, "min_samples_split": 0.0, "min_impurity_decrease": -math.inf}]
    mine = fo.point_scores(model, fo.share_table(table, whole), rows, COLS)
    theirs = model.transform(fo.assembled(rows, COLS)).select("click_id", "probability")
    both = mine.join(theirs, "click_id").collect()
    assert all(r.scores[0] == pytest.approx(r.probability[1], abs=1e-12) for r in both)


def test_small_search_has_all_points_and_folds(spark, rows):
    grid = {"n_trees": 5, "max_depth": [2, 32], "min_samples_split": [0.05, 0.3], "min_samples_leaf": [0.02, 0.1],
            "min_impurity_decrease": 0.001}
    scores = fo.out_of_fold_scores(rows, grid, scratch_path(spark, "search"), cols=COLS)
    assert scores.groupBy("point").count().where("count = 600").count() == 8
    metrics = fo.grid_metrics(scores, grid).collect()
    assert len(metrics) == 8 and all(0.5 < r.roc_auc < 1 and r.roc_auc_std >= 0 for r in metrics)


def test_importances_and_saved_cut(spark, rows):
    point = {"n_trees": 6, "max_depth": 4, "min_samples_split": 0.1, "min_samples_leaf": 0.02,
             "min_impurity_decrease": 0.001}
    model = fo.CutForest.fit(rows, point, scratch_path(spark, "cut"), COLS)
    found = {r.feature: r.importance for r in model.importances().collect()}
    assert set(found) == set(COLS) and sum(found.values()) == pytest.approx(1) and max(found, key=found.get) == "a"
    stump = fo.CutForest.write(spark, model.model, {**point, "max_depth": 0}, scratch_path(spark, "stumps"), COLS)
    assert {r.importance for r in stump.importances().collect()} == {0.0}
    folder = scratch_path(spark, "cut-copy")
    model.save(folder)
    again = fo.CutForest(spark, folder)
    assert again.point == point
    assert sorted(model.predict(rows).collect()) == sorted(again.predict(rows).collect())


def boosted(rows, **point):
    point = {**bo.GRID, "rounds": 6, "max_depth": 4, **point}
    pdf = rows.orderBy("click_id").toPandas()
    return point, pdf, bo.boost(pdf[list(COLS)].to_numpy(), pdf["is_attributed"].to_numpy(dtype=float), point)


def test_leaf_weights_equal_sql(spark, duck, rows):
    point, pdf, nodes = boosted(rows, columns_per_tree=1.0, columns_per_level=1.0)
    trees, x = bo.Trees(nodes), pdf[list(COLS)].to_numpy()
    margin = np.zeros(len(pdf))
    for number, root in enumerate(trees.roots):
        leaf = trees.leaves(x, root)
        p = 1 / (1 + np.exp(-margin))
        steps = pd.DataFrame({"leaf": leaf - root, "g": p - pdf["is_attributed"], "h": p * (1 - p)})
        duck.register("steps", steps)
        want = dict(duck.sql(f"SELECT leaf, -sum(g) / (sum(h) + {point['reg_lambda']}) * {point['step']} "
                             "FROM steps GROUP BY leaf").fetchall())
        tree = nodes[nodes["tree"] == number].set_index("node")
        for node, weight in want.items():
            assert tree.loc[node, "weight"] == pytest.approx(weight) and tree.loc[node, "left"] == -1
        assert all(h >= bo.MIN_CHILD - 1e-9 for h in steps.groupby("leaf")["h"].sum()) or len(want) == 1
        margin += trees.weight[leaf]


def test_gamma_takes_splits_back_and_columns_are_sampled(rows):
    _, _, free = boosted(rows, gamma=0.0)
    _, _, strict = boosted(rows, gamma=5.0)
    assert (strict["left"] >= 0).sum() < (free["left"] >= 0).sum()
    for nodes, gamma in ((free, 0.0), (strict, 5.0)):
        for _, tree in nodes.groupby("tree"):
            kept = tree.set_index("node")
            for node, r in kept[kept["left"] >= 0].iterrows():
                ends = kept.loc[[int(r["left"]), int(r["right"])], "left"]
                assert (ends >= 0).any() or r["loss"] >= gamma
    _, _, one = boosted(rows, columns_per_tree=0.25, columns_per_level=1.0)
    assert all(t.loc[t["feature"] >= 0, "feature"].nunique() <= 1 for _, t in one.groupby("tree"))
    assert one.loc[one["feature"] >= 0, "feature"].nunique() > 1


def test_flags_take_no_room_for_bins_they_do_not_have():
    rnd = np.random.default_rng(5)
    x = np.concatenate([rnd.random((4000, 1)), rnd.random((4000, 30)) < 0.5], axis=1)
    y = (rnd.random(4000) < 0.5).astype(float)
    point = {**bo.GRID, "rounds": 1, "max_depth": 12, "columns_per_tree": 1.0, "columns_per_level": 1.0, "gamma": 0.0}
    tracemalloc.start()
    nodes = bo.boost(x, y, point)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # A level of some hundred nodes by 31 columns by 256 bins would alone take more.
    assert len(nodes) > 500 and peak < 20e6


def brute_split(x, grad, hess, lam):
    """Largest gain of any cut of one node's rows."""
    best = -math.inf
    for col in x.T:
        for cut in np.unique(col)[:-1]:
            low = col <= cut
            sums = [(grad[m].sum(), hess[m].sum()) for m in (low, ~low)]
            if min(h for _, h in sums) >= bo.MIN_CHILD:
                best = max(best, sum(g * g / (h + lam) for g, h in sums) - grad.sum() ** 2 / (hess.sum() + lam))
    return best


def test_first_splits_are_the_best_of_all_cuts(rows):
    point, pdf, _ = boosted(rows, columns_per_tree=1.0, columns_per_level=1.0, rounds=1, gamma=0.0)
    x, y = np.round(pdf[list(COLS)].to_numpy(), 2), pdf["is_attributed"].to_numpy(dtype=float)
    tree = bo.boost(x, y, point)
    at, grad, hess = {0: np.ones(len(x), dtype=bool)}, 0.5 - y, np.full(len(x), 0.25)
    for node, r in tree.set_index("node").iterrows():
        if r["left"] < 0:
            continue
        mine = at[node]
        assert r["loss"] == pytest.approx(brute_split(x[mine], grad[mine], hess[mine], point["reg_lambda"]))
        low = x[:, int(r["feature"])] <= r["threshold"]
        at[int(r["left"])], at[int(r["right"])] = mine & low, mine & ~low


def test_boosted_scores_follow_the_label_and_the_bound_is_per_label(spark, rows):
    grid = {**bo.GRID, "rounds": 30, "max_depth": [3, 64], "columns_per_level": 1.0}
    scores = bo.out_of_fold_scores(rows, grid, cols=COLS)
    assert all(r.roc_auc > 0.65 for r in bo.grid_metrics(scores, grid).collect())
    assert scores.groupBy("point", "fold").count().count() == 10 and scores.count() == 1200
    bound = bo.bounded_rows(rows, 40).groupBy("is_attributed").count().collect()
    assert [r["count"] for r in bound] == [40, 40]
    nodes = bo.fit_nodes(rows, bo.grid_points(grid)[0], COLS)
    pred = bo.predict(spark, nodes, rows.select("click_id", *COLS), cols=COLS)
    auc = ev.roc_auc(pred.join(rows, "click_id"), "probability").first()["roc_auc"]
    assert auc > 0.8 and pred.where("predicted <> int(probability > 0.5)").count() == 0


def test_a_result_is_made_once_and_again_after_a_fit_cut_short(spark, rows):
    made = []

    def make():
        made.append(1)
        return rows.limit(3)

    sig = ms.signature(rows)
    assert sig == ms.signature(rows.repartition(7)) != ms.signature(rows.where("click_id > 0"))
    for _ in range(3):
        assert ms.stored_table(spark, "test", {"a": 1}, sig, make).count() == 3
    assert len(made) == 1
    ms.stored_table(spark, "test", {"a": 2}, sig, make)
    assert len(made) == 2

    def broken(folder):
        rows.write.parquet(f"{folder}/rows")
        raise RuntimeError

    with pytest.raises(RuntimeError):
        ms.stored(spark, "test", {"a": 3}, sig, broken, str)
    assert ms.stored_table(spark, "test", {"a": 3}, sig, make).count() == 3


def test_registered_model_queries(spark, monkeypatch):
    grown = []
    grow = fo.grow
    monkeypatch.setattr(fo, "grow", lambda *a, **k: grown.append(1) or grow(*a, **k))
    grid = Q["rf_grid_search"](spark, SF01).collect()
    points = {(r.max_depth, r.min_samples_split, r.min_samples_leaf) for r in grid}
    assert len(points) == 27 and all(0 <= r.roc_auc <= 1 for r in grid)
    n_dev = Q["gbt_predictions"](spark, SF01).count()
    pred = Q["rf_predictions"](spark, SF01)
    assert pred.count() == n_dev == 1000 and pred.where("predicted <> int(probability > 0.5)").count() == 0
    assert pred.where("probability < 0 OR probability > 1").count() == 0
    folds = {r.fold: r for r in Q["rf_fold_metrics"](spark, SF01).collect()}
    assert set(folds) == {"0", "1", "2", "3", "4", "mean", "std"}
    best = max(r.roc_auc for r in grid)
    assert folds["mean"].roc_auc == pytest.approx(best)
    assert folds["mean"].f1 == pytest.approx(sum(folds[str(k)].f1 for k in range(5)) / 5)
    imp = Q["feature_importances"](spark, SF01).collect()
    assert len(imp) == 10 and sum(r.importance for r in imp) <= 1 + 1e-9
    sub = Q["submission"](spark, SF01)
    assert sub.count() == clicks_from_events(spark, SF01).count()
    assert {r.is_attributed for r in sub.select("is_attributed").distinct().collect()} <= {0, 1}
    assert sorted(Q["model_roundtrip"](spark, SF01).collect()) == sorted(pred.collect())
    gbt = Q["gbt_grid_search"](spark, SF01).collect()
    assert {r.max_depth for r in gbt} == {8, 32, 64} and all(r.rounds == 300 and 0 <= r.roc_auc <= 1 for r in gbt)
    assert max(r.roc_auc for r in gbt) == pytest.approx(
        Q["gbt_fold_metrics"](spark, SF01).where(F.col("fold") == "mean").first()["roc_auc"])
    # 3 leaf shares of 5 folds, and the best point on all training rows: grown once for all queries above.
    assert len(grown) in (0, 16)

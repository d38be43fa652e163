"""Trees grown level by level: sums and splits against a walk over rows, draws, and what a rule keeps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickcast.operators import tree_levels as tl


def entropy(zeros, ones):
    return -sum(p * math.log2(p) for p in (zeros / (zeros + ones), ones / (zeros + ones)) if p > 0)


def test_draws_follow_the_poisson_law():
    rnd = np.random.default_rng(3)
    single = tl.draw_weights(np.ones(400_000, dtype=np.int64), rnd)
    for k in range(5):
        assert np.mean(single == k) == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.004)
    many = tl.draw_weights(np.full(100_000, 7), rnd)
    assert many.mean() == pytest.approx(7, abs=0.05) and many.var() == pytest.approx(7, abs=0.2)


def test_splits_are_the_best_of_all_cuts(spark, monkeypatch):
    # Every row weighs 1: then a node's sums are counts, and its split can be told from the rows.
    monkeypatch.setattr(tl, "draw_weights", lambda counts, rnd: counts.copy())
    rnd = np.random.default_rng(4)
    x = np.stack([rnd.integers(0, 9, 900), rnd.integers(0, 3, 900)], axis=1).astype(float)
    y = (rnd.random(900) < 0.2 + 0.07 * x[:, 0] * (x[:, 1] > 0)).astype(int)
    rows = spark.createDataFrame([(int(b), *map(float, a)) for a, b in zip(x, y)], "y int, a double, b double")
    cuts = tl.bin_cuts(rows, ["a", "b"])
    bins = np.stack([np.searchsorted(c, x[:, j]) * 2 + y for j, c in enumerate(cuts)], axis=1).astype(np.uint8)
    tree = {"tree": 0, "open": [0], "left": [-1], "right": [-1], "feature": [-1], "cut": [-1]}
    level = tl.Level([tree], 2, 2, 1)
    found = tl.best_splits(level.sums(tree, 0, bins.ravel(), np.ones(900, dtype=np.int64), 7), tree["sub"], 0.05 * 900).iloc[0]
    best = max((entropy(900 - y.sum(), y.sum()) - sum(m.mean() * entropy((y[m] == 0).sum(), y[m].sum()) for m in (low, ~low)), j, c)
               for j in (0, 1) for c in np.unique(x[:, j])[:-1] for low in [x[:, j] <= c] if 45 <= low.sum() <= 855)
    assert found["gain"] == pytest.approx(best[0]) and (found["zeros"], found["ones"]) == ((y == 0).sum(), y.sum())
    assert cuts[int(found["feature"])][int(found["cut"])] >= best[2] and int(found["feature"]) == best[1]


def test_a_rule_keeps_its_splits_though_both_sides_have_one_label(spark):
    # Share of ones 0.1 or 0.4: a split of much decrease between two sides of label 0.
    rows = spark.range(2000).select(
        ((F.col("id") % 10) < F.when(F.col("id") % 4 < 2, 1).otherwise(4)).cast("int").alias("y"),
        (F.col("id") % 4 >= 2).cast("double").alias("a"))
    rule = {"max_depth": 3, "min_samples_leaf": 0.1, "min_samples_split": 0.1, "min_impurity_decrease": 0.001}
    nodes = tl.grow_trees(tl.Cells(rows, "y"), 8, rule, 5)
    assert (nodes["left"] >= 0).sum() == 8 and len(nodes) == 24
    leaves = nodes[nodes["left"] < 0]
    assert (leaves["ones"] < leaves["zeros"]).all()
    again = tl.grow_trees(tl.Cells(rows.repartition(5), "y"), 8, rule, 5)
    assert nodes.equals(again)


def test_a_leaf_keeps_its_share_and_nan_is_above_all(spark):
    rows = spark.range(1000).select((F.col("id") % 5 == 0).cast("int").alias("y"),
                                    F.when(F.col("id") % 5 == 0, float("nan")).otherwise(F.col("id") % 7).alias("a"))
    rule = {"max_depth": 1, "min_samples_leaf": 0.1, "min_samples_split": 0.0, "min_impurity_decrease": 0.0}
    nodes = tl.grow_trees(tl.Cells(rows, "y"), 5, rule, 1)
    roots = nodes[nodes["node"] == 0]
    assert (roots["left"] == 1).all() and (roots["threshold"] > 5).sum() == 5
    leaves = nodes[nodes["left"] < 0]
    assert ((leaves["zeros"] + leaves["ones"]) >= 100).all()

"""Boosted fits take all rows: cells against rows, cuts against numpy, shared fits against single ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clickcast.operators import boosting as bo
from clickcast.operators.quantiles import around_steps
from clickcast.plans.catalog import QUERIES  # noqa: F401 - before the plans
from clickcast.plans import q_features as qf  # noqa: E402

COLS = ("a", "b", "c", "d")


def table(n, seed=3):
    """Few distinct rows, a rare flag, nulls."""
    rnd = np.random.default_rng(seed)
    x = pd.DataFrame({"a": rnd.integers(0, 40, n) / 7, "b": rnd.integers(0, 3, n) * 1.0, "c": (rnd.random(n) < 0.04) * 1.0,
                      "d": rnd.integers(0, 5, n) * 1.0})
    p = 1 / (1 + np.exp(-(x["a"] - 3) / 2 - x["c"] * 2 + (x["b"] == x["d"])))
    x.loc[rnd.random(n) < 0.1, "a"] = np.nan
    return x.assign(is_attributed=(rnd.random(n) < p).astype(int), fold=np.arange(n) % 5, click_id=range(n))


@pytest.fixture(scope="module")
def train(spark):
    """More rows of each label than the fits once took."""
    pdf = table(130_000)
    assert pdf.groupby("is_attributed").size().min() > 50_000
    return pdf, spark.createDataFrame(pdf).withColumn("a", F.when(~F.isnan("a"), F.col("a"))).cache()


def test_queries_fit_on_all_rows(spark, train, monkeypatch):
    pdf, rows = train
    for c in bo.FEATURE_COLS:
        rows = rows.withColumn(c, F.col(COLS[bo.FEATURE_COLS.index(c)]) if bo.FEATURE_COLS.index(c) < 4 else F.lit(0.0))
    monkeypatch.setattr(qf, "_made_from", lambda *_: "130,000 rows")
    monkeypatch.setattr(qf, "_train_dev", lambda *_: (rows, rows.limit(100)))
    monkeypatch.setattr(bo, "GRID", {**bo.GRID, "rounds": 2, "columns_per_tree": 1.0, "columns_per_level": 1.0})
    scores = qf._boosted_scores(spark, "")
    counts = {(r["point"], r["fold"], r["is_attributed"]): r["count"]
              for r in scores.groupBy("point", "fold", "is_attributed").count().collect()}
    want = pdf.groupby(["fold", "is_attributed"]).size()
    assert counts == {(k, *key): n for k in range(3) for key, n in want.items()}
    root = qf._best_boosted(spark, "")[0].where("tree = 0 AND node = 0").first()
    assert root["hess"] == pytest.approx(len(pdf) / 4)
    assert root["grad"] == pytest.approx(len(pdf) / 2 - pdf["is_attributed"].sum())


def test_a_fit_on_cells_is_the_fit_on_their_rows(spark, train):
    pdf, rows = train[0][:6000], train[1].where("click_id < 6000")
    point = {**bo.GRID, "rounds": 5, "max_depth": 6, "columns_per_tree": 1.0, "columns_per_level": 0.5}
    got = bo.fit_nodes(rows, point, COLS).toPandas().sort_values(["tree", "node"], ignore_index=True)
    want = bo.boost(pdf[list(COLS)].to_numpy(), pdf["is_attributed"].to_numpy(float), point)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
    # Rows left out are scored by a fit on all others.
    grid = {**point, "max_depth": [6]}
    scores = bo.out_of_fold_scores(rows, grid, cols=COLS).where("fold = 2").toPandas()
    held = pdf["fold"] == 2
    x, y = (pdf.loc[~held, list(COLS)].to_numpy(), pdf.loc[~held, "is_attributed"].to_numpy(float))
    p = bo.Trees(bo.boost(x, y, point)).probability(pdf.loc[held, list(COLS)].to_numpy())
    for label in (0, 1):
        mine = np.sort(scores.loc[scores["is_attributed"] == label, "score"])
        np.testing.assert_allclose(mine, np.sort(p[pdf.loc[held, "is_attributed"] == label]), atol=1e-9)


def test_deeper_fits_go_on_from_the_first_tree_that_a_depth_cut(monkeypatch):
    pdf = table(3000)
    rnd = np.random.default_rng(4)
    x = np.concatenate([pdf[list(COLS)].to_numpy(), rnd.random((3000, 2))], axis=1)
    codes, cuts = bo.bin_columns(x)
    y = pdf["is_attributed"].to_numpy(float)
    cells = bo.Cells(codes, [len(c) + 1 for c in cuts], np.ones(len(y)), y)
    points = [{**bo.GRID, "rounds": 12, "max_depth": d, "columns_per_tree": 1.0, "columns_per_level": 0.3} for d in (3, 9, 14, 60)]

    def last(points):
        return {k: margin.copy() for k, number, _, margin in bo.grow_trees(cells, points) if number >= 11}

    together = last(points)
    assert len({m.tobytes() for m in together.values()}) in (3, 4)
    alone = [last([point])[0] for point in points]
    for k in range(4):
        assert (together[k] == alone[k]).all()
    monkeypatch.setattr(bo, "ROOM", 300)  # sums a few nodes at a time
    monkeypatch.setattr(bo, "SLICE", 700)
    np.testing.assert_allclose(last(points[2:3])[0], alone[2], atol=1e-9)
    monkeypatch.setattr(bo, "SPARSE", 10 ** 9)  # all bins of all columns
    dense = bo.Cells(codes, cells.widths, cells.n, cells.ones)
    assert not any(dense.sparse) and any(cells.sparse)
    np.testing.assert_allclose([m for *_, m in bo.grow_trees(dense, points[2:3])][-1], alone[2], atol=1e-9)


def test_cuts_are_exact_quantiles_of_the_other_folds(spark):
    rnd = np.random.default_rng(7)
    n = 5000
    pdf = pd.DataFrame({"a": rnd.random(n), "b": rnd.integers(0, 3, n) * 1.0, "c": np.round(rnd.exponential(60, n)),
                        "d": rnd.permutation(np.arange(n) % 257) * 1.0, "e": np.nan, "_f": np.arange(n) % 5})
    pdf.loc[rnd.random(n) < 0.1, ["a", "c"]] = np.nan
    cols = list("abcde")
    df = spark.createDataFrame(pdf)
    cuts = bo.fold_cuts(df, cols, "_f", [0, 3, None])
    for k, got in zip([0, 3, None], cuts):
        want = bo.bin_columns(pdf.loc[pdf["_f"] != k, cols].to_numpy())[1]
        for a, b in zip(got, want):
            np.testing.assert_array_equal(a, b)
    counts = df.where("NOT isnan(a)").groupBy("_f", F.col("a").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    in_one, in_many = (sorted(around_steps(counts, 64, ["_f"], size).collect()) for size in (10 ** 6, 300))
    assert in_one == in_many and len(in_one) < counts.count()


def test_jobs_in_one_partition_are_fitted_one_after_the_other(spark, train, monkeypatch):
    rows, grid = train[1].where("click_id < 2000"), {**bo.GRID, "rounds": 3, "max_depth": [2, 40]}
    apart = sorted(bo.out_of_fold_scores(rows, grid, cols=COLS).collect())
    monkeypatch.setattr(bo, "_keys", lambda _, n: [5] * n)
    assert sorted(bo.out_of_fold_scores(rows, grid, cols=COLS).collect()) == apart and len(apart) == 4000


def test_other_labels_are_refused_and_no_rows_give_no_scores(spark, train):
    grid = {**bo.GRID, "rounds": 1, "max_depth": [2]}
    with pytest.raises(Exception, match="labels of 0 or 1"):
        bo.out_of_fold_scores(train[1].limit(9).withColumn("is_attributed", F.lit(2)), grid, cols=COLS)
    assert bo.out_of_fold_scores(train[1].where("click_id < 0"), grid, cols=COLS).count() == 0


def test_a_model_is_applied_in_parts(spark, train, monkeypatch):
    rows = train[1].where("click_id < 3000")
    point = {**bo.GRID, "rounds": 6, "max_depth": 4, "columns_per_level": 1.0}
    nodes = bo.fit_nodes(rows, point, COLS).cache()
    whole = sorted(bo.predict(spark, nodes, rows, cols=COLS).collect())
    monkeypatch.setattr(bo, "HELD_NODES", 30)
    assert nodes.count() > 60
    parts = sorted(bo.predict(spark, nodes, rows, cols=COLS).collect())
    assert len(parts) == 3000 and [r[0] for r in parts] == [r[0] for r in whole]
    np.testing.assert_allclose([r[1] for r in parts], [r[1] for r in whole], atol=1e-12)

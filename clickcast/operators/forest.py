"""Random forests as node tables: one grown forest answers every grid point that only cuts it.

``pyspark.ml`` grows forests by depth and least leaf share, but knows no least share of rows to
split and weighs no impurity decrease by the rows of its node.  A fitted forest is therefore read
as a table with a row per node (children, rows, gain, share of label 1).  A grid point
is a rule on that table: a node splits only above a depth, with enough rows, and with
enough decrease; where the rule first says no on a row's way down, the row stops.
So one forest per least leaf share and fold serves all depths and split shares:
a node's split does not depend on what grows below it.

``pyspark.ml`` also grows every node to the end and merges sibling leaves of one label, so it spends
most of its passes below what any rule keeps, and loses splits that a rule does keep.  Forests are
therefore grown here, level by level (:mod:`clickcast.operators.tree_levels`), down to what the mildest
rule keeps, and saved as models of ``pyspark.ml``, which loads, applies and stores them.

Rows go down the trees on the executors, by arrays of the nodes; a rule is a table
(tree, leaf) → share of label 1 at the stop, as large as the model.  Rules that stop every row at the same
share are worked out once.
"""

from __future__ import annotations

import json
import math
from functools import cache, cached_property
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickcast.operators.evaluate import roc_auc
from clickcast.operators.features import HOUR_FLAG_COLS, NUMERIC_COLS
from clickcast.operators.sampling import SEED
from clickcast.operators.tree_levels import Cells, fold_cells, grow_forests
from clickcast.session import scratch_path

FEATURE_COLS = NUMERIC_COLS + HOUR_FLAG_COLS
LABEL = "is_attributed"
NODES = ("tree int, node int, left int, right int, rows long, gain double, feature int, threshold double, "
         "share double")

# The grid of the original search (a depth of 32 is grown to 30, the most that
# pyspark.ml takes; trees stop long before, a leaf holding a share of all rows).
GRID = {"n_trees": 300, "max_depth": [8, 16, 32], "min_samples_split": [0.025, 0.05, 0.1],
        "min_samples_leaf": [0.025, 0.05, 0.1], "min_impurity_decrease": 0.001}
DEEPEST = 30
#: Folds worked on at a time.
PARALLEL = 5
#: Nodes a level of depth up to which comparing all rows at each node is faster than walking each row down.
DENSE = 8


def assembled(df: DataFrame, cols=FEATURE_COLS) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep").transform(df)


def grow(train: DataFrame, n_trees: int, min_samples_leaf: float, max_depth: int = DEEPEST, seed: int = SEED,
         cols=FEATURE_COLS, min_samples_split: float = 0.0, min_impurity_decrease: float = 0.0,
         nodes: pd.DataFrame | None = None, folder: str | None = None) -> RandomForestClassificationModel | None:
    """A forest by entropy with a square root of the features at each node.

    It is whole for every rule that asks for at least this share of rows and this decrease, and is cut by none yet.
    ``nodes`` are its node table, if grown with others already.  With ``folder`` it is saved there and not loaded.
    """
    spark = train.sparkSession
    rule = growing_rule(min_samples_leaf, max_depth, min_samples_split, min_impurity_decrease)
    if nodes is None:
        nodes = grow_forests(training_cells(train, cols), n_trees, [rule], seed)[0]
    # The files of a model of this many bare roots; the nodes are then put in their place.
    model, saved = bare_roots(spark, n_trees, len(cols)), folder or scratch_path(spark, "forest-grown")
    model = model.copy({model.minWeightFractionPerNode: min(min_samples_leaf, 0.49), model.maxDepth: rule["max_depth"],
                        model.seed: seed})
    model.write().overwrite().save(saved)
    node_rows(spark, nodes).coalesce(1).write.mode("overwrite").parquet(f"{saved}/data")
    return None if folder else RandomForestClassificationModel.load(saved)


def growing_rule(min_samples_leaf: float, max_depth: int, min_samples_split: float, min_impurity_decrease: float) -> dict:
    return {"max_depth": min(max_depth, DEEPEST), "min_samples_leaf": min_samples_leaf,
            "min_samples_split": min_samples_split, "min_impurity_decrease": min_impurity_decrease}


def _labelled(train: DataFrame, cols, *more: str) -> DataFrame:
    return train.select(*more, F.col(LABEL).cast("int").alias(LABEL), *[F.col(c).cast("double").alias(c) for c in cols])


def training_cells(train: DataFrame, cols=FEATURE_COLS) -> Cells:
    return Cells(_labelled(train, cols), LABEL)


@cache
def bare_roots(spark: SparkSession, n_trees: int, n_features: int) -> RandomForestClassificationModel:
    """A model of ``pyspark.ml`` whose trees do not split; the same for all forests of this size."""
    est = RandomForestClassifier(labelCol=LABEL, featuresCol="features", impurity="entropy",
                                 featureSubsetStrategy="sqrt", numTrees=n_trees, maxDepth=0, minInfoGain=0.0)
    rows = spark.createDataFrame([(Vectors.dense([0.0] * n_features), k % 2) for k in range(100)], ["features", LABEL])
    return est.fit(rows.coalesce(1))


def node_rows(spark: SparkSession, nodes: pd.DataFrame) -> DataFrame:
    """Grown nodes (numbered left to right in their trees) as ``pyspark.ml`` saves them."""
    table = spark.createDataFrame(nodes)
    inner = F.col("left") >= 0
    total = F.col("zeros") + F.col("ones")
    share = F.when(total > 0, F.col("ones") / total).otherwise(0.0)
    half = [F.when(x > 0, -x * F.log2(x)).otherwise(0.0) for x in (share, 1 - share)]
    return table.select(F.col("tree").cast("int").alias("treeID"), F.struct(
        F.col("node").cast("int").alias("id"), (share > 0.5).cast("double").alias("prediction"),
        (half[0] + half[1]).alias("impurity"), F.array("zeros", "ones").alias("impurityStats"),
        total.cast("long").alias("rawCount"), F.col("gain"),
        F.col("left").cast("int").alias("leftChild"), F.col("right").cast("int").alias("rightChild"),
        F.struct(F.col("feature").cast("int").alias("featureIndex"),
                 F.when(inner, F.array("threshold")).otherwise(F.array().cast("array<double>")).alias(
                     "leftCategoriesOrThreshold"),
                 F.lit(-1).alias("numCategories")).alias("split")).alias("nodeData"))


def read_nodes(spark: SparkSession, saved: str) -> DataFrame:
    """The node table of a saved forest.  Node numbers go left to right, a parent before its children."""
    n = F.col("nodeData")
    total = F.aggregate(n["impurityStats"], F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(f"{saved}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), n["leftChild"].alias("left"),
        n["rightChild"].alias("right"), n["rawCount"].alias("rows"), n["gain"].alias("gain"),
        n["split"]["featureIndex"].alias("feature"),
        F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        F.when(total > 0, F.get(n["impurityStats"], F.lit(1)) / total).otherwise(0.0).alias("share"))


def grown_nodes(nodes: pd.DataFrame) -> pd.DataFrame:
    """What :func:`read_nodes` gives when grown nodes are saved."""
    total = nodes["zeros"] + nodes["ones"]
    return nodes.assign(rows=total.astype(np.int64), share=nodes["ones"] / total.where(total > 0, 1.0))


class Shape:
    """The trees of a node table (rows by tree, then node, numbered from 0 in each) as arrays over all nodes."""

    def __init__(self, nodes: pd.DataFrame):
        tree = nodes["tree"].to_numpy()
        self.roots = np.flatnonzero(np.diff(tree, prepend=tree[:1] - 1))
        self.of = np.repeat(np.arange(len(self.roots)), np.diff(self.roots, append=len(tree)))  # place of a node's tree
        self.left, self.right = (np.where(own >= 0, own + self.roots[self.of], -1) for own in (
            nodes[c].to_numpy(dtype=np.int64) for c in ("left", "right")))
        self.inner = self.left >= 0
        self.leaf = np.cumsum(~self.inner) - 1  # leaves are numbered left to right in their tree
        self.leaf -= (self.leaf + self.inner)[self.roots][self.of]
        self.depth = np.zeros(len(tree), dtype=np.int64)
        self.levels = []  # the nodes with children, level by level
        at = self.roots
        while len(at := at[self.inner[at]]):
            self.levels.append(at)
            at = np.concatenate([self.left[at], self.right[at]])
            self.depth[at] = len(self.levels)


def splits(nodes: pd.DataFrame, point: dict, shape: Shape | None = None) -> np.ndarray:
    """Which nodes of one or more trees (rows by tree, in node order, numbered from 0) split under a grid point."""
    shape = shape or Shape(nodes)
    rows = nodes["rows"].to_numpy()
    total = rows[shape.roots][shape.of]
    ok = shape.inner & (rows >= np.ceil(point["min_samples_split"] * total)) & (
        nodes["gain"].to_numpy() * rows / total >= point["min_impurity_decrease"])
    for at in shape.levels:
        # A node below one that does not split is never reached.
        for child in (shape.left[at], shape.right[at]):
            ok[child] &= ok[at]
    return ok & (shape.depth < point["max_depth"])


def stop_table(nodes: pd.DataFrame, points: list[dict], shape: Shape) -> np.ndarray:
    """[point, tree, leaf] → the share of label 1 where the point stops (0 beyond a tree's leaves)."""
    share, leaves = nodes["share"].to_numpy(), np.flatnonzero(~shape.inner)
    table = np.zeros((len(points), len(shape.roots), shape.leaf.max() + 1))
    for k, point in enumerate(points):
        ok, stop = splits(nodes, point, shape), np.arange(len(share))
        for at in shape.levels:
            for child in (shape.left[at], shape.right[at]):
                stop[child] = np.where(ok[at], child, stop[at])
        table[k, shape.of[leaves], shape.leaf[leaves]] = share[stop[leaves]]
    return table


def stop_shares(nodes: DataFrame, points: list[dict]) -> DataFrame:
    """tree, leaf, shares: for each leaf (numbered left to right) the share of label 1 where each point stops."""

    def stops(tree: pd.DataFrame) -> pd.DataFrame:
        tree = tree.sort_values("node")
        table = stop_table(tree, points, Shape(tree))[:, 0]
        return pd.DataFrame({"tree": int(tree["tree"].iloc[0]), "leaf": range(table.shape[1]), "shares": table.T.tolist()})

    # A tree has at most 2 / min_samples_leaf nodes.
    return nodes.groupBy("tree").applyInPandas(stops, "tree int, leaf int, shares array<double>")


class StopShares:
    """The trees of a forest as arrays, and [point, tree, leaf] → share of label 1; as large as the model."""

    def __init__(self, nodes: pd.DataFrame, table: np.ndarray, shape: Shape):
        # Points of one table have one score: the table of the first of them, and its place for every point.
        self.first, self.place = [], []
        for k in range(len(table)):
            same = next((j for j, f in enumerate(self.first) if np.array_equal(table[k], table[f])), len(self.first))
            if same == len(self.first):
                self.first.append(k)
            self.place.append(same)
        self.table = table[self.first]
        feature = np.where(shape.inner, nodes["feature"], 0).astype(np.int64)
        threshold = nodes["threshold"].to_numpy(np.float64)
        base, own = shape.roots[shape.of], np.arange(len(feature))
        child = np.stack([np.where(shape.inner, c, own) - base for c in (shape.left, shape.right)], axis=1)
        self.trees = []
        for lo, hi in zip(shape.roots, [*shape.roots[1:], len(own)]):
            self.trees.append((int(shape.depth[lo:hi].max()), feature[lo:hi], threshold[lo:hi], child[lo:hi].ravel(),
                               shape.leaf[lo:hi], np.flatnonzero(shape.inner[lo:hi])))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """[distinct table, row] → mean share over the trees; ``x`` has a row a feature.  NaN goes right."""
        out, n = np.zeros((len(self.table), x.shape[1])), x.shape[1]
        x = np.ascontiguousarray(x)
        row, low = np.arange(n), {}
        for t, (depth, feature, threshold, child, leaf, inner) in enumerate(self.trees):
            if len(inner) <= DENSE * depth:
                # Few nodes: each compares all rows, from the last to the root.
                found = list(leaf)
                for node in inner[::-1]:
                    cut = feature[node], threshold[node]
                    if cut not in low:
                        low[cut] = x[cut[0]] <= cut[1]
                    found[node] = np.where(low[cut], found[child[2 * node]], found[child[2 * node + 1]])
                at = found[0]
            else:
                at = np.zeros(n, dtype=np.int64)
                for _ in range(depth):
                    at = child.take(at * 2 + ~(x.ravel().take(feature.take(at) * n + row) <= threshold.take(at)))
                at = leaf.take(at)
            for k, shares in enumerate(self.table[:, t]):
                out[k] += shares.take(at)
        return out / len(self.trees)


def share_table(nodes: DataFrame | pd.DataFrame, points: list[dict]) -> StopShares:
    """Worked out where the table is to be broadcast from: a forest has at most 2 / least leaf share nodes a tree."""
    table = (nodes if isinstance(nodes, pd.DataFrame) else nodes.toPandas()).sort_values(["tree", "node"], ignore_index=True)
    shape = Shape(table)
    return StopShares(table, stop_table(table, points, shape), shape)


def mean_shares(spark: SparkSession, tables: list[StopShares], cols) -> Column:
    """An array of the mean shares over the trees for each point, table after table."""
    shared = spark.sparkContext.broadcast(tables)

    @F.arrow_udf("array<double>")
    def scores(*columns: pa.Array) -> pa.Array:
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in columns])
        per_point = np.concatenate([t.scores(x)[t.place] for t in shared.value])
        ends = np.arange(x.shape[1] + 1, dtype=np.int32) * len(per_point)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(per_point.T.ravel()))

    return scores(*[F.col(c).cast("double") for c in cols])


def fold_mean_shares(spark: SparkSession, tables: dict[int, list[StopShares]], fold: str, cols) -> Column:
    """An array of the mean shares by the tables of the row's fold, for the first of equal points: one pass for all folds."""
    shared = spark.sparkContext.broadcast(tables)

    @F.arrow_udf("array<double>")
    def scores(folds: pa.Array, *columns: pa.Array) -> pa.Array:
        x, folds = np.stack([c.to_numpy(zero_copy_only=False) for c in columns]), folds.to_numpy(zero_copy_only=False)
        lengths = np.zeros(len(folds), dtype=np.int32)
        found = []
        for k, of in shared.value.items():
            mine = np.flatnonzero(folds == k)
            if len(mine):
                found.append((mine, np.concatenate([t.scores(x[:, mine]) for t in of])))
                lengths[mine] = len(found[-1][1])
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        flat = np.empty(ends[-1])
        for mine, per_point in found:
            flat[ends[mine] + np.arange(len(per_point))[:, None]] = per_point
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    return scores(F.col(fold), *[F.col(c).cast("double") for c in cols])


def point_scores(model: RandomForestClassificationModel | None, table: StopShares, df: DataFrame, cols=FEATURE_COLS) -> DataFrame:
    """``df`` with ``scores``: per point the mean share over the trees of ``table`` (those of ``model``, if it is given)."""
    if model is not None and model.getNumTrees != len(table.trees):
        raise ValueError("the table is of another forest")
    return df.select("*", mean_shares(df.sparkSession, [table], cols).alias("scores"))


def grid_points(grid: dict) -> list[dict]:
    """Every point, those that share a forest next to each other."""
    return [{"min_samples_leaf": leaf, "max_depth": depth, "min_samples_split": split,
             "min_impurity_decrease": grid["min_impurity_decrease"], "n_trees": grid["n_trees"]}
            for leaf, depth, split in product(grid["min_samples_leaf"], grid["max_depth"], grid["min_samples_split"])]


def out_of_fold_variants(train: DataFrame, grid: dict, folder: str, fold: str = "fold", n_folds: int = 5,
                         cols=FEATURE_COLS) -> tuple[DataFrame, DataFrame]:
    """Scores of every row, once for the points that cut a fold's forest alike; a forest a (leaf share, fold).

    Forests are kept under ``folder``.  The first table has variant, fold, label, score; the second point, fold, variant.
    ``point`` is the place in :func:`grid_points`, ``variant`` the first point of the same scores.
    """
    spark, leaves = train.sparkSession, grid["min_samples_leaf"]
    points = grid_points(grid)
    by_leaf = [[k for k, p in enumerate(points) if p["min_samples_leaf"] == leaf] for leaf in leaves]
    mildest = max(grid["max_depth"]), min(grid["min_samples_split"]), grid["min_impurity_decrease"]

    def one(k: int) -> list[pd.DataFrame]:
        # The forests of one fold, whatever their leaf share, grow on the same cells, together.
        grown = grow_forests(cells[k], grid["n_trees"], [growing_rule(leaf, *mildest) for leaf in leaves], SEED)
        depth, split, decrease = mildest
        # Saving is many small jobs: beside the growing and scoring, which need the nodes only.
        saves.extend(savers.apply_async(grow, (train, grid["n_trees"], leaf, depth), {
            "cols": cols, "min_samples_split": split, "min_impurity_decrease": decrease, "nodes": nodes,
            "folder": f"{folder}/forest-{leaf}-{k}"}) for leaf, nodes in zip(leaves, grown))
        return grown

    saves: list = []
    with ThreadPool(PARALLEL) as pool, ThreadPool(2 * PARALLEL) as savers:
        roots = pool.apply_async(bare_roots, (spark, grid["n_trees"], len(cols)))  # once, not by each thread
        cells = fold_cells(_labelled(train, cols, fold), LABEL, fold, list(range(n_folds)))
        roots.get()
        tables, variants, same = {}, [], []
        for k, grown in enumerate(pool.map(one, range(n_folds), chunksize=1)):
            tables[k] = [share_table(grown_nodes(nodes), [points[p] for p in mine]) for nodes, mine in zip(grown, by_leaf)]
            variants.append([mine[first] for t, mine in zip(tables[k], by_leaf) for first in t.first])
            same += [(p, k, mine[t.first[at]]) for t, mine in zip(tables[k], by_leaf) for p, at in zip(mine, t.place)]
        rows = train.where(F.col(fold).isin(list(range(n_folds)))).select(
            F.col(fold).alias("fold"), LABEL, F.posexplode(fold_mean_shares(spark, tables, fold, cols)).alias("at", "score"))
        of_fold = F.get(F.array(*[F.array(*map(F.lit, v)) for v in variants]), F.col("fold").cast("int"))
        scored = f"{folder}/scores-all"
        rows.select(F.get(of_fold, F.col("at")).alias("variant"), "fold", LABEL, "score").write.mode("overwrite").parquet(scored)
        for save in saves:
            save.get()
    return spark.read.parquet(scored), spark.createDataFrame(same, "point int, fold int, variant int")


def out_of_fold_scores(train: DataFrame, grid: dict, folder: str, fold: str = "fold", n_folds: int = 5,
                       cols=FEATURE_COLS) -> DataFrame:
    """point, fold, label, score of every row and grid point."""
    return every_point(*out_of_fold_variants(train, grid, folder, fold, n_folds, cols))


def every_point(scores: DataFrame, same: DataFrame) -> DataFrame:
    """point, fold, label, score from the two tables of :func:`out_of_fold_variants`."""
    # A row a point and fold: a proven bound.
    return scores.join(F.broadcast(same), ["variant", "fold"]).select("point", "fold", LABEL, "score")


def grid_metrics(scores: DataFrame, grid: dict, same: DataFrame | None = None) -> DataFrame:
    """A row a grid point: its parameters, mean and deviation of the folds' area under the ROC curve, and its rank.

    With ``same``, ``scores`` has the variants of :func:`out_of_fold_variants`, each measured once.
    """
    points = scores.sparkSession.createDataFrame(
        [(k, p["max_depth"], p["min_samples_split"], p["min_samples_leaf"]) for k, p in enumerate(grid_points(grid))],
        "point int, max_depth int, min_samples_split double, min_samples_leaf double")
    if same is None:
        per_fold = roc_auc(scores, by=["point", "fold"])
    else:
        per_fold = roc_auc(scores, by=["variant", "fold"]).join(F.broadcast(same), ["variant", "fold"])
    means = per_fold.groupBy("point").agg(F.avg("roc_auc").alias("roc_auc"), F.stddev_pop("roc_auc").alias("roc_auc_std"))
    return points.join(means, "point")


class CutForest:
    """A saved forest and the grid point that cuts it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        meta = spark.read.text(f"{folder}/point").first()["value"]
        self.point, self.cols = json.loads(meta)["point"], json.loads(meta)["cols"]

    @staticmethod
    def fit(train: DataFrame, point: dict, folder: str, cols=FEATURE_COLS) -> CutForest:
        grow(train, point["n_trees"], point["min_samples_leaf"], point["max_depth"], cols=cols,
             min_samples_split=point["min_samples_split"], min_impurity_decrease=point["min_impurity_decrease"],
             folder=f"{folder}/forest")
        return CutForest._with_point(train.sparkSession, point, folder, cols)

    @cached_property
    def model(self) -> RandomForestClassificationModel:
        return RandomForestClassificationModel.load(f"{self.folder}/forest")

    @staticmethod
    def write(spark: SparkSession, model, point: dict, folder: str, cols=FEATURE_COLS) -> CutForest:
        model.write().overwrite().save(f"{folder}/forest")
        return CutForest._with_point(spark, point, folder, cols)

    @staticmethod
    def _with_point(spark: SparkSession, point: dict, folder: str, cols) -> CutForest:
        meta = json.dumps({"point": point, "cols": list(cols)})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/point")
        return CutForest(spark, folder)

    def save(self, folder: str) -> None:
        CutForest.write(self.spark, self.model, self.point, folder, self.cols)

    def nodes(self) -> DataFrame:
        return read_nodes(self.spark, f"{self.folder}/forest")

    def probability(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability``: of label 1."""
        scored = point_scores(None, share_table(self.nodes(), [self.point]), df, self.cols)
        return scored.withColumn("probability", F.col("scores")[0]).drop("scores")

    def predict(self, df: DataFrame, keep=("click_id",)) -> DataFrame:
        """Ids, probability of label 1 and the predicted label (1 above a half)."""
        ids = [c for c in keep if c in df.columns]
        return self.probability(df).select(*ids, "probability", predicted(F.col("probability")))

    def importances(self, top: int = 10) -> DataFrame:
        """The features of most impurity decrease by the splits that the point leaves; all features sum to 1."""
        point, cols = self.point, self.cols

        def decrease(tree: pd.DataFrame) -> pd.DataFrame:
            tree = tree.sort_values("node")
            tree = tree[splits(tree, point)]
            by_feature = (tree["gain"] * tree["rows"]).groupby(tree["feature"]).sum()
            return pd.DataFrame({"at": by_feature.index, "share": (by_feature / by_feature.sum()).to_numpy()})

        per_tree = self.nodes().groupBy("tree").applyInPandas(decrease, "at int, share double")
        found = per_tree.groupBy("at").agg(F.sum("share").alias("share"))
        total = found.agg(F.sum("share")).first()[0]  # null if no tree splits: all features are 0
        every = self.spark.createDataFrame(list(enumerate(cols)), "at int, feature string").join(found, "at", "left")
        return every.select("feature", F.coalesce(F.col("share") / F.lit(total), F.lit(0.0)).alias("importance")).orderBy(
            F.col("importance").desc(), "feature").limit(top)


def predicted(probability: Column) -> Column:
    return (probability > 0.5).cast("int").alias("predicted")

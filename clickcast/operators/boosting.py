"""Boosted trees for a label 0/1 with shrinkage, leaf penalty, least split loss and column sampling.

``pyspark.ml`` boosts without a leaf penalty and without column samples per tree and level,
and its rounds cost seconds of jobs each, however few rows there are.  A round needs the whole
round before, but models are many: so Spark deals the fits, and a task makes one, or several that begin alike.

A fit takes all rows.  Columns are cut into bins at exact quantiles, and rows of equal bins become one cell with
counts (a Spark aggregate): they go down every tree together, so a fit on cells is the fit on their rows.  Rows
held out are cells without weight, which go down with the others and are scored on the way.  A task holds
the cells of its fold, a byte or two a column and some 130 bytes of sums and work arrays each.

A fitted model is a node table; rows are scored where they are, all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickcast.operators.evaluate import roc_auc
from clickcast.operators.features import HOUR_FLAG_COLS, NUMERIC_COLS
from clickcast.operators.quantiles import around_steps, value_counts
from clickcast.operators.sampling import SEED, stratum_rank
from clickcast.session import materialised

FEATURE_COLS = NUMERIC_COLS + HOUR_FLAG_COLS
LABEL = "is_attributed"
MAX_BINS = 256
NODES = ("tree int, node int, left int, right int, feature int, threshold double, grad double, hess double, "
         "loss double, weight double")

# The grid of the original search.  A step is never bounded (max_delta_step 0).
GRID = {"rounds": 300, "max_depth": [8, 32, 64], "step": 0.1, "gamma": 0.01, "columns_per_tree": 0.8,
        "columns_per_level": 0.2, "reg_lambda": 0.5}
#: Least sum of second derivatives in a child.
MIN_CHILD = 1.0
EPS = 1e-6
#: Sums (node, bin) of a column worked on at a time.
ROOM = 1 << 17
#: Cells moved down or scored at a time.
SLICE = 1 << 16
#: A column is summed without its most common bin if all others have at most one cell in so many.
SPARSE = 4
#: Nodes of a model that a task which scores rows holds at a time.
HELD_NODES = 2_000_000


def _cuts(values: np.ndarray) -> np.ndarray:
    return (values[:-1] + values[1:]) / 2


def bin_columns(x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Bins (a value is in bin b if it is above b of the cuts) and the cuts of each column."""
    cuts = []
    for col in x.T:
        values = np.unique(col[~np.isnan(col)])
        if len(values) > MAX_BINS:
            values = np.unique(np.quantile(col[~np.isnan(col)], np.linspace(0, 1, MAX_BINS + 1)))
        cuts.append(_cuts(values))
    return [np.searchsorted(c, col).astype(code_type(c)) for c, col in zip(cuts, x.T)], cuts


def _steps(values: pd.DataFrame) -> np.ndarray:
    """All values of a column, or (if there are many) their quantiles, from :func:`around_steps`."""
    v, upto, total = values["_v"].to_numpy(), values["_upto"].to_numpy(), values["_total"].iloc[0]
    if values["_values"].iloc[0] <= MAX_BINS:
        return v
    place = np.linspace(0, 1, MAX_BINS + 1) * (total - 1)
    low, high = (v[np.searchsorted(upto, rank, side="right")] for rank in (np.floor(place), np.ceil(place)))
    part = place - np.floor(place)  # as numpy's quantiles
    return np.unique(np.where(part < 0.5, low + (high - low) * part, high - (high - low) * (1 - part)))


def code_type(cuts: np.ndarray) -> str:
    """The numpy type of a column's bins."""
    return "<u1" if len(cuts) < 256 else "<u2"


def cell_type(cuts: list[np.ndarray]) -> np.dtype:
    """A cell as bytes: the bins of all columns."""
    return np.dtype([(str(j), code_type(c)) for j, c in enumerate(cuts)])


def fold_cuts(rows: DataFrame, cols, fold: str, left_out: list[int | None]) -> list[list[np.ndarray]]:
    """For each fold left out (None: none) the cuts that :func:`bin_columns` finds in the rows of all others."""
    known = {c: F.when(~F.isnan(c), F.col(c)) for c in cols}
    sizes = rows.agg(F.lit(0), *[F.approx_count_distinct(known[c]).alias(c) for c in cols]).first()
    few = [c for c in cols if sizes[c] <= MAX_BINS / 2]  # sizes are near, not exact
    many = [c for c in cols if c not in few]
    sets = rows.groupBy(fold).agg(F.lit(0), *[F.collect_set(known[c]).alias(c) for c in few]).collect()
    found = {(c, at): np.unique([v for r in sets if k is None or r[0] != k for v in r[c]])
             for c in few for at, k in enumerate(left_out)}
    if many:
        by = ["_c", "_at"]
        long = rows.select(F.col(fold).alias("_f"), F.posexplode(F.array(*[known[c] for c in many])).alias("_c", "_x"))
        of_others = F.explode(F.array_compact(F.array(*[
            F.lit(at) if k is None else F.when(~F.col("_f").eqNullSafe(k), at) for at, k in enumerate(left_out)])))
        counts = value_counts(value_counts(long.where("_x IS NOT NULL"), "_x", by=["_c", "_f"]).withColumn("_at", of_others),
                              "_v", by=by, weight="_n")
        for (c, at), values in around_steps(counts, MAX_BINS, by).toPandas().sort_values("_v").groupby(by):
            found[many[c], at] = _steps(values)
    return [[_cuts(found.get((c, at), np.empty(0))) for c in cols] for at in range(len(left_out))]


def fold_cells(train: DataFrame, cols, fold: str | None, left_out: list[int | None]):
    """Cells, their number and the cuts, for each fold left out (None: none).

    Cells are rows at, cell, zeros, ones (training rows by label), held_zeros, held_ones (rows left out).
    """
    rows = train.select((F.col(fold) if fold else F.lit(None)).cast("int").alias("_f"), F.col(LABEL).cast("int").alias(LABEL),
                        *[F.col(c).cast("double").alias(c) for c in cols])
    cuts = fold_cuts(rows, cols, "_f", left_out)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds, y, *x = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not np.isin(y, (0, 1)).all():
                raise ValueError("boosting needs labels of 0 or 1")
            made: dict[tuple[int, bytes], np.ndarray] = {}
            for at, k in enumerate(left_out):
                cells = np.empty(len(y), dtype=cell_type(cuts[at]))
                for j, cut in enumerate(cuts[at]):
                    key = j, cut.tobytes()
                    if key not in made:
                        made[key] = np.searchsorted(cut, x[j])
                    cells[str(j)] = made[key]
                kind = y.astype(np.int32) + (2 * (folds == k) if k is not None else 0)
                ends = np.arange(len(y) + 1, dtype=np.int32) * cells.itemsize
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(y), at, dtype=np.int32)),
                     pa.Array.from_buffers(pa.binary(), len(y), [None, pa.py_buffer(ends), pa.py_buffer(cells.tobytes())]),
                     pa.array(kind.astype(np.int32))], names=["at", "cell", "kind"])

    cells = materialised(rows.mapInArrow(code, "at int, cell binary, kind int").groupBy("at", "cell").agg(
        *[F.count_if(F.col("kind") == k).alias(name) for k, name in enumerate(COUNTS)]), "boosting-cells")
    sizes = dict(cells.groupBy("at").count().collect())
    return cells, [sizes.get(at, 0) for at in range(len(left_out))], cuts


COUNTS = ("zeros", "ones", "held_zeros", "held_ones")


class Cells:
    """Binned rows as columns, each with its number of training rows and those of label 1."""

    def __init__(self, codes: list[np.ndarray], widths: list[int], n: np.ndarray, ones: np.ndarray):
        self.codes, self.widths, self.n, self.ones = codes, widths, n, ones
        self.sparse, self.top = [], np.full(len(codes), -1)
        for f, (code, width) in enumerate(zip(codes, widths)):
            counts = np.bincount(code, minlength=width)
            top = int(counts.argmax())
            few = (len(code) - counts[top]) * SPARSE <= len(code)
            others = np.flatnonzero(code != top) if few else None
            self.sparse.append((top, others, code[others]) if few else None)
            if few:
                self.top[f] = top

    def __len__(self) -> int:
        return len(self.n)


def _sums(slot: np.ndarray, code: np.ndarray, grad: np.ndarray, hess: np.ndarray, nodes: int, width: int):
    """(first node, [node, bin] sums of both) for ranges of nodes; a slot of -1 is in none."""
    step = max(1, ROOM // width)
    if nodes <= step:
        key = (slot + 1) * np.int64(width) + code  # those in none come first
        yield 0, *(np.bincount(key, w, (nodes + 1) * width)[width:].reshape(nodes, width) for w in (grad, hess))
        return
    order = np.argsort(slot)
    ends = np.searchsorted(slot[order], np.arange(0, nodes + step, step))
    for lo, (begin, end) in zip(range(0, nodes, step), zip(ends, ends[1:])):
        mine, here = order[begin:end], min(step, nodes - lo)
        key = (slot[mine] - lo) * np.int64(width) + code[mine]
        yield lo, *(np.bincount(key, w[mine], here * width).reshape(here, width) for w in (grad, hess))


def best_splits(cells: Cells, part: np.ndarray, place: np.ndarray, rows: np.ndarray | None, grad: np.ndarray,
                hess: np.ndarray, all_g: np.ndarray, all_h: np.ndarray, used: np.ndarray, lam: float) -> dict[str, np.ndarray]:
    """Per node of a level its best split: gain (EPS if it has none), feature, cut, and the sums of the rows below.

    ``place`` is the node of each part (-1: none of them), ``rows`` are the cells to look at (None: all).
    Columns are taken one by one, each as wide as it has bins.
    """
    nodes = len(all_g)
    best = {"gain": np.full(nodes, EPS), "feature": np.full(nodes, -1), "cut": np.full(nodes, -1),
            "below_g": np.zeros(nodes), "below_h": np.zeros(nodes)}
    own = None
    for f in used:
        width = cells.widths[f]
        if width == 1:
            continue
        if cells.sparse[f]:
            top, others, code = cells.sparse[f]
            found = _sums(place.take(part.take(others)), code, grad.take(others), hess.take(others), nodes, width)
        else:
            if own is None:
                own = (place.take(part), grad, hess) if rows is None else (place.take(part.take(rows)), grad.take(rows), hess.take(rows))
            code = cells.codes[f] if rows is None else cells.codes[f].take(rows)
            found = _sums(own[0], code, own[1], own[2], nodes, width)
        for lo, sum_g, sum_h in found:
            here = slice(lo, lo + len(sum_g))
            g, h = all_g[here, None], all_h[here, None]
            if cells.sparse[f]:
                sum_g[:, top], sum_h[:, top] = g[:, 0] - sum_g.sum(axis=1), h[:, 0] - sum_h.sum(axis=1)
            # All bins below is no cut.
            below_g, below_h = sum_g[:, :-1].cumsum(axis=1), sum_h[:, :-1].cumsum(axis=1)
            above_g, above_h = g - below_g, h - below_h
            gain = below_g ** 2 / (below_h + lam) + above_g ** 2 / (above_h + lam) - g ** 2 / (h + lam)
            gain[(below_h < MIN_CHILD) | (above_h < MIN_CHILD)] = -np.inf
            cut = gain.argmax(axis=1)
            better = np.flatnonzero(gain[np.arange(len(cut)), cut] > best["gain"][here])
            cut = cut[better]
            for name, value in (("gain", gain[better, cut]), ("feature", f), ("cut", cut),
                                ("below_g", below_g[better, cut]), ("below_h", below_h[better, cut])):
                best[name][lo + better] = value
    return best


def grow_tree(cells: Cells, grad: np.ndarray, hess: np.ndarray, point: dict, rnd: np.random.Generator):
    """(node columns, leaf of each cell, whether a greater depth could change the tree or the draws after it).

    Levels are grown whole, then splits of too little loss are taken back.  The cells of a node have a part in common; when it
    splits, those of one child keep it, so that where a column has one bin for most cells only the others are touched.
    """
    lam, columns = point["reg_lambda"], len(cells.codes)
    of_tree = rnd.choice(columns, max(1, math.ceil(point["columns_per_tree"] * columns)), replace=False)
    left, feature, cut = (np.array([-1], dtype=np.int32) for _ in range(3))
    loss, g, h = np.zeros(1), np.array([grad.sum()]), np.array([hess.sum()])
    part, rows, looked_at = np.zeros(len(cells), dtype=np.int32), None, h[0]
    node_of, part_of = np.zeros(1, dtype=np.int32), np.zeros(1, dtype=np.int32)  # of each part; of each node
    level, splits, deeper = np.array([0]), [], False
    for _ in range(point["max_depth"]):
        used = rnd.choice(of_tree, max(1, math.ceil(point["columns_per_level"] * len(of_tree))), replace=False)
        level = level[h[level] >= 2 * MIN_CHILD]  # no split of a lighter node leaves both children heavy enough
        if not len(level):
            break
        place = np.full(len(node_of), -1, dtype=np.int32)
        place[part_of[level]] = np.arange(len(level))
        if h[level].sum() < 0.6 * looked_at:
            rows, looked_at = np.flatnonzero(place.take(part) >= 0), h[level].sum()
        best = best_splits(cells, part, place, rows, grad, hess, g[level], h[level], used, lam)
        found = np.flatnonzero(best["feature"] >= 0)
        if not len(found):
            break
        split, first = level[found], len(left)
        splits.append(split)
        left, feature, cut, part_of = (np.concatenate([c, np.full(2 * len(found), -1, dtype=np.int32)])
                                       for c in (left, feature, cut, part_of))
        level = np.arange(first, first + 2 * len(found))
        left[split], feature[split], cut[split] = level[::2], best["feature"][found], best["cut"][found]
        loss = np.concatenate([loss, np.zeros(len(level))])
        loss[split] = best["gain"][found]
        below_g, below_h = best["below_g"][found], best["below_h"][found]
        g, h = (np.concatenate([c, np.stack([below, c[split] - below], axis=1).ravel()])
                for c, below in ((g, below_g), (h, below_h)))
        # The child of the most common bin keeps the part, or the lower one.
        keeps = left[split] + (cells.top[feature[split]] > cut[split])
        leaves = 2 * left[split] + 1 - keeps
        old, new = part_of[split], np.arange(len(node_of), len(node_of) + len(split), dtype=np.int32)
        _part_off(cells, part, rows, old, new, feature[split], cut[split])
        node_of = np.concatenate([node_of, leaves.astype(np.int32)])
        node_of[old] = keeps
        part_of[keeps], part_of[leaves] = old, new
    else:
        deeper = bool(len(level))
    parent = np.arange(len(left))
    for split in reversed(splits):
        low = left[split]
        back = split[(left[low] < 0) & (left[low + 1] < 0) & (loss[split] < point["gamma"])]
        parent[left[back]] = parent[left[back] + 1] = back
        left[back] = feature[back] = cut[back] = -1
    while (parent != parent[parent]).any():
        parent = parent[parent]
    weight = -g / (h + lam) * point["step"]
    tree = {"left": left, "right": np.where(left >= 0, left + 1, -1), "feature": feature, "cut": cut, "grad": g, "hess": h,
            "loss": loss, "weight": weight}
    return tree, parent[node_of].astype(np.int32).take(part), deeper


def _part_off(cells: Cells, part: np.ndarray, rows: np.ndarray | None, old: np.ndarray, new: np.ndarray, feature: np.ndarray,
              cut: np.ndarray) -> None:
    """Gives the cells of the child that does not keep its part the new one: ``part`` is changed."""
    size = new[-1] + 1
    by, at, to = np.full(size, -1, dtype=np.int8 if len(cells.codes) < 128 else np.int32), *np.zeros((2, size), dtype=np.int32)
    by[old], at[old], to[old] = feature, cut, new
    dense = []
    for f in np.unique(feature):
        if not cells.sparse[f]:
            dense.append(f)
            continue
        top, others, code = cells.sparse[f]
        of = part.take(others)
        here = np.flatnonzero(by.take(of) == f)
        of, bound = of.take(here), at.take(of.take(here))
        off = np.flatnonzero((code.take(here) > bound) != (top > bound))
        part[others.take(here.take(off))] = to.take(of.take(off))
    for lo in range(0, len(part) if rows is None else len(rows), SLICE) if dense else ():
        mine = slice(lo, lo + SLICE) if rows is None else rows[lo:lo + SLICE]
        of = part[mine]
        split_by = by.take(of)
        for f in dense:
            here = np.flatnonzero(split_by == f)
            if len(here):
                was = of.take(here)
                of[here] = np.where(cells.codes[f][mine].take(here) > at.take(was), to.take(was), was)
        part[mine] = of


def grow_trees(cells: Cells, points: list[dict], seed: int = SEED) -> Iterator[tuple[int, int, dict | None, np.ndarray]]:
    """(place of the point, number, tree, margins of all cells after it) for each tree of each point.

    The points differ in their greatest depth and ascend by it.  A deeper fit is the one before up to the first tree
    that its depth has cut, and goes on from there; without such a tree it has no trees of its own, and one
    entry (its rounds, None) with the same margins.
    """
    n, ones = cells.n.astype(np.float64), cells.ones.astype(np.float64)
    begin: tuple | None = (0, np.random.default_rng(seed).bit_generator.state, np.zeros(len(cells)))
    for place, point in enumerate(points):
        if begin is None:
            yield place, point["rounds"], None, margin
            continue
        first, state, margin = begin
        rnd, begin = np.random.default_rng(), None
        rnd.bit_generator.state = state
        for number in range(first, point["rounds"]):
            state = rnd.bit_generator.state
            p = 1 / (1 + np.exp(-margin))
            tree, leaf, deeper = grow_tree(cells, n * p - ones, n * np.maximum(p * (1 - p), 1e-16), point, rnd)
            if deeper and begin is None and place + 1 < len(points):
                begin = number, state, margin.copy()
            margin += tree["weight"][leaf]
            yield place, number, tree, margin


def node_table(tree: dict, number: int, cuts: list[np.ndarray]) -> pd.DataFrame:
    """The rows of one tree, with thresholds instead of bins."""
    first = np.cumsum([0, *map(len, cuts)])
    inner, every = tree["feature"] >= 0, np.concatenate([*cuts, [np.nan]])
    place = np.where(inner, first[tree["feature"]] + tree["cut"], len(every) - 1)
    table = pd.DataFrame({c: v for c, v in tree.items() if c != "cut"} | {"threshold": every[place]})
    return table.assign(tree=number, node=range(len(table)))[[c.split()[0] for c in NODES.split(", ")]]


def boost(x: np.ndarray, y: np.ndarray, point: dict, seed: int = SEED) -> pd.DataFrame:
    """The node table of a model."""
    codes, cuts = bin_columns(x)
    cells = Cells(codes, [len(c) + 1 for c in cuts], np.ones(len(y)), y)
    return pd.concat([node_table(tree, number, cuts) for _, number, tree, _ in grow_trees(cells, [point], seed)],
                     ignore_index=True)


class Trees:
    """A node table (of some trees that follow each other) ready to score rows."""

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values(["tree", "node"])
        tree = nodes["tree"].to_numpy()
        self.roots = np.flatnonzero(np.diff(tree, prepend=tree[:1] - 1))
        base = np.repeat(self.roots, np.diff(self.roots, append=len(tree)))
        self.left, self.right = (np.where(nodes[c] >= 0, nodes[c] + base, -1).astype(np.int32) for c in ("left", "right"))
        self.feature, self.threshold = nodes["feature"].to_numpy(np.int16), nodes["threshold"].to_numpy()
        self.weight = nodes["weight"].to_numpy()

    def leaves(self, x: np.ndarray, root: int) -> np.ndarray:
        at = np.full(len(x), root)
        rows = np.arange(len(x)) if self.left[root] >= 0 else np.empty(0, dtype=np.int64)
        while len(rows):
            node = at[rows]
            at[rows] = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            rows = rows[self.left[at[rows]] >= 0]
        return at

    def margin(self, x: np.ndarray) -> np.ndarray:
        return sum(self.weight[self.leaves(x, root)] for root in self.roots)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def grid_points(grid: dict) -> list[dict]:
    return [{**grid, "max_depth": depth} for depth in grid["max_depth"]]


def bounded_rows(train: DataFrame, max_rows: int, id_col: str = "click_id") -> DataFrame:
    """At most ``max_rows`` rows of each label, the first by a seeded hash of their ids.  No query fits on a part."""
    return stratum_rank(train, LABEL, id_col=id_col).where(F.col("_rn") <= max_rows).drop("_rn", "_n", "_nmin")


def _read_cells(batches: Iterator[pa.RecordBatch], size: int, cuts: list[np.ndarray]) -> tuple[Cells, np.ndarray]:
    """The cells of one fold and [cell, label] → number of rows left out."""
    kind = cell_type(cuts)
    codes = [np.empty(size, dtype=code_type(c)) for c in cuts]
    counts, at = np.empty((4, size), dtype=np.int64), 0
    for batch in batches:
        mine = slice(at, at := at + batch.num_rows)
        found = np.frombuffer(b"".join(batch.column("cell").to_pylist()), dtype=kind)
        for j, code in enumerate(codes):
            code[mine] = found[str(j)]
        for k, name in enumerate(COUNTS):
            counts[k, mine] = batch.column(name).to_numpy()
    if at != size:
        raise ValueError("cells are missing")
    # An order of their own, whatever way they came: sums are added up alike, and cells of one flag are next to each other.
    order = np.lexsort(codes)
    for j, code in enumerate(codes):
        codes[j] = code[order]
    counts = counts[:, order]
    return Cells(codes, [len(c) + 1 for c in cuts], counts[0] + counts[1], counts[1]), counts[2:].T


def _keys(spark: SparkSession, n: int) -> list[int]:
    """Numbers that a repartition by hash sends to n partitions, one to each."""
    at = spark.range(100 * n + 100).select(F.expr(f"pmod(hash(id), {n})").alias("at"), "id")
    return [r["id"] for r in at.groupBy("at").agg(F.min("id").alias("id")).orderBy("at").collect()]


def _dealt(cells: DataFrame, jobs: list[int]) -> DataFrame:
    """The cells of each job's fold, a job a partition (if not, one after the other).  ``jobs`` has the jobs' folds."""
    keys = _keys(cells.sparkSession, len(jobs))
    of_fold = [F.array(*[F.struct(F.lit(job).alias("job"), F.lit(key).cast("long").alias("key"))
                         for job, (at, key) in enumerate(zip(jobs, keys)) if at == k]) for k in range(max(jobs) + 1)]
    dealt = cells.withColumn("_j", F.explode(F.get(F.array(*of_fold), F.col("at")))).select("_j.job", "_j.key", "cell", *COUNTS)
    return dealt.repartition(len(jobs), "key").sortWithinPartitions("job")


def _by_job(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """The jobs of a partition and the batches of each."""

    def parts() -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            job = batch.column("job").to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(job)) + 1).tolist(), len(job)]
            yield from ((int(job[lo]), batch.slice(lo, hi - lo)) for lo, hi in zip(ends, ends[1:]) if hi > lo)

    for job, mine in groupby(parts(), key=lambda part: part[0]):
        yield job, (batch for _, batch in mine)


def _alike(points: list[dict], size: int) -> list[list[int]]:
    """Places of points that one task fits, each going on from the one before, the deepest first.

    A tree shallower than the logarithm of the cells is nearly always cut by its depth: such points have little in common.
    """
    order = sorted(range(len(points)), key=lambda k: points[k]["max_depth"])
    deep = [k for k in order if points[k]["max_depth"] >= math.log2(max(size, 1))]
    return [*([deep] if deep else []), *[[k] for k in reversed(order) if k not in deep]]


def out_of_fold_scores(train: DataFrame, grid: dict, fold: str = "fold", n_folds: int = 5,
                       cols=FEATURE_COLS) -> DataFrame:
    """point, fold, label, score of every row of ``train``: a task a fold and its fits that begin alike."""
    points = grid_points(grid)
    cells, sizes, cuts = fold_cells(train, cols, fold, list(range(n_folds)))
    jobs = [(at, run) for run in _alike(points, max(sizes)) for at in range(n_folds)]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for job, parts in _by_job(batches):
            at, run = jobs[job]
            mine, held = _read_cells(parts, sizes[at], cuts[at])
            for place, number, _, margin in grow_trees(mine, [points[k] for k in run]):
                if number < points[run[place]]["rounds"] - 1:
                    continue
                score = 1 / (1 + np.exp(-margin))
                for lo in range(0, len(mine), SLICE):
                    n = held[lo:lo + SLICE]
                    label = np.repeat(np.tile(np.array([0, 1], dtype=np.int32), len(n)), n.ravel())
                    out = np.repeat(score[lo:lo + SLICE], n.sum(axis=1))
                    yield pa.RecordBatch.from_pydict({
                        "point": np.full(len(out), run[place], dtype=np.int32), "fold": np.full(len(out), at, dtype=np.int32),
                        LABEL: label, "score": out})

    return _dealt(cells, [at for at, _ in jobs]).mapInArrow(fit, f"point int, fold int, {LABEL} int, score double")


def grid_metrics(scores: DataFrame, grid: dict) -> DataFrame:
    """A row a grid point: depth, mean and deviation of the folds' area under the ROC curve."""
    points = scores.sparkSession.createDataFrame(
        [(k, p["max_depth"], p["rounds"], p["step"], p["gamma"], p["reg_lambda"], p["columns_per_tree"],
          p["columns_per_level"]) for k, p in enumerate(grid_points(grid))],
        "point int, max_depth int, rounds int, step double, gamma double, reg_lambda double, "
        "columns_per_tree double, columns_per_level double")
    means = roc_auc(scores, by=["point", "fold"]).groupBy("point").agg(
        F.avg("roc_auc").alias("roc_auc"), F.stddev_pop("roc_auc").alias("roc_auc_std"))
    return points.join(means, "point")


def fit_nodes(train: DataFrame, point: dict, cols=FEATURE_COLS) -> DataFrame:
    """The node table of one model, fitted in a task on all rows of ``train``."""
    cells, sizes, cuts = fold_cells(train, cols, None, [None])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _by_job(batches):
            mine, _ = _read_cells(parts, sizes[0], cuts[0])
            for _, number, tree, _ in grow_trees(mine, [point]):
                table = node_table(tree, number, cuts[0])
                yield pa.RecordBatch.from_pandas(table, schema=NODE_SCHEMA, preserve_index=False)

    return _dealt(cells, [0]).mapInArrow(fit, NODES)


NODE_SCHEMA = pa.schema([(c.split()[0], pa.int32() if c.endswith("int") else pa.float64()) for c in NODES.split(", ")])


def predict(spark: SparkSession, nodes: DataFrame, df: DataFrame, keep=("click_id",), cols=FEATURE_COLS) -> DataFrame:
    """Ids, probability of label 1 and the predicted label; the model is sent to every task in parts of some trees,
    of which a task (and the driver) holds one at a time."""
    names = ["tree", "node", "left", "right", "feature", "threshold", "weight"]
    parts, held = [], HELD_NODES
    for tree, n in nodes.groupBy("tree").count().orderBy("tree").collect():
        if held + n > HELD_NODES:
            parts.append([tree, tree])
            held = 0
        parts[-1][1], held = tree, held + n
    shared = [spark.sparkContext.broadcast(Trees(nodes.where(F.col("tree").between(*part)).select(*names).toPandas()))
              for part in parts]

    def score(batches: list[np.ndarray]) -> Iterator[pd.Series]:
        x = np.concatenate(batches)
        margin = np.zeros(len(x))
        for part in shared:
            trees = part.value
            for lo in range(0, len(x), SLICE):
                margin[lo:lo + SLICE] += trees.margin(x[lo:lo + SLICE])
            if len(shared) > 1:
                vars(part).pop("_value", None)  # read again when needed
        probability = pd.Series(1 / (1 + np.exp(-margin)))
        at = 0
        for batch in batches:
            yield probability.iloc[at:(at := at + len(batch))].reset_index(drop=True)

    @F.pandas_udf("double")
    def probability(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        waiting: list[np.ndarray] = []
        for columns in batches:
            waiting.append(np.stack([c.to_numpy(dtype=np.float64) for c in columns], axis=1))
            if sum(map(len, waiting)) >= 2 * SLICE:
                yield from score(waiting)
                waiting = []
        if waiting:
            yield from score(waiting)

    ids = [c for c in keep if c in df.columns]
    scored = df.select(*ids, probability(*[F.col(c).cast("double") for c in cols]).alias("probability"))
    return scored.withColumn("predicted", (F.col("probability") > 0.5).cast("int"))

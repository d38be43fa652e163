"""Random trees grown level by level: each level is one pass over the rows, one shuffle of sums.

Columns are cut into at most ``MAX_BINS`` bins.  Equal binned rows become one cell with a count
(a Spark aggregate), so a pass looks at cells, never more than there are rows.  A tree weighs a cell of
n rows by a Poisson(n) draw, as if each row were drawn by itself.  The draws follow from the seed, the
tree and the block of cells, so they are made again in each pass instead of being kept.

A task sums, for every open node, the weights by bin of the columns the node may split by; Spark
adds the tasks' sums by tree and picks each node's best split there.  The driver holds the
nodes: at most 2 / least leaf share a tree.

Forests of the same cells that differ in their rule grow together: a pass draws once for all of them and sums
once for trees that have split alike so far.  Folds are binned together, too.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickcast.session import materialised

MAX_BINS = 32
CODES = 2 * MAX_BINS  # a bin and a label in one byte
#: Cells of a block, whose work arrays a task holds at a time.
BLOCK_ROWS = 16_384
#: Trees whose sums a task adds up, each as its tasks' sums come in.
SUMMED_TREES = 32

_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def _poisson_table() -> np.ndarray:
    """Poisson(1) by the first 16 bits of a uniform number; 255 where more bits decide."""
    edges = np.arange(65_537) / 65_536
    low, high = (np.searchsorted(_POISSON, e, side="right") for e in (edges[:-1], np.nextafter(edges[1:], 0)))
    return np.where(low == high, low, 255).astype(np.uint8)


_BY_16_BITS = _poisson_table()


def draw_weights(counts: np.ndarray, rnd: np.random.Generator) -> np.ndarray:
    """A Poisson(n) draw for each count n; counts ascend."""
    single = int(np.searchsorted(counts, 2))
    bits = rnd.integers(0, 65_536, single, dtype=np.uint16)
    out = np.empty(len(counts), dtype=np.int64)
    out[:single] = _BY_16_BITS.take(bits)
    open_ = np.flatnonzero(out[:single] == 255)
    out[open_] = np.searchsorted(_POISSON, (bits[open_] + rnd.random(len(open_))) / 65_536, side="right")
    out[single:] = rnd.poisson(counts[single:])
    return out


def bin_cuts(rows: DataFrame, cols: list[str]) -> list[np.ndarray]:
    """Cuts of each column (a value is in bin b if it is above b of them): between all its values, or at quantiles."""
    return fold_cuts(rows.withColumn("_fold", F.lit(0)), cols, "_fold", [None])[0]


def _others(found: list, k: int | None) -> list:
    """Rows a fold, but for fold ``k``; all of them for None."""
    return [r for r in found if r[0] != k or k is None]


def _known(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def _sizes(cols: list[str]) -> list[Column]:
    return [F.approx_count_distinct(_known(c)).alias(c) for c in cols]


def fold_cuts(rows: DataFrame, cols: list[str], fold: str, left_out: list[int | None],
              sizes: list | None = None) -> list[list[np.ndarray]]:
    """For each fold left out (None: none) the cuts of the rows of all others: two passes over the rows for all.

    ``sizes`` are the folds' numbers of values (:func:`_sizes`), if counted already.
    """
    known = {c: _known(c) for c in cols}
    if sizes is None:
        sizes = rows.groupBy(fold).agg(*_sizes(cols)).collect()
    # A column of the rows of some folds has no fewer values than in one of them, no more than in all together.
    few = {(c, k) for c in cols for k in left_out if max((r[c] for r in _others(sizes, k)), default=0) <= 2 * MAX_BINS}
    # Sizes are near, not exact.
    many = [(c, k) for c in cols for k in left_out if sum(r[c] for r in _others(sizes, k)) > MAX_BINS / 2]
    at_ranks = [k / MAX_BINS for k in range(1, MAX_BINS)]
    with ThreadPool(1) as pool:
        found = pool.apply_async(rows.groupBy(fold).agg(F.lit(0), *[
            F.collect_set(known[c]).alias(c) for c in cols if any((c, k) in few for k in left_out)]).collect)
        quantiles = rows.agg(F.lit(0), *[
            F.percentile_approx(known[c] if k is None else F.when(F.col(fold) != k, known[c]), at_ranks, 1_000).alias(f"{c} {k}")
            for c, k in many]).first()
        sets = found.get()

    def cuts(c: str, k: int | None) -> np.ndarray:
        if (c, k) in few:
            values = np.unique([v for r in _others(sets, k) for v in r[c]])
            if len(values) <= MAX_BINS:
                return (values[:-1] + values[1:]) / 2
        return np.unique(quantiles[f"{c} {k}"])

    return [[cuts(c, k) for c in cols] for k in left_out]


def binned_blocks(rows: DataFrame, label: str, cols: list[str], fold: str, left_out: list[int | None],
                  cuts: list[list[np.ndarray]]) -> list[DataFrame]:
    """For each fold left out: cells, counts (both binary): blocks of cells, those of small counts first.

    A cell is a byte (bin, label) a column.  One pass over the rows bins them for all.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(cols)
        for batch in batches:
            y, folds = (batch.column(c).to_numpy(zero_copy_only=False) for c in (label, fold))
            x = [batch.column(c).to_numpy(zero_copy_only=False) for c in cols]
            made: dict[tuple[int, bytes], np.ndarray] = {}
            for at, k in enumerate(left_out):
                bins = np.empty((len(y), width), dtype=np.uint8)
                for j, cut in enumerate(cuts[at]):
                    key = j, cut.tobytes()
                    if key not in made:
                        made[key] = np.searchsorted(cut, x[j]) * 2 + y
                    bins[:, j] = made[key]
                if k is not None:
                    bins = bins[folds != k]
                ends = np.arange(len(bins) + 1, dtype=np.int32) * width
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(bins), at, dtype=np.int32)),
                     pa.Array.from_buffers(pa.binary(), len(bins), [None, pa.py_buffer(ends), pa.py_buffer(bins.tobytes())])],
                    names=["at", "cell"])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def block(parts: list[pd.DataFrame]) -> pd.DataFrame:
            cells = pd.concat(parts).sort_values(["n", "cell"])
            return pd.DataFrame({"cells": [b"".join(cells["cell"])], "counts": [cells["n"].to_numpy(np.int64).tobytes()]})

        parts, held = [], 0
        for batch in batches:
            if held and held + len(batch) > BLOCK_ROWS:
                yield block(parts)
                parts, held = [], 0
            parts.append(batch)
            held += len(batch)
        if held:
            yield block(parts)

    cells = materialised(rows.mapInArrow(code, "at int, cell binary").groupBy("at", "cell").agg(F.count(F.lit(1)).alias("n")),
                         "forest-cells")
    sizes = dict(cells.groupBy("at").count().collect())

    def blocks(at: int) -> DataFrame:
        mine = cells.where(F.col("at") == at).select("cell", "n")
        dealt = mine.repartition(sizes[at] // BLOCK_ROWS + 1, "cell").sortWithinPartitions("cell")
        return materialised(dealt.mapInPandas(pack, "cells binary, counts binary"), "forest-blocks")

    with ThreadPool(len(left_out)) as pool:
        return pool.map(blocks, range(len(left_out)), chunksize=1)


class Level:
    """The trees so far, as arrays by (tree, node), and their open nodes."""

    def __init__(self, trees: list[dict], k: int, columns: int, seed: int):
        self.trees = [t for t in trees if t["open"]]
        self.k, self.columns, self.seed = k, columns, seed
        for t in self.trees:
            place = np.full(len(t["left"]), -1, dtype=np.int32)
            place[t["open"]] = np.arange(len(t["open"]))
            inner = np.array(t["left"]) >= 0
            own = np.arange(len(inner))
            t["walk"] = (np.where(inner, t["feature"], 0).astype(np.int32), (np.array(t["cut"]) * 2 + 1).astype(np.int32),
                         np.stack([np.where(inner, t["left"], own), np.where(inner, t["right"], own)], axis=1).astype(
                             np.int32).ravel(), place)
            # Columns that a node may split by.
            t["sub"] = np.stack([np.sort(np.random.default_rng([seed, t["tree"], node, 1]).choice(columns, k, replace=False))
                                 for node in t["open"]]).astype(np.int32)

    def drawn(self, tree: dict, counts: np.ndarray, block_seed: int) -> np.ndarray:
        """The weights of one block's cells in a tree: the same in all forests."""
        return draw_weights(counts, np.random.default_rng([self.seed, tree["tree"], block_seed]))

    def sums(self, tree: dict, depth: int, flat: np.ndarray, counts: np.ndarray, block_seed: int,
             weights: np.ndarray | None = None, by_column: np.ndarray | None = None) -> np.ndarray:
        """[open node, column of its choice, bin and label] → weight in one block.

        ``weights`` are those drawn, ``by_column`` the block with a row a column, if made already.
        """
        feature, cut, child, place = tree["walk"]
        if weights is None:
            weights = self.drawn(tree, counts, block_seed)
        if not depth and by_column is not None:  # all cells are at the root
            weights = weights.astype(np.float64)
            return np.stack([np.bincount(by_column[j], weights, CODES) for j in tree["sub"][0]])[None]
        drawn = np.flatnonzero(weights)
        base, weights = (drawn * self.columns).astype(np.int64), weights[drawn].astype(np.float64)
        at = np.zeros(len(drawn), dtype=np.int32)
        for _ in range(depth):
            at = child.take(at * 2 + (flat.take(base + feature.take(at)) > cut.take(at)))
        slot = place.take(at)
        if depth:
            here = np.flatnonzero(slot >= 0)
            base, weights, slot = base[here], weights[here], slot[here]
        out = np.empty((len(tree["open"]), self.k, CODES))
        for j in range(self.k):
            key = slot * CODES + flat.take(base + tree["sub"][:, j].take(slot))
            out[:, j] = np.bincount(key, weights, len(out) * CODES).reshape(len(out), CODES)
        return out


def entropy(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    total = np.maximum(zeros + ones, 1e-300)
    out = np.zeros(np.shape(total))
    for part in (zeros, ones):
        p = part / total
        out -= p * np.log2(np.where(p > 0, p, 1.0))
    return out


def best_splits(sums: np.ndarray, sub: np.ndarray, least: float) -> pd.DataFrame:
    """A row an open node: its best column and cut, the gain (0 if no split leaves ``least`` on both sides), weights."""
    low = sums.reshape(*sums.shape[:2], MAX_BINS, 2).cumsum(axis=2)
    every = low[:, :, -1:, :]
    high = every - low
    n, n_low, n_high = (x.sum(axis=3) for x in (every, low, high))
    gain = entropy(every[..., 0], every[..., 1]) - (
        n_low * entropy(low[..., 0], low[..., 1]) + n_high * entropy(high[..., 0], high[..., 1])) / np.maximum(n, 1)
    gain = np.where((n_low >= least) & (n_high >= least), gain, 0.0).reshape(len(sums), -1)
    at = gain.argmax(axis=1)
    node, (j, cut) = np.arange(len(sums)), np.divmod(at, MAX_BINS)
    return pd.DataFrame({
        "feature": sub[node, j], "cut": cut, "gain": gain[node, at], "low_zeros": low[node, j, cut, 0],
        "low_ones": low[node, j, cut, 1], "zeros": every[:, 0, 0, 0], "ones": every[:, 0, 0, 1]})


SPLITS = ("forest int, tree int, place int, feature int, cut int, gain double, low_zeros double, low_ones double, "
          "zeros double, ones double")


def level_splits(blocks: DataFrame, level: Level, depth: int) -> pd.DataFrame:
    """forest, tree, place, best split of every open node: one pass over all cells."""
    wanted, names = [(t["sub"], t["forests"]) for t in level.trees], [c.split()[0] for c in SPLITS.split(", ")]
    k = level.k

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: list[np.ndarray | None] = [None] * len(level.trees)
        for batch in batches:
            for cells, counts in zip(batch["cells"], batch["counts"]):
                flat, n = np.frombuffer(cells, dtype=np.uint8), np.frombuffer(counts, dtype=np.int64)
                by_column = None if depth else flat.reshape(-1, level.columns).T.astype(np.int64, order="C")
                block_seed = zlib.crc32(cells[:level.columns])  # a cell is in one block only
                tree = weights = None
                for at, t in enumerate(level.trees):
                    if t["tree"] != tree:
                        tree, weights = t["tree"], level.drawn(t, n, block_seed)
                    found = level.sums(t, depth, flat, n, block_seed, weights, by_column)
                    totals[at] = found if totals[at] is None else totals[at] + found
        for at, found in enumerate(totals):
            if found is not None:
                yield pd.DataFrame({"at": [at], "sums": [found.tobytes()]})

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for part in parts:
            for at, sums in zip(part["at"], part["sums"]):
                totals[at] = totals.get(at, 0.0) + np.frombuffer(sums)
        for at, sums in totals.items():
            sub, forests = wanted[at]
            sums = sums.reshape(len(sub), k, CODES)
            for forest, tree, slots, least in forests:
                yield best_splits(sums[slots], sub[slots], least).assign(forest=forest, tree=tree, place=range(len(slots)))[names]

    # A fixed number of tasks: sums of so few bytes would be put into one otherwise.
    summed = blocks.mapInPandas(count, "at int, sums binary").repartition(len(level.trees) // SUMMED_TREES + 1, "at")
    return summed.mapInPandas(best, SPLITS).toPandas()


def _add(tree: dict, zeros: float, ones: float) -> int:
    for name, value in (("left", -1), ("right", -1), ("feature", -1), ("cut", -1), ("gain", -1.0), ("zeros", zeros), ("ones", ones)):
        tree[name].append(value)
    return len(tree["left"]) - 1


def _may_split(zeros: float, ones: float, total: float, rule: dict, least: float) -> bool:
    """Whether any split of a node of these weights can pass: no gain is above its entropy."""
    n = zeros + ones
    return bool(zeros > 0 and ones > 0 and n >= max(2 * least, math.ceil(rule["min_samples_split"] * total))
                and (entropy(np.float64(zeros), np.float64(ones)) + 1e-9) * n / total >= rule["min_impurity_decrease"])


def numbered(tree: dict, cuts: list[np.ndarray]) -> pd.DataFrame:
    """The nodes of one tree, left to right, a parent before its children."""
    order, todo = [], [0]
    while todo:
        node = todo.pop()
        order.append(node)
        if tree["left"][node] >= 0:
            todo += [tree["right"][node], tree["left"][node]]
    new = {node: k for k, node in enumerate(order)} | {-1: -1}
    return pd.DataFrame({
        "tree": tree["tree"], "node": range(len(order)), "left": [new[tree["left"][n]] for n in order],
        "right": [new[tree["right"][n]] for n in order], "feature": [int(tree["feature"][n]) for n in order],
        "threshold": [float(cuts[tree["feature"][n]][tree["cut"][n]]) if tree["left"][n] >= 0 else 0.0 for n in order],
        **{c: [float(tree[c][n]) for n in order] for c in ("gain", "zeros", "ones")}})


class Cells:
    """Training rows (an int label 0/1, all other columns doubles) in bins, ready to grow any number of forests on."""

    def __init__(self, rows: DataFrame, label: str, **made):
        self.cols = [c for c in rows.columns if c != label]
        if not made:
            made = vars(fold_cells(rows.withColumn("_fold", F.lit(0)), label, "_fold", [None])[0])
        self.n, self.cuts, self.blocks = made["n"], made["cuts"], made["blocks"]


def fold_cells(rows: DataFrame, label: str, fold: str, left_out: list[int | None]) -> list[Cells]:
    """For each fold left out (None: none) the cells of the rows of all others, made together."""
    cols = [c for c in rows.columns if c not in (label, fold)]
    rows = rows.where(F.col(fold).isNotNull())
    facts = rows.groupBy(fold).agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col(label).isin(0, 1), 1)).alias("_known"),
                                   *_sizes(cols)).collect()
    ns = [sum(r["_n"] for r in _others(facts, k)) for k in left_out]
    if not all(ns) or any(r["_known"] < r["_n"] for r in facts):
        raise ValueError("a forest needs rows, and labels of 0 or 1")
    cuts = fold_cuts(rows, cols, fold, left_out, facts)
    blocks = binned_blocks(rows, label, cols, fold, left_out, cuts)
    return [Cells(rows.drop(fold), label, n=n, cuts=c, blocks=b) for n, c, b in zip(ns, cuts, blocks)]


def _shapes(forests: list[list[dict]], leasts: list[float]) -> list[dict]:
    """Trees to sum for: those of several forests that have split alike so far have the same draws, columns and sums."""
    shapes: dict[tuple, dict] = {}
    for forest, trees in enumerate(forests):
        for t in trees:
            if t["open"]:
                key = t["tree"], *(tuple(t[c]) for c in ("left", "feature", "cut"))
                shape = shapes.setdefault(key, {c: t[c] for c in ("tree", "left", "right", "feature", "cut")} | {"of": []})
                shape["of"].append((forest, t["open"]))
    for shape in shapes.values():
        shape["open"] = sorted({node for _, nodes in shape["of"] for node in nodes})
        slot = {node: k for k, node in enumerate(shape["open"])}
        shape["forests"] = [(forest, shape["tree"], [slot[node] for node in nodes], leasts[forest])
                            for forest, nodes in shape.pop("of")]
    return sorted(shapes.values(), key=lambda shape: shape["tree"])


def grow_trees(cells: Cells, n_trees: int, rule: dict, seed: int) -> pd.DataFrame:
    """The node table of ``n_trees`` trees.

    A node splits above a depth, if it has enough of the rows, the decrease weighed by its share of rows is
    enough, and both children keep the least leaf share; NaN is above all values.
    """
    return grow_forests(cells, n_trees, [rule], seed)[0]


def grow_forests(cells: Cells, n_trees: int, rules: list[dict], seed: int) -> list[pd.DataFrame]:
    """For each rule what :func:`grow_trees` gives: all forests grow in the same passes and share what they have in common."""
    leasts = [max(1.0, rule["min_samples_leaf"] * cells.n) for rule in rules]
    k = math.ceil(math.sqrt(len(cells.cols)))
    forests = [[{"tree": t, "open": [0], **{c: [] for c in ("left", "right", "feature", "cut", "gain", "zeros", "ones")}}
                for t in range(n_trees)] for _ in rules]
    for t in (t for trees in forests for t in trees):
        _add(t, 0.0, 0.0)
    depth = 0
    while shapes := _shapes([trees if depth < max(rule["max_depth"], 1) else [] for trees, rule in zip(forests, rules)], leasts):
        found = level_splits(cells.blocks, Level(shapes, k, len(cells.cols), seed), depth)
        opened: list[dict[int, list[int]]] = [{t["tree"]: [] for t in trees} for trees in forests]
        for s in found.sort_values(["forest", "tree", "place"]).itertuples():
            t, rule, least = forests[s.forest][s.tree], rules[s.forest], leasts[s.forest]
            node = t["open"][s.place]
            t["zeros"][node], t["ones"][node] = s.zeros, s.ones
            n, total = s.zeros + s.ones, t["zeros"][0] + t["ones"][0]
            if (s.gain <= 0 or depth >= rule["max_depth"] or n < math.ceil(rule["min_samples_split"] * total)
                    or s.gain * n / total < rule["min_impurity_decrease"]):
                continue
            t["feature"][node], t["cut"][node], t["gain"][node] = s.feature, s.cut, s.gain
            t["left"][node] = _add(t, s.low_zeros, s.low_ones)
            t["right"][node] = _add(t, s.zeros - s.low_zeros, s.ones - s.low_ones)
            opened[s.forest][s.tree] += [child for child in (t["left"][node], t["right"][node])
                                         if _may_split(t["zeros"][child], t["ones"][child], total, rule, least)]
        for trees, new in zip(forests, opened):
            for t in trees:
                t["open"] = new[t["tree"]]
        depth += 1
    return [pd.concat([numbered(t, cells.cuts) for t in trees], ignore_index=True) for trees in forests]

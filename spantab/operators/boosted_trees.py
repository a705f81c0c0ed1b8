"""Second-order boosted regression trees from gradient histograms, all folds together.

Features become bin numbers between exact quantiles. A level of a tree is one
aggregation of gradient and curvature by (fold, node, feature, bin); sums from
the left over the bins give the gain of every split, and the best one per node
is chosen by a window over that small table. Tasks add up their rows' cells by
blocks first, and rows find their node by the trees' small arrays, so no row is
copied per fold or feature and no table of members is joined back. Squared
error has curvature 1 per row, and a leaf is ``-G / (H + penalty)``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from spantab.functions.scalars import clean_double, split_hash
from spantab.operators.cleaning import _quoted
from spantab.operators.quantiles import exact_ranks
from spantab.operators.splits import SplitPlan
from spantab.operators.trials import FOLD_SCHEMA, evaluate_folds
from spantab.staging import stage

#: Trees between two tables of running predictions; the plan of a pass holds at most so many trees.
STAGED_TREES = 10
#: Histogram cells that a task adds up in one array; beyond, it passes on the cells of every Arrow batch.
DENSE_CELLS = 1 << 22
GAIN_DIGITS = 6  # gains that agree to so many places are equal; the first feature and bin win


@dataclass(frozen=True)
class TreeSettings:
    """Defaults are the usual ones of such trees."""

    trees: int = 600
    depth: int = 10
    rate: float = 0.02
    row_share: float = 0.6
    column_share: float = 0.8
    bins: int = 64
    penalty: float = 1.0
    min_curvature: float = 1.0
    min_gain: float = 0.0
    seed: int = 42

    def columns(self, features: Sequence[str], tree: int) -> list[int]:
        """The features drawn for a tree, by seeded digests of their names."""
        n = max(1, int(self.column_share * len(features)))
        drawn = sorted(range(len(features)), key=lambda i: hashlib.md5(f"{self.seed}:{tree}:{features[i]}".encode()).hexdigest())
        return sorted(drawn[:n])

    def row_limit(self) -> str:
        """Rows whose split hash with the tree's seed is below this text are drawn."""
        return f"{min(int(self.row_share * 16**8), 16**8 - 1):08x}"

    def row_seed(self, tree: int) -> int:
        return 1_000_003 * self.seed + tree


@dataclass
class Tree:
    """One tree per fold, by heap numbers of nodes: children of node k are 2k+1 and 2k+2."""

    size: int
    feature: list[int]
    cut: list[int]
    leaf: list[float]

    @classmethod
    def bare(cls, folds: int, depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return cls(size, [-1] * folds * size, [0] * folds * size, [0.0] * folds * size)

    def nodes(self, fold: int, bins: np.ndarray, levels: int) -> np.ndarray:
        """Numbers of the nodes that rows stand at after so many levels: rows at least at the cut go right."""
        own = slice(fold * self.size, (fold + 1) * self.size)
        feature, cut = np.asarray(self.feature[own]), np.asarray(self.cut[own])
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            right = bins[rows, np.maximum(feature[at], 0)] >= cut[at]
            at = np.where(feature[at] < 0, at, 2 * at + 1 + right)
        return at


def _constants(values: Sequence[float], kind: str) -> Column:
    """A constant array as one literal, folded once by the optimizer."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


@dataclass
class TreeModel:
    features: tuple[str, ...]
    cuts: tuple[tuple[float, ...], ...]
    start: list[float]
    rate: float
    depth: int
    fitted: tuple[bool, ...]
    trees: list[Tree] = field(default_factory=list)

    def bins(self) -> Column:
        """Array of the bin of every feature: how many of its cuts are at or below the value."""
        cuts = [np.asarray(c, float) for c in self.cuts]

        def place(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for values in batches:
                values = values if isinstance(values, tuple) else (values,)
                found = [np.searchsorted(c, v.to_numpy(zero_copy_only=False), side="right") for c, v in zip(cuts, values)]
                yield _lists(np.column_stack(found).astype(np.int32))

        return arrow_udf(place, "array<int>")(*(clean_double(_quoted(name)) for name in self.features))

    def add(self, predictions: Column, bins: Column, trees: Sequence[Tree]) -> Column:
        """Array of all folds' predictions with more trees added."""
        trees, more = list(trees), self.added

        def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for old, own in batches:
                yield _lists(more(_rows(old), _rows(own), trees))

        return arrow_udf(run, "array<double>")(predictions, bins) if trees else predictions

    def added(self, predictions: np.ndarray, bins: np.ndarray, trees: Sequence[Tree]) -> np.ndarray:
        """Predictions, a column per fold, with more trees added."""
        out = predictions.copy()
        for tree in trees:
            leaf = np.asarray(tree.leaf).reshape(-1, tree.size)
            for fold in range(out.shape[1]):
                out[:, fold] += self.rate * leaf[fold, tree.nodes(fold, bins, self.depth)]
        return out


def _rows(cells: pa.Array) -> np.ndarray:
    """Arrays of one length as the rows of a matrix."""
    flat = cells.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(cells), -1) if len(cells) else flat.reshape(0, 1)


def _lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def quantile_cuts(df: DataFrame, features: Sequence[str], bins: int) -> tuple[tuple[float, ...], ...]:
    """Per feature the distinct values that begin each of ``bins`` equal parts of its rows, without the least value."""
    found = exact_ranks(
        df, {c: clean_double(_quoted(c)) for c in features}, lambda n: sorted({k * n // bins for k in range(bins)})
    )
    return tuple(tuple(sorted(set(values) - set(values[:1]))) for _, values in (found[c] for c in features))


def fit_trees(
    df: DataFrame, features: Sequence[str], target: str, key: str, train: Column, folds: int, settings: TreeSettings,
) -> TreeModel:
    """Boosted trees per fold over the rows with a target whose array ``train`` names the fold.

    Missing and non-finite features count as 0. The number of jobs follows from
    trees and levels, not from folds or features. Running predictions are
    written to the shared folder every few trees, which bounds the plan.
    """
    y = _quoted(target).cast("double")
    known = df.filter(y.isNotNull() & ~F.isnan(y))
    model = TreeModel(
        tuple(features), quantile_cuts(known, features, settings.bins), [0.0] * folds, settings.rate, settings.depth,
        (False,) * folds,
    )
    rows = stage(known.select(_quoted(key).cast("string").alias("key"), y.alias("y"), train.alias("folds"),
                              model.bins().alias("bins")), "tree-rows")
    means = {r["fold"]: r["mean"] for r in rows.select(F.explode("folds").alias("fold"), "y").groupBy("fold").agg(
        F.avg("y").alias("mean")
    ).collect()}
    model.start = [means.get(f, 0.0) for f in range(folds)]
    model.fitted = tuple(f in means for f in range(folds))
    base = rows.withColumn("p", _constants(model.start, "double"))
    since = 0
    for k in range(settings.trees):
        if k - since == STAGED_TREES:
            base = stage(base.withColumn("p", model.add(F.col("p"), F.col("bins"), model.trees[since:])), "tree-rows")
            since = k
        model.trees.append(_grow(base, model, settings, folds, k, since))
    return model


def _grow(rows: DataFrame, model: TreeModel, settings: TreeSettings, folds: int, number: int, since: int) -> Tree:
    """One tree per fold; ``rows`` hold the predictions of the trees before ``since``."""
    tree = Tree.bare(folds, settings.depth)
    if settings.row_share < 1.0:
        rows = rows.filter(split_hash("key", settings.row_seed(number)) < settings.row_limit())
    drawn = settings.columns(model.features, number)
    for level in range(settings.depth + 1):
        at_end = level == settings.depth
        cells = _cells(rows, model, tree, level, model.trees[since:], [] if at_end else drawn, settings.bins)
        if at_end:
            best = cells.groupBy("fold", "node").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).select(
                "fold", "node", "g", "h", F.lit(None).cast("int").alias("feature"), F.lit(None).cast("int").alias("cut")
            )
        else:
            best = _best_splits(cells, settings)
        grown = False
        for r in best.collect():  # one per open node
            place = r["fold"] * tree.size + r["node"]
            tree.leaf[place] = -r["g"] / (r["h"] + settings.penalty)
            if r["feature"] is not None:
                tree.feature[place], tree.cut[place] = r["feature"], r["cut"]
                grown = True
        if not grown:
            break
    return tree


def _cells(
    rows: DataFrame, model: TreeModel, tree: Tree, level: int, trees: Sequence[Tree], drawn: Sequence[int], bins: int
) -> DataFrame:
    """(fold, node, feature, bin, g, h): each task's sums of gradient and curvature at a level.

    Without drawn features a cell is a node, under feature and bin 0.
    """
    first, n_nodes = 2**level - 1, 2**level
    features, trees = list(drawn), list(trees)
    folds, width = len(model.start), len(features) or 1
    per_cell = bins if features else 1
    shape = (folds, n_nodes, width, per_cell)
    size, dense = int(np.prod(shape)), int(np.prod(shape)) <= DENSE_CELLS

    def emitted(keys: np.ndarray, g: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        fold, node, place, at = np.unravel_index(keys, shape)
        own = np.asarray(features or [0])[place]
        ints = [pa.array(c.astype(np.int32)) for c in (fold, node + first, own, at)]
        return pa.RecordBatch.from_arrays(
            [*ints, pa.array(g), pa.array(h.astype(np.int64))], ["fold", "node", "feature", "bin", "g", "h"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, h = np.zeros(size if dense else 0), np.zeros(size if dense else 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _rows(batch.column("bins"))
            p = model.added(_rows(batch.column("p")), own, trees) - batch.column("y").to_numpy(zero_copy_only=False)[:, None]
            listed = batch.column("folds")
            of_row = np.repeat(np.arange(batch.num_rows), np.diff(listed.offsets.to_numpy()))
            of_fold = listed.flatten().to_numpy(zero_copy_only=False)
            keys, weights = [], []
            for fold in range(folds):
                at = of_row[of_fold == fold]
                node = tree.nodes(fold, own[at], level) - first
                at, node = at[node >= 0], node[node >= 0]
                for k in range(width):
                    cell = own[at, features[k]] if features else 0
                    keys.append(((fold * n_nodes + node) * width + k) * per_cell + cell)
                    weights.append(p[at, fold])
            key, weight = np.concatenate(keys), np.concatenate(weights)
            if dense:
                g += np.bincount(key, weight, size)
                h += np.bincount(key, minlength=size)
            elif len(key):
                found, back = np.unique(key, return_inverse=True)
                yield emitted(found, np.bincount(back, weight), np.bincount(back))
        if dense:
            (found,) = np.nonzero(h)
            yield emitted(found, g[found], h[found])

    return rows.select("bins", "y", "p", "folds").mapInArrow(
        run, "fold int, node int, feature int, bin int, g double, h bigint"
    )


def _best_splits(cells: DataFrame, settings: TreeSettings) -> DataFrame:
    """(fold, node, g, h, feature, cut) of every node; feature and cut are null where no split gains enough."""
    histogram = cells.groupBy("fold", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    feature = Window.partitionBy("fold", "node", "feature")
    left = feature.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = histogram.select(
        "fold", "node", "feature", "bin", F.coalesce(F.sum("g").over(left), F.lit(0.0)).alias("gl"),
        F.coalesce(F.sum("h").over(left), F.lit(0)).alias("hl"), F.sum("g").over(feature).alias("g"),
        F.sum("h").over(feature).alias("h"),
    )

    def score(g: Column, h: Column) -> Column:
        return g * g / (h + F.lit(settings.penalty))

    g, h, gl, hl = (F.col(c) for c in ("g", "h", "gl", "hl"))
    gain = F.round((score(gl, hl) + score(g - gl, h - hl) - score(g, h)) / 2, GAIN_DIGITS)
    allowed = (hl >= settings.min_curvature) & (h - hl >= settings.min_curvature) & (gain > settings.min_gain)
    ranked = sums.withColumn("gain", F.when(allowed, gain)).withColumn(
        "place", F.row_number().over(
            Window.partitionBy("fold", "node").orderBy(F.col("gain").desc_nulls_last(), "feature", "bin")
        )
    )
    split = F.col("gain").isNotNull()
    return ranked.filter("place = 1").select(
        "fold", "node", "g", "h", F.when(split, F.col("feature")).alias("feature"), F.when(split, F.col("bin")).alias("cut")
    )


def predict_trees(df: DataFrame, model: TreeModel, name: str = "p") -> DataFrame:
    """Add the array of all folds' predictions. Row-local."""
    binned = df.withColumn("_bins", model.bins())
    return binned.withColumn(
        name, model.add(_constants(model.start, "double"), F.col("_bins"), model.trees)
    ).drop("_bins")


def tree_folds(
    exact: DataFrame, bounded: DataFrame, plan: SplitPlan, features: Sequence[str], settings: TreeSettings, target: str = "y"
) -> DataFrame:
    """(fold, set, r2, accuracy, rmse, bounds_accuracy) of boosted trees fitted on the train rows of each fold.

    Rows of ``exact`` without a key belong to no set. A fold without train rows gives one row of set ``failed``.
    """
    n = len(plan.folds)
    everywhere = F.array(*(F.struct(F.lit(f).alias("fold"), F.lit("bounded").alias("role")) for f in range(n)))
    kept = [*(_quoted(c) for c in features), F.col("lower"), F.col("upper")]
    known = exact.filter(_quoted(plan.key).isNotNull()).select(
        *kept, _quoted(plan.key).alias("_key"), _quoted(target).alias("_y"), plan.placements().alias("_placed")
    )
    train = F.transform(F.filter("_placed", lambda s: s["role"] == "train"), lambda s: s["fold"])
    model = fit_trees(known, features, "_y", "_key", train, n, settings)
    rows = known.drop("_key").unionByName(
        bounded.select(*kept, F.lit(None).cast(known.schema["_y"].dataType).alias("_y"), everywhere.alias("_placed"))
    )
    predicted = predict_trees(rows, model, "_p").select(
        F.col("_y").cast("double").alias("y"), "lower", "upper", "_p", F.explode("_placed").alias("s")
    )
    every = predicted.select("y", "lower", "upper", "s.fold", "s.role", F.get("_p", F.col("s.fold")).alias("p"))
    working = every.filter(F.col("fold").isin([f for f in range(n) if model.fitted[f]]))
    found = [tuple(r) for r in evaluate_folds(working).collect()]  # at most four per fold
    found += [(f, "failed", None, None, None, None) for f in range(n) if not model.fitted[f]]
    return exact.sparkSession.createDataFrame(found, FOLD_SCHEMA)

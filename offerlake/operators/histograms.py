"""Boosted trees, forests and linear models of many settings and folds from shared scans.

MLlib fits one model at a time and keeps every row unpacked for it, a hundred bytes and more, so a search over
folds and settings reads and spills the same rows again and again. Here

* a feature is cut at MLlib's candidates (midpoints of all values, or of values at even counts where there are more
  than ``maxBins``), taken from counts of all rows, not from a sample;
* a row is a few small numbers, each the bins of several features (``Layout``); rows of the same bins are one row
  with a count and a sum of labels, which is all that a boosted tree for squared error asks of them;
* one scan a tree level sums (count, residual) per (fold, setting, node, bin) for all folds and settings together;
* a forest draws its bags row by row, so there rows stay apart; trees and nodes are summed in one scan a level;
* a linear model sees the sums of all products alone, so MLlib's solver is given a few rows that have the same sums.

The trees become MLlib models, split by split; the tests hold them against MLlib's own fits.
"""

from __future__ import annotations

import weakref
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.operators.quantiles import exact_quantiles
from offerlake.session import materialize, materialize_for_fit

#: Different values of a feature up to which its candidates are found from the list of them, by the driver.
LISTED_VALUES = 20_000
#: Bins that the features of one code may have together.
CODE_BINS = 4096
#: Rows of a task and of a block of arrays in it.
TASK_ROWS, BLOCK_ROWS = 400_000, 65_536


# --------------------------------------------------------------------- bins
def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    """Features x rows of an Arrow column of equally long lists."""
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).T)


def _count_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, value, n) of the rows of a task; handed on in between where there are many values."""
    known: list[np.ndarray] = []
    counts: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        which = np.repeat(np.arange(len(known), dtype=np.int32), [len(k) for k in known])
        return pa.RecordBatch.from_arrays([pa.array(which), pa.array(np.concatenate(known)), pa.array(np.concatenate(counts))],
                                          names=["feature", "value", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column(0), batch.num_rows)
        if not known:
            known, counts = ([np.empty(0, t) for _ in x] for t in (float, np.int64))
        for f, col in enumerate(x):
            col = col[~np.isnan(col)]
            at = np.searchsorted(known[f], col)
            new = np.ones(len(col), bool) if not len(known[f]) else known[f][np.minimum(at, len(known[f]) - 1)] != col
            if new.any():
                added = np.setdiff1d(col[new], known[f])
                place = np.searchsorted(known[f], added)
                known[f], counts[f] = np.insert(known[f], place, added), np.insert(counts[f], place, 0)
                at = np.searchsorted(known[f], col)
            counts[f] += np.bincount(at, minlength=len(known[f]))
        if sum(map(len, known)) > 200_000:
            yield out()
            known = []
    if known:
        yield out()


def candidates(values: np.ndarray, counts: np.ndarray, max_bins: int) -> np.ndarray:
    """MLlib's thresholds of a feature: all midpoints, or those at about even counts of rows where there are more values than bins."""
    values, counts = values + 0.0, counts.astype(float)    # -0.0 and 0.0 are one value
    middle = (values[:-1] + values[1:]) / 2.0
    if len(middle) <= max_bins - 1:
        return middle
    stride, found, seen, target = counts.sum() / max_bins, [], counts[0], counts.sum() / max_bins
    for i in range(1, len(values)):
        before, seen = seen, seen + counts[i]
        if abs(before - target) < abs(seen - target):
            found.append(middle[i - 1])
            target += stride
    return np.array(found)


def thresholds(rows: DataFrame, max_bins: int, column: str = "features") -> list[np.ndarray]:
    """Candidates of every feature from exact counts of all rows: by value where a feature has a bounded number of them, at the
    exact quantiles otherwise."""
    size = len(rows.select(vector_to_array(column)).first()[0])
    seen = rows.select(vector_to_array(column).alias("x")).mapInArrow(_count_values, "feature int, value double, n long")
    counts = materialize(seen.groupBy("feature", "value").agg(F.sum("n").alias("n")))
    many = [r["feature"] for r in counts.groupBy("feature").count().where(F.col("count") > LISTED_VALUES).collect()]
    out: list[np.ndarray] = [np.empty(0)] * size
    listed = counts.where(~F.col("feature").isin(many)).toArrow()   # at most LISTED_VALUES a feature
    feature, value, n = (listed.column(c).to_numpy() for c in ("feature", "value", "n"))
    order = np.lexsort((value, feature))
    for f in np.unique(feature):
        own = order[feature[order] == f]
        out[f] = candidates(value[own], n[own], max_bins)
    if many:
        names = [f"q{i}" for i in range(1, max_bins)]
        for r in exact_quantiles(counts.where(F.col("feature").isin(many)), "value", [i / max_bins for i in range(1, max_bins)],
                                 ["feature"], names, weight="n").collect():
            out[r["feature"]] = np.unique([r[q] for q in names])
    return out


class Layout(NamedTuple):
    """How the bins of all features make up the codes of a row. A feature without a candidate is in no code."""

    cuts: list[np.ndarray]
    codes: list[tuple[int, ...]]

    @classmethod
    def of(cls, cuts: list[np.ndarray]) -> Layout:
        codes, room = [], 0
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            if len(cut) + 1 > room:
                codes.append([])
                room = max(CODE_BINS, len(cut) + 1)
            codes[-1].append(f)
            room //= len(cut) + 1
        return cls(cuts, [tuple(c) for c in codes] or [()])

    def bins(self, f: int) -> int:
        return len(self.cuts[f]) + 1

    @property
    def sizes(self) -> list[int]:
        return [int(np.prod([self.bins(f) for f in fs], dtype=int)) for fs in self.codes]

    @property
    def offsets(self) -> dict[int, int]:
        """Place of a feature's first bin in the row of all bins, which begins with the sum; features in the order of the vector."""
        used = sorted(f for fs in self.codes for f in fs)
        return dict(zip(used, np.cumsum([1, *(self.bins(f) for f in used)]).tolist(), strict=False))

    @property
    def total(self) -> int:
        return 1 + sum(self.bins(f) for fs in self.codes for f in fs)

    def members(self, decoded: list[np.ndarray]) -> list[np.ndarray]:
        """Per code which bins its values belong to, (values of the code) x (bins of its features)."""
        return [np.concatenate([(table[:, j][:, None] == np.arange(self.bins(f))).astype(float) for j, f in enumerate(fs)], axis=1)
                if fs else np.zeros((1, 0)) for fs, table in zip(self.codes, decoded, strict=True)]

    @property
    def owners(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per place of a bin: its feature, the threshold above it (-1 for none) and the place of the feature's first bin."""
        owner, cut, begin = np.zeros(self.total, int), np.full(self.total, -1), np.ones(self.total, int)
        for f, at in self.offsets.items():
            n = self.bins(f)
            owner[at:at + n], begin[at:at + n] = f, at
            cut[at:at + n - 1] = np.arange(n - 1)
        return owner, cut, begin

    def encode(self, x: np.ndarray) -> list[np.ndarray]:
        out = []
        for fs in self.codes:
            code = np.zeros(x.shape[1], np.int32)
            for f in fs:
                code = code * self.bins(f) + np.searchsorted(self.cuts[f], x[f]).astype(np.int32)
            out.append(code)
        return out

    def decode(self) -> list[np.ndarray]:
        """Per code the bins of its features, (values of the code) x (features)."""
        return [np.stack(np.unravel_index(np.arange(n), [self.bins(f) for f in fs]), axis=1) if fs else np.zeros((1, 0), int)
                for n, fs in zip(self.sizes, self.codes, strict=True)]


class Binned:
    """A table of (features, label) as codes, written once: row by row (``rows``) and summed up (``grouped``)."""

    def __init__(self, table: DataFrame, max_bins: int):
        self.size = len(table.select(vector_to_array("features")).first()[0])
        self.layout = layout = Layout.of(thresholds(table, max_bins))
        names = [f"c{i}" for i in range(len(layout.codes))]

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    codes = layout.encode(_matrix(batch.column(0), batch.num_rows))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, codes), batch.column(1)], names=[*names, "y"])

        self.names = names
        self.rows = materialize_for_fit(table.select(vector_to_array("features").alias("x"), F.col("label").cast("double")).mapInArrow(
            encode, ", ".join(f"{c} int" for c in names) + ", y double"), TASK_ROWS)
        self._grouped = None

    @property
    def grouped(self) -> DataFrame:
        if self._grouped is None:
            self._grouped = materialize_for_fit(self.rows.groupBy(*self.names).agg(
                F.count("y").cast("double").alias("n"), F.sum("y").alias("y")).where("n > 0").select(*self.names, "n", "y"), TASK_ROWS)
        return self._grouped

    def blocks(self, key: int, grouped: bool, of: int = 1):
        """RDD of (key, codes, counts, sums of labels), with about ``BLOCK_ROWS`` rows each; ``of`` tables are read at once."""
        width = len(self.names)
        kind = np.uint16 if max(self.layout.sizes) <= 1 << 16 else np.uint32

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def out() -> pa.RecordBatch:
                t = pa.Table.from_batches(held)
                codes = np.stack([t.column(i).to_numpy().astype(kind) for i in range(width)])
                floats = np.stack([t.column(i).to_numpy() for i in range(width, t.num_columns)])
                return pa.RecordBatch.from_arrays([pa.array([codes.tobytes()], pa.binary()), pa.array([floats.tobytes()], pa.binary())], names=["c", "f"])

            for batch in batches:
                held.append(batch)
                if sum(b.num_rows for b in held) >= BLOCK_ROWS:
                    yield out()
                    held = []
            if sum(b.num_rows for b in held):
                yield out()

        def unpack(r):
            codes = np.frombuffer(r[0], kind).reshape(width, -1)
            floats = np.frombuffer(r[1], float).reshape(-1, codes.shape[1])
            return (key, codes, floats[0], floats[1]) if grouped else (key, codes, np.ones(codes.shape[1]), floats[0])

        table = self.grouped if grouped else self.rows.where("y IS NOT NULL")
        found = table.mapInArrow(pack, "c binary, f binary").rdd.map(unpack)
        return found.coalesce(max(-(-found.context.defaultParallelism // of), -(-table.count() // TASK_ROWS)))


_BINNED: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def binned(table: DataFrame, max_bins: int = 32) -> Binned:
    """The codes of a table to fit on, made once as long as the table is held."""
    own = _BINNED.setdefault(table, {})
    if max_bins not in own:
        own[max_bins] = Binned(table, max_bins)
    return own[max_bins]


def binned_all(tables: list[DataFrame], grouped: bool, parallelism: int = 4) -> list[Binned]:
    """Codes of all tables, which are independent jobs; summed up too where ``grouped``."""
    def one(table: DataFrame) -> Binned:
        own = binned(table)
        if grouped:
            own.grouped  # noqa: B018 - written here, by all threads
        return own

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return list(pool.map(one, tables))


# --------------------------------------------------------------------- trees
class Tree:
    """A tree while it grows: per level the split (feature, bin; -1 for none) of each of 2^level places. A place without a split
    hands its rows to its left one. ``stats`` are (count, sum) of the places of each level, ``gains`` those of the splits."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.gains: list[np.ndarray] = []
        self.stats: list[np.ndarray] = []

    def grow(self, hist: np.ndarray, layout: Layout, allowed: np.ndarray | None = None) -> None:
        """The best split of each place by ``hist``, places x bins x (count, sum); ``allowed``, places x features, where not all are.
        Of equal ones the first by feature and threshold, as in MLlib."""
        places, whole = len(hist), hist[:, 0]
        if not self.stats:
            self.stats.append(whole)
        open_ = np.repeat(self.levels[-1][0] >= 0, 2) if self.levels else np.ones(places, bool)
        owner, cut_at, begin = layout.owners
        run = np.cumsum(hist, axis=1)
        low = run - run[:, begin - 1]           # of the same feature, up to the bin
        high = whole[:, None] - low
        n, m = low[..., 0], high[..., 0]
        ok = (n > 0.5) & (m > 0.5) & open_[:, None] & (cut_at >= 0)
        if allowed is not None:
            ok &= allowed[:, owner]
        with np.errstate(divide="ignore", invalid="ignore"):
            apart = low[..., 1] / n - high[..., 1] / m
            gain = np.where(ok, n * m / (n + m) * apart * apart, 0.0)
        k = gain.argmax(axis=1)
        best = gain[np.arange(places), k]
        left = low[np.arange(places), k]
        feature, cut = np.where(best > 0, owner[k], -1), np.where(best > 0, cut_at[k], -1)
        split = feature >= 0
        kept = np.where(split[:, None], left, self.stats[-1])
        right = np.where(split[:, None], self.stats[-1] - left, 0.0)
        self.levels.append((feature, cut))
        self.gains.append(best / np.maximum(self.stats[-1][:, 0], 1.0))
        self.stats.append(np.stack([kept, right], axis=1).reshape(-1, 2))

    def values(self) -> np.ndarray:
        n, s = self.stats[-1].T
        return s / np.where(n > 0, n, 1.0)

    def route(self, codes: np.ndarray, layout: Layout, tables: list[np.ndarray]) -> np.ndarray:
        """The place that each row has reached."""
        at = np.zeros(codes.shape[1], np.int64)
        for feature, cut in self.levels:
            right = np.zeros(codes.shape[1], bool)
            for b, fs in enumerate(layout.codes):
                goes = np.zeros((len(feature), len(tables[b])), bool)
                for j, f in enumerate(fs):
                    for p in np.nonzero(feature == f)[0]:
                        goes[p] = tables[b][:, j] > cut[p]
                if goes.any():
                    right |= goes.reshape(-1)[at * goes.shape[1] + codes[b]]
            at = 2 * at + right
        return at

    def to_jvm(self, sc, layout: Layout):
        """The root of the same tree as MLlib's nodes. Counts, predictions and gains are set; impurities are not known here (NaN)."""
        tree, double = sc._jvm.org.apache.spark.ml.tree, sc._jvm.double
        leaf_node, inner_node, threshold = tree.LeafNode, tree.InternalNode, tree.ContinuousSplit   # looked up once: each step is a call
        variance = sc._jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator

        def stats(n: float, s: float):
            values = sc._gateway.new_array(double, 3)
            values[0], values[1], values[2] = float(n), float(s), float("nan")
            return variance(values, int(round(n)))

        def node(level: int, place: int):
            n, s = self.stats[level][place]
            mean = float(s / n) if n > 0 else 0.0
            f = int(self.levels[level][0][place]) if level < len(self.levels) else -1
            if f < 0:
                return leaf_node(mean, float("nan"), stats(n, s))
            split = threshold(f, float(layout.cuts[f][self.levels[level][1][place]]))
            return inner_node(mean, float("nan"), float(self.gains[level][place]), node(level + 1, 2 * place),
                              node(level + 1, 2 * place + 1), split, stats(n, s))

        return node(0, 0)


def _fold_codes(layout: Layout, hot: list[np.ndarray], sums: list[np.ndarray]) -> np.ndarray:
    """Places x bins x 2 from the sums per code, places x 2 x values of the code."""
    places, offsets = len(sums[0]), layout.offsets
    out = np.zeros((places, layout.total, 2))
    out[:, 0] = sums[0].sum(axis=2)
    for fs, table, s in zip(layout.codes, hot, sums, strict=True):
        if fs:
            where = np.concatenate([np.arange(offsets[f], offsets[f] + layout.bins(f)) for f in fs])
            out[:, where] = (s.reshape(2 * places, -1) @ table).reshape(places, 2, -1).transpose(0, 2, 1)
    return out


def _level(blocks, layouts: dict[int, Layout], growing: dict[int, dict[int, Tree]], weigh) -> dict[tuple[int, int], np.ndarray]:
    """One scan: for each table and each of its growing trees the sums per place and bin. ``weigh(block, j)`` gives the counts
    and targets of a block's rows for tree ``j``."""
    sc = blocks.context
    shared = sc.broadcast((layouts, growing))

    def task(part):
        layouts, growing = shared.value
        sums: dict[tuple[int, int], list[np.ndarray]] = {}
        tables = {}
        for block in part:
            key, codes = block[0], block[1]
            layout = layouts[key]
            if key not in tables:
                tables[key] = layout.decode()
            for j, tree in growing.get(key, {}).items():
                n, target = weigh(block, j)
                at, places = tree.route(codes, layout, tables[key]), 1 << len(tree.levels)
                own = sums.setdefault((key, j), [np.zeros((places, 2, size)) for size in layout.sizes])
                for b, size in enumerate(layout.sizes):
                    index = at * size + codes[b]
                    for i, w in enumerate((n, target)):
                        own[b][:, i] += np.bincount(index, w, places * size).reshape(places, size)
        hot = {key: layouts[key].members(own) for key, own in tables.items()}
        for (key, j), own in sums.items():
            yield (key, j), _fold_codes(layouts[key], hot[key], own)

    found = dict(blocks.mapPartitions(task).reduceByKey(lambda a, b: a + b, len(layouts)).collect())
    shared.unpersist()
    return found


def boost(tables: list[Binned], settings: list[dict]) -> list[list[list[Tree]]]:
    """Trees of a boosted model for squared error, per table and setting (``maxDepth``, ``maxIter``, ``stepSize``). The first tree is
    fitted to the labels and counts whole, the others to twice the residual, as in MLlib."""
    sc = tables[0].rows.sparkSession.sparkContext
    layouts = {k: t.layout for k, t in enumerate(tables)}
    done: list[list[list[Tree]]] = [[[] for _ in settings] for _ in tables]
    state = sc.union([t.blocks(k, grouped=True, of=len(tables)) for k, t in enumerate(tables)]).map(
        lambda b: (*b, np.zeros((len(settings), len(b[2]))))).persist(StorageLevel.MEMORY_AND_DISK)
    old = None
    for i in range(max(s["maxIter"] for s in settings)):
        running = [j for j, s in enumerate(settings) if s["maxIter"] > i]
        trees = {k: {j: Tree() for j in running} for k in layouts}
        factor = 1.0 if i == 0 else 2.0

        def weigh(block, j, factor=factor):
            return block[2], factor * (block[3] - block[2] * block[4][j])

        for level in range(max(settings[j]["maxDepth"] for j in running)):
            growing = {k: {j: t for j, t in own.items() if settings[j]["maxDepth"] > level and (not t.levels or (t.levels[-1][0] >= 0).any())}
                       for k, own in trees.items()}
            for (k, j), hist in _level(state, layouts, growing, weigh).items():
                trees[k][j].grow(hist, layouts[k])
            if old is not None:     # the new predictions were kept in the first scan
                old.unpersist()
                old = None
        for k, own in trees.items():
            for j, t in own.items():
                done[k][j].append(t)
        rates = {j: 1.0 if i == 0 else settings[j]["stepSize"] for j in running}

        def step(part, trees=trees, rates=rates):
            decoded = {}
            for key, codes, n, y, sofar in part:
                if key not in decoded:
                    decoded[key] = layouts[key].decode()
                now = sofar.copy()
                for j, t in trees[key].items():
                    now[j] += rates[j] * t.values()[t.route(codes, layouts[key], decoded[key])]
                yield key, codes, n, y, now

        old, state = state, state.mapPartitions(step).persist(StorageLevel.MEMORY_AND_DISK)
    old.unpersist()
    state.unpersist()
    return done


def grow_forest(table: Binned, trees: int, depth: int, seed: int, bootstrap: bool = True, share: float = 1 / 3) -> list[Tree]:
    """Trees of a forest for regression: each row is in a tree's bag a Poisson(1) number of times, each node may split on
    ``share`` of the features."""
    layout, size = table.layout, table.size

    def bag(part):
        draw = np.random.Generator(np.random.Philox(key=[seed, TaskContext.get().partitionId()]))
        for key, codes, n, y in part:
            yield key, codes, (draw.poisson(1.0, (trees, len(n))) if bootstrap else np.ones((trees, len(n)))).astype(np.uint8), y

    def weigh(block, j):
        n = block[2][j].astype(float)
        return n, n * block[3]

    state = table.blocks(0, grouped=False).mapPartitions(bag).persist(StorageLevel.MEMORY_AND_DISK)
    choose, grown = np.random.default_rng(seed), {j: Tree() for j in range(trees)}
    for _ in range(depth):
        growing = {j: t for j, t in grown.items() if not t.levels or (t.levels[-1][0] >= 0).any()}
        for (_, j), hist in sorted(_level(state, {0: layout}, {0: growing}, weigh).items()):
            allowed = np.zeros((len(hist), size), bool)
            for own in allowed:
                own[choose.permutation(size)[:max(1, -int(-size * share // 1))]] = True
            grown[j].grow(hist, layout, allowed)
    state.unpersist()
    return list(grown.values())


# --------------------------------------------------------------------- MLlib models
def _trees_to_jvm(spark, trees: list[Tree], table: Binned):
    sc = spark.sparkContext
    kind = sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    out = sc._gateway.new_array(kind, len(trees))
    for i, t in enumerate(trees):
        out[i] = kind(t.to_jvm(sc, table.layout), table.size)
    return out


def boosted_model(reg, trees: list[Tree], rate: float, table: Binned) -> GBTRegressionModel:
    spark = table.rows.sparkSession
    sc = spark.sparkContext
    weights = sc._gateway.new_array(sc._jvm.double, len(trees))
    for i in range(len(trees)):
        weights[i] = 1.0 if i == 0 else float(rate)
    model = sc._jvm.org.apache.spark.ml.regression.GBTRegressionModel(
        reg.uid, _trees_to_jvm(spark, trees, table), weights, table.size)
    return reg._copyValues(GBTRegressionModel(model))


def forest_model(reg, trees: list[Tree], table: Binned) -> RandomForestRegressionModel:
    spark = table.rows.sparkSession
    model = spark.sparkContext._jvm.org.apache.spark.ml.regression.RandomForestRegressionModel(
        _trees_to_jvm(spark, trees, table), table.size)
    return reg._copyValues(RandomForestRegressionModel(model))


# --------------------------------------------------------------------- linear models
def moments(table: DataFrame) -> np.ndarray:
    """Sums of all products of (1, features, label) over the rows; (features + 2)^2 numbers a task reach the driver."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), batch.num_rows)
                z = np.vstack([np.ones(batch.num_rows), x, batch.column(1).to_numpy()])
                total = z @ z.T if total is None else total + z @ z.T
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    rows = table.where("label IS NOT NULL").select(vector_to_array("features").alias("x"), F.col("label").cast("double"))
    flat = rows.mapInArrow(part, "m binary").rdd.map(lambda r: np.frombuffer(r[0], float)).treeReduce(lambda a, b: a + b)
    return flat.reshape(int(round(len(flat) ** 0.5)), -1)


def rows_of_moments(spark, sums: np.ndarray) -> DataFrame:
    """A few weighted rows (features, label, weight) with the same sums: the mean, and steps both ways along each axis of the
    covariance. Least squares with any penalty gives the same coefficients on them as on the rows that were summed up."""
    n, mean = sums[0, 0], sums[0, 1:] / sums[0, 0]
    second = sums[1:, 1:] / n
    spread = second - np.outer(mean, mean)
    vary = np.nonzero(np.diag(spread) > 1e-12 * np.diag(second))[0]     # a constant stays exactly constant
    length, axes = np.linalg.eigh(spread[np.ix_(vary, vary)])
    steps = np.zeros((len(vary), len(mean)))
    steps[:, vary] = (axes * np.sqrt(np.clip(length, 0, None) * max(len(vary), 1))).T
    points = np.vstack([mean + steps, mean - steps]) if len(vary) else mean[None, :]
    weight = float(n / len(points))
    return spark.createDataFrame([(Vectors.dense(p[:-1]), float(p[-1]), weight) for p in points], ["features", "label", "weight"]).coalesce(1)

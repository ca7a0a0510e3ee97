"""Boosted regression trees on binned rows: the training of M1.

The trees are those of Spark ML's ``GBTRegressor`` for squared error (its bins, splits by gain of
variance, leaves, pruning and weights) and come back as its model. The rows are kept as one byte per
feature and one double, in chunks; a level of a tree is one pass that adds a chunk's rows to
histograms with numpy, and only sums of histograms reach the driver. What a row has left to learn
is written anew once a tree, with the pass for the next tree's root.

Bin edges come from all rows: counts per value, merged over partitions. A feature of more than
``POINTS`` values goes on with the values at ``POINTS`` equal steps of its rank, each with the
count of the values up to it; a merge, of up to ``MERGED`` such tables, moves a rank by at most one step.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame

from revlens.session import checkpoint_dir

POINTS = 1 << 16
MERGED = 16                 # counts of a feature that wait for a merge
CHUNK = 1 << 18             # rows of a chunk
ONE_TASK = 2_000_000        # rows, of 17 bytes each, that one task takes
BLOCK = 1 << 15             # rows of a chunk that are worked on at a time
COLLECTED = 64 << 20        # bytes of histograms that the driver adds up itself
EPSILON = float(np.finfo(float).eps)
NODE = ("treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, "
        "leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>")

Points = tuple[np.ndarray, np.ndarray]      # sorted values, rows of each
Chunk = tuple[np.ndarray, np.ndarray, np.ndarray]   # bins (feature x row), what is left to learn, its squares by leaf of the last tree


# ------------------------------------------------------------------ bins
def _merged(parts: list[Points]) -> Points:
    values, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    counts = np.bincount(at, weights=np.concatenate([c for _, c in parts]), minlength=len(values))
    if len(values) <= POINTS:
        return values, counts
    upto = np.cumsum(counts)
    keep = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, POINTS + 1) / POINTS))
    return values[keep], np.diff(upto[keep], prepend=0.0)


def _columns(b: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in b.columns]


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[list[Points]] | None = None
    size = 0
    for b in batches:
        held = held or [[] for _ in b.columns]
        for own, c in zip(held, _columns(b)):
            own.append((c + 0.0, np.ones(len(c))))      # -0.0 is 0.0
        size += len(b)
        if size >= CHUNK:
            held, size = [[_merged(own)] for own in held], 0
    if held:
        found = [_merged(own) for own in held]
        yield pa.RecordBatch.from_pydict({"feature": pa.array(range(len(found)), pa.int32()), "points": pa.array([v.tobytes() for v, _ in found], pa.binary()),
                                          "counts": pa.array([c.tobytes() for _, c in found], pa.binary())})


def _joined(a: list[Points], b: list[Points]) -> list[Points]:
    both = a + b
    return both if len(both) <= MERGED else [_merged(both)]


def thresholds(values: np.ndarray, counts: np.ndarray, n_splits: int) -> np.ndarray:
    """Spark ML's cuts of a feature: between all values, or where the count is nearest to the next multiple of an equal share."""
    middle = (values[:-1] + values[1:]) / 2.0
    if len(middle) <= n_splits:
        return middle
    share = counts.sum() / (n_splits + 1)
    upto, target, out = np.cumsum(counts).tolist(), share, []
    for i in range(1, len(upto)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(middle[i - 1])
            target += share
    return np.array(out)


def edges(features: DataFrame, n_splits: int) -> list[np.ndarray]:
    """Cuts of each column."""
    found = (features.mapInArrow(_values, "feature int, points binary, counts binary").rdd
             .map(lambda r: (r[0], [(np.frombuffer(r[1]), np.frombuffer(r[2]))])).reduceByKey(_joined).mapValues(_merged).collectAsMap())
    return [thresholds(*found[f], n_splits) for f in range(len(features.columns))]


def _binned(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row of two buffers for CHUNK rows or the partition's last."""
    kind = np.uint8 if max(map(len, cuts)) < 256 else np.uint16
    bins: list[np.ndarray] = []
    labels: list[np.ndarray] = []

    def chunk() -> pa.RecordBatch:
        x, y = np.concatenate(bins, axis=1), np.concatenate(labels)
        bins.clear()
        labels.clear()
        return pa.RecordBatch.from_pydict({"bins": pa.array([x.tobytes()], pa.binary()), "label": pa.array([y.tobytes()], pa.binary())})
    for b in batches:
        *columns, label = _columns(b)
        bins.append(np.stack([np.searchsorted(c, x).astype(kind) for c, x in zip(cuts, columns)]))
        labels.append(label)
        if sum(map(len, labels)) >= CHUNK:
            yield chunk()
    if labels:
        yield chunk()


def _chunk(row: tuple, n_features: int) -> Chunk:
    label = np.frombuffer(row[1])
    kind = np.uint8 if len(row[0]) == n_features * len(label) else np.uint16
    return np.frombuffer(row[0], kind).reshape(n_features, -1), label, np.zeros(1)


# ------------------------------------------------------------------ passes over the chunks
class Tree:
    """A tree being grown, its nodes numbered like a heap. Below a leaf all rows go left, so
    that ``depth`` steps bring every row to the place of its leaf."""

    def __init__(self, depth: int):
        n = (2 << depth) - 1
        self.depth = depth
        self.feature, self.bin = np.zeros(n, np.int64), np.full(n, np.iinfo(np.uint16).max, np.uint16)
        self.split = np.zeros(n, bool)
        self.rows, self.sum, self.squares, self.gain = np.zeros(n), np.zeros(n), np.zeros(n), np.full(n, -1.0)

    def level(self, depth: int) -> slice:
        return slice((1 << depth) - 1, (2 << depth) - 1)

    def values(self) -> np.ndarray:
        """Prediction at each place of the lowest level."""
        out = self.sum / np.maximum(self.rows, 1)
        for i in range((1 << self.depth) - 1):
            if not self.split[i]:
                out[2 * i + 1] = out[i]
        return out[self.level(self.depth)]


def _places(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Rows, BLOCK at a time, and the place of each among the nodes of the level ``depth``."""
    n = bins.shape[1]
    flat, first = bins.ravel(), feature * n
    for lo in range(0, n, BLOCK):
        at = np.arange(lo, min(n, lo + BLOCK))
        node = np.zeros(len(at), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (flat.take(first.take(node) + at) > cut.take(node))
        yield slice(lo, lo + len(at)), node - ((1 << depth) - 1)


def _histograms(chunks: Iterator[Chunk], widths: list[int], scale: float, depth: int, feature: np.ndarray, cut: np.ndarray,
                slot: np.ndarray, counted: bool) -> Iterator[list[np.ndarray]]:
    """[sum by slot, feature and bin; its squares by slot; squares by leaf of the tree before;
    rows by slot, feature and bin if counted]. Nodes of the last slot are left out."""
    slots = int(slot.max()) + 1
    sums, rows = ([np.zeros(slots * w) for w in widths] for _ in range(2))
    squares, before = np.zeros(slots), 0.0
    for bins, left, last in chunks:
        before = before + last
        for block, node in _places(bins, feature, cut, depth):
            target, place = left[block] * scale, slot.take(node)
            squares += np.bincount(place, target * target, slots)
            for f, w in enumerate(widths):
                index = place * w
                index += bins[f, block]
                sums[f] += np.bincount(index, target, slots * w)
                if counted:
                    rows[f] += np.bincount(index, None, slots * w)

    def table(parts: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([x.reshape(slots, w) for x, w in zip(parts, widths)], axis=1)
    if np.ndim(before):
        yield [table(sums), squares, before] + ([table(rows)] if counted else [])


def _added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [x + y for x, y in zip(a, b)]


def _advanced(chunk: Chunk, scale: float, depth: int, feature: np.ndarray, cut: np.ndarray, step: np.ndarray) -> Chunk:
    bins, left, _ = chunk
    now, squares = np.empty(len(left)), np.zeros(1 << depth)
    for block, place in _places(bins, feature, cut, depth):
        target = left[block] * scale
        squares += np.bincount(place, target * target, 1 << depth)
        now[block] = left[block] - step.take(place)
    return bins, now, squares


class Held:
    """The chunks in the hands of one task."""

    def __init__(self, chunks: list[Chunk]):
        self.chunks = chunks

    def histograms(self, number: int, size: int, **how) -> list[np.ndarray]:
        return next(_histograms(iter(self.chunks), **how))

    def advance(self, **how) -> None:
        self.chunks = [_advanced(c, **how) for c in self.chunks]

    def squares(self) -> np.ndarray:
        return sum(c[2] for c in self.chunks)


class Spread:
    """The chunks in an RDD, kept once a tree. Its lineage is cut every ``interval`` trees: a lost
    task learns at most the trees since then again."""

    def __init__(self, state: RDD, interval: int):
        self.state, self.interval = state.persist(StorageLevel.MEMORY_AND_DISK), interval
        self.old: RDD | None = None
        self.written: str | None = None

    def histograms(self, number: int, size: int, **how) -> list[np.ndarray]:
        if self.old is not None and number % self.interval == 0:
            self.state.checkpoint()
        found = self.state.mapPartitions(partial(_histograms, **how))
        if found.getNumPartitions() * size <= COLLECTED:
            out = reduce(_added, found.collect())
        else:
            out = found.treeReduce(_added)
        if self.old is not None:
            self.old.unpersist()
            self.old = None
        return out

    def advance(self, **how) -> None:
        self.old, self.state = self.state, self.state.map(partial(_advanced, **how)).persist(StorageLevel.MEMORY_AND_DISK)
        if self.old.isCheckpointed():
            self._forget()
            self.written = self.old.getCheckpointFile()

    def squares(self) -> np.ndarray:
        out = reduce(np.add, self.state.map(lambda c: c[2]).collect())
        self.state.unpersist()
        self.old.unpersist()
        self._forget()
        return out

    def _forget(self) -> None:
        if self.written:
            sc = self.state.context
            path = sc._jvm.org.apache.hadoop.fs.Path(self.written)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


# ------------------------------------------------------------------ growth
def _splits(tree: Tree, nodes: np.ndarray, rows: np.ndarray, sums: np.ndarray, widths: list[int]) -> None:
    """Splits the nodes at the cut of most gain (the first of equals), if it gains; rows and sums by node, feature and bin."""
    n, s = rows[:, :widths[0]].sum(axis=1), sums[:, :widths[0]].sum(axis=1)
    best, feature, cut = np.zeros(len(nodes)), np.full(len(nodes), -1), np.zeros(len(nodes), np.int64)
    left_n, left_s = np.zeros(len(nodes)), np.zeros(len(nodes))
    every, at = np.arange(len(nodes)), 0
    for f, w in enumerate(widths):
        if w > 1:
            nl, sl = rows[:, at:at + w - 1].cumsum(axis=1), sums[:, at:at + w - 1].cumsum(axis=1)
            nr, sr = n[:, None] - nl, s[:, None] - sl
            gain = np.where((nl > 0) & (nr > 0), (sl * sl / np.maximum(nl, 1) + sr * sr / np.maximum(nr, 1) - (s * s / n)[:, None]) / n[:, None], -1.0)
            top = gain.argmax(axis=1)
            better = gain[every, top] > best
            best = np.where(better, gain[every, top], best)
            feature, cut = np.where(better, f, feature), np.where(better, top, cut)
            left_n, left_s = np.where(better, nl[every, top], left_n), np.where(better, sl[every, top], left_s)
        at += w
    for k in np.flatnonzero(feature >= 0):
        i = nodes[k]
        tree.split[i], tree.feature[i], tree.bin[i], tree.gain[i] = True, feature[k], cut[k], best[k]
        tree.rows[2 * i + 1], tree.sum[2 * i + 1] = left_n[k], left_s[k]
        tree.rows[2 * i + 2], tree.sum[2 * i + 2] = n[k] - left_n[k], s[k] - left_s[k]


def _node_rows(tree: Tree, number: int, cuts: list[np.ndarray]) -> list[tuple]:
    """Rows of Spark ML's table of nodes, in its order; leaves of one prediction under one node are one."""
    out: list[list] = []

    def add(i: int) -> float | None:
        """Prediction if the node is a leaf."""
        n, s, q = float(tree.rows[i]), float(tree.sum[i]), float(tree.squares[i])
        prediction, at = s / n, len(out)
        out.append([at, prediction, (q - s * s / n) / n, [n, s, q], int(n), -1.0, -1, -1, (-1, [], -1)])
        if not tree.split[i]:
            return prediction
        left = add(2 * i + 1)
        right_at = len(out)
        right = add(2 * i + 2)
        if left is not None and left == right:
            del out[at + 1:]
            return left
        f = int(tree.feature[i])
        out[at][5:] = [float(tree.gain[i]), at + 1, right_at, (f, [float(cuts[f][tree.bin[i]])], -1)]
        return None
    add(0)
    return [(number, tuple(r)) for r in out]


def _as_model(features: DataFrame, regressor: GBTRegressor, trees: list[Tree], weights: list[float], cuts: list[np.ndarray]) -> GBTRegressionModel:
    """The trees in the folders that Spark ML's model is loaded from."""
    spark = features.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/boosted-{uuid.uuid4().hex[:12]}"

    def metadata(estimator, name: str, **more) -> str:
        own = f"{path}/{name}"
        estimator.save(own)
        made = json.loads(spark.read.text(f"{own}/metadata").first()[0])
        return json.dumps(made | {"class": made["class"].replace("Regressor", "RegressionModel")} | more)
    whole = metadata(regressor, "estimator", numFeatures=len(cuts), numTrees=len(trees))
    one = DecisionTreeRegressor(featuresCol=regressor.getFeaturesCol(), labelCol=regressor.getLabelCol(), maxDepth=regressor.getMaxDepth(),
                                maxBins=regressor.getMaxBins(), seed=regressor.getSeed())
    of_tree = metadata(one, "tree")
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/model/metadata")
    spark.createDataFrame([(i, of_tree, w) for i, w in enumerate(weights)], "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/model/treesMetadata")
    rows = [r for i, tree in enumerate(trees) for r in _node_rows(tree, i, cuts)]
    spark.createDataFrame(rows, NODE).coalesce(1).write.parquet(f"{path}/model/data")
    return GBTRegressionModel.load(f"{path}/model")


def grow(chunks: Held | Spread, widths: list[int], depth: int, rounds: int, rate: float) -> list[Tree]:
    trees: list[Tree] = []
    root_rows = None
    for number in range(rounds):
        tree, scale = Tree(depth), 2.0 if number else 1.0       # minus the gradient of the squared error, but for the first tree
        for level in range(max(depth, 1)):
            here = tree.level(level)
            nodes = np.arange(here.start, here.stop)
            if level:
                nodes = nodes[tree.split[(nodes - 1) // 2]]
            if not len(nodes):
                break
            slot = np.full(1 << level, len(nodes))
            slot[nodes - here.start] = np.arange(len(nodes))
            sums, squares, before, *rows = chunks.histograms(number, 2 * 8 * sum(widths) * len(nodes), widths=widths, scale=scale, depth=level,
                                                             feature=tree.feature, cut=tree.bin, slot=slot, counted=level > 0 or not number)
            if not level:
                if trees:
                    trees[-1].squares[tree.level(depth)] = before
                root_rows = rows[0] if rows else root_rows      # the same for all trees
                tree.rows[0], tree.sum[0] = root_rows[0, :widths[0]].sum(), sums[0, :widths[0]].sum()
            rows = rows[0] if level else root_rows
            tree.squares[nodes] = squares[:len(nodes)]
            # a node without variance is a leaf (the root is one for want of gain)
            n, s = tree.rows[nodes], tree.sum[nodes]
            found = np.flatnonzero(np.abs((tree.squares[nodes] - s * s / n) / n) >= EPSILON) if level else np.zeros(1, int)
            if len(found) and depth:
                _splits(tree, nodes[found], rows[found], sums[found], widths)
        trees.append(tree)
        chunks.advance(scale=scale, depth=depth, feature=tree.feature, cut=tree.bin, step=(rate if number else 1.0) * tree.values())
    trees[-1].squares[trees[-1].level(depth)] = chunks.squares()
    return trees


def fit(features: DataFrame, label: str, rows: int, regressor: GBTRegressor) -> GBTRegressionModel:
    """The regressor's model of the table features(finite doubles, ..., label), of ``rows`` rows.
    Up to ONE_TASK rows one task grows all trees: its passes take less time than jobs take to start."""
    checkpoint_dir(features.sparkSession)
    names = [c for c in features.columns if c != label]
    rounds, rate = regressor.getMaxIter(), regressor.getStepSize()
    cuts = edges(features.select(*names), min(regressor.getMaxBins(), rows) - 1)
    how = {"widths": [len(c) + 1 for c in cuts], "depth": regressor.getMaxDepth(), "rounds": rounds, "rate": rate}
    binned = features.select(*names, label).mapInArrow(partial(_binned, cuts=cuts), "bins binary, label binary").rdd
    chunks = binned.map(partial(_chunk, n_features=len(names)))
    if rows <= ONE_TASK:
        trees = chunks.repartition(1).mapPartitions(lambda own: [grow(Held(list(own)), **how)]).first()
    else:
        trees = grow(Spread(chunks, regressor.getCheckpointInterval()), **how)
    return _as_model(features, regressor, trees, [1.0] + [rate] * (rounds - 1), cuts)

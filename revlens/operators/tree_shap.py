"""M3 with a fitted ensemble: exact path-dependent Shapley values.

The value of a set S of known features is the ensemble's output where splits on S follow
the row and the others go both ways, weighted by the training rows on each side. It is a
sum over leaves: leaf value times, per feature of the leaf's path, 1 or 0 (known: whether
the row meets all of the path's conditions on it) or the share of training rows that go the path's
way at its splits (unknown). A leaf's Shapley values therefore depend on the row only through
one bit per feature of its path, so they are tabulated for all bit patterns once.
Neighbouring leaves share splits, so their tables are added up by the outcomes of the
splits of the group; a row looks the outcomes up by its features' bins, then a sum per
group. Rows are taken in batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from revlens.operators.ml import feature_columns
from revlens.schemas import FEATURE_ORDER

ROWS = 4096             # rows walked at a time
LEAVES = 4096           # leaves whose tables are made at a time
BITS = 8                # tests of a group of leaves, unless one leaf alone has more


@dataclass
class Leaves:
    """Leaves of an ensemble, one row each; paths are filled up to the same number of
    features with ones that every row meets and no split tests (feature 0, share 1)."""
    feature: np.ndarray     # leaf x slot: feature index
    low: np.ndarray         # leaf x slot: the path holds rows with low < x <= high
    high: np.ndarray
    share: np.ndarray       # leaf x slot: product of the training shares of the path's splits
    value: np.ndarray       # leaf value times its tree's weight

    @property
    def base(self) -> float:
        return float((self.value * self.share.prod(axis=1)).sum())

    def part(self, lo: int, hi: int) -> Leaves:
        return Leaves(self.feature[lo:hi], self.low[lo:hi], self.high[lo:hi], self.share[lo:hi], self.value[lo:hi])


def leaves(nodes: list[dict], weights: list[float]) -> Leaves:
    """From node rows (tree, id, left, right, feature, threshold, prediction, rows); a leaf has left = -1."""
    trees: dict[int, dict[int, dict]] = {}
    for n in nodes:
        trees.setdefault(n["tree"], {})[n["id"]] = n
    paths = []
    for t, tree in sorted(trees.items()):
        waiting = [(0, {})]
        while waiting:
            at, path = waiting.pop()
            n = tree[at]
            if n["left"] < 0:
                paths.append((path, weights[t] * n["prediction"]))
                continue
            f, cut = n["feature"], n["threshold"]
            lo, hi, share = path.get(f, (-np.inf, np.inf, 1.0))
            for child, bounds in ((n["left"], (lo, min(hi, cut))), (n["right"], (max(lo, cut), hi))):
                waiting.append((child, {**path, f: (*bounds, share * tree[child]["rows"] / n["rows"])}))
    width = max([1, *(len(p) for p, _ in paths)])
    shape = (len(paths), width)
    out = Leaves(np.zeros(shape, np.int64), np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape), np.array([v for _, v in paths]))
    for i, (path, _) in enumerate(paths):
        for j, (f, (lo, hi, share)) in enumerate(sorted(path.items())):
            out.feature[i, j], out.low[i, j], out.high[i, j], out.share[i, j] = f, lo, hi, share
    return out


def tables(part: Leaves) -> np.ndarray:
    """leaf x pattern x slot: Shapley value of each slot's feature when the bits of the pattern
    say which slots' conditions the row meets."""
    n, d = part.share.shape
    meets = (np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(float)
    weight = np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])
    out = np.empty((n, 1 << d, d))
    for i in range(d):
        # coefficient k: sum over sets of k other slots known, of the product of their bits
        # and of the shares of the rest
        poly = np.zeros((n, 1 << d, d))
        poly[:, :, 0] = 1
        for degree, j in enumerate([j for j in range(d) if j != i], 1):
            shifted = poly[:, :, :degree] * meets[None, :, j, None]
            poly *= part.share[:, None, None, j]
            poly[:, :, 1:degree + 1] += shifted
        out[:, :, i] = (poly @ weight) * (meets[None, :, i] - part.share[:, None, i]) * part.value[:, None]
    return out


@dataclass
class Group:
    """Leaves that are looked up together: their sums by the outcomes of the tests they share."""
    tests: list[tuple[int, float, float]]   # (feature, low, high): bit i is set if low < x <= high
    table: np.ndarray                       # outcomes x (contribution per feature, prediction)


def grouped(ensemble: Leaves, n_features: int) -> Iterator[Group]:
    """Neighbouring leaves share most splits of their paths: as many as have BITS cuts together
    make a group. A leaf with more of its own is tested by the intervals of its features."""
    paths = [[(int(f), lo, hi) for f, lo, hi in zip(*row) if lo > -np.inf or hi < np.inf]
             for row in zip(ensemble.feature, ensemble.low.tolist(), ensemble.high.tolist())]
    cuts = [{(f, cut) for f, lo, hi in path for cut in (lo, hi) if np.isfinite(cut)} for path in paths]
    step = max(1, LEAVES >> max(0, ensemble.share.shape[1] - 6))
    for first in range(0, len(paths), step):
        part = ensemble.part(first, first + step)
        by_leaf, lo = tables(part), 0
        while lo < len(part.value):
            hi, own = lo + 1, cuts[first + lo]
            while hi < len(part.value) and len(own | cuts[first + hi]) <= BITS:
                own = own | cuts[first + hi]
                hi += 1
            tests = [(f, cut, np.inf) for f, cut in sorted(own)] if len(own) <= BITS else paths[first + lo]
            yield Group(tests, _merged(part.part(lo, hi), by_leaf[lo:hi], tests, n_features))
            lo = hi


def _merged(part: Leaves, by_leaf: np.ndarray, tests: list[tuple[int, float, float]], n_features: int) -> np.ndarray:
    outcome = np.arange(1 << len(tests))
    passed = {test: (outcome >> i & 1).astype(bool) for i, test in enumerate(tests)}
    out = np.zeros((len(outcome), n_features + 1))
    d = part.share.shape[1]
    for i in range(len(part.value)):
        pattern = np.zeros(len(outcome), np.int64)
        for j in range(d):
            f, lo, hi = int(part.feature[i, j]), float(part.low[i, j]), float(part.high[i, j])
            meets = passed.get((f, lo, hi))
            if meets is None:
                meets = np.ones(len(outcome), bool)
                if lo > -np.inf:
                    meets = meets & passed[f, lo, np.inf]
                if hi < np.inf:
                    meets = meets & ~passed[f, hi, np.inf]
            pattern |= meets.astype(np.int64) << j
        for j in range(d):
            out[:, part.feature[i, j]] += by_leaf[i, pattern, j]
        out[:, -1] += np.where(pattern == (1 << d) - 1, part.value[i], 0.0)
    return out


class TreeExplainer:
    """Per feature, the bin of a value among all cuts gives the outcomes of all tests of the
    feature; put together over the features, they are the rows of the groups' tables."""

    def __init__(self, ensemble: Leaves, n_features: int):
        self.n = n_features
        groups = list(grouped(ensemble, n_features))
        self.tables = [g.table for g in groups]
        # tests at one place of the outcomes' words: groups of many tests have wider words
        width = max(len(g.tests) for g in groups)
        word = next(t for t in (np.uint8, np.uint16, np.uint32) if 8 * np.dtype(t).itemsize >= width)
        self.cuts = []
        for f in range(n_features):
            cuts = ensemble.low[ensemble.feature == f], ensemble.high[ensemble.feature == f]
            cuts = np.concatenate(cuts)
            self.cuts.append(np.unique(cuts[np.isfinite(cuts)]))
        self.outcomes = [np.zeros((len(c) + 1, len(groups)), word) for c in self.cuts]
        for at, g in enumerate(groups):
            for i, (f, lo, hi) in enumerate(g.tests):
                # bin b holds the values above b cuts
                above = 0 if lo == -np.inf else np.searchsorted(self.cuts[f], lo) + 1
                upto = len(self.cuts[f]) if hi == np.inf else np.searchsorted(self.cuts[f], hi)
                self.outcomes[f][above:upto + 1, at] |= word(1 << i)

    def explain(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rows x features -> (prediction, contributions); a missing value goes right at every split."""
        x = np.where(np.isnan(x), np.inf, x)
        out = np.zeros((len(x), self.n + 1))
        for lo in range(0, len(x), ROWS):
            rows, sums = x[lo:lo + ROWS], out[lo:lo + ROWS]
            pattern = np.zeros((len(rows), len(self.tables)), self.outcomes[0].dtype)
            for f, (cuts, outcomes) in enumerate(zip(self.cuts, self.outcomes)):
                if len(cuts):
                    pattern |= outcomes[np.searchsorted(cuts, rows[:, f])]
            found = np.empty(sums.shape)
            for table, at in zip(self.tables, np.ascontiguousarray(pattern.T)):
                sums += np.take(table, at, axis=0, out=found, mode="clip")
        return out[:, -1], out[:, :-1]


# ------------------------------------------------------------------ Spark
def export(spark: SparkSession, path: str) -> Leaves:
    """The boosted trees of a saved pipeline (``ml.train_and_register``), read as tables. A model
    has a bounded number of nodes (rounds x 2^(depth + 1)); they go through the driver."""
    found = [(i, s) for i, s in enumerate(PipelineModel.load(path).stages) if hasattr(s, "treeWeights")]
    if not found:
        raise ValueError("the pipeline holds no boosted trees")
    i, stage = found[-1]
    data = spark.read.parquet(f"{path.rstrip('/')}/stages/{i}_{stage.uid}/data").select("treeID", "nodeData.*")
    nodes = [{"tree": r.treeID, "id": r.id, "left": r.leftChild, "right": r.rightChild, "feature": r.split.featureIndex if r.split else -1,
              "threshold": r.split.leftCategoriesOrThreshold[0] if r.split and r.split.leftCategoriesOrThreshold else 0.0,
              "prediction": r.prediction, "rows": r.rawCount} for r in data.collect()]
    return leaves(nodes, list(stage.treeWeights))


def explain_trees(df: DataFrame, ensemble: Leaves) -> DataFrame:
    """(click_id, base_value, prediction, attributions) of every row: exact Shapley values of the
    ensemble; base_value + their sum = prediction up to rounding. No shuffle: rows are
    explained where they lie, in Arrow batches; the leaves travel with the task."""
    held: dict[str, TreeExplainer] = {}
    n = len(FEATURE_ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "explainer" not in held:
            held["explainer"] = TreeExplainer(ensemble, n)
        explainer = held["explainer"]
        for b in batches:
            x = np.column_stack([c.fill_null(np.nan).to_numpy(zero_copy_only=False) for c in b.columns[1:]]) if len(b) else np.zeros((0, n))
            prediction, phi = explainer.explain(x)
            keys = pa.array(FEATURE_ORDER, pa.string()).take(pa.array(np.tile(np.arange(n), len(b))))
            offsets = pa.array(np.arange(len(b) + 1) * n, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(b), ensemble.base)), pa.array(prediction),
                                              pa.MapArray.from_arrays(offsets, keys, pa.array(phi.ravel()))],
                                             ["click_id", "base_value", "prediction", "attributions"])
    return df.select("click_id", *feature_columns(df)).mapInArrow(
        run, "click_id string, base_value double, prediction double, attributions map<string, double>")

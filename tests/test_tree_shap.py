"""Exact tree attributions against the subset definition."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.operators import ml
from revlens.operators import tree_shap as ts


def random_tree(rng, t, depth, n_features):
    """Node rows of a random tree; features repeat along paths, thresholds may contradict."""
    nodes, counter = [], [0]

    def grow(level, rows):
        i = counter[0]
        counter[0] += 1
        node = {"tree": t, "id": i, "left": -1, "right": -1, "feature": -1, "threshold": 0.0, "prediction": float(rng.normal()), "rows": rows}
        nodes.append(node)
        if level < depth and rows > 1 and rng.random() < 0.9:
            node.update(feature=int(rng.integers(n_features)), threshold=float(rng.normal()))
            left = int(rng.integers(1, rows))
            node["left"] = grow(level + 1, left)
            node["right"] = grow(level + 1, rows - left)
        return i
    grow(0, int(rng.integers(50, 500)))
    return nodes


def value(tree, x, known, at=0):
    """Output of one tree when only the features in ``known`` are."""
    n = tree[at]
    if n["left"] < 0:
        return n["prediction"]
    if n["feature"] in known:
        return value(tree, x, known, n["left"] if x[n["feature"]] <= n["threshold"] else n["right"])
    return sum(tree[c]["rows"] / n["rows"] * value(tree, x, known, c) for c in (n["left"], n["right"]))


def by_definition(trees, weights, x, n):
    def v(known):
        return sum(w * value(t, x, known) for t, w in zip(trees, weights))
    phi = np.zeros(n)
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        for k in range(n):
            for s in combinations(rest, k):
                phi[i] += factorial(k) * factorial(n - 1 - k) / factorial(n) * (v({*s, i}) - v(set(s)))
    return v(set()), v(set(range(n))), phi


@pytest.mark.parametrize("depth, n_features", [(1, 2), (3, 3), (5, 4), (6, 5)])
def test_equals_subset_definition(depth, n_features, monkeypatch):
    monkeypatch.setattr(ts, "LEAVES", 8)        # several parts
    monkeypatch.setattr(ts, "ROWS", 3)
    rng = np.random.default_rng(depth)
    for _ in range(4):
        rows = [random_tree(rng, t, depth, n_features) for t in range(3)]
        weights = [1.0, 0.5, -0.25]
        ensemble = ts.leaves([n for r in rows for n in r], weights)
        trees = [{n["id"]: n for n in r} for r in rows]
        x = rng.normal(size=(7, n_features))
        x[0, 0], x[1, 1] = np.nan, rows[0][0]["threshold"]
        prediction, phi = ts.TreeExplainer(ensemble, n_features).explain(x)
        for i in range(len(x)):
            base, out, want = by_definition(trees, weights, x[i], n_features)
            assert ensemble.base == pytest.approx(base) and prediction[i] == pytest.approx(out)
            assert phi[i] == pytest.approx(want, abs=1e-12) and base + phi[i].sum() == pytest.approx(out)


def test_single_leaf():
    node = {"tree": 0, "id": 0, "left": -1, "right": -1, "feature": -1, "threshold": 0.0, "prediction": 3.0, "rows": 5}
    prediction, phi = ts.TreeExplainer(ts.leaves([node], [2.0]), 2).explain(np.zeros((2, 2)))
    assert prediction.tolist() == [6, 6] and not phi.any()


def test_fitted_model_explained(spark, tmp_path):
    df = spark.range(600).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("click_id"),
                                 *[((F.col("id") * (7 + 4 * i)) % (50 + i) / 10.0).alias(f) for i, f in enumerate(ml.FEATURE_ORDER)])
    df = df.withColumn("target_revenue", F.col("rpc_7d") * 2 + F.col("rpc_14d") * F.col("cerberus_score"))
    model = ml.train_rpc(df, rounds=6, max_depth=4)
    model.write().save(f"{tmp_path}/m")
    clicks = df.withColumn("rpc_7d", F.when(F.col("click_id") == "c5", F.lit(None)).otherwise(F.col("rpc_7d")))
    got = {r.click_id: r for r in ts.explain_trees(clicks, ts.export(spark, f"{tmp_path}/m")).collect()}
    want = {r.click_id: r.prediction for r in model.transform(clicks).select("click_id", "prediction").collect()}
    assert set(got) == set(want) and len(got) == 600
    for k, r in got.items():
        assert r.prediction == pytest.approx(want[k]) and r.base_value + sum(r.attributions.values()) == pytest.approx(r.prediction)
    assert len({round(r.attributions["cerberus_score"], 6) for r in got.values()}) > 3
    assert ts.explain_trees(clicks.limit(0), ts.export(spark, f"{tmp_path}/m")).count() == 0
    with pytest.raises(ValueError):
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import VectorAssembler
        Pipeline(stages=[VectorAssembler(inputCols=["rpc_7d"], outputCol="v")]).fit(df).write().save(f"{tmp_path}/no")
        ts.export(spark, f"{tmp_path}/no")


@pytest.mark.parametrize("bits", [1, 3, 6])
def test_leaves_of_many_cuts(bits, monkeypatch):
    """Groups whose tests are cuts, and leaves alone whose tests are intervals; -inf goes left, as in the model."""
    monkeypatch.setattr(ts, "BITS", bits)
    rng = np.random.default_rng(bits)
    nodes = random_tree(rng, 0, 6, 3)
    ensemble = ts.leaves(nodes, [1.5])
    x = rng.normal(size=(9, 3))
    x[0, 0], x[1, 1], x[2, 2], x[3] = -np.inf, np.inf, np.nan, -np.inf
    prediction, phi = ts.TreeExplainer(ensemble, 3).explain(x)
    for i in range(len(x)):
        base, out, want = by_definition([{n["id"]: n for n in nodes}], [1.5], x[i], 3)
        assert prediction[i] == pytest.approx(out) and phi[i] == pytest.approx(want, abs=1e-12)


def test_work_of_a_row_is_of_groups_not_leaves():
    """A complete tree of depth 5: a row looks up a few sums, each of neighbouring leaves."""
    rng = np.random.default_rng(7)
    inner = [{"tree": 0, "id": i, "left": 2 * i + 1, "right": 2 * i + 2, "feature": int(rng.integers(8)), "threshold": float(rng.normal()),
              "prediction": 0.0, "rows": 64 >> (i + 1).bit_length() - 1} for i in range(31)]
    ends = [{"tree": 0, "id": i, "left": -1, "right": -1, "feature": -1, "threshold": 0.0, "prediction": float(i), "rows": 2} for i in range(31, 63)]
    ensemble = ts.leaves(inner + ends, [1.0])
    assert len(ensemble.value) == 32 and len(list(ts.grouped(ensemble, 8))) <= 8


def test_join_of_predictions_moves_no_attributions(spark, tmp_path, monkeypatch):
    """a click's attributions are summed up before the join with the pipeline's own predictions."""
    from revlens.plans import catalog as C
    df = spark.range(300).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("click_id"),
                                 *[((F.col("id") * (7 + 4 * i)) % (50 + i) / 10.0).alias(f) for i, f in enumerate(ml.FEATURE_ORDER)])
    ml.train_rpc(df.withColumn("target_revenue", F.col("rpc_7d") * 2), rounds=3, max_depth=2).write().save(f"{tmp_path}/m")
    monkeypatch.setattr(C, "fitted_model", lambda spark, sf: f"{tmp_path}/m")
    monkeypatch.setattr(C, "valid_clicks", lambda spark, sf: df)
    out = C._m3t(spark, "")
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Join ")[0]
    assert "adds_up" in above and "attributions" not in above
    assert out.columns == ["click_id", "features", "adds_up", "same_prediction"]
    assert [tuple(r[1:]) for r in out.collect()] == [(8, True, True)] * 300

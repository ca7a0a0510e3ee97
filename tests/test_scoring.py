"""Scoring decision tree (the reference's use-case tests) and model jobs."""

import pytest
from pyspark.sql import functions as F

from revlens.operators import ml
from revlens.operators import scoring as sc
from revlens.operators.breaker import STATE, BreakerState

CLICK = "click_id string, correlation_id string, hour_of_day long, cerberus_score double, rpc_7d double, " \
        "rpc_14d double, rpc_30d double, is_payday_week boolean, auction_pressure double, visits_prev_30d long"
CFG = "version long, kill boolean, bounds_min double, bounds_max double, canary_bp long"
LEDGER = "click_id string, revenue double, revenue_ts timestamp, order_id string, ts_ms long"


def _click(spark, cid="c-1"):
    return spark.createDataFrame([(cid, "r", 14, 0.8, 1.2, 1.1, 1.0, False, 0.4, 3)], CLICK)


class Const(ml.LinearRpcModel):
    def __init__(self, v):
        super().__init__(v, {})


def _score(spark, model, cfg, ledger=None, **kw):
    led = ledger if ledger is not None else spark.createDataFrame([], LEDGER)
    return sc.score_clicks(_click(spark), spark.createDataFrame([cfg], CFG), led, model, "v9", **kw).first()


def test_kill_switch(spark):
    r = _score(spark, Const(4.2), (1, True, 0.1, 100.0, 10_000))
    assert (r.source, r.reason, r.predicted_rpc, r.model_version) == ("KILL_SWITCH", "kill_switch", 0.0, "fallback")


def test_canary_zero(spark):
    r = _score(spark, Const(4.2), (1, False, 0.1, 100.0, 0))
    assert (r.source, r.reason, r.predicted_rpc) == ("FALLBACK_TCPA", "out_of_canary", 0.0)


def test_bounds_rejected(spark):
    r = _score(spark, Const(9999.0), (1, False, 0.1, 100.0, 10_000))
    assert (r.source, r.reason) == ("FALLBACK_TCPA", "bounds_rejected")


def test_model_ok(spark):
    r = _score(spark, Const(4.2), (1, False, 0.1, 100.0, 10_000))
    assert (r.source, r.reason, r.predicted_rpc, r.model_version) == ("MODEL", "score.model", 4.2, "v9")


def test_model_error_uses_ledger(spark):
    led = spark.createDataFrame([("c-1", 2.5, None, "o", 0)], LEDGER)
    r = _score(spark, Const(float("nan")), (1, False, 0.1, 100.0, 10_000), ledger=led)
    assert (r.source, r.reason, r.predicted_rpc) == ("FALLBACK_DATA_LAYER", "model_error", 2.5)
    neg = spark.createDataFrame([("c-1", -2.5, None, "o", 0)], LEDGER)
    r = _score(spark, Const(float("nan")), (1, False, 0.1, 100.0, 10_000), ledger=neg)
    assert (r.reason, r.predicted_rpc) == ("negative_ledger", 0.0)


def test_clv_premium_in_tree(spark):
    clv = spark.createDataFrame([("c-1", 100.0)], "click_id string, clv double")
    r = _score(spark, Const(2.0), (1, False, 0.1, 100.0, 10_000), clv=clv,
               premium=dict(alpha=0.5, reference=100.0, cap=3.0))
    assert (r.source, r.predicted_rpc) == ("MODEL", 3.0)


def test_audit_hash(spark):
    df = spark.createDataFrame([("c", "r", 3.0, "MODEL", "score.model"), ("c", "r", 2.5, "FALLBACK_TCPA", "x")],
                               "click_id string, correlation_id string, predicted_rpc double, source string, reason string")
    assert [r.after_hash for r in sc.audit_events(df).collect()] == ["Model:3", "FallbackTcpa:2.5"]


def test_overrides_guarded(spark):
    store = spark.createDataFrame([("c-1", -1.0, float("nan"), 7.0, 9)],
                                  "click_id string, rpc_7d double, rpc_14d double, rpc_30d double, visits_prev_30d long")
    r = sc.feature_overrides(_click(spark), store).first()
    assert (r.rpc_7d, r.rpc_14d, r.rpc_30d, r.visits_prev_30d) == (1.2, 1.1, 7.0, 9)


def test_shapley_sums_to_prediction_gbt(spark, sf):
    from revlens.plans import catalog as C
    frame = C.training_rows(spark, sf)
    model = ml.train_rpc(frame, rounds=5, max_depth=3)
    e = ml.explain_clicks(frame.limit(40), model, paths=4)
    bad = e.select((F.col("base_value") + F.aggregate(F.map_values("attributions"), F.lit(0.0), lambda a, b: a + b)
                    - F.col("prediction")).alias("d")).where(F.abs("d") > 1e-6)
    assert e.count() == 40 and bad.count() == 0


def test_shapley_linear_exact(spark, sf):
    from revlens.sources import fixtures as fx
    c = fx.clicks(spark, sf).limit(50)
    e = ml.explain_clicks(c, ml.STAND_IN, paths=3)
    exact = ml.linear_attributions(c)
    j = (e.select("click_id", F.explode("attributions").alias("f", "v"))
          .join(exact.select("click_id", F.explode("attributions").alias("f", "w")), ["click_id", "f"]))
    assert j.count() == 50 * 8 and j.where(F.abs(F.col("v") - F.col("w")) > 1e-6).count() == 0


def test_train_and_register(spark, sf, tmp_path):
    from pyspark.ml import PipelineModel
    from revlens.plans import catalog as C
    frame = C.training_rows(spark, sf)
    m = ml.train_and_register(frame, str(tmp_path / "models"), str(tmp_path / "registry"), "rpc-model",
                              "v7", 1_700_000_000_000, rounds=3, max_depth=2)
    reg = spark.read.parquet(str(tmp_path / "registry")).collect()
    assert [(r.model, r.trained_at_ms) for r in reg] == [("rpc-model@v7", 1_700_000_000_000)]
    loaded = PipelineModel.load(str(tmp_path / "models" / "v7"))
    a = ml.predict(frame, m).select("click_id", "rpc_raw")
    b = ml.predict(frame, loaded).select("click_id", "rpc_raw")
    assert a.exceptAll(b).count() == 0


class Exploding(ml.LinearRpcModel):
    """A model whose evaluation fails: it must never run for bypassed clicks."""

    def __init__(self):
        super().__init__(0.0, {})

    def _transform(self, df):
        return df.withColumn("prediction", F.raise_error(F.lit("model must not run")).cast("double"))


def test_kill_switch_never_calls_model(spark):
    r = _score(spark, Exploding(), (1, True, 0.1, 100.0, 10_000))
    assert r.source == "KILL_SWITCH"


def test_out_of_canary_never_calls_model(spark):
    r = _score(spark, Exploding(), (1, False, 0.1, 100.0, 0))
    assert r.source == "FALLBACK_TCPA" and r.reason == "out_of_canary"


def test_null_click_id_is_not_lost(spark):
    clicks = spark.createDataFrame([(None, "r", 14, 0.8, 1.2, 1.1, 1.0, False, 0.4, 3), ("", "r", 14, 0.8, 1.2, 1.1, 1.0, False, 0.4, 3)], CLICK)
    cfg = spark.createDataFrame([(1, False, 0.1, 100.0, 5_000)], CFG)
    rows = sc.score_clicks(clicks, cfg, spark.createDataFrame([], LEDGER), Const(4.2)).collect()
    assert len(rows) == 2 and {r.click_id: r.reason for r in rows}[None] == "out_of_canary"


def test_breaker_guard_carries_its_state(spark):
    """One table at once equals the same calls in two parts with the state handed over."""
    rows = [(f"c-{i:03d}", "r", 14, 0.8, 0.0 if i % 3 else -9.0, 1.0, 1.0, False, float("nan") if i == 40 else 0.4, 3, i % 2, 1000 * i) for i in range(120)]
    clicks = spark.createDataFrame(rows, CLICK + ", lane long, at_ms long")
    cfg = spark.createDataFrame([(1, False, 0.1, 100.0, 10_000)], CFG)
    model = ml.LinearRpcModel(1.0, {"rpc_7d": 1.0, "auction_pressure": 0.0})
    policy = sc.BreakerPolicy(key="lane", ts="at_ms", window_ms=30_000, threshold=0.3, min_samples=5, cool_off_ms=9_000)
    args = (cfg, spark.createDataFrame([], LEDGER), model, policy)
    whole, _ = sc.score_clicks_guarded(clicks, *args)
    one, state = sc.score_clicks_guarded(clicks.where("at_ms < 50000"), *args)
    two, _ = sc.score_clicks_guarded(clicks.where("at_ms >= 50000"), *args, state)
    want = {r.click_id: r.reason for r in whole.collect()}
    assert {r.click_id: r.reason for r in one.unionByName(two).collect()} == want
    assert set(want.values()) == {"score.model", "anomaly", "breaker_open", "model_error", "bounds_rejected"}
    killed = spark.createDataFrame([(1, True, 0.1, 100.0, 10_000)], CFG)
    out, kept = sc.score_clicks_guarded(clicks, killed, *args[1:], state)
    assert out.count() == 120 and kept.count() == state.count() == 2


def test_breaker_guard_reads_a_shard_batch_by_batch(spark):
    """A hot shard goes through many small Arrow batches, never through one frame."""
    rows = [(f"c-{i:03d}", 0.0 if i % 7 < 2 else 1.0, i % 50 == 49, int(i % 10 == 0), 500 * (i // 2)) for i in range(400)]
    calls = spark.createDataFrame(rows, "click_id string, rpc double, model_error boolean, lane long, at_ms long").repartition(5)
    policy = sc.BreakerPolicy(key="lane", ts="at_ms", window_ms=20_000, threshold=0.3, min_samples=5, cool_off_ms=3_000)
    want, ends = {}, {}
    for lane in (0, 1):
        st = BreakerState(20_000, 0.3, 5, 3_000)
        for c, rpc, error, _, at in (r for r in rows if r[3] == lane):
            reason = st.fail(at) if error else st.step(at, rpc)[-1]
            want[c] = None if reason == "score.model" else reason
        ends[lane] = (list(st.ms), list(st.cnt), list(st.zer), st.opened_at)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        idle = spark.createDataFrame([(9, [1], [2], [1], 5)], STATE)
        df = sc.guard_calls(calls, policy, idle)
        out = df.collect()
        assert "InPandas" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {r.click_id: r.verdict for r in out if not r.is_state} == want and {None, "anomaly", "breaker_open", "model_error"} == set(want.values())
    assert {r.shard: (r.ms, r.cnt, r.zer, r.opened_at) for r in out if r.is_state} == {**ends, 9: ([1], [2], [1], 5)}
    assert len(out) == 403


def test_plain_text_of_doubles(spark):
    from revlens.functions.columns import f64_text
    values = {0.0005: "0.0005", 1e16: "10000000000000000", 12345678.5: "12345678.5", 3.0: "3", 0.0: "0", -2.25: "-2.25", 1.5e-7: "0.00000015",
              1e22: "1" + "0" * 22, 123456789012345.6: "123456789012345.6", -1e-3: "-0.001", 0.1: "0.1", 1e7: "10000000"}
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert {r.v: r.t for r in df.select("v", f64_text("v").alias("t")).collect()} == values


def test_hash_of_an_empty_id(spark):
    from revlens.functions.columns import fnv1a64_mod
    df = spark.createDataFrame([("",), ("a",), (None,)], "c string")
    assert [r[0] for r in df.select(fnv1a64_mod("c")).collect()] == [0xcbf29ce484222325 % 10_000, 0xaf63dc4c8601ec8c % 10_000, None]


def test_attributions_are_parsed_once(spark):
    """The explode's filter and the two shapes refer to one parse of the response."""
    from revlens.operators import ml
    body = '{"explanations":[{"attributions":[{"baselineOutputValue":0.5,"featureAttributions":%s}]}]}'
    df = spark.createDataFrame([("a", body % '{"rpc_7d":1.5,"rpc_14d":"x"}'), ("b", body % '{"features":[1,2,null,"y"]}'), ("c", "{}"), ("d", None)],
                               "click_id string, explanation string")
    p = ml.parse_attributions(df)
    rows = {r.click_id: (r.base_value, r.contributions, r.valid) for r in p.collect()}
    assert rows == {"a": (0.5, {"rpc_7d": 1.5}, True), "b": (0.5, {"hour_of_day": 1.0, "cerberus_score": 2.0}, True),
                    "c": (0.0, None, False), "d": (0.0, None, False)}
    plan = p.select("click_id", F.explode("contributions"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object(") == 3 and plan.count("from_json(") == 2


def test_explain_repeats_no_row_per_term(spark):
    """One row per model input goes into the aggregation: the fan-out is the only generator. The sums
    are those of the linear model's exact attributions, also from a baseline and with nulls."""
    from revlens.operators import ml
    from revlens.schemas import FEATURE_ORDER
    df = spark.range(20).select(F.col("id").cast("string").alias("click_id"), *[
        (F.col("id") * (i + 1) % 7 / 4.0).alias(f) for i, f in enumerate(FEATURE_ORDER)])
    df = df.withColumn("rpc_7d", F.when(F.col("click_id") != "3", F.col("rpc_7d")))
    base = {"rpc_14d": 1.25, "visits_prev_30d": 3.0}
    e = ml.explain_clicks(df, ml.STAND_IN, paths=4, baseline=base)
    assert e._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1
    own = {r.click_id: r for r in df.collect()}
    for r in e.collect():
        if r.click_id == "3":
            assert r.prediction is None
            continue
        for f, w in zip(FEATURE_ORDER, ml.STAND_IN.weights):
            assert abs(r.attributions[f] - w * (own[r.click_id][f] - base.get(f, 0.0))) < 1e-9
        assert abs(r.base_value + sum(r.attributions.values()) - r.prediction) < 1e-9


def test_training_keeps_no_node_ids_and_few_tasks(spark):
    """a round of a small frame is the start of its tasks; the model's own settings stay."""
    frame = spark.range(0, 400, 1, 16).select(F.col("id").cast("string").alias("click_id"),
                                              *[((F.col("id") * (i + 3)) % 17 / 4.0).alias(f) for i, f in enumerate(ml.FEATURE_ORDER)])
    frame = frame.withColumn("target_revenue", F.col("rpc_7d") * 2)
    assert ml.in_full_partitions(frame).rdd.getNumPartitions() == 1
    wide = spark.range(0, 3 * ml.PARTITION_ROWS, 1, 8)
    assert ml.in_full_partitions(wide).rdd.getNumPartitions() == 3
    assert ml.in_full_partitions(wide.coalesce(2)).rdd.getNumPartitions() == 2
    gbt = ml.train_rpc(frame, rounds=3, max_depth=2).stages[-1]
    assert not gbt.getCacheNodeIds() and gbt.getNumTrees == 3
    assert (gbt.getMaxBins(), gbt.getStepSize(), gbt.getSubsamplingRate(), gbt.getLossType()) == (256, 0.05, 1.0, "squared")
    assert (ml.GBT_DEPTH, ml.GBT_ROUNDS) == (6, 400)


def _boosted(spark, rows=3000):
    """Features of few and of many values, one of them constant, and a label that needs several."""
    df = spark.range(0, rows, 1, 3).select(F.col("id"), *[((F.col("id") * (7 + 4 * i)) % (5 + 211 * i) / 8.0).alias(f) for i, f in enumerate(ml.FEATURE_ORDER)])
    return df.withColumn("is_payday_week", F.lit(1.0)).withColumn("target_revenue", F.col("rpc_7d") * 2 + F.col("rpc_14d") * F.col("cerberus_score") + F.sin("id"))


def _by_spark_ml(df, **params):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    return Pipeline(stages=[VectorAssembler(inputCols=ml.FEATURE_ORDER, outputCol="features"), GBTRegressor(
        featuresCol="features", labelCol="target_revenue", stepSize=0.05, seed=42, **params)]).fit(df)


@pytest.mark.parametrize("one_task", [True, False])
def test_trained_trees_are_those_of_spark_ml(spark, monkeypatch, one_task):
    """rows of bins and passes of histograms give Spark ML's trees; in one task or spread over several."""
    import re
    from revlens.operators import boosting
    if not one_task:
        for name, value in (("ONE_TASK", 0), ("CHUNK", 700), ("BLOCK", 256), ("COLLECTED", 300_000)):
            monkeypatch.setattr(boosting, name, value)
        monkeypatch.setattr(ml, "PARTITION_ROWS", 1000)
        monkeypatch.setattr(ml, "CHECKPOINT_ROUNDS", 2)
    df = _boosted(spark)
    got = ml.train_rpc(df, rounds=5, max_depth=4, max_bins=64)
    want = _by_spark_ml(df, maxIter=5, maxDepth=4, maxBins=64)
    shape = [re.sub(r"Predict: .*|GBTRegressionModel.*", "", m.stages[-1].toDebugString) for m in (got, want)]
    assert shape[0] == shape[1] and got.stages[-1].treeWeights == want.stages[-1].treeWeights
    both = got.transform(df).select("id", F.col("prediction").alias("got")).join(want.transform(df).select("id", "prediction"), "id")
    assert both.where(F.abs(F.col("got") - F.col("prediction")) > 1e-9).count() == 0 and both.count() == 3000
    assert [round(x, 9) for x in got.stages[-1].featureImportances.toArray()] == [round(x, 9) for x in want.stages[-1].featureImportances.toArray()]


def test_a_tree_is_no_job_per_level(spark):
    """all trees of a small frame are grown by one task: the jobs do not become more with the rounds."""
    df, sc, counts = _boosted(spark, 300), spark.sparkContext, []
    for rounds in (1, 30):
        sc.setJobGroup(f"boost-{rounds}", "")
        ml.train_rpc(df, rounds=rounds, max_depth=3)
        counts.append(len(sc.statusTracker().getJobIdsForGroup(f"boost-{rounds}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1] > 0


def test_training_odd_rows(spark):
    """A constant label, one row, no row; what is not finite is an error, as it was."""
    df = _boosted(spark, 60)
    for frame, value in ((df.withColumn("target_revenue", F.lit(3.0)), 3.0), (df.limit(1), df.first().target_revenue)):
        model = ml.train_rpc(frame, rounds=3, max_depth=2)
        assert model.stages[-1].getNumTrees == 3 and model.stages[-1].totalNumNodes == 3
        assert model.transform(frame).first().prediction == pytest.approx(value)
    with pytest.raises(ValueError):
        ml.train_rpc(df.limit(0), rounds=1)
    for column, value in (("rpc_7d", None), ("rpc_7d", float("nan")), ("rpc_7d", float("inf")), ("target_revenue", None), ("target_revenue", float("nan"))):
        bad = df.withColumn(column, F.when(F.col("id") == 7, F.lit(value).cast("double")).otherwise(F.col(column)))
        with pytest.raises(Exception, match="MUST NOT"):
            ml.train_rpc(bad, rounds=1)


def test_bin_edges_of_many_values(monkeypatch):
    """Counts of a feature of many values keep all rows; their ranks move by less than a bin."""
    import numpy as np
    from revlens.operators import boosting
    rng = np.random.default_rng(1)
    x = rng.exponential(size=40_000)
    exact = boosting.thresholds(*np.unique(x, return_counts=True), 31)
    monkeypatch.setattr(boosting, "POINTS", 1000)
    values, counts = boosting._merged([boosting._merged([(part, np.ones(len(part)))]) for part in np.split(x, 8)])
    assert len(values) <= 1000 and counts.sum() == len(x)
    about = boosting.thresholds(values, counts, 31)
    ranks = [np.searchsorted(np.sort(x), e) for e in (exact, about)]
    assert len(exact) == len(about) == 31 and np.abs(ranks[0] - ranks[1]).max() < 40_000 / 32 / 4

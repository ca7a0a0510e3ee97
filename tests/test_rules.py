"""Row rules and small tables: the reference's own unit cases as table tests."""

import json

from pyspark.sql import functions as F

from revlens.functions import columns as fc
from revlens.operators import activation as act
from revlens.operators import guardrails as gr
from revlens.operators import ingest as ing
from revlens.operators import ml
from revlens.operators import monitoring as mon
from revlens.operators import reconcile as rec
from revlens.streaming.jobs import BreakerState


def test_bounds_inclusive(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.01,), (0.5,), (10.0,)], "rpc double")
    got = [r[0] for r in df.select(fc.bounds_check("rpc", 0.5, 10.0)).collect()]
    assert got == [False, True, False, True, True]


def test_fnv_canary_values(spark):
    ids = spark.range(5000).select(F.concat(F.lit("c-"), F.col("id").cast("string")).alias("click_id"))
    b = {r.click_id: r.b for r in ids.where(F.col("click_id").isin("c-0", "c-1", "c-2"))
         .select("click_id", fc.fnv1a64_mod("click_id").alias("b")).collect()}
    assert b == {"c-0": 8007, "c-1": 9796, "c-2": 4429}
    hits = ids.where(fc.canary("click_id", 1000)).count()
    assert hits == 471 and 350 <= hits <= 650
    assert ids.where(fc.canary("click_id", 10_000)).count() == 5000
    assert ids.where(fc.canary("click_id", 0)).count() == 0
    # monotone in the ratio: a click in at r bp stays in at any larger ratio
    inc = ids.select(fc.canary("click_id", 500).alias("a"), fc.canary("click_id", 2500).alias("b"))
    assert inc.where(F.col("a") & ~F.col("b")).count() == 0


def test_clv_premium(spark):
    df = spark.createDataFrame([(2.0, 0.0), (2.0, 100.0), (1.0, 1000.0), (2.0, None), (2.0, -5.0)],
                               "rpc double, clv double")
    got = [r[0] for r in df.select(fc.clv_adjust("rpc", "clv", 0.5, 100.0, 3.0)).collect()]
    assert got == [2.0, 3.0, 2.5, 2.0, 2.0]


def test_anomaly_window_cases(spark):
    # 97 ones + 4 zeros, threshold 0.03, min 20: breached at the end
    rows = [(i, 0, i, 1.0) for i in range(97)] + [(97 + i, 0, 97 + i, 0.0) for i in range(4)]
    df = spark.createDataFrame(rows, "event_id long, shard long, ts_ms long, rpc double")
    out = gr.anomaly_window(df, window_ms=60_000, threshold=0.03, min_samples=20).orderBy("ts_ms").collect()
    assert out[-1].breached and not out[-2].breached
    # the same 101 samples in one millisecond: RANGE peers share one frame, all breached
    same = df.withColumn("ts_ms", F.lit(1000).cast("long"))
    assert gr.anomaly_window(same, window_ms=60_000, threshold=0.03, min_samples=20).where("breached").count() == 101
    # 3 zero samples only: below the min_samples floor
    df3 = spark.createDataFrame([(i, 0, 1000, 0.0) for i in range(3)],
                                "event_id long, shard long, ts_ms long, rpc double")
    assert gr.anomaly_window(df3, window_ms=60_000, threshold=0.03, min_samples=20).where("breached").count() == 0
    # 50 zeros at t=0, 50 ones at 120 s with a 60 s window: recovered
    rec_rows = [(i, 0, 0, 0.0) for i in range(50)] + [(50 + i, 0, 120_000, 1.0) for i in range(50)]
    dfr = spark.createDataFrame(rec_rows, "event_id long, shard long, ts_ms long, rpc double")
    last = gr.anomaly_window(dfr, window_ms=60_000, threshold=0.03, min_samples=20).where("ts_ms = 120000").first()
    assert not last.breached


def test_anomaly_window_blocks_equal_range_form(spark, sf):
    from revlens.sources import fixtures as fx
    s = fx.samples(spark, sf)
    a = gr.anomaly_window(s, window_ms=300_000, min_samples=2, block_ms=300_000)
    b = gr.anomaly_window_range(s, window_ms=300_000, min_samples=2)
    cols = ["event_id", "n", "zeros", "breached"]
    assert a.select(cols).exceptAll(b.select(cols)).count() == 0
    assert a.count() == b.count()


def test_breaker_state_machine():
    st = BreakerState(window_ms=60_000, threshold=0.03, min_samples=1, cool_off_ms=1000)
    st.opened_at = 1000
    assert st.step(1500, 1.0)[0] is False          # blocked inside the cool-off
    assert st.step(2001, 1.0)[0] is True           # allowed afterwards, stays open (no half-open)
    assert st.opened_at == 1000


def test_propose_bounds_cases(spark):
    df = spark.createDataFrame([(0.1, 50.0, 100_000), (0.1, 50.0, 50), (0.01, 333.0, 100_000),
                                (5.0, 1.0, 100_000)], "p1 double, p99 double, n long")
    out = gr.propose_bounds(df, 0.01, 500.0).collect()
    assert (out[0].status, out[0].min_rpc, out[0].max_rpc) == ("proposed", 0.1, 75.0)
    assert out[0].reason == "n=100000, p1=0.1000, p99=50.0000"
    assert out[1].status == "too_few_samples" and out[1].min_rpc is None
    assert out[2].status == "no_change"
    assert out[3].status == "invalid_sample"


def test_breaker_decisions(spark):
    msgs = [{"kind": "null_or_zero_rate", "value": 0.04, "threshold": 0.03, "occurred_at_ms": 1},
            {"kind": "null_or_zero_rate", "value": 0.01, "threshold": 0.03, "occurred_at_ms": 2},
            {"kind": "feature_drift", "value": 0.3, "threshold": 0.25, "occurred_at_ms": 3},
            {"kind": "latency", "value": 0.5, "threshold": 1.0, "occurred_at_ms": 4},
            {"kind": "latency", "value": -1.0, "threshold": 1.0, "occurred_at_ms": 5}]
    df = spark.createDataFrame([(json.dumps(m),) for m in msgs], "data string")
    out = act.breaker_events(df).orderBy("occurred_at_ms").collect()
    assert [r.trip for r in out] == [True, False, True, False, False]
    assert out[0].reason == "null/zero rate above threshold"
    assert out[4].reason == "invalid payload"
    cfg = spark.createDataFrame([(1, False, 0.5, 42.0, 2500)],
                                "version long, kill boolean, bounds_min double, bounds_max double, canary_bp long")
    eng = act.engage_kill_switch(act.breaker_events(df), cfg).collect()
    assert len(eng) == 1 and eng[0].kill and eng[0].version == 2
    killed = cfg.withColumn("kill", F.lit(True))
    assert act.engage_kill_switch(act.breaker_events(df), killed).count() == 0


def test_drift_verdicts(spark):
    df = spark.createDataFrame([("d", "v", "a", 0.05), ("d", "v", "b", 0.15), ("d", "v", "c", 0.30)],
                               "as_of_date string, model_version string, feature string, psi double")
    out = {r.feature: (r.feature_verdict, r.overall_verdict) for r in mon.drift_verdict(df).collect()}
    assert out == {"a": ("healthy", "breach"), "b": ("warn", "breach"), "c": ("breach", "breach")}


def test_top_features(spark):
    df = spark.createDataFrame([("x", {"hour_of_day": -2.0, "rpc_7d": 0.5, "rpc_14d": 1.0})],
                               "click_id string, attributions map<string,double>")
    got = [(r.feature, r.rank) for r in ml.top_features(df, 2).orderBy("rank").collect()]
    assert got == [("hour_of_day", 1), ("rpc_14d", 2)]


def test_parse_attribution_shapes(spark):
    a = {"explanations": [{"attributions": [{"baselineOutputValue": 1.5,
                                             "featureAttributions": {"rpc_7d": 0.3, "cerberus_score": -0.1}}]}]}
    b = {"explanations": [{"attributions": [{"baselineOutputValue": -4.1, "featureAttributions": {
        "features": [0.39, 3.10, 8.55, -1.05, -0.28, 0.07, 0.06, 0.31]}}]}]}
    df = spark.createDataFrame([("a", json.dumps(a)), ("b", json.dumps(b)), ("c", "{}")],
                               "click_id string, explanation string")
    p = {r.click_id: r for r in ml.parse_attributions(df).collect()}
    assert p["a"].base_value == 1.5 and p["a"].contributions == {"rpc_7d": 0.3, "cerberus_score": -0.1}
    assert p["b"].base_value == -4.1 and len(p["b"].contributions) == 8
    top = ml.top_features(ml.parse_attributions(df).where("click_id = 'b'")
                          .withColumnRenamed("contributions", "attributions"), 1).first()
    assert top.feature == "rpc_7d"
    assert not p["c"].valid and p["c"].base_value == 0.0


def test_reconciliation_cases(spark):
    df = spark.createDataFrame([("c1", 1.0, 1.5, "MODEL", 500), ("c2", 1.0, 1.5, "MODEL", 2000),
                                ("", 1.0, 1.0, "MODEL", 600), ("c3", -1.0, 1.0, "MODEL", 700)],
                               "click_id string, predicted_rpc double, realized_rpc double, source string, "
                               "window_ends_at_ms long")
    out = rec.reconciliation_window(df, 0, 10_000, 1000, include_pending=True).orderBy("click_id").collect()
    assert [(r.click_id, r.status, r.residual) for r in out] == [("c1", "completed", 0.5), ("c2", "pending", 0.5)]
    assert rec.reconciliation_window(df, 0, 10_000, 1000).count() == 1
    import pytest
    with pytest.raises(ValueError):
        rec.reconciliation_window(df, 10, 5, 1000)


def test_validate_click_cases(spark):
    base = ("c-1", 14, 0.8, 1.2, 1.1, 1.0)
    cases = [base, ("c-1", 24, 0.8, 1.2, 1.1, 1.0), ("c-1", 14, 1.5, 1.2, 1.1, 1.0),
             ("c-1", 14, 0.8, -0.01, 1.1, 1.0), ("", 14, 0.8, 1.2, 1.1, 1.0),
             ("  ", 14, 0.8, 1.2, 1.1, 1.0), ("c-1", 14, 0.8, float("inf"), 1.1, 1.0)]
    df = spark.createDataFrame(cases, "click_id string, hour_of_day long, cerberus_score double, rpc_7d double, "
                                      "rpc_14d double, rpc_30d double")
    got = [r[0] for r in df.select(ing.rejection_reason()).collect()]
    assert got == [None, "invalid_hour", "invalid_cerberus_score", "invalid_rpc_7d", "empty_click_id",
                   "empty_click_id", "invalid_rpc_7d"]


def test_typed_json_scalars(spark):
    raw = spark.createDataFrame([
        ("m1", '{"click_id":"abc-123","click_ts":"2026-04-27T12:34:56Z","hour_of_day":12,'
               '"cerberus_score":0.8,"geo":{"a":1},"is_payday_week":true}', None),
        ("m2", '{"click_id": "x", "hour_of_day": "notanint"}', None),
        ("m3", 'not json', None)], "message_id string, data string, publish_time timestamp")
    t = {r.message_id: r for r in ing.typed_clicks(raw.withColumn("subscription_name", F.lit("s"))
                                                   .withColumn("attributes", F.lit(None).cast("string"))).collect()}
    assert t["m1"].click_id == "abc-123" and t["m1"].hour_of_day == 12 and t["m1"].geo is None
    assert t["m1"].is_payday_week is True and not t["m1"].corrupt
    assert str(t["m1"].click_ts) == "2026-04-27 12:34:56"
    assert t["m2"].corrupt and t["m2"].hour_of_day is None
    assert t["m3"].corrupt and t["m3"].click_id is None


def test_push_envelope_decode(spark):
    import base64
    body_ok = json.dumps({"message": {"data": base64.b64encode(b'{"click_id":"c1","predicted_rpc":2.5}').decode()}})
    df = spark.createDataFrame([(body_ok,), (json.dumps({"message": {}}),), (json.dumps({"message": {"data": ""}}),)],
                               "body string")
    got = [r.data for r in ing.decode_push_envelope(df).collect()]
    assert got == ['{"click_id":"c1","predicted_rpc":2.5}', "{}", "{}"]
    ok, dead = act.activation_envelopes(ing.decode_push_envelope(df))
    assert ok.count() == 1 and dead.count() == 2
    e = ok.first()
    assert (e.correlation_id, e.source, e.model_version) == ("", "MODEL", "unknown")
    routed = act.activation_route(ok, "hybrid").collect()
    assert sorted(r.channel for r in routed) == ["oci", "ssgtm"]
    assert json.loads([r for r in routed if r.channel == "oci"][0].payload) == {
        "gclid_equivalent": "c1", "conversion_value": 2.5}


def test_read_reconciliation_json_e2e(spark, tmp_path):
    # the end-to-end fixture: two rows, both returned for the window 0..9999999999
    rows = [{"click_id": "e2e-1", "predicted_rpc": 2.5, "realized_rpc": 2.8, "source": "MODEL",
             "window_ends_at_ms": 1},
            {"click_id": "e2e-2", "predicted_rpc": 0.0, "realized_rpc": 3.1, "source": "FALLBACK_TCPA",
             "window_ends_at_ms": 2}]
    f = tmp_path / "reconciliation_rows.json"
    f.write_text(json.dumps(rows, indent=2))
    df = rec.read_reconciliation_json(spark, str(f))
    out = rec.reconciliation_window(df, 0, 9_999_999_999, 10, include_pending=True).collect()
    assert sorted((r.click_id, r.status) for r in out) == [("e2e-1", "completed"), ("e2e-2", "completed")]


def test_write_day_replaces_only_its_day(spark, tmp_path):
    path = str(tmp_path / "psi")
    d1 = spark.createDataFrame([("2024-01-01", "f", 0.1), ("2024-01-02", "f", 0.2)],
                               "as_of_date string, feature string, psi double")
    mon.write_day(d1.withColumn("as_of_date", F.to_date("as_of_date")), path)
    redo = spark.createDataFrame([("2024-01-02", "f", 0.3)], "as_of_date string, feature string, psi double")
    mon.write_day(redo.withColumn("as_of_date", F.to_date("as_of_date")), path)
    got = {(str(r.as_of_date), r.psi) for r in spark.read.parquet(path).collect()}
    assert got == {("2024-01-01", 0.1), ("2024-01-02", 0.3)}


def test_model_source_filter_pushdown(spark, tmp_path):
    path = str(tmp_path / "pred")
    spark.createDataFrame([("c", "MODEL", 1.0), ("d", "FALLBACK_TCPA", 0.0)],
                          "click_id string, source string, predicted_rpc double").write.parquet(path)
    df = gr.model_source_filter(spark.read.parquet(path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(source,MODEL)" in plan, plan
    assert [r.click_id for r in df.collect()] == ["c"]


def test_backfill_replaces_range(spark, tmp_path):
    path = str(tmp_path / "res")
    df = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-02", 2.0), ("2024-01-03", 3.0)],
                               "as_of_date string, v double").withColumn("as_of_date", F.to_date("as_of_date"))
    mon.write_day(df, path)
    redo = df.withColumn("v", F.col("v") * 10)
    mon.backfill_days(redo, path, "2024-01-02", "2024-01-03")
    got = {(str(r.as_of_date), r.v) for r in spark.read.parquet(path).collect()}
    assert got == {("2024-01-01", 1.0), ("2024-01-02", 20.0), ("2024-01-03", 30.0)}

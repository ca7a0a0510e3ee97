"""Registered queries: one per operator of the inventory, each a function
(spark, sf_dir) -> DataFrame over the driver's tables, finalized to the shared
output conventions so that it can be compared with ``revlens.plans.oracle``."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.operators import attribution as att
from revlens.operators import rolling as rol
from revlens.plans.output import finalize
from revlens.sources.staged import keyed, staged
from revlens.schemas import DRIVER_TABLES
from revlens.sources import fixtures as fx
from revlens.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: finalize(fn(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        return fn
    return deco


# -------------------------------------------------------------- shared stages
def click_revenue(spark, sf):
    return att.click_revenue(fx.clicks(spark, sf), fx.ledger(spark, sf))


def stored_click_revenue(spark, sf):
    return staged(spark, sf, "click_revenue", lambda: click_revenue(spark, sf))


def rolling(spark, sf):
    return rol.rolling_rpc(stored_click_revenue(spark, sf))


def training_rows(spark, sf):
    cr = stored_click_revenue(spark, sf)
    return att.training_rows(cr, rol.rolling_rpc(cr), fx.auctions(spark, sf))


def stored_training_rows(spark, sf):
    return staged(spark, sf, "training_rows", lambda: training_rows(spark, sf))


# -------------------------------------------------------------- sources
@register("S1_read_table")
def _s1(spark, sf):
    return read_table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderstatus",
                                            "o_totalprice", "o_orderdate", "o_orderpriority"])


@register("S1_declared_tables")
def _s1d(spark, sf):
    """Every declared table: rows, declared columns, non-null values of the first column and of all."""
    parts = []
    for name, schema in DRIVER_TABLES.items():
        t = read_table(spark, sf, name)
        filled = sum((F.count(F.col(f"`{c}`")) for c in t.columns), F.lit(0))
        parts.append(t.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.lit(len(schema)).alias("columns"),
                           F.count(F.col(t.columns[0])).alias("keys"), filled.alias("filled")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -------------------------------------------------------------- joins / windows
@register("J1_click_revenue")
def _j1(spark, sf):
    return click_revenue(spark, sf)


@register("W1_rolling_rpc")
def _w1(spark, sf):
    return rolling(spark, sf)


@register("J2_training_rows")
def _j2(spark, sf):
    return training_rows(spark, sf)


@register("J3_training_rows_contract")
def _j3(spark, sf):
    return att.training_rows_contract(fx.clicks(spark, sf), fx.ledger(spark, sf))


@register("J4_predictions_vs_revenue")
def _j4(spark, sf):
    return att.predictions_vs_revenue(fx.predictions(spark, sf), fx.ledger(spark, sf))


@register("J5_prediction_realized")
def _j5(spark, sf):
    return att.prediction_realized(fx.predictions(spark, sf), fx.ledger(spark, sf))


# -------------------------------------------------------------- monitoring
from revlens.operators import monitoring as mon  # noqa: E402

BASELINE_VERSION = "v1"


def baseline(spark, sf):
    return mon.feature_baseline(stored_training_rows(spark, sf), BASELINE_VERSION)


def stored_baseline(spark, sf):
    return staged(spark, sf, "feature_baseline", lambda: baseline(spark, sf))


@register("P4_unpivot_features")
def _p4(spark, sf):
    return mon.unpivot_features(fx.clicks(spark, sf))


@register("W2_feature_deciles")
def _w2(spark, sf):
    long_df = mon.unpivot_features(stored_training_rows(spark, sf), ids=())
    return (mon.decile_counts(long_df).groupBy("feature", "value", "decile")
            .agg(F.sum("n").alias("n")))


@register("A1_feature_baseline")
def _a1(spark, sf):
    return baseline(spark, sf)


@register("J6_psi_bin_join")
def _j6(spark, sf):
    return mon.psi_bin_join(mon.live_feature_counts(fx.clicks(spark, sf)), stored_baseline(spark, sf))


@register("A2_psi_daily")
def _a2(spark, sf):
    return mon.psi_daily(fx.clicks(spark, sf), stored_baseline(spark, sf))


@register("A2_psi_daily_binned")
def _a2b(spark, sf):
    return mon.psi_daily_binned(fx.clicks(spark, sf), stored_baseline(spark, sf))


@register("A3_drift_verdict")
def _a3(spark, sf):
    return mon.drift_verdict(mon.psi_daily(fx.clicks(spark, sf), stored_baseline(spark, sf)))


@register("A4_residuals_daily")
def _a4(spark, sf):
    return mon.residuals_daily(att.prediction_realized(fx.predictions(spark, sf), fx.ledger(spark, sf)))


# -------------------------------------------------------------- guardrails
from revlens.functions import columns as fc  # noqa: E402
from revlens.operators import guardrails as gr  # noqa: E402
from revlens.operators import quantiles as qn  # noqa: E402
from revlens.operators import reconcile as rec  # noqa: E402

CANARY_BP = 1000
CLV_POLICY = dict(alpha=0.5, reference=100.0, cap=3.0)
BOUNDS = (0.5, 400.0)
CALIBRATION_MIN_N = 5_000
ANOMALY = dict(window_ms=2 * 86_400_000, threshold=0.05, min_samples=5)
RECON_FROM_MS, RECON_TO_MS = 852_076_800_000, 996_624_000_000   # 1997-01-01 .. 2001-08-01 UTC
NOW_MS = 959_817_600_000          # 2000-06-01T00:00:00Z
REPORT_NOW_MS = 996_624_000_000   # 2001-08-01T00:00:00Z


@register("A5_prediction_percentiles")
def _a5(spark, sf):
    """Exact ranks."""
    return gr.prediction_percentiles(fx.predictions(spark, sf), exact=True)


def stored_prediction_sketches(spark, sf):
    return staged(spark, sf, "prediction_sketches", lambda: gr.prediction_sketches(fx.predictions(spark, sf)))


@register("A5_stored_percentiles")
def _a5s(spark, sf):
    """For every day the percentiles of the week before it, from the hourly sketches. Exact while
    a week has at most ``quantiles.SKETCH_K`` predictions of a version."""
    return gr.stored_percentiles(stored_prediction_sketches(spark, sf))


@register("A6_propose_bounds")
def _a6(spark, sf):
    """Per model version (too few samples for one of them), against the live config's bounds."""
    cfg = sc.read_config(fx.config_versions(spark, sf))
    pct = gr.prediction_percentiles(fx.predictions(spark, sf), by=("model_version",), exact=True)
    return gr.propose_bounds(pct, cfg["bounds_min"], cfg["bounds_max"], min_n=CALIBRATION_MIN_N)


@register("F2_canary")
def _f2(spark, sf):
    c = fx.clicks(spark, sf)
    return c.select("click_id", fc.fnv1a64_mod("click_id").alias("bucket"),
                    fc.canary("click_id", CANARY_BP).alias("in_canary"))


@register("F3_clv_adjust")
def _f3(spark, sf):
    p = fx.predictions(spark, sf).where(F.col("source") == "MODEL")
    j = p.join(fx.clv(spark, sf), "click_id", "left")
    return j.select("click_id", "predicted_rpc", "clv",
                    fc.clv_adjust("predicted_rpc", "clv", **CLV_POLICY).alias("adjusted_rpc"))


@register("F4_bounds_check")
def _f4(spark, sf):
    p = fx.predictions(spark, sf)
    return p.select("click_id", "predicted_rpc", fc.bounds_check("predicted_rpc", *BOUNDS).alias("in_bounds"))


@register("W3_anomaly_window")
def _w3(spark, sf):
    return gr.anomaly_window(fx.samples(spark, sf), **ANOMALY)


def pvr(spark, sf):
    return att.predictions_vs_revenue(fx.predictions(spark, sf), fx.ledger(spark, sf))


@register("P9_reconciliation_window")
def _p9(spark, sf):
    return rec.reconciliation_window(pvr(spark, sf), RECON_FROM_MS, RECON_TO_MS, NOW_MS, include_pending=True)


@register("P10_reconciliation_report")
def _p10(spark, sf):
    return rec.reconciliation_report(pvr(spark, sf), REPORT_NOW_MS, days=7)


@register("A17_route_mix")
def _a17(spark, sf):
    return rec.route_mix(fx.predictions(spark, sf))


# -------------------------------------------------------------- ingestion / quality
from revlens.operators import activation as act  # noqa: E402
from revlens.operators import ingest as ing  # noqa: E402
from revlens.operators import quality as qual  # noqa: E402

MERGE_AS_OF = "2002-01-01 00:00:00"
MERGE_LOOKBACK_HOURS = 24 * 365 * 5
MERGE_TARGET_BEFORE = "1999-01-01 00:00:00"
FEED_AS_OF = "2002-01-01 00:00:00"
FEED_LIVE = "1995-06-01 00:00:00"


def typed_landing(spark, sf):
    return ing.typed_clicks(fx.landing_clicks(spark, sf))


def stored_typed_landing(spark, sf):
    return staged(spark, sf, "typed_clicks", lambda: typed_landing(spark, sf))


@register("S2_decode_push_envelope")
def _s2(spark, sf):
    d = ing.decode_push_envelope(fx.push_bodies(spark, sf))
    return d.select("message_id", F.get_json_object("data", "$.click_id").alias("click_id"),
                    F.get_json_object("data", "$.predicted_rpc").cast("double").alias("predicted_rpc"),
                    (F.col("data") == "{}").alias("empty"))


@register("S3_typed_clicks")
def _s3(spark, sf):
    return typed_landing(spark, sf).drop("subscription_name")


@register("S4_typed_predictions")
def _s4(spark, sf):
    return ing.typed_predictions(fx.landing_predictions(spark, sf)).drop("subscription_name")


@register("S6_merge_ledger")
def _s6(spark, sf):
    led = fx.ledger(spark, sf)
    target = led.where(F.col("revenue_ts") < F.lit(MERGE_TARGET_BEFORE).cast("timestamp"))
    return ing.merge_ledger(target, led, MERGE_AS_OF, MERGE_LOOKBACK_HOURS)


@register("P1_normalize_clicks")
def _p1(spark, sf):
    return ing.normalize_clicks(fx.clicks(spark, sf)).select("click_id", "device")


@register("P2_validate_clicks")
def _p2(spark, sf):
    return fx.clicks(spark, sf).select("click_id", ing.rejection_reason().alias("reason"))


@register("W5_dedup_clicks")
def _w5(spark, sf):
    landed = stored_typed_landing(spark, sf).where(~F.col("corrupt"))
    return ing.dedup_clicks(landed).select("click_id", "message_id", "visits_prev_30d", "ingested_at")


@register("J9_ledger_orphans")
def _j9(spark, sf):
    return qual.ledger_orphans(fx.ledger(spark, sf), valid_clicks(spark, sf))


@register("C1_assertions")
def _c1(spark, sf):
    cr = stored_click_revenue(spark, sf)
    parts = [qual.assert_unique(cr, ["click_id"], "click_revenue.unique_click_id").select("assertion", "click_id"),
             qual.assert_non_null(cr, ["click_id", "click_ts"], "click_revenue.non_null").select("assertion", "click_id"),
             qual.assert_rows(fx.clicks(spark, sf), "cerberus_score BETWEEN 0 AND 1",
                              "clicks.cerberus_in_range").select("assertion", "click_id")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("A7_dq_sla")
def _a7(spark, sf):
    return qual.dq_sla(fx.clicks(spark, sf), fx.ledger(spark, sf))


@register("A8_freshness_gaps_clicks")
def _a8c(spark, sf):
    return qual.freshness_gaps(read_table(spark, sf, "events", ["ts"]), "ts", 15, 6, 22)


@register("A8_freshness_gaps_ledger")
def _a8l(spark, sf):
    return qual.freshness_gaps(fx.ledger(spark, sf), "revenue_ts", 12 * 60)


@register("A9_feed_lag")
def _a9(spark, sf):
    """On a day long after the feed ended and on one at its end."""
    ledger = fx.ledger(spark, sf)
    parts = [qual.feed_lag(ledger, d).withColumn("as_of", F.lit(d)) for d in (FEED_AS_OF, FEED_LIVE)]
    return parts[0].unionByName(parts[1])


def envelopes(spark, sf):
    return act.activation_envelopes(ing.decode_push_envelope(fx.push_bodies(spark, sf)),
                                    keep=("message_id",))


@register("P7_activation_envelopes")
def _p7(spark, sf):
    t = act.tagged_envelopes(ing.decode_push_envelope(fx.push_bodies(spark, sf)))
    ok = F.col("reason").isNull()
    return t.select("message_id", *[F.when(ok, F.col(c)).alias(c) for c in act.ENVELOPE],
                    F.when(ok, F.lit("ok")).otherwise(F.lit("dead")).alias("status"), "reason")


@register("P8_activation_route")
def _p8(spark, sf):
    ok, _ = envelopes(spark, sf)
    return act.activation_route(ok, "hybrid")


@register("T4_breaker_events")
def _t4(spark, sf):
    return act.breaker_events(fx.anomaly_messages(spark, sf))


# -------------------------------------------------------------- scoring / ML
from pyspark.ml import PipelineModel  # noqa: E402
from pyspark.ml.functions import vector_to_array  # noqa: E402

from revlens.operators import ml  # noqa: E402
from revlens.operators import scoring as sc  # noqa: E402
from revlens.operators import tree_shap as ts  # noqa: E402
from revlens.schemas import FEATURE_ORDER  # noqa: E402

SCORED_AT_MS = 1_706_659_200_000  # 2024-01-31T00:00:00Z
TOP_K = 3


def valid_clicks(spark, sf):
    return staged(spark, sf, "valid_clicks", lambda: ing.validate_clicks(fx.clicks(spark, sf))[0])


def scoring_clicks(spark, sf):
    """Valid clicks; every 13th has a feature that makes the model fail."""
    k = F.regexp_extract("click_id", r"(\d+)$", 1).cast("long")
    return valid_clicks(spark, sf).withColumn(
        "auction_pressure", F.when(k % 13 == 0, F.lit(float("nan"))).otherwise(F.col("auction_pressure")))


def keyed_ledger(spark, sf):
    """Lifetime revenue per click."""
    return keyed(spark, sf, "ledger_sums", lambda: fx.ledger(spark, sf).groupBy("click_id").agg(F.sum("revenue").alias("revenue")))


def keyed_clv(spark, sf):
    return keyed(spark, sf, "clv", lambda: fx.clv(spark, sf))


def keyed_store(spark, sf):
    return keyed(spark, sf, "feature_store", lambda: fx.feature_store(spark, sf))


def sides(spark, sf):
    """Static sides of scoring, stored by click."""
    return dict(clv=keyed_clv(spark, sf), premium=CLV_POLICY, store=keyed_store(spark, sf))


def scored(spark, sf, kill=False):
    config = fx.config_versions(spark, sf)
    return sc.score_clicks(scoring_clicks(spark, sf), config.withColumn("kill", F.lit(True)) if kill else config, keyed_ledger(spark, sf),
                           ml.STAND_IN, model_version="v1", **sides(spark, sf))


@register("S11_runtime_config")
def _s11(spark, sf):
    return sc.runtime_config(fx.config_versions(spark, sf))


@register("J7_ledger_fallback")
def _j7(spark, sf):
    return sc.ledger_fallback(fx.clicks(spark, sf).select("click_id"), keyed_ledger(spark, sf))


@register("J8_feature_overrides")
def _j8(spark, sf):
    return (sc.feature_overrides(fx.clicks(spark, sf), keyed_store(spark, sf))
            .select("click_id", "rpc_7d", "rpc_14d", "rpc_30d", "visits_prev_30d"))


@register("F5_predict")
def _f5(spark, sf):
    return ml.predict(valid_clicks(spark, sf), ml.STAND_IN).select("click_id", "rpc_raw", "model_error")


@register("F1_score_clicks")
def _f1(spark, sf):
    return scored(spark, sf)


POLICY = sc.BreakerPolicy(key="serving_shard", ts="call_ms", window_ms=40 * 86_400_000, threshold=0.2, min_samples=5,
                          cool_off_ms=12 * 3_600_000)


def guarded_clicks(spark, sf):
    """Scoring clicks on four shards; every fifth is one the model values at zero."""
    k = F.regexp_extract("click_id", r"(\d+)$", 1).cast("long")
    poor = k % 5 == 0
    c = scoring_clicks(spark, sf)
    c = c.withColumns({f: F.when(poor, F.lit(-100.0)).otherwise(F.col(f)) for f in ("cerberus_score",)})
    return c.withColumns({"serving_shard": k % 4, "call_ms": F.unix_millis("click_ts")})


@register("F1_score_clicks_guarded")
def _f1g(spark, sf):
    """With breaker and anomaly window: calls are blocked, windows breached, model errors trip."""
    return sc.score_clicks_guarded(guarded_clicks(spark, sf), fx.config_versions(spark, sf), keyed_ledger(spark, sf), ml.STAND_IN, POLICY,
                                   model_version="v1", **sides(spark, sf))[0]


@register("T5_score_stream_guarded")
def _t5g(spark, sf):
    """Clicks in time order, one year per micro-batch; the audit trail has every reason."""
    clicks, year = guarded_clicks(spark, sf), F.year("click_ts")
    files = sj.slot_files(clicks, year)
    src = sj.stage_slots(clicks, year, "clicks", files)
    config = sj.stage(fx.config_versions(spark, sf), "config", files=1)
    log, audit = sj.scratch(spark, "pred-log"), sj.scratch(spark, "audit")
    sj.run(sj.score_stream(spark, src, log, audit, sj.scratch(spark, "ckpt"), config, keyed_ledger(spark, sf), ml.STAND_IN, "v1",
                           **sides(spark, sf), policy=POLICY, max_files=files))
    reasons = spark.read.parquet(audit).select("click_id", F.col("source").alias("reason"))
    return spark.read.parquet(log).drop("batch", "ts_ms").join(reasons, "click_id")


@register("F1_score_clicks_killed")
def _f1k(spark, sf):
    return scored(spark, sf, kill=True)


@register("S8_log_predictions")
def _s8(spark, sf):
    return sc.log_predictions(scored(spark, sf), SCORED_AT_MS)


@register("S9_audit_events")
def _s9(spark, sf):
    """The scored clicks, some with values whose text is hard: small, large, many digits."""
    k = F.regexp_extract("click_id", r"(\d+)$", 1).cast("long") % 50
    hard = {0: 0.0005, 1: 1e16, 2: 12345678.5, 3: 1.5e-7, 4: 0.1}
    rpc = F.col("predicted_rpc")
    for i, v in hard.items():
        rpc = F.when(k == i, F.lit(v)).otherwise(rpc)
    return sc.audit_events(scored(spark, sf).withColumn("predicted_rpc", rpc))


TRAIN_FROM_MS, TRAIN_TO_MS = 820_454_400_000, 915_148_800_000   # 1996-01-01 .. 1999-01-01 UTC


@register("P3_training_window")
def _p3(spark, sf):
    return ml.training_window(stored_training_rows(spark, sf), TRAIN_FROM_MS, TRAIN_TO_MS).select(
        "click_id", "click_ts_ms", "target_revenue")


@register("P5_assemble_features")
def _p5(spark, sf):
    a = ml.assemble_features(stored_training_rows(spark, sf))
    arr = vector_to_array("features")
    return a.select("click_id", *[arr[i].alias(f) for i, f in enumerate(FEATURE_ORDER)])


@register("M1_train_rpc")
def _m1(spark, sf):
    """Facts that hold for any correct run: rows scored, trees, errors, and that the
    model's mean squared error is below that of the mean."""
    frame = stored_training_rows(spark, sf)
    model = ml.train_rpc(frame)
    y, raw = F.col("target_revenue"), F.col("rpc_raw")
    p = ml.predict(frame.select("click_id", "target_revenue", *FEATURE_ORDER), model)
    return p.agg(F.count(F.lit(1)).alias("scored"), F.lit(model.stages[-1].getNumTrees).alias("trees"),
                 F.count_if("model_error").alias("errors"),
                 (F.avg((y - raw) * (y - raw)) < F.var_pop(y)).alias("beats_mean"))


def _long_attr(df, col):
    return df.select("click_id", "base_value", F.explode(col).alias("feature", "contribution"))


@register("M3_explain_clicks")
def _m3(spark, sf):
    e = ml.explain_clicks(fx.clicks(spark, sf), ml.STAND_IN, paths=10, seed=42)
    return e.select("click_id", "base_value", "prediction",
                    F.explode("attributions").alias("feature", "contribution"))


TREE_ROUNDS, TREE_DEPTH = 40, 5


def fitted_model(spark, sf) -> str:
    """Folder of a pipeline fitted on the stored training frame, once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _fitted:
        path = sj.scratch(spark, "models")
        ml.train_and_register(stored_training_rows(spark, sf), path, f"{path}/registry", "rpc", "v1", SCORED_AT_MS, rounds=TREE_ROUNDS, max_depth=TREE_DEPTH)
        _fitted[key] = f"{path}/v1"
    return _fitted[key]


_fitted: dict[tuple[str, str], str] = {}


@register("M3_explain_trees")
def _m3t(spark, sf):
    """Exact attributions of a fitted ensemble: every click's add up to its prediction, which is
    the fitted pipeline's own."""
    path = fitted_model(spark, sf)
    clicks = valid_clicks(spark, sf)
    e = ts.explain_trees(clicks, ts.export(spark, path))
    total = F.aggregate(F.map_values("attributions"), F.lit(0.0), lambda a, b: a + b)
    # what the join moves is the outcome of the sum, not the attributions
    e = e.select("click_id", "prediction", F.size("attributions").alias("features"),
                 (F.abs(F.col("base_value") + total - F.col("prediction")) < 1e-6).alias("adds_up"))
    own = PipelineModel.load(path).transform(clicks.select("click_id", *FEATURE_ORDER)).select("click_id", F.col("prediction").alias("own"))
    return e.join(own, "click_id").select("click_id", "features", "adds_up", (F.abs(F.col("prediction") - F.col("own")) < 1e-6).alias("same_prediction"))


def explanation_json(spark, sf):
    """Explanation responses in both shapes: name -> value (even keys), or one
    array in explanation order (odd keys)."""
    # spread: a narrow click becomes a long text, and its parse takes the time
    la = ml.linear_attributions(fx.clicks(spark, sf).select("click_id", *FEATURE_ORDER).hint("rebalance"))
    key = F.regexp_extract("click_id", r"(\d+)$", 1).cast("long")
    arr = F.array(*[F.col("attributions")[f] for f in ml.EXPLANATION_ORDER])
    def wrap(feats):
        return F.to_json(F.struct(F.array(F.struct(F.array(F.struct(
            F.col("base_value").alias("baselineOutputValue"), feats.alias("featureAttributions")))
            .alias("attributions"))).alias("explanations")))
    return la.select("click_id", F.when(key % 2 == 0, wrap(F.col("attributions")))
                     .otherwise(wrap(F.struct(arr.alias("features")))).alias("explanation"))


@register("M4_parse_attributions")
def _m4(spark, sf):
    p = ml.parse_attributions(explanation_json(spark, sf))
    return p.select("click_id", "base_value", "valid",
                    F.explode("contributions").alias("feature", "contribution"))


@register("W4_top_features")
def _w4(spark, sf):
    return ml.top_features(ml.linear_attributions(fx.clicks(spark, sf)), TOP_K)


# -------------------------------------------------------------- ops metrics
from revlens.operators import ops_metrics as om  # noqa: E402

LATENCY_THRESHOLD_MS = 300.0


@register("A10_request_metrics")
def _a10(spark, sf):
    return om.request_metrics(fx.requests(spark, sf))


@register("A11_latency_alert")
def _a11(spark, sf):
    return om.latency_alert(fx.requests(spark, sf), LATENCY_THRESHOLD_MS)


@register("A12_error_rate_alert")
def _a12(spark, sf):
    return om.error_rate_alert(fx.requests(spark, sf), 0.01, 5)


@register("A13_availability_slo")
def _a13(spark, sf):
    return om.availability_slo(fx.requests(spark, sf), 0.995, 30)


@register("A14_breaker_trips")
def _a14(spark, sf):
    w = gr.anomaly_window(fx.samples(spark, sf), **ANOMALY)
    audit = w.select("ts_ms", F.when(F.col("breached"), F.lit("anomaly"))
                     .otherwise(F.lit("score.model")).alias("source"))
    return om.breaker_trips(audit)


@register("A15_backlog_alert")
def _a15(spark, sf):
    landed = fx.landing_clicks(spark, sf)
    delivered = stored_typed_landing(spark, sf).where(~F.col("corrupt"))
    return om.backlog_alert(landed, delivered, limit=4, minutes=3 * 1440)


def stored_latency_sketches(spark, sf):
    """Latency of every second request is v1's, failed requests take three times as long."""
    req = fx.requests(spark, sf).select(
        F.unix_millis("ts").alias("ts_ms"), F.when(F.col("request_id") % 2 == 0, F.lit("v1")).otherwise(F.lit("v2")).alias("model_version"),
        (F.when(F.col("status") == 500, 3.0).otherwise(1.0) * F.col("latency_ms")).alias("latency_ms"))
    return staged(spark, sf, "latency_sketches", lambda: qn.hourly_sketches(req, "latency_ms", "ts_ms", ["model_version"]))


@register("A16_model_health")
def _a16(spark, sf):
    """Versions by training time (v2 before v1, against their names), p95 latency per version from
    hourly sketches (exact up to ``quantiles.SKETCH_K`` requests of a version)."""
    psi = mon.psi_daily(fx.clicks(spark, sf), stored_baseline(spark, sf))
    req = fx.requests(spark, sf)
    latency = om.latency_by_version(stored_latency_sketches(spark, sf))
    registry = req.select(F.lit("v2").alias("model_version"), F.lit(1).cast("long").alias("trained_at_ms")).limit(1).unionByName(
        req.select(F.lit("v1").alias("model_version"), F.lit(2).cast("long").alias("trained_at_ms")).limit(1))
    res = mon.residuals_daily(att.prediction_realized(fx.predictions(spark, sf), fx.ledger(spark, sf)))
    return om.model_health(psi, res, registry, latency, mae_factor=0.9)


# -------------------------------------------------------------- streaming (availableNow runs)
from revlens.streaming import jobs as sj  # noqa: E402

REPLAY_BATCHES = 4      # micro-batches of a replay without slots


@register("S5_land_stream")
def _s5(spark, sf):
    src = sj.stage(fx.landing_clicks(spark, sf), "landing", files=4)
    out = sj.scratch(spark, "raw-clicks")
    sj.run(sj.land_stream(spark, src, out, sj.scratch(spark, "ckpt"), "clicks"))
    return spark.read.parquet(out).select("message_id", "publish_time", "topic", "publish_date")


@register("T1_clicks_stream")
def _t1(spark, sf):
    """Re-emits, corrected ones among them, in other files than the first emits; last write wins."""
    src = sj.stage(fx.landing_clicks(spark, sf), "landing", files=4)
    out, dead = sj.scratch(spark, "clicks"), sj.scratch(spark, "clicks-dead")
    sj.run(sj.clicks_stream(spark, src, out, dead, sj.scratch(spark, "ckpt"), keep="last", max_files=sj.files_a_batch(spark, src, REPLAY_BATCHES)))
    return sj.latest_clicks(spark, out).select("click_id", "message_id", "click_ts", "device", "geo", "hour_of_day",
                                               "cerberus_score", "rpc_7d", "visits_prev_30d")


FEED_LATENESS_DAYS = 14


def event_files(spark, sf, days: int = 6):
    """Events as files of ``days`` days, written one after the other; every tenth event
    comes a file late (at most 2 * days out of order)."""
    ev = read_table(spark, sf, "events", ["event_id", "ts"])
    slot = (F.floor(F.unix_seconds("ts") / (days * 86_400)) + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)).cast("long")
    return sj.stage_slots(ev, slot, "events"), ev.schema


@register("T2_freshness_stream")
def _t2(spark, sf):
    """Slots in time order, but every tenth event one slot late; one slot per micro-batch."""
    src, schema = event_files(spark, sf)
    out = sj.scratch(spark, "gaps")
    sj.run(sj.freshness_stream(spark, src, schema, "ts", out, sj.scratch(spark, "ckpt"),
                               lateness=f"{FEED_LATENESS_DAYS} days", max_files=sj.SLOT_FILES))
    return spark.read.parquet(out).drop("batch")


SILENT_DAYS = 2


@register("T2_silence_stream")
def _t2s(spark, sf):
    """Four feeds, replayed with the clock set to SILENT_DAYS after the newest event and the middle
    of a window: the windows without an event since each feed's last one."""
    ev = read_table(spark, sf, "events", ["user_id", "ts"])
    src, step = sj.stage(ev, "events", files=4), 900_000
    newest = spark.read.parquet(src).agg(F.max(F.unix_millis("ts"))).first()[0]
    clock = (newest // step + 1) * step + SILENT_DAYS * 86_400_000 + step // 2
    out = sj.scratch(spark, "silence")
    sj.run_for(sj.silence_stream(spark, src, ev.schema, "ts", out, sj.scratch(spark, "ckpt"), feed=F.col("user_id") % 4, grace_ms=0,
                                 shift_ms=int(time.time() * 1000) - clock, interval="200 milliseconds"))
    return spark.read.schema(sj.SILENCE_OUT).parquet(out)


@register("T3_breaker_stream")
def _t3(spark, sf):
    """Samples in slots of ten days, in time order, one per micro-batch; thresholds at which breakers trip."""
    s = fx.samples(spark, sf)
    src = sj.stage_slots(s, F.floor(F.col("ts_ms") / (10 * 86_400_000)), "samples")
    out = sj.scratch(spark, "breaker")
    sj.run(sj.breaker_stream(spark, src, s.schema, out, sj.scratch(spark, "ckpt"), cool_off_ms=6 * 3_600_000, max_files=sj.SLOT_FILES, **ANOMALY))
    return spark.read.parquet(out).drop("batch")


@register("T4_breaker_events_stream")
def _t4s(spark, sf):
    m = fx.anomaly_messages(spark, sf)
    src = sj.stage(m, "anomalies", files=2)
    config = sj.stage(fx.config_versions(spark, sf), "config", files=1)
    out = sj.scratch(spark, "decisions")
    sj.run(sj.breaker_events_stream(spark, src, m.schema, out, config, sj.scratch(spark, "ckpt")))
    return spark.read.parquet(out).drop("batch")


@register("T5_score_stream")
def _t5(spark, sf):
    """Every hundredth click is emitted twice: each emit is scored and logged once."""
    clicks = scoring_clicks(spark, sf)
    again = clicks.where(F.regexp_extract("click_id", r"(\d+)$", 1).cast("long") % 100 == 0)
    src = sj.stage(clicks.unionByName(again), "valid-clicks", files=4)
    config = sj.stage(fx.config_versions(spark, sf), "config", files=1)
    log, audit = sj.scratch(spark, "pred-log"), sj.scratch(spark, "audit")
    sj.run(sj.score_stream(spark, src, log, audit, sj.scratch(spark, "ckpt"), config, keyed_ledger(spark, sf),
                           ml.STAND_IN, "v1", **sides(spark, sf), max_files=sj.files_a_batch(spark, src, REPLAY_BATCHES)))
    return spark.read.parquet(log).drop("batch")


@register("T6_activation_stream")
def _t6(spark, sf):
    src = sj.stage(fx.push_bodies(spark, sf), "push", files=4)
    out, dead = sj.scratch(spark, "activation"), sj.scratch(spark, "activation-dead")
    sj.run(sj.activation_stream(spark, src, out, dead, sj.scratch(spark, "ckpt"), "hybrid"))
    return spark.read.parquet(out).select("click_id", "channel", "payload")


@register("T7_metrics_stream")
def _t7(spark, sf):
    r = fx.requests(spark, sf)
    src = sj.stage(r, "requests", files=4)
    out = sj.scratch(spark, "metrics")
    sj.run(sj.metrics_stream(spark, src, r.schema, out, sj.scratch(spark, "ckpt")))
    return spark.read.parquet(out)


HEARTBEAT_DAYS = 40


def time_ordered_files(spark, rows, files: int = 4):
    """Rows (column ``ts``) as files written one after the other in time order, then a
    heartbeat (a row of nulls but for ts) that closes every window."""
    lo, hi = rows.agg(F.min(F.unix_millis("ts")), F.max(F.unix_millis("ts"))).first()
    path = sj.stage_slots(rows, F.floor((F.unix_millis("ts") - lo) * files / (hi - lo + 1)), "log")
    stored = spark.read.schema(rows.schema).parquet(path)
    beat = stored.agg((F.max("ts") + F.make_interval(days=F.lit(HEARTBEAT_DAYS))).alias("ts"))
    beat.select(*[F.col("ts") if c == "ts" else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]).write.mode("append").parquet(path)
    return path


def _alerts(spark, sf, kind, **options):
    r = fx.requests(spark, sf)
    out = sj.scratch(spark, "alerts")
    sj.run(sj.alert_stream(spark, time_ordered_files(spark, r), r.schema, out, sj.scratch(spark, "ckpt"), kind, max_files=sj.SLOT_FILES, **options))
    return spark.read.parquet(out)


@register("T7_latency_alert_stream")
def _t7l(spark, sf):
    return _alerts(spark, sf, "latency", threshold_ms=LATENCY_THRESHOLD_MS)


@register("T7_error_rate_alert_stream")
def _t7e(spark, sf):
    return _alerts(spark, sf, "error_rate", threshold=0.01, minutes=5)


@register("T7_availability_stream")
def _t7a(spark, sf):
    return _alerts(spark, sf, "availability", goal=0.995, days=30)


@register("T7_breaker_trip_stream")
def _t7b(spark, sf):
    w = gr.anomaly_window(fx.samples(spark, sf), **ANOMALY)
    audit = w.select(F.timestamp_millis("ts_ms").alias("ts"), F.when(F.col("breached"), F.lit("anomaly")).otherwise(F.lit("score.model")).alias("source"))
    out = sj.scratch(spark, "trips")
    sj.run(sj.trip_stream(spark, time_ordered_files(spark, audit), audit.schema, out, sj.scratch(spark, "ckpt"), max_files=sj.SLOT_FILES))
    return spark.read.parquet(out)


@register("P6_model_source_filter")
def _p6(spark, sf):
    return gr.model_source_filter(fx.predictions(spark, sf), since="1998-01-01 00:00:00").drop("predicted_at")


@register("W1_rolling_rpc_point_in_time")
def _w1p(spark, sf):
    ledger = staged(spark, sf, "ledger", lambda: fx.ledger(spark, sf))
    return rol.rolling_rpc(stored_click_revenue(spark, sf), point_in_time=True, ledger=ledger)


# -------------------------------------------------------------- sinks and files
import uuid  # noqa: E402


@register("S7_write_day")
def _s7(spark, sf):
    """Writes all days, in one partition a month, then replaces the months of 1996 by a
    corrected run; reads the table back."""
    path = sj.scratch(spark, "residuals")
    res = mon.residuals_daily(att.prediction_realized(fx.predictions(spark, sf), fx.ledger(spark, sf)))
    res = res.withColumn("month", F.trunc("as_of_date", "month")).repartition("month")
    mon.write_day(res, path, "month")
    mon.backfill_days(res.withColumn("scored_clicks", F.col("scored_clicks") + 1000), path, "1996-01-01", "1996-12-31", "month")
    return spark.read.parquet(path).select("as_of_date", "model_version", "scored_clicks", "mae")


@register("S10_read_reconciliation_json")
def _s10(spark, sf):
    """Reconciliation rows as JSON array files, one per month of the window's end, read back."""
    rows = rec.reconciliation_window(pvr(spark, sf), RECON_FROM_MS, RECON_TO_MS, NOW_MS, include_pending=True)
    path = f"{sj.scratch(spark, 'recon')}-{uuid.uuid4().hex[:6]}"
    month = F.date_format(F.timestamp_millis("window_ends_at_ms"), "yyyyMM").alias("month")
    arrays = rows.groupBy(month).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    arrays.repartition("month").write.partitionBy("month").text(path)
    return rec.read_reconciliation_json(spark, path).drop("month")


# -------------------------------------------------------------- gates, late data, past configs
from revlens.operators import asof  # noqa: E402
from revlens.operators import gate  # noqa: E402
from revlens.operators import refresh as rf  # noqa: E402

CLICK_RULES = {"cerberus_in_range": "cerberus_score BETWEEN 0 AND 1", "rpc_7d_not_negative": "rpc_7d >= 0"}
LATE_FROM = "1998-06-01 00:00:00"


@register("C1_publish_gate")
def _c1g(spark, sf):
    """The clicks of even orders that pass are published; then all clicks are offered, and some
    fail: the target stays, what fails is in quarantine, once per assertion that it fails."""
    path = sj.scratch(spark, "gate")
    clicks = fx.clicks(spark, sf)
    even = F.regexp_extract("click_id", r"(\d+)$", 1).cast("long") % 2 == 0
    gate.publish(clicks.where(even).where(" AND ".join(CLICK_RULES.values())), path, CLICK_RULES, {"click_id_unique": ["click_id"]})
    twice = clicks.unionByName(clicks.where(F.regexp_extract("click_id", r"(\d+)$", 1).cast("long") % 100 == 0))
    refused = gate.publish(twice, path, CLICK_RULES, {"click_id_unique": ["click_id"]})
    if refused.published:
        raise RuntimeError("the gate let failing rows through")
    held = spark.read.parquet(f"{path}/_quarantine").select("click_id", F.explode("failed").alias("failed"))
    return gate.read_published(spark, path).select("click_id", F.lit("published").alias("failed")).unionByName(held)


@register("S11_config_at_call")
def _s11c(spark, sf):
    """Requests as calls; a version comes into force some hours into its day, some days have none."""
    v = F.col("version")
    versions = fx.config_versions(spark, sf).where(v % 5 != 0).withColumn("valid_from_ms", v * 86_400_000 + (v * 7919) % 86_400 * 1000)
    calls = fx.requests(spark, sf).select("request_id", F.unix_millis("ts").alias("call_ms"))
    return asof.config_at_call(calls, versions)


def past_configs(spark, sf):
    """Config versions in force for 80 days each, from 1992-06-01 on."""
    versions = fx.config_versions(spark, sf)
    first = F.min("version").over(Window.partitionBy(F.lit(1)))     # a few versions
    return versions.withColumn("valid_from_ms", F.lit(707_356_800_000) + (F.col("version") - first) * 80 * 86_400_000)


@register("F1_score_clicks_at")
def _f1a(spark, sf):
    """Every click scored with the config of its time."""
    calls = scoring_clicks(spark, sf).withColumn("call_ms", F.unix_millis("click_ts"))
    return sc.score_clicks_at(calls, past_configs(spark, sf), keyed_ledger(spark, sf), ml.STAND_IN, model_version="v1", **sides(spark, sf))


def _late(ledger):
    """(rows known at the first run, late rows)."""
    cut = F.lit(LATE_FROM).cast("timestamp")
    return ledger.where(F.col("revenue_ts") < cut), ledger.where(F.col("revenue_ts") >= cut)


@register("J1_click_revenue_refreshed")
def _j1r(spark, sf):
    """Stored by month without the late ledger rows, then refreshed: only the months that they mark."""
    ledger, path = fx.ledger(spark, sf), sj.scratch(spark, "click-revenue")
    known, late = _late(ledger)
    month = F.trunc("click_ts", "month")
    mon.write_day(att.click_revenue(fx.clicks(spark, sf), known).withColumn("month", month).repartition("month"), path, "month")
    days = rf.dirty_days(spark.read.parquet(path), late, "click_ts", "month")

    def recompute(old):
        return att.click_revenue(old, rf.window_ledger(ledger, days)).withColumn("month", month)
    rf.refresh(spark, path, "month", days, recompute)
    return spark.read.parquet(path).drop("month")


@register("A4_residuals_refreshed")
def _a4r(spark, sf):
    """Realised predictions stored by month, refreshed after late revenue; residuals of the stored rows."""
    ledger, path = fx.ledger(spark, sf), sj.scratch(spark, "realized")
    known, late = _late(ledger)
    preds = fx.predictions(spark, sf)
    month = F.trunc(F.timestamp_millis("ts_ms"), "month")
    stored = preds.withColumn("month", month).repartition("month")
    mon.write_day(stored, path, "month")
    out = sj.scratch(spark, "residuals")

    def residuals(part, rows):
        return mon.residuals_daily(att.prediction_realized(part.drop("month"), rows)).withColumn("month", F.trunc("as_of_date", "month"))
    mon.write_day(residuals(spark.read.parquet(path), known).repartition("month"), out, "month")
    marked = rf.dirty_days(spark.read.parquet(path).withColumn("at", F.timestamp_millis("ts_ms")), late, "at", "month")
    if marked:
        part = spark.read.parquet(path).where(F.col("month").isin(marked))
        mon.write_day(residuals(part, rf.window_ledger(ledger, marked)).repartition("month"), out, "month")
    return spark.read.parquet(out).drop("month")


@register("T1_clicks_upsert_stream")
def _t1u(spark, sf):
    """Re-emits in other files than the first emits, merged into a bucketed table of one row a click."""
    src = sj.stage(fx.landing_clicks(spark, sf), "landing", files=4)
    schema = ing.normalize_clicks(typed_landing(spark, sf)).drop("corrupt").schema
    table = sj.UpsertTable(spark, sj.scratch(spark, "clicks"), schema, "click_id", ["ingested_at", "message_id"], buckets=16)
    sj.run(sj.clicks_upsert_stream(spark, src, table, sj.scratch(spark, "clicks-dead"), sj.scratch(spark, "ckpt"),
                                   max_files=sj.files_a_batch(spark, src, REPLAY_BATCHES)))
    return table.read().select("click_id", "message_id", "click_ts", "device", "geo", "hour_of_day", "cerberus_score", "rpc_7d", "visits_prev_30d")

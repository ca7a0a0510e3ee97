"""Batch scoring: S11 runtime_config, J7 ledger_fallback, J8 feature_overrides,
F1 score_clicks, S8 log_predictions, S9 audit_events.

The decision order per click is: kill switch -> canary -> (breaker, streaming
only) -> feature-store overrides -> model (+ CLV premium) -> bounds -> MODEL.
Fallback values: kill switch / tCPA 0.0, data layer = the click's ledger sum.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.columns import bounds_check, canary, clv_adjust, f64_text, is_finite
from revlens.operators.asof import config_at_call
from revlens.operators.breaker import STATE, BreakerPolicy, guard_calls
from revlens.operators.ml import predict
from revlens.session import checkpoint_dir

# Debug names of the prediction sources, as printed in the audit hash: fixed values.
SOURCE_DEBUG = {"MODEL": "Model", "FALLBACK_TCPA": "FallbackTcpa",
                "FALLBACK_DATA_LAYER": "FallbackDataLayer", "KILL_SWITCH": "KillSwitch"}
# Audit actor name: fixed value.
ACTOR = "scoring-api"


def runtime_config(config_versions: DataFrame) -> DataFrame:
    """The newest config version (one row): kill, bounds, canary ratio."""
    cols = ["version", "kill", "bounds_min", "bounds_max", "canary_bp"]
    return (config_versions.agg(F.max_by(F.struct(*cols), F.col("version")).alias("c"))
                           .select(*[F.col(f"c.{c}").alias(c) for c in cols]))


def read_config(config_versions: DataFrame) -> dict:
    """The newest config as driver scalars (one row; the only per-job driver read)."""
    row = runtime_config(config_versions).first()
    if row is None:
        raise ValueError("no runtime config version")
    cfg = row.asDict()
    lo, hi = cfg["bounds_min"], cfg["bounds_max"]
    if lo is None or hi is None or lo != lo or hi != hi or lo < 0 or hi < 0 or lo > hi:
        raise ValueError(f"invalid bounds min={lo} max={hi}")
    if cfg["canary_bp"] is None or not 0 <= cfg["canary_bp"] <= 10_000:
        raise ValueError(f"invalid canary bp {cfg['canary_bp']}")
    return cfg


def ledger_fallback(clicks: DataFrame, ledger: DataFrame) -> DataFrame:
    """Data-layer fallback revenue per click = lifetime ledger sum, 0.0 when the
    click has no row. A net-negative sum is clamped at 0 and flagged."""
    sums = ledger.groupBy("click_id").agg(F.sum("revenue").alias("_ledger_sum"))
    s = F.coalesce(F.col("_ledger_sum"), F.lit(0.0))
    return (clicks.join(sums, "click_id", "left")
                  .withColumn("fallback_rpc", F.greatest(s, F.lit(0.0)))
                  .withColumn("negative_ledger", s < 0)
                  .drop("_ledger_sum"))


def feature_overrides(clicks: DataFrame, store: DataFrame) -> DataFrame:
    """Fresh rolling signals from the feature store: rpc_* replaced only by
    finite, non-negative values; visits replaced whenever present."""
    s = store.select("click_id", *[F.col(c).alias(f"_s_{c}") for c in
                                   ("rpc_7d", "rpc_14d", "rpc_30d", "visits_prev_30d")])
    out = clicks.join(s, "click_id", "left")
    for c in ("rpc_7d", "rpc_14d", "rpc_30d"):
        v = F.col(f"_s_{c}")
        out = out.withColumn(c, F.when(is_finite(v) & (v >= 0), v).otherwise(F.col(c)))
    out = out.withColumn("visits_prev_30d", F.coalesce(F.col("_s_visits_prev_30d"), F.col("visits_prev_30d")))
    return out.drop(*[f"_s_{c}" for c in ("rpc_7d", "rpc_14d", "rpc_30d", "visits_prev_30d")])


def _outcome(rpc: Column, source, reason, version: Column) -> Column:
    """(predicted_rpc, source, reason, model_version) as one struct."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(rpc.alias("predicted_rpc"), lit(source).alias("source"), lit(reason).alias("reason"),
                    version.alias("model_version"))


def written(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and read back."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/calls-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _calls(clicks: DataFrame, cfg: dict, model, clv, premium, store, ids: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(outcomes of the clicks that the kill switch or the canary stops, model calls of
    the others: ids, model_error, rpc). Killed: no calls."""
    fallback, zero = F.lit("fallback"), F.lit(0.0)
    if cfg["kill"]:
        return _result(clicks, ids, _outcome(zero, "KILL_SWITCH", "kill_switch", fallback)), None
    x = clicks.withColumn("_reach", F.coalesce(canary("click_id", int(cfg["canary_bp"])), F.lit(False)))
    stopped = _result(x.where(~F.col("_reach")), ids, _outcome(zero, "FALLBACK_TCPA", "out_of_canary", fallback))
    return stopped, _outputs(x.where(F.col("_reach")), model, clv, premium, store, ids)


def _outputs(x: DataFrame, model, clv, premium, store, ids: list[str]) -> DataFrame:
    """Model outputs (ids, model_error, rpc) of the clicks that reach the model."""
    if store is not None:
        x = feature_overrides(x, store)
    x = predict(x, model, out="rpc_raw")
    if clv is not None and premium is not None:
        x = x.join(clv.select("click_id", "clv"), "click_id", "left")
        x = x.withColumn("rpc", clv_adjust("rpc_raw", "clv", **premium)).drop("clv")
    else:
        x = x.withColumn("rpc", F.col("rpc_raw"))
    return x.select(*ids, "model_error", "rpc")


def _result(df: DataFrame, ids: list[str], d: Column) -> DataFrame:
    return df.select(*ids, d.alias("d")).select(
        "click_id", "correlation_id", "d.predicted_rpc", "d.source", "d.reason", "d.model_version", *ids[2:])


def _decide(calls: DataFrame, cfg: dict, ledger: DataFrame, ids: list[str], model_version: str) -> DataFrame:
    """Outcomes of model calls by their ``verdict`` (NULL: the output stands). The ledger
    is read only for the clicks that fall back to it."""
    fallback = F.lit("fallback")
    falls = F.col("verdict").isNotNull()
    failed = calls.where(falls).select("click_id").distinct()
    x = ledger_fallback(calls, ledger.join(failed, "click_id", "left_semi"))
    reason = F.when(F.col("negative_ledger"), F.lit("negative_ledger")).otherwise(F.col("verdict"))
    d = (F.when(falls, _outcome(F.col("fallback_rpc"), "FALLBACK_DATA_LAYER", reason, fallback))
          .when(~bounds_check("rpc", cfg["bounds_min"], cfg["bounds_max"]),
                _outcome(F.lit(0.0), "FALLBACK_TCPA", "bounds_rejected", fallback))
          .otherwise(_outcome(F.col("rpc"), "MODEL", "score.model", F.lit(model_version))))
    return _result(x, ids, d)


def score_clicks(clicks: DataFrame, config_versions: DataFrame, ledger: DataFrame, model,
                 model_version: str = "unknown", clv: DataFrame | None = None,
                 premium: dict | None = None, store: DataFrame | None = None, keep: tuple = (), hold=None) -> DataFrame:
    """the decision tree over a click table with the breaker closed (see
    ``score_clicks_guarded``). The config is read once (one row) and enters the plan as
    literals. ``keep``: click columns to carry through.

    The kill switch and the canary are row-local and come first, so the clicks they
    stop meet no join. The others meet the feature store and the model; the ledger
    is read only for clicks whose model output is an error. A NULL click_id is in no
    canary sample. The model's outputs are read twice (which clicks fell back, and all of
    them), so ``hold`` stages them: by default as narrow files in the shared folder.
    """
    cfg = read_config(config_versions)
    ids = ["click_id", "correlation_id", *keep]
    stopped, calls = _calls(clicks, cfg, model, clv, premium, store, ids)
    if calls is None:
        return stopped
    calls = (hold or written)(calls.withColumn("verdict", F.when(F.col("model_error"), F.lit("model_error"))))
    return _decide(calls, cfg, ledger, ids, model_version).unionByName(stopped)


def score_clicks_guarded(clicks: DataFrame, config_versions: DataFrame, ledger: DataFrame, model, policy: BreakerPolicy,
                         state: DataFrame | None = None, model_version: str = "unknown", clv: DataFrame | None = None,
                         premium: dict | None = None, store: DataFrame | None = None, keep: tuple = (),
                         hold=None) -> tuple[DataFrame, DataFrame]:
    """F1 with the breaker: (scored clicks, breaker state per shard after them).

    The clicks that pass the canary are calls of their shard, in time order. An open
    breaker blocks a call (breaker_open); a model error opens it; every model output
    enters the anomaly window, and a breach opens it too (anomaly). All three fall back to
    the ledger; bounds are checked last. ``hold`` stages the guarded calls (default:
    files in the shared folder), from which both results are read, so they are replayed once.
    """
    cfg = read_config(config_versions)
    ids = ["click_id", "correlation_id", *keep]
    extra = [c for c in (policy.key, policy.ts) if c not in ids]
    stopped, calls = _calls(clicks, cfg, model, clv, premium, store, [*ids, *extra])
    if calls is None:
        empty = clicks.sparkSession.createDataFrame([], STATE)
        return stopped.drop(*extra), state if state is not None else empty
    guarded = (hold or written)(guard_calls(calls, policy, state))
    scored = _decide(guarded.where("NOT is_state").drop("is_state", *STATE.names), cfg, ledger, ids, model_version)
    return scored.unionByName(stopped.drop(*extra)), guarded.where("is_state").select(*STATE.names)


def score_clicks_at(clicks: DataFrame, config_versions: DataFrame, ledger: DataFrame, model, call_ms: str = "call_ms",
                    valid_from: str = "valid_from_ms", model_version: str = "unknown", clv: DataFrame | None = None, premium: dict | None = None,
                    store: DataFrame | None = None, keep: tuple = (), hold=None) -> DataFrame:
    """F1 with the config in force at each call (S11 at call time), to score a past period again: kill
    switch, canary and bounds are columns of the call. A call before the first version is
    stopped like a killed one (``no_config``). The breaker is closed."""
    fallback, zero = F.lit("fallback"), F.lit(0.0)
    ids = ["click_id", "correlation_id", *keep]
    c = config_at_call(clicks, config_versions, call_ms, valid_from)
    killed = F.col("version").isNull() | F.coalesce(F.col("kill"), F.lit(True))
    reach = F.coalesce(canary("click_id", F.col("canary_bp")), F.lit(False))
    x = c.withColumn("_stop", F.when(F.col("version").isNull(), F.lit("no_config")).when(killed, F.lit("kill_switch"))
                               .when(~reach, F.lit("out_of_canary")))
    stop = F.col("_stop")
    stopped = _result(x.where(stop.isNotNull()), ids, F.when(stop == "out_of_canary", _outcome(zero, "FALLBACK_TCPA", stop, fallback))
                      .otherwise(_outcome(zero, "KILL_SWITCH", stop, fallback)))
    bounds = {"bounds_min": F.col("bounds_min"), "bounds_max": F.col("bounds_max")}
    calls = _outputs(x.where(stop.isNull()).drop("_stop"), model, clv, premium, store, [*ids, *bounds])
    calls = (hold or written)(calls.withColumn("verdict", F.when(F.col("model_error"), F.lit("model_error"))))
    return _decide(calls, bounds, ledger, ids, model_version).unionByName(stopped)


def log_predictions(scored: DataFrame, ts_ms: Column | int) -> DataFrame:
    """One prediction-log row per scored click (fallbacks included)."""
    ts = ts_ms if isinstance(ts_ms, Column) else F.lit(ts_ms).cast("long")
    return scored.select("click_id", "correlation_id", "predicted_rpc", "source", "model_version",
                         ts.alias("ts_ms"))


def audit_events(scored: DataFrame) -> DataFrame:
    """One audit row per scored click; after_hash = '<Source>:<rpc>' and
    ``source`` carries the decision's reason code."""
    dbg = F.create_map(*[x for k, v in SOURCE_DEBUG.items() for x in (F.lit(k), F.lit(v))])
    return scored.select(F.lit(ACTOR).alias("actor"), F.lit("score").alias("action"),
                         "correlation_id", "click_id", F.lit(None).cast("string").alias("before_hash"),
                         F.concat(dbg[F.col("source")], F.lit(":"), f64_text("predicted_rpc")).alias("after_hash"),
                         F.col("reason").alias("source"))

"""Activation and breaker automation: P7 activation_envelopes, P8 activation_route,
T4 breaker_events (batch body; the stream wraps it)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Activation modes and their channels: fixed values.
MODES = {"direct_oci": ["oci"], "ssgtm_phoebe": ["ssgtm"], "hybrid": ["oci", "ssgtm"]}

# Breaker decision reasons per anomaly kind: fixed values.
TRIP_REASONS = {
    "null_or_zero_rate": "null/zero rate above threshold",
    "feature_drift": "feature drift PSI breach",
    "latency": "latency SLO breach",
}
NO_TRIP_REASON = "within threshold"

def tagged_envelopes(msgs: DataFrame, data: str = "data") -> DataFrame:
    """P7 in one pass: every message with its envelope columns and ``reason`` (NULL:
    valid). The payload is parsed once, in a projection of its own that later uses
    refer to; write it partitioned by status instead of filtering it twice."""
    m = F.col("_m")
    msgs = msgs.withColumn("_m", F.from_json(F.col(data), "map<string,string>"))   # NULL when not an object
    has = lambda k: F.map_contains_key(m, k) & m[k].isNotNull()
    p = {k: m[k] for k in ("click_id", "correlation_id", "predicted_rpc", "source", "model_version")}
    rpc = p["predicted_rpc"].try_cast("double")
    reason = (F.when(m.isNull(), F.lit("malformed_json"))
               .when(~has("click_id"), F.lit("missing click_id"))
               .when(~has("predicted_rpc"), F.lit("missing predicted_rpc"))
               .when(F.length(F.coalesce(p["click_id"], F.lit(""))) == 0, F.lit("click_id required"))
               .when(rpc.isNull(), F.lit("predicted_rpc not a number"))
               .when(F.isnan(rpc) | (rpc < 0), F.lit("predicted_rpc invalid")))
    return msgs.select(
        *[c for c in msgs.columns if c != "_m"], reason.alias("reason"), p["click_id"].alias("click_id"),
        F.coalesce(p["correlation_id"], F.lit("")).alias("correlation_id"), rpc.alias("predicted_rpc"),
        F.coalesce(p["source"], F.lit("MODEL")).alias("source"),
        F.coalesce(p["model_version"], F.lit("unknown")).alias("model_version"))


ENVELOPE = ["click_id", "correlation_id", "predicted_rpc", "source", "model_version"]


def activation_envelopes(msgs: DataFrame, data: str = "data",
                         keep: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """Decoded prediction payloads -> (envelopes, dead letters).
    Required: click_id (non-empty) and predicted_rpc (a number, not NaN, >= 0).
    Defaults: correlation_id '', source 'MODEL', model_version 'unknown'."""
    tagged = tagged_envelopes(msgs, data)
    return (tagged.where(F.col("reason").isNull()).select(*keep, *ENVELOPE),
            tagged.where(F.col("reason").isNotNull()).select(*msgs.columns, "reason"))


def activation_route(env: DataFrame, mode: str) -> DataFrame:
    """One payload row per envelope and channel of ``mode`` (hybrid fans out to
    both). The OCI payload carries the click as gclid_equivalent and the value;
    the SSGTM payload carries the whole envelope."""
    if mode not in MODES:
        raise ValueError(f"unknown activation mode {mode!r}")
    oci = F.to_json(F.struct(F.col("click_id").alias("gclid_equivalent"),
                             F.col("predicted_rpc").alias("conversion_value")))
    ssgtm = F.to_json(F.struct("click_id", F.col("predicted_rpc").alias("value"),
                               "correlation_id", "source", "model_version"))
    channels = F.explode(F.array(*[F.lit(c) for c in MODES[mode]]))
    return (env.select("click_id", channels.alias("channel"), oci.alias("_oci"), ssgtm.alias("_ssgtm"))
               .select("click_id", "channel",
                       F.when(F.col("channel") == "oci", F.col("_oci")).otherwise(F.col("_ssgtm"))
                        .alias("payload")))


_ANOMALY_TEXT = T.StructType([T.StructField(n, T.StringType()) for n in
                              ("kind", "value", "threshold", "occurred_at_ms")])


def breaker_events(msgs: DataFrame, data: str = "data") -> DataFrame:
    """T4 body: anomaly event JSON -> validated event and breaker decision.
    Invalid payloads (unknown kind, negative or missing numbers) are not tripped."""
    p = F.from_json(F.col(data), _ANOMALY_TEXT)
    kind = p["kind"]
    value = p["value"].try_cast("double")
    thr = p["threshold"].try_cast("double")
    at = p["occurred_at_ms"].try_cast("bigint")
    valid = (kind.isin(*TRIP_REASONS) & (value >= 0) & (thr >= 0) & (at >= 0))
    valid = F.coalesce(valid, F.lit(False))
    trip = valid & (value > thr)
    reasons = F.create_map(*[x for k, v in TRIP_REASONS.items() for x in (F.lit(k), F.lit(v))])
    return msgs.select(
        *[c for c in msgs.columns if c != data], kind.alias("kind"), value.alias("value"),
        thr.alias("threshold"), at.alias("occurred_at_ms"), valid.alias("valid"), trip.alias("trip"),
        F.when(~valid, F.lit("invalid payload")).when(trip, reasons[kind])
         .otherwise(F.lit(NO_TRIP_REASON)).alias("reason"))


def engage_kill_switch(decisions: DataFrame, config: DataFrame) -> DataFrame:
    """Idempotent engagement: one new config version with kill = true when some
    event trips and the newest version is not already killed; otherwise no row.
    Config rows and decisions are stacked and reduced in one aggregation
    (``max_by`` skips the decision rows, whose version is NULL)."""
    cfg = config.select("version", F.struct("version", "kill", "bounds_min", "bounds_max",
                                            "canary_bp").alias("cfg"),
                        F.lit(None).cast("boolean").alias("trip"),
                        F.lit(None).cast("long").alias("occurred_at_ms"),
                        F.lit(None).cast("string").alias("reason"))
    dec = decisions.select(F.lit(None).cast("long").alias("version"),
                           F.lit(None).cast(cfg.schema["cfg"].dataType).alias("cfg"),
                           "trip", "occurred_at_ms", "reason")
    agg = cfg.unionByName(dec).agg(
        F.max_by("cfg", "version").alias("c"),
        F.max(F.col("trip").cast("int")).alias("any_trip"),
        F.min_by("reason", F.when(F.col("trip"), F.col("occurred_at_ms"))).alias("reason"))
    return (agg.where((F.col("any_trip") == 1) & ~F.coalesce(F.col("c.kill"), F.lit(False)))
               .select((F.col("c.version") + 1).alias("version"), F.lit(True).alias("kill"),
                       "c.bounds_min", "c.bounds_max", "c.canary_bp", "reason"))

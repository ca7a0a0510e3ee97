"""Declared schemas. Nothing in the library infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, L, B, TS = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType(), T.TimestampType()


def _s(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


# Model input order: fixed values of the contract (8 features, in this order).
FEATURE_ORDER = [
    "hour_of_day",
    "cerberus_score",
    "rpc_7d",
    "rpc_14d",
    "rpc_30d",
    "is_payday_week",
    "auction_pressure",
    "visits_prev_30d",
]

# Numeric features monitored for drift (baseline deciles and PSI): fixed values.
MONITORED_FEATURES = [
    "cerberus_score",
    "rpc_7d",
    "rpc_14d",
    "rpc_30d",
    "hour_of_day",
    "auction_pressure",
    "visits_prev_30d",
]

# Prediction sources: fixed values.
SOURCES = ["MODEL", "FALLBACK_TCPA", "FALLBACK_DATA_LAYER", "KILL_SWITCH"]

CLICKS = _s(
    ("click_id", S, False), ("correlation_id", S, True), ("click_ts", TS, False),
    ("device", S, False), ("geo", S, False), ("hour_of_day", L, False),
    ("query_intent", S, False), ("ad_creative_id", S, False), ("cerberus_score", D, False),
    ("rpc_7d", D, False), ("rpc_14d", D, False), ("rpc_30d", D, False),
    ("is_payday_week", B, False), ("auction_pressure", D, False),
    ("landing_path", S, False), ("visits_prev_30d", L, False),
)

LEDGER = _s(
    ("click_id", S, False), ("revenue", D, False), ("revenue_ts", TS, False),
    ("order_id", S, True), ("ts_ms", L, True),
)

PREDICTIONS = _s(
    ("click_id", S, True), ("correlation_id", S, True), ("predicted_rpc", D, True),
    ("source", S, True), ("model_version", S, True), ("ts_ms", L, True),
    ("predicted_at", TS, True),
)

LANDING = _s(
    ("subscription_name", S, True), ("message_id", S, True), ("publish_time", TS, True),
    ("data", S, True), ("attributes", S, True),
)

# JSON payload of a click message: every field arrives as text and is cast after.
CLICK_PAYLOAD = _s(*[(f.name, S, True) for f in CLICKS.fields])
PREDICTION_PAYLOAD = _s(*[(n, S, True) for n in
                          ("click_id", "correlation_id", "predicted_rpc", "source",
                           "model_version", "ts_ms")])

RUNTIME_CONFIG = _s(
    ("version", L, False), ("kill", B, True), ("bounds_min", D, True),
    ("bounds_max", D, True), ("canary_bp", L, True),
)

ANOMALY_EVENT = _s(
    ("kind", S, True), ("value", D, True), ("threshold", D, True), ("occurred_at_ms", L, True),
)

AUDIT_EVENT = _s(
    ("actor", S, False), ("action", S, False), ("correlation_id", S, True),
    ("click_id", S, False), ("before_hash", S, True), ("after_hash", S, False),
    ("source", S, False),
)

ACTIVATION_ENVELOPE = _s(
    ("click_id", S, True), ("correlation_id", S, True), ("predicted_rpc", D, True),
    ("source", S, True), ("model_version", S, True),
)

RECONCILIATION_ROW = _s(
    ("click_id", S, True), ("predicted_rpc", D, True), ("realized_rpc", D, True),
    ("source", S, True), ("window_ends_at_ms", L, True),
)

# Declared schemas of the input tables (wall-clock instants, as the files hold them).
_DRIVER = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}
_TYPES = {"int": T.IntegerType(), "long": L, "double": D, "string": S, "timestamp_ntz": T.TimestampNTZType(), "array<float>": T.ArrayType(T.FloatType())}
DRIVER_TABLES = {name: _s(*[(n, _TYPES[t], True) for n, t in (c.split(" ") for c in columns.split(", "))])
                 for name, columns in _DRIVER.items()}

"""Product tables derived from the driver's tables.

Each builder is a pure DataFrame derivation of the given parquet tables, so its
work grows with them. The DuckDB twin of every rule lives in
``revlens.plans.oracle`` and must stay in step with this file.

Rules (all keyed on the order key k = o_orderkey):
  clicks       one per order; ts = order date + (k*7919 mod 86400) s;
               device by k mod 4 (3 -> 'watch', invalid); geo by region, k mod 97 = 0 -> 'usa';
               cerberus (k*37 mod 1000)/1000, k mod 997 = 0 -> 1.5 (invalid);
               rpc_7d (k*31 mod 500)/100, k mod 499 = 0 -> -0.5 (invalid)
  ledger       one per line item; revenue in quarters:
               (round(price*100) * (100 - round(disc*100)) + 1250) div 2500 / 4,
               negative for return flag 'R'; revenue_ts = ship date
  predictions  one per click; rpc = total price / 1000 in 1/64 units; source by k mod 10; version by k mod 2
  auctions     orders not in status 'P'
  overrides    orders of priority 1-URGENT / 2-HIGH, some negative / NaN / NULL values
  clv          customer account balance per click (negative balances are invalid CLV)
  landing      JSON message per click, publish 60 s after the click, k mod 211 = 0 malformed;
               those, k mod 997 = 0 and priority 1-URGENT in status 'P' re-emitted one hour
               later, well-formed, with a valid cerberus score and other visits
  samples      events -> anomaly samples (value < 1 -> rpc 0), key user_id mod 4
  requests     events -> request log (error -> 500)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions.columns import sunday_week
from revlens.sources.tables import read_table



def _k() -> Column:
    return F.col("o_orderkey")


def _case(expr: Column, mapping: dict, default) -> Column:
    out = None
    for key, val in mapping.items():
        out = (F.when(expr == key, F.lit(val)) if out is None
               else out.when(expr == key, F.lit(val)))
    return out.otherwise(F.lit(default))


def _orders_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders",
                   ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                    "o_orderpriority"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal"])
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    # nation is a fixed 25-row dimension; customer size is left to the planner
    # (broadcast only under spark.sql.autoBroadcastJoinThreshold, else sort-merge).
    return (o.join(c, o.o_custkey == c.c_custkey)
             .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")))


def _click_columns() -> list[Column]:
    click_ts = F.timestamp_seconds(F.unix_seconds("o_orderdate") + (_k() * 7919) % 86400)
    return [
        F.concat(F.lit("c-"), _k().cast("string")).alias("click_id"),
        F.concat(F.lit("r-"), _k().cast("string")).alias("correlation_id"),
        click_ts.alias("click_ts"),
        _case(_k() % 4, {0: "mobile", 1: "desktop", 2: "tablet"}, "watch").alias("device"),
        F.when(_k() % 97 == 0, F.lit("usa"))
         .otherwise(_case(F.col("n_regionkey"), {0: "ZA", 1: "US", 2: "CN", 3: "GB"}, "AE"))
         .alias("geo"),
        F.hour(click_ts).cast("long").alias("hour_of_day"),
        _case(_k() % 3, {0: "commercial", 1: "informational"}, "navigational").alias("query_intent"),
        F.concat(F.lit("ad-"), F.lpad((F.col("o_custkey") % 5).cast("string"), 3, "0"))
         .alias("ad_creative_id"),
        F.when(_k() % 997 == 0, F.lit(1.5)).otherwise((_k() * 37) % 1000 / F.lit(1000.0))
         .alias("cerberus_score"),
        F.when(_k() % 499 == 0, F.lit(-0.5)).otherwise((_k() * 31) % 500 / F.lit(100.0)).alias("rpc_7d"),
        ((_k() * 17) % 500 / F.lit(100.0)).alias("rpc_14d"),
        ((_k() * 11) % 500 / F.lit(100.0)).alias("rpc_30d"),
        (sunday_week(click_ts) % 2 == 0).alias("is_payday_week"),
        ((_k() * 13) % 100 / F.lit(100.0)).alias("auction_pressure"),
        F.concat(F.lit("/lp/"), (_k() % 20).cast("string")).alias("landing_path"),
        (F.col("o_custkey") % 10).cast("long").alias("visits_prev_30d"),
    ]


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_enriched(spark, sf_dir).select(*_click_columns())


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount",
                     "l_returnflag", "l_shipdate"])
    price_cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    disc_pct = F.round(F.col("l_discount") * 100).cast("long")
    # revenue in quarter units: dyadic values add up exactly in binary floating
    # point, so sums do not depend on the order an engine adds them in
    quarters = F.floor((price_cents * (100 - disc_pct) + 1250) / 2500).cast("long")
    sign = F.when(F.col("l_returnflag") == "R", F.lit(-1)).otherwise(F.lit(1))
    return li.select(
        F.concat(F.lit("c-"), F.col("l_orderkey").cast("string")).alias("click_id"),
        (sign * quarters / F.lit(4.0)).alias("revenue"),
        F.col("l_shipdate").alias("revenue_ts"),
        F.concat_ws("-", F.lit("o"), F.col("l_orderkey").cast("string"),
                    F.col("l_linenumber").cast("string")).alias("order_id"),
        F.unix_millis("l_shipdate").alias("ts_ms"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice", "o_orderdate"])
    click_ts = F.timestamp_seconds(F.unix_seconds("o_orderdate") + (_k() * 7919) % 86400)
    source = _case(_k() % 10, {0: "FALLBACK_TCPA", 1: "FALLBACK_DATA_LAYER", 2: "KILL_SWITCH"},
                   "MODEL")
    ts_ms = F.unix_millis(click_ts) + 50
    return o.select(
        F.concat(F.lit("c-"), _k().cast("string")).alias("click_id"),
        F.concat(F.lit("r-"), _k().cast("string")).alias("correlation_id"),
        # 1/64 units: dyadic, so means over predictions are exact in any engine
        (F.floor(F.col("o_totalprice") * 64 / 1000 + 0.5) / F.lit(64.0)).alias("predicted_rpc"),
        source.alias("source"),
        F.when(source != "MODEL", F.lit("fallback"))
         .when(_k() % 2 == 0, F.lit("v1")).otherwise(F.lit("v2")).alias("model_version"),
        ts_ms.alias("ts_ms"),
        F.timestamp_millis(ts_ms + 250).alias("predicted_at"),
    )


def auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus"])
    return (o.where(F.col("o_orderstatus") != "P")
             .select(F.concat(F.lit("c-"), _k().cast("string")).alias("click_id"),
                     ((_k() * 29) % 100 / F.lit(100.0)).alias("auction_pressure")))


def feature_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders",
                   ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"])
    base = (F.col("o_totalprice") % 1000) / F.lit(100.0)
    return (o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
             .select(F.concat(F.lit("c-"), _k().cast("string")).alias("click_id"),
                     F.when(_k() % 7 == 0, F.lit(-1.0))
                      .when(_k() % 11 == 0, F.lit(float("nan"))).otherwise(base).alias("rpc_7d"),
                     F.when(_k() % 3 == 0, F.lit(None).cast("double"))
                      .otherwise(base / 2).alias("rpc_14d"),
                     F.when(_k() % 13 == 0, F.lit(float("inf"))).otherwise(base / 3).alias("rpc_30d"),
                     F.when(_k() % 5 == 0, F.lit(None).cast("long"))
                      .otherwise((F.col("o_custkey") % 7).cast("long")).alias("visits_prev_30d")))


def clv(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal"])
    return (o.join(c, o.o_custkey == c.c_custkey)
             .select(F.concat(F.lit("c-"), _k().cast("string")).alias("click_id"),
                     F.col("c_acctbal").alias("clv")))


def _click_json(cols: list[Column]) -> Column:
    return F.to_json(F.struct(*cols))


def landing_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw click messages as they land from the bus: envelope columns and a JSON
    ``data`` string. Includes malformed payloads and one-hour-later re-emits."""
    base = _orders_enriched(spark, sf_dir).select(
        _k(), "o_orderstatus", "o_orderpriority", *_click_columns())
    payload_cols = [F.col(c) for c in
                    ("click_id", "correlation_id", "device", "geo", "hour_of_day",
                     "query_intent", "ad_creative_id", "cerberus_score", "rpc_7d", "rpc_14d",
                     "rpc_30d", "is_payday_week", "auction_pressure", "landing_path")]

    def msg(base: DataFrame, visits: Column, delay_s: int, suffix: str, corrected: bool) -> DataFrame:
        js = _click_json([F.date_format("click_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("click_ts"),
                          *payload_cols, visits.alias("visits_prev_30d")])
        return base.select(
            F.lit("clicks-landing").alias("subscription_name"),
            F.concat(F.lit("m-"), _k().cast("string"), F.lit(suffix)).alias("message_id"),
            (F.col("click_ts") + F.make_interval(secs=F.lit(delay_s))).alias("publish_time"),
            (F.when(_k() % 211 == 0, F.substr(js, F.lit(2))).otherwise(js) if not corrected else js).alias("data"),
            F.lit(None).cast("string").alias("attributes"),
            _k(), F.col("o_orderstatus"), F.col("o_orderpriority"))

    first = msg(base, F.col("visits_prev_30d"), 60, "", False)
    fixed = base.withColumn("cerberus_score", F.when(_k() % 997 == 0, F.lit(0.5)).otherwise(F.col("cerberus_score")))
    again = (msg(fixed, F.col("visits_prev_30d") + 1, 3660, "-r", True)
             .where(((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"))
                    | (_k() % 211 == 0) | (_k() % 997 == 0)))
    return first.unionByName(again).drop("o_orderkey", "o_orderstatus", "o_orderpriority")


def landing_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    js = F.to_json(F.struct("click_id", "correlation_id", "predicted_rpc", "source",
                            "model_version", "ts_ms"))
    key = F.regexp_extract("click_id", r"(\d+)$", 1).cast("long")
    return p.select(
        F.lit("predictions-landing").alias("subscription_name"),
        F.concat(F.lit("p-"), F.col("click_id")).alias("message_id"),
        F.col("predicted_at").alias("publish_time"),
        F.when(key % 211 == 0, F.substr(js, F.lit(2))).otherwise(js).alias("data"),
        F.lit(None).cast("string").alias("attributes"))


def push_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Push-subscription request bodies carrying prediction payloads in base64;
    orders with key mod 17 = 0 arrive without data."""
    lp = landing_predictions(spark, sf_dir)
    key = F.regexp_extract("message_id", r"(\d+)$", 1).cast("long")
    data = F.when(key % 17 == 0, F.lit(None).cast("string")).otherwise(F.base64(F.encode("data", "UTF-8")))
    body = F.to_json(F.struct(F.struct(data.alias("data"), F.col("message_id").alias("messageId"))
                              .alias("message"), F.col("subscription_name").alias("subscription")))
    return lp.select("message_id", body.alias("body"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomaly-window samples: each event is one realised model output."""
    e = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "value"])
    return e.select(
        F.col("event_id"),
        (F.col("user_id") % 4).alias("shard"),
        F.unix_millis("ts").alias("ts_ms"),
        F.when(F.col("value") < 1.0, F.lit(0.0)).otherwise(F.col("value")).alias("rpc"))


REQUEST_PATHS = ["/v1/score", "/v1/explain", "/v1/score", "/healthz"]


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log of the scoring service, one row per handled request."""
    e = read_table(spark, sf_dir, "events", ["event_id", "ts", "event_type", "value"])
    path = _case(F.col("event_id") % 4, dict(enumerate(REQUEST_PATHS[:3])), REQUEST_PATHS[3])
    return e.select(
        F.col("event_id").alias("request_id"),
        F.col("ts"),
        path.alias("path"),
        F.when(path == "/healthz", F.lit("GET")).otherwise(F.lit("POST")).alias("method"),
        F.when(F.col("event_type") == "error", F.lit(500)).otherwise(F.lit(200)).cast("long")
         .alias("status"),
        (F.col("value") * 10).alias("latency_ms"))


ANOMALY_KINDS = ["null_or_zero_rate", "feature_drift", "latency"]


def anomaly_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomaly event messages (JSON) as published to the breaker topic."""
    e = read_table(spark, sf_dir, "events", ["event_id", "ts", "value", "event_type"])
    kind = _case(F.col("event_id") % 3, {0: ANOMALY_KINDS[0], 1: ANOMALY_KINDS[1]},
                 ANOMALY_KINDS[2])
    value = F.when(F.col("event_type") == "error", -F.col("value") / 100).otherwise(F.col("value") / 100)
    js = F.to_json(F.struct(kind.alias("kind"), value.alias("value"),
                            F.lit(0.25).alias("threshold"),
                            F.unix_millis("ts").alias("occurred_at_ms")))
    return e.select(F.col("event_id"), js.alias("data"))


def config_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runtime config history: one version per event day (version = day number);
    kill on days = 3 mod 7, canary 2500 bp x (1 + day mod 4), bounds [0.5, 50 x (1 + day mod 8)]."""
    e = read_table(spark, sf_dir, "events", ["ts"])
    day = F.floor(F.unix_micros("ts") / 86_400_000_000).cast("long")
    d = e.select(day.alias("version")).distinct()
    v = F.col("version")
    return d.select(v, (v % 7 == 3).alias("kill"), F.lit(0.5).alias("bounds_min"),
                    (50 * (1 + v % 8)).cast("double").alias("bounds_max"),
                    F.least(2500 * (1 + v % 4), F.lit(10_000)).cast("long").alias("canary_bp"))

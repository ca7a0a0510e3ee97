"""Ingestion: S2 decode_push_envelope, S3 typed_clicks, S4 typed_predictions,
S6 merge_ledger, P1 normalize_clicks, P2 validate_clicks, W5 dedup_clicks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions.columns import is_finite
from revlens.schemas import CLICK_PAYLOAD, PREDICTION_PAYLOAD

# Contract values: allowed devices.
DEVICES = ["mobile", "desktop", "tablet"]


def decode_push_envelope(df: DataFrame, body: str = "body") -> DataFrame:
    """Push request body -> base64-decoded ``message.data`` as ``data``;
    a missing or empty payload becomes '{}'."""
    raw = F.get_json_object(F.col(body), "$.message.data")
    decoded = F.when(F.length(raw) > 0, F.decode(F.try_to_binary(raw, F.lit("base64")), "UTF-8"))
    return df.withColumn("data", F.coalesce(decoded, F.lit("{}")))


def _scalar(text: Column) -> Column:
    """JSON_EXTRACT_SCALAR semantics on a field read as text: objects and arrays
    give NULL (the parser hands their JSON text to a string field). The JSON check
    only runs for values starting with '{' or '[' (the AND short-circuits)."""
    maybe = F.substring(text, 1, 1).isin("{", "[")
    nested = maybe & (F.json_object_keys(text).isNotNull() | F.json_array_length(text).isNotNull())
    return F.when(~nested, text)


_CORRUPT = "_corrupt_record"


def _typed(raw: DataFrame, payload_schema, casts: dict, extra: list[Column]) -> DataFrame:
    """One parse per row: from_json with a corrupt-record column flags malformed
    payloads; a payload that is not an object ('[..]', '1') is flagged too."""
    schema = T.StructType([*payload_schema.fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = raw.withColumn("_p", F.from_json("data", schema, {"columnNameOfCorruptRecord": _CORRUPT}))
    is_obj = (F.substring(F.ltrim(F.col("data")), 1, 1) == "{") & F.col(f"_p.{_CORRUPT}").isNull()
    cols, bad = [], F.lit(False)
    for f in payload_schema.fields:
        text = _scalar(F.col("_p")[f.name])
        target = casts.get(f.name)
        val = text if target is None else text.try_cast(target)
        if target is not None:
            bad = bad | (text.isNotNull() & val.isNull())
        cols.append(F.when(is_obj, val).alias(f.name))
    # The typed columns leave through a generator: its outputs are plain columns, so later
    # filters and self-joins neither repeat the parse nor make the planner infer
    # constraints over every combination of the expressions.
    typed = F.struct(*cols, *extra, (~F.coalesce(is_obj, F.lit(False)) | bad).alias("corrupt"))
    return parsed.select(*[c for c in raw.columns if c not in ("data", "attributes")], F.inline(F.array(typed)))


CLICK_CASTS = {"click_ts": "timestamp", "hour_of_day": "bigint", "cerberus_score": "double",
               "rpc_7d": "double", "rpc_14d": "double", "rpc_30d": "double",
               "is_payday_week": "boolean", "auction_pressure": "double", "visits_prev_30d": "bigint"}


def typed_clicks(raw: DataFrame) -> DataFrame:
    """S3: landing rows (envelope + JSON ``data``) -> the 15 typed click columns,
    ``ingested_at`` = publish time, and a ``corrupt`` flag (payload not a JSON
    object, or a value that does not cast) for the dead letter."""
    return (_typed(raw, CLICK_PAYLOAD, CLICK_CASTS, [F.col("publish_time").alias("ingested_at")])
            .drop("publish_time"))


def typed_predictions(raw: DataFrame) -> DataFrame:
    """Prediction messages -> typed rows with ``predicted_at`` = publish time."""
    casts = {"predicted_rpc": "double", "ts_ms": "bigint"}
    return (_typed(raw, PREDICTION_PAYLOAD, casts, [F.col("publish_time").alias("predicted_at")])
            .drop("publish_time"))


def merge_ledger(target: DataFrame, source: DataFrame, as_of, lookback_hours: int = 6) -> DataFrame:
    """Rows to append to the ledger. Source rows of the last ``lookback_hours``
    before ``as_of`` that match no target row on (click_id, order_id null-safe,
    revenue_ts) - an insert-only MERGE. Duplicates inside the batch are all kept,
    as MERGE inserts them. The null-safe key is an equi-join key (sort-merge anti join)."""
    end = F.lit(as_of).cast("timestamp")
    s = (source.where(F.col("revenue_ts") >= end - F.make_interval(hours=F.lit(lookback_hours)))
               .select("click_id", "revenue", "revenue_ts", "order_id",
                       F.unix_millis("revenue_ts").alias("ts_ms"))).alias("s")
    # a match has the source row's revenue_ts, so older target rows cannot match
    t = (target.where(F.col("revenue_ts") >= end - F.make_interval(hours=F.lit(lookback_hours)))
               .select("click_id", "order_id", "revenue_ts").alias("t"))
    cond = ((F.col("s.click_id") == F.col("t.click_id"))
            & F.col("s.order_id").eqNullSafe(F.col("t.order_id"))
            & (F.col("s.revenue_ts") == F.col("t.revenue_ts")))
    return s.join(t, cond, "left_anti")


def normalize_clicks(clicks: DataFrame) -> DataFrame:
    """Devices outside the contract's list become 'unknown'."""
    d = F.col("device")
    return clicks.withColumn("device", F.when(d.isin(*DEVICES), d).otherwise(F.lit("unknown")))


def rejection_reason(c=F.col) -> Column:
    """P2 rules in order, first failure wins: hour in 0..23; cerberus in [0, 1] and
    not NaN; rpc_7d, rpc_14d, rpc_30d finite and >= 0; click_id not blank."""
    hour, cer = c("hour_of_day"), c("cerberus_score")
    r = (F.when(hour.isNull() | (hour < 0) | (hour > 23), F.lit("invalid_hour"))
          .when(cer.isNull() | F.isnan(cer) | (cer < 0) | (cer > 1), F.lit("invalid_cerberus_score")))
    for name in ("rpc_7d", "rpc_14d", "rpc_30d"):
        v = c(name)
        r = r.when(~is_finite(v) | (v < 0), F.lit(f"invalid_{name}"))
    return r.when(F.length(F.trim(F.coalesce(c("click_id"), F.lit("")))) == 0, F.lit("empty_click_id"))


def validate_clicks(clicks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected); rejected rows carry ``reason``. One projection,
    two filters: Spark reads the input once per consumer, so cache or write the
    tagged frame when both outputs are materialised in one job."""
    tagged = clicks.withColumn("reason", rejection_reason())
    return (tagged.where(F.col("reason").isNull()).drop("reason"),
            tagged.where(F.col("reason").isNotNull()))


def dedup_clicks(landed: DataFrame, hours: int = 24, ts: str = "ingested_at",
                 tiebreak: str = "message_id") -> DataFrame:
    """One row per click_id, last write wins among the emits within ``hours``
    of the first emit (ordered by ``ts`` then ``tiebreak``); later re-emits are
    dropped. ``landed`` should be a stored table: it is scanned narrow first.

    The first and last emit times are primitive hash aggregates over (click_id, ts)
    with map-side partial aggregation, so a click re-emitted millions of times
    collapses before the shuffle; only keys whose last emit falls after the window
    are aggregated again. The payload is joined back on (click_id, ts), which also
    spreads a hot click; ties and redeliveries, the few rows that are left, are
    broken on their own."""
    limit = F.col("_first") + F.make_interval(hours=F.lit(hours))
    ends = landed.groupBy("click_id").agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    done = ends.where(F.col("_last") <= limit).select("click_id", "_last")
    late = ends.where(F.col("_last") > limit).select("click_id", "_first")
    redo = (landed.select("click_id", ts).join(late, "click_id").where(F.col(ts) <= limit)
                  .groupBy("click_id").agg(F.max(ts).alias("_last")))
    last = done.unionByName(redo).withColumnRenamed("click_id", "_id")
    cand = landed.join(last, F.col("click_id").eqNullSafe(F.col("_id")) & (F.col(ts) == F.col("_last"))).drop("_id", "_last")
    ties = (landed.select("click_id", ts).join(last, F.col("click_id").eqNullSafe(F.col("_id")) & (F.col(ts) == F.col("_last")))
                  .groupBy("click_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("click_id").alias("_id")))
    same = F.col("click_id").eqNullSafe(F.col("_id"))
    order = F.col(tiebreak).desc_nulls_last()
    tied = cand.join(ties, same, "left_semi").withColumn("_rn", F.row_number().over(Window.partitionBy("click_id").orderBy(order)))
    return cand.join(ties, same, "left_anti").unionByName(tied.where("_rn = 1").drop("_rn"))

"""Revenue attribution: J1 click_revenue, J2/J3 training frames, J4 predictions vs
revenue, J5 realised revenue per prediction.

Scale notes. click_id is high-cardinality, so the interval joins are sort-merge
joins on click_id. Only the narrow key columns (click_id, click_ts) and the three
ledger columns are shuffled for the interval join; the revenue sum is computed on
that narrow side (its output is already hash-partitioned by click_id, so the
aggregate adds no exchange) and joined back to the wide click row once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.columns import sunday_week

def _window_sum(keys: DataFrame, ledger: DataFrame, ts_col: str, window_days: int,
                until=None, out: str = "revenue_sum") -> DataFrame:
    """Sum of ledger revenue per (click_id, ts_col) with
    ts_col <= revenue_ts <= ts_col + window_days, optionally capped at ``until``."""
    k = keys.select("click_id", ts_col).alias("k")
    # rows of one instant are one term: a click with many ledger rows collapses map-side
    r = ledger.groupBy("click_id", "revenue_ts").agg(F.sum("revenue").alias("revenue"))
    if until is not None:
        r = r.where(F.col("revenue_ts") <= F.lit(until).cast("timestamp"))
    r = r.alias("r")
    cond = ((F.col("k.click_id") == F.col("r.click_id"))
            & (F.col("r.revenue_ts") >= F.col(f"k.{ts_col}"))
            & (F.col("r.revenue_ts") <= F.col(f"k.{ts_col}") + F.expr(f"INTERVAL {int(window_days)} DAYS")))
    return (k.join(r, cond, "inner")
             .groupBy(F.col("k.click_id").alias("click_id"), F.col(f"k.{ts_col}").alias(ts_col))
             .agg(F.sum("r.revenue").alias(out)))


def click_revenue(clicks: DataFrame, ledger: DataFrame, window_days: int = 30,
                  until=None) -> DataFrame:
    """One row per click with the revenue booked within ``window_days`` after it
    (both ends inclusive); clicks without revenue get 0.0. Expects de-duplicated
    click_ids (W5), as the table's uniqueness assertion states."""
    rev = _window_sum(clicks, ledger, "click_ts", window_days, until)
    c = clicks.select("click_id", "click_ts", "device", "geo", "hour_of_day", "query_intent",
                      "ad_creative_id", "cerberus_score", "landing_path", "visits_prev_30d")
    # joined on click_id alone, by which the sums are partitioned; equal times as a filter
    same = (c.click_id == F.col("_id")) & (F.unix_micros("click_ts") - F.unix_micros("_ts") == 0)
    return (c.join(rev.withColumnsRenamed({"click_id": "_id", "click_ts": "_ts"}), same, "left")
             .select("click_id", "click_ts",
                     F.unix_millis("click_ts").alias("click_ts_ms"),
                     "device", "geo",
                     F.hour("click_ts").cast("long").alias("hour_of_day"),
                     "query_intent", "ad_creative_id", "cerberus_score", "landing_path",
                     "visits_prev_30d",
                     F.coalesce(F.col("revenue_sum"), F.lit(0.0)).alias("target_revenue")))


def training_rows(click_rev: DataFrame, rolling: DataFrame, auctions: DataFrame) -> DataFrame:
    """Training frame. Rolling RPC defaults to 0.0, auction pressure to 0.5,
    payday week = even Sunday-based week number."""
    rr = rolling.select("click_id", "rpc_7d", "rpc_14d", "rpc_30d")
    a = auctions.select("click_id", "auction_pressure")
    return (click_rev.join(rr, "click_id", "left").join(a, "click_id", "left")
            .select("click_id", "click_ts_ms", "device", "geo", "hour_of_day", "cerberus_score",
                    F.coalesce("rpc_7d", F.lit(0.0)).alias("rpc_7d"),
                    F.coalesce("rpc_14d", F.lit(0.0)).alias("rpc_14d"),
                    F.coalesce("rpc_30d", F.lit(0.0)).alias("rpc_30d"),
                    (sunday_week(F.timestamp_millis("click_ts_ms")) % 2 == 0).alias("is_payday_week"),
                    F.coalesce("auction_pressure", F.lit(0.5)).alias("auction_pressure"),
                    "visits_prev_30d", "target_revenue"))


def training_rows_contract(clicks: DataFrame, ledger: DataFrame) -> DataFrame:
    """Training frame over client-supplied features. The ledger is summed per
    click before the join ("we sum on read"), so a click never fans out."""
    rev = ledger.groupBy("click_id").agg(F.sum("revenue").alias("revenue_sum"))
    return (clicks.join(rev, "click_id", "left")
            .select("click_id", F.unix_millis("click_ts").alias("click_ts_ms"), "device", "geo",
                    "hour_of_day", "cerberus_score", "rpc_7d", "rpc_14d", "rpc_30d",
                    "is_payday_week", "auction_pressure", "visits_prev_30d",
                    F.coalesce("revenue_sum", F.lit(0.0)).alias("target_revenue")))


def ledger_by_click(ledger: DataFrame) -> DataFrame:
    """Lifetime ledger per click: signed sum and first revenue time (pre-aggregated
    once, with map-side partial aggregation, before any join)."""
    return ledger.groupBy("click_id").agg(
        F.sum("revenue").alias("realized_rpc"),
        F.min(F.timestamp_millis("ts_ms")).alias("first_revenue_at"))


def predictions_vs_revenue(pred: DataFrame, ledger: DataFrame, window_days: int = 30) -> DataFrame:
    """Every logged prediction with the click's lifetime signed revenue.
    ``window_ends_at_ms`` = ts_ms + window_days (the sum itself is not windowed)."""
    rev = ledger_by_click(ledger)
    p = pred.select("click_id", "correlation_id", "predicted_rpc", "source", "model_version", "ts_ms")
    return (p.join(rev, "click_id", "left")
             .select("click_id", "correlation_id", "predicted_rpc",
                     F.coalesce("realized_rpc", F.lit(0.0)).alias("realized_rpc"),
                     "source", "model_version",
                     (F.col("ts_ms") + int(window_days) * 86_400_000).alias("window_ends_at_ms"),
                     "first_revenue_at"))


def prediction_realized(pred: DataFrame, ledger: DataFrame, as_of=None, window_days: int = 30,
                        strict: bool = False) -> DataFrame:
    """Realised revenue per MODEL prediction within ``window_days`` of its ts_ms.

    ``as_of`` given: only predictions of that UTC day (the daily job); None: every
    day at once (backfill) with ``as_of_date`` as a column. Literal form: the left
    join is grouped by (click, version, rpc), so identical prediction rows add their
    revenue again; ``strict=True`` de-duplicates prediction rows first.
    The join shuffles only click_id plus four narrow columns; the grouping keys
    contain click_id, so the aggregate reuses the join's partitioning.
    """
    p = (pred.where(F.col("source") == "MODEL")
             .select("click_id", "model_version", "predicted_rpc",
                     F.timestamp_millis("ts_ms").alias("predicted_at")))
    p = p.withColumn("as_of_date", F.to_date("predicted_at"))
    if as_of is not None:
        p = p.where(F.col("as_of_date") == F.lit(as_of).cast("date"))
    if strict:
        p = p.dropDuplicates()
    p = p.alias("p")
    r = ledger.groupBy("click_id", "revenue_ts").agg(F.sum("revenue").alias("revenue")).alias("r")
    cond = ((F.col("p.click_id") == F.col("r.click_id"))
            & (F.col("r.revenue_ts") >= F.col("p.predicted_at"))
            & (F.col("r.revenue_ts") <= F.col("p.predicted_at")
               + F.expr(f"INTERVAL {int(window_days)} DAYS")))
    return (p.join(r, cond, "left")
             .groupBy("p.as_of_date", "p.click_id", "p.model_version", "p.predicted_rpc")
             .agg(F.coalesce(F.sum("r.revenue"), F.lit(0.0)).alias("actual_revenue")))

"""Reconciliation of predictions with realised revenue: P9 reconciliation_window,
P10 reconciliation_report, A17 route_mix, S10 read_reconciliation_json."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.functions.columns import round_half_away
from revlens.schemas import RECONCILIATION_ROW

DAY_MS = 86_400_000


def reconciliation_window(pvr: DataFrame, start_ms: int, end_ms: int, now_ms: int,
                          include_pending: bool = False) -> DataFrame:
    """Rows whose window ends in [start_ms, end_ms] (inclusive); completed when
    now >= window end; residual = realized - predicted. Rows with a blank id, a
    negative prediction or a negative window end are rejected; a net-negative
    realised sum (refunds) is kept."""
    if end_ms < start_ms:
        raise ValueError(f"end_ms {end_ms} < start_ms {start_ms}")
    end = F.col("window_ends_at_ms")
    valid = ((F.length(F.coalesce(F.col("click_id"), F.lit(""))) > 0)
             & (F.col("predicted_rpc") >= 0) & (end >= 0))
    out = (pvr.where(end.between(start_ms, end_ms) & valid)
              .select("click_id", "predicted_rpc", "realized_rpc", "source", "window_ends_at_ms",
                      (F.col("realized_rpc") - F.col("predicted_rpc")).alias("residual"),
                      F.when(F.lit(now_ms) >= end, F.lit("completed")).otherwise(F.lit("pending"))
                       .alias("status")))
    return out if include_pending else out.where(F.col("status") == "completed")


def reconciliation_report(pvr: DataFrame, now_ms: int, days: int = 7) -> DataFrame:
    """P10: completed rows of the last ``days`` days, money to 2 decimals."""
    rows = reconciliation_window(pvr, now_ms - days * DAY_MS, now_ms, now_ms)
    return rows.select("click_id", "source", "window_ends_at_ms",
                       round_half_away(F.col("predicted_rpc"), 2).alias("predicted"),
                       round_half_away(F.col("realized_rpc"), 2).alias("realized"),
                       round_half_away(F.col("residual"), 2).alias("residual"))


def route_mix(pred: DataFrame) -> DataFrame:
    """Share of predictions per (source, model_version). The grand total is
    a window over the aggregated rows (sources x versions, a few rows)."""
    g = pred.groupBy("source", "model_version").agg(F.count(F.lit(1)).alias("predictions"))
    return g.withColumn("share", F.col("predictions") / F.sum("predictions").over(Window.partitionBy()))


def read_reconciliation_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array file of reconciliation rows, read with the declared schema."""
    return spark.read.schema(RECONCILIATION_ROW).option("multiLine", True).json(path)

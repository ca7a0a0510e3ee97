"""Incremental refresh after late revenue (Q12): only the days that a late ledger row can
change are read and written again.

A day table is partitioned by a day (or month) column. A ledger row changes a click only if it
lies in the click's window, so it marks the partitions of its click's days; everything
else stays as it is on disk."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.operators.monitoring import write_day
from revlens.session import checkpoint_dir


def dirty_days(stored: DataFrame, late: DataFrame, ts: str, day: str, window_days: int = 30) -> list[dt.date]:
    """Partitions of ``stored`` (click_id, ``ts``, partition column ``day``) that hold a click with
    a row of ``late`` (click_id, revenue_ts) in its window.

    Partitions outside [first late day - window, last late day] are not listed or read. The
    driver gets one value per marked partition."""
    rows = late.select("click_id", "revenue_ts").distinct()
    lo, hi = rows.agg(F.min("revenue_ts"), F.max("revenue_ts")).first()
    if lo is None:
        return []
    # a month's column holds its first day
    first, last = (lo - dt.timedelta(days=window_days + 31)).date(), hi.date()
    near = stored.where(F.col(day).between(F.lit(first), F.lit(last))).select("click_id", ts, day)
    r = rows.select(F.col("click_id").alias("_id"), "revenue_ts")
    inside = ((F.col("click_id") == F.col("_id")) & (F.col("revenue_ts") >= F.col(ts))
              & (F.col("revenue_ts") <= F.col(ts) + F.expr(f"INTERVAL {int(window_days)} DAYS")))
    return sorted(x[0] for x in near.join(r, inside).select(day).distinct().collect())


def refresh(spark: SparkSession, path: str, day: str, days: list[dt.date], recompute: Callable[[DataFrame], DataFrame]) -> None:
    """Replace the partitions ``days`` of the table at ``path`` by ``recompute(their rows)``; the scan
    is pruned to them. The new rows are staged first, so that a run that fails half way leaves the
    old ones, and one that runs again gives the same."""
    if not days:
        return
    old = spark.read.parquet(path).where(F.col(day).isin(days))
    new = f"{checkpoint_dir(spark).rstrip('/')}/refresh-{uuid.uuid4().hex[:12]}"
    recompute(old).write.parquet(new)
    write_day(spark.read.parquet(new).repartition(day), path, day)


def window_ledger(ledger: DataFrame, days: list[dt.date], window_days: int = 30, span_days: int = 31) -> DataFrame:
    """Ledger rows that can lie in a window of a click of ``days`` (partitions of at most ``span_days``)."""
    lo, hi = min(days), max(days) + dt.timedelta(days=window_days + span_days)
    return ledger.where((F.col("revenue_ts") >= F.lit(lo)) & (F.col("revenue_ts") < F.lit(hi)))

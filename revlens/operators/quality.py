"""Data-contract checks: A7 dq_sla, A8 freshness_gaps, A9 feed_lag,
J9 ledger_orphans, C1 table assertions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.schemas import CLICKS

# Contract thresholds (rolling 24 h): fixed values.
SLA_RULES = {
    "cerberus_out_of_range": 0.001,
    "geo_not_alpha2": 0.01,
    "negative_revenue_unexplained": 0.0,
    "missing_required": 0.0,
    "ledger_orphan": 0.01,
}
HOUR_MS = 3_600_000
DAY_MS = 86_400_000


def ledger_orphans(ledger: DataFrame, clicks: DataFrame) -> DataFrame:
    """Ledger rows whose click_id matches no click (sort-merge anti join)."""
    return ledger.join(clicks.select("click_id"), "click_id", "left_anti")


def _hourly(df: DataFrame, ts: str, flags: dict[str, Column]) -> DataFrame:
    hour = F.floor(F.unix_millis(ts) / HOUR_MS).cast("long")
    return (df.groupBy(hour.alias("hour"))
              .agg(F.count(F.lit(1)).alias("rows"),
                   *[F.count_if(c).alias(n) for n, c in flags.items()]))


def dq_sla(clicks: DataFrame, ledger: DataFrame, hours: int = 24) -> DataFrame:
    """The five contract rules as rates over a rolling ``hours`` window, one row
    per (rule, hour with data): hourly counts first (partial aggregation), then a
    RANGE frame over the hourly table, which is bounded by the calendar."""
    required = [f.name for f in CLICKS.fields if not f.nullable]
    click_flags = {
        "cerberus_out_of_range": F.col("cerberus_score").isNull() | F.isnan("cerberus_score")
        | (F.col("cerberus_score") < 0) | (F.col("cerberus_score") > 1),
        "geo_not_alpha2": ~F.coalesce(F.col("geo").rlike("^[A-Z]{2}$"), F.lit(False)),
        "missing_required": reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required]),
    }
    # a refund row is explained when the same (click, order) also has a positive row
    positive = (ledger.where(F.col("revenue") > 0).select("click_id", "order_id")
                      .distinct().withColumn("_has_pos", F.lit(True)))
    led = ledger.join(positive, ["click_id", "order_id"], "left")
    orphan_ids = ledger_orphans(ledger.select("click_id").distinct(), clicks)
    led = led.join(orphan_ids.withColumn("_orphan", F.lit(True)), "click_id", "left")
    ledger_flags = {
        "negative_revenue_unexplained": (F.col("revenue") < 0) & F.col("_has_pos").isNull(),
        "ledger_orphan": F.col("_orphan").isNotNull(),
    }
    parts = []
    for table, df, ts, flags in (("clicks", clicks, "click_ts", click_flags),
                                 ("sales_ledger", led, "revenue_ts", ledger_flags)):
        h = _hourly(df, ts, flags)
        w = Window.orderBy("hour").rangeBetween(-(hours - 1), 0)
        rolled = h.select("hour", F.sum("rows").over(w).alias("rows_24h"),
                          *[F.sum(n).over(w).alias(n) for n in flags])
        for rule in flags:
            parts.append(rolled.select(
                F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
                ((F.col("hour") + 1) * HOUR_MS).alias("window_end_ms"), "rows_24h",
                F.col(rule).alias("bad_24h")))
    out = reduce(DataFrame.unionByName, parts)
    thr = F.create_map(*[x for k, v in SLA_RULES.items() for x in (F.lit(k), F.lit(v))])
    rate = F.col("bad_24h") / F.col("rows_24h")
    return (out.withColumn("rate", rate)
               .withColumn("threshold", thr[F.col("rule")])
               .withColumn("breach", rate > F.col("threshold")))


def freshness_gaps(df: DataFrame, ts: str, minutes: int, from_hour: int = 0,
                   to_hour: int = 24) -> DataFrame:
    """Empty ``minutes`` windows (aligned to the epoch) between the first and the
    last event whose start hour lies in [from_hour, to_hour). The windows that have
    rows look for their successor: within their day, the day's last one in the next
    day with rows. The gap between two is listed day by day, so no row holds the
    windows of a long silence (such as one before or after a stray timestamp)."""
    step_ms = minutes * 60_000
    day_of = lambda w: F.floor(w * step_ms / DAY_MS).cast("long")
    seen = df.where(F.col(ts).isNotNull()).select(F.floor(F.unix_millis(ts) / step_ms).cast("long").alias("w")).distinct()
    seen = seen.withColumn("day", day_of(F.col("w")))
    days = seen.groupBy("day").agg(F.min("w").alias("first"))
    # one row per day with data
    following = days.select("day", F.lead("first").over(Window.orderBy("day")).alias("after"))
    pairs = (seen.withColumn("next", F.lead("w").over(Window.partitionBy("day").orderBy("w")))
                 .join(following, "day").select("w", F.coalesce("next", "after").alias("next"))
                 .where(F.col("next") > F.col("w") + 1)
                 .select((F.col("w") + 1).alias("lo"), (F.col("next") - 1).alias("hi")))
    by_day = pairs.select("lo", "hi", F.explode(F.sequence(day_of(F.col("lo")), day_of(F.col("hi")))).alias("day"))
    first = F.ceil(F.col("day") * DAY_MS / step_ms).cast("long")
    last = (F.ceil((F.col("day") + 1) * DAY_MS / step_ms) - 1).cast("long")
    lo, hi = F.greatest("lo", first), F.least("hi", last)
    gaps = by_day.where(lo <= hi).select(F.explode(F.sequence(lo, hi)).alias("w"))
    start_hour = F.hour(F.timestamp_millis(F.col("w") * step_ms))
    return (gaps.where((start_hour >= from_hour) & (start_hour < to_hour))
                .select((F.col("w") * step_ms).alias("window_start_ms"),
                        ((F.col("w") + 1) * step_ms).alias("window_end_ms")))


def feed_lag(ledger: DataFrame, as_of, max_lag_hours: int = 24) -> DataFrame:
    """Newest revenue_ts against ``as_of``; stale when older than the limit."""
    end = F.lit(as_of).cast("timestamp")
    newest = F.max("revenue_ts")
    return ledger.agg(
        F.unix_millis(newest).alias("max_revenue_ts_ms"),
        (F.unix_millis(end) - F.unix_millis(newest)).alias("lag_ms"),
        (newest < end - F.make_interval(hours=F.lit(max_lag_hours))).alias("stale"))


# ----------------------------------------------------------------- C1
def assert_non_null(df: DataFrame, cols: list[str], name: str | None = None) -> DataFrame:
    """Rows with a NULL in any of ``cols``; empty result = pass."""
    cond = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    return df.where(cond).withColumn("assertion", F.lit(name or f"non_null({','.join(cols)})"))


def assert_unique(df: DataFrame, keys: list[str], name: str | None = None) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"))
              .where(F.col("occurrences") > 1)
              .withColumn("assertion", F.lit(name or f"unique({','.join(keys)})")))


def assert_rows(df: DataFrame, condition: str, name: str | None = None) -> DataFrame:
    """Rows for which ``condition`` (SQL) is not true."""
    return (df.where(~F.coalesce(F.expr(condition), F.lit(False)))
              .withColumn("assertion", F.lit(name or condition)))

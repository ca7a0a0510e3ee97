"""Service metrics and alert conditions over the request / audit logs:
A10 request_metrics, A11 latency_alert, A12 error_rate_alert, A13 availability_slo,
A14 breaker_trips, A15 backlog_alert, A16 model_health.

Every alert first reduces the log to one row per minute (or day) with partial
aggregation; the rolling conditions then run over that calendar-bounded table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.operators import quantiles as qn

# Duration histogram buckets in seconds (the Prometheus exporter defaults): fixed values.
DURATION_BUCKETS_S = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
MINUTE_MS = 60_000
DAY_MS = 86_400_000


def _bucket_name(b: float) -> str:
    return "le_" + (f"{b:g}").replace(".", "_")


def _minute(ts: str) -> Column:
    return F.floor(F.unix_millis(ts) / MINUTE_MS).cast("long")


def request_metrics(log: DataFrame, window: str = "1 minute", ts: str = "ts") -> DataFrame:
    """A10: rate, errors (status >= 500) and the duration histogram (cumulative
    bucket counts, sum) per window x path x method x status. Works on a stream too
    (tumbling ``window``; add a watermark on ``ts`` for append mode)."""
    secs = F.col("latency_ms") / 1000.0
    g = log.groupBy(F.window(ts, window).alias("w"), "path", "method", "status")
    return (g.agg(F.count(F.lit(1)).alias("requests"),
                  F.count_if(F.col("status") >= 500).alias("errors"),
                  F.sum(secs).alias("duration_sum_s"),
                  *[F.count_if(secs <= b).alias(_bucket_name(b)) for b in DURATION_BUCKETS_S])
             .select(F.unix_millis("w.start").alias("window_start_ms"), "path", "method", "status",
                     "requests", "errors", "duration_sum_s", *[_bucket_name(b) for b in DURATION_BUCKETS_S]))


def latency_alert(log: DataFrame, threshold_ms: float, minutes: int = 5, accuracy: int = 10_000,
                  ts: str = "ts", series: str = "path") -> DataFrame:
    """p95 latency per minute and series, averaged over the series; the alert
    holds when the last ``minutes`` consecutive minutes are all above the threshold."""
    per = (log.groupBy(_minute(ts).alias("minute"), series)
              .agg(F.percentile_approx("latency_ms", 0.95, accuracy).alias("p95")))
    m = per.groupBy("minute").agg(F.avg("p95").alias("p95_ms"))
    w = Window.orderBy("minute").rangeBetween(-(minutes - 1), 0)
    return (m.withColumn("_min", F.min("p95_ms").over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
             .select((F.col("minute") * MINUTE_MS).alias("minute_ms"), "p95_ms",
                     ((F.col("_n") == minutes) & (F.col("_min") > threshold_ms)).alias("alert")))


def error_rate_alert(log: DataFrame, threshold: float = 0.01, minutes: int = 5, ts: str = "ts") -> DataFrame:
    """Share of 5xx responses over the last ``minutes`` minutes (a share of
    requests, not a per-second rate) above ``threshold``."""
    m = (log.groupBy(_minute(ts).alias("minute"))
            .agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") >= 500).alias("errors")))
    w = Window.orderBy("minute").rangeBetween(-(minutes - 1), 0)
    r = m.select("minute", F.sum("requests").over(w).alias("requests_5m"),
                 F.sum("errors").over(w).alias("errors_5m"))
    share = F.col("errors_5m") / F.col("requests_5m")
    return r.select((F.col("minute") * MINUTE_MS).alias("minute_ms"), "requests_5m", "errors_5m",
                    share.alias("error_share"), (share > threshold).alias("alert"))


def availability_slo(log: DataFrame, goal: float = 0.995, days: int = 30, ts: str = "ts") -> DataFrame:
    """2xx / all requests over a rolling ``days`` window, per day with traffic."""
    d = (log.groupBy(F.floor(F.unix_millis(ts) / DAY_MS).cast("long").alias("day"))
            .agg(F.count(F.lit(1)).alias("total"),
                 F.count_if((F.col("status") >= 200) & (F.col("status") < 300)).alias("good")))
    w = Window.orderBy("day").rangeBetween(-(days - 1), 0)
    r = d.select("day", F.sum("good").over(w).alias("good_30d"), F.sum("total").over(w).alias("total_30d"))
    av = F.col("good_30d") / F.col("total_30d")
    return r.select((F.col("day") * DAY_MS).alias("day_ms"), "good_30d", "total_30d",
                    av.alias("availability"), (av >= goal).alias("met"))


def breaker_trips(audit: DataFrame, ts_ms: str = "ts_ms", reason: str = "source") -> DataFrame:
    """Breaker trips (audit rows with reason 'anomaly') per minute; every
    minute with a trip raises the alert."""
    t = audit.where(F.col(reason) == "anomaly")
    return (t.groupBy(F.floor(F.col(ts_ms) / MINUTE_MS).cast("long").alias("minute"))
             .agg(F.count(F.lit(1)).alias("trips"))
             .select((F.col("minute") * MINUTE_MS).alias("minute_ms"), "trips",
                     (F.col("trips") > 0).alias("alert")))


def backlog_alert(landed: DataFrame, delivered: DataFrame, limit: int = 10_000, minutes: int = 10,
                  landed_ts: str = "publish_time", delivered_ts: str = "ingested_at") -> DataFrame:
    """Undelivered backlog = messages landed - messages delivered so far; alert when
    it has been above ``limit`` for ``minutes`` minutes. Between minutes with traffic
    the backlog stays as it is.

    Running values are taken within a day and start from the day's carry-in, which
    comes from one row per day."""
    def per(df: DataFrame, ts: str, sign: int) -> DataFrame:
        return df.select(_minute(ts).alias("minute"), F.lit(sign).alias("net"))
    m = (per(landed, landed_ts, 1).unionByName(per(delivered, delivered_ts, -1))
         .groupBy("minute").agg(F.sum("net").alias("net"))
         .withColumn("day", F.floor(F.col("minute") * MINUTE_MS / DAY_MS).cast("long")))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("day").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    carry = m.groupBy("day").agg(F.sum("net").alias("n")).select("day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carry"))
    b = m.join(carry, "day").withColumn("backlog", F.col("carry") + F.sum("net").over(so_far))
    above = F.col("backlog") > limit
    # where a spell above the limit begins
    b = b.withColumn("begin", F.when(above & (F.col("backlog") - F.col("net") <= limit), F.col("minute")))
    spells = (b.groupBy("day").agg(F.max("begin").alias("x"))
               .select("day", F.max("x").over(before).alias("since_before")))
    b = b.join(spells, "day").withColumn("since", F.coalesce(F.max("begin").over(so_far), F.col("since_before")))
    return b.select((F.col("minute") * MINUTE_MS).alias("minute_ms"), "backlog",
                    (above & F.coalesce(F.col("minute") - F.col("since") >= minutes - 1, F.lit(False))).alias("alert"))


def latency_by_version(sketches: DataFrame, by: str = "model_version") -> DataFrame:
    """p95 latency of each version from stored (hour, version) sketches."""
    return qn.sketch_quantiles(qn.merge_sketches(sketches, [by]), [0.95]).select(by, F.col("q")[0].alias("p95_ms"))


def model_health(psi: DataFrame, residuals: DataFrame, registry: DataFrame, latency: DataFrame | None = None,
                 mae_factor: float = 5.0, min_major: int = 2, latency_factor: float = 2.0) -> DataFrame:
    """Rollback triggers per model version against the version registered before it
    (``registry``: model_version, trained_at_ms): MAE >= 5x the previous version's,
    ``major_shift`` on >= 2 features on some day, or p95 latency (``latency``:
    model_version, p95_ms) >= 2x the previous version's. Versions that are not in the
    registry have no previous one. All inputs are reduced to a row per version and
    stacked, then grouped."""
    mae = (residuals.groupBy("model_version")
                    .agg((F.sum(F.col("mae") * F.col("scored_clicks")) / F.sum("scored_clicks")).alias("mae")))
    major = (psi.where(F.col("verdict") == "major_shift")
                .groupBy("model_version", "as_of_date").agg(F.countDistinct("feature").alias("n"))
                .groupBy("model_version").agg(F.max("n").alias("major_features")))
    parts = [mae, major, registry.select("model_version", "trained_at_ms")]
    if latency is not None:
        parts.append(latency.select("model_version", "p95_ms"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    if latency is None:
        rows = rows.withColumn("p95_ms", F.lit(None).cast("double"))
    v = rows.groupBy("model_version").agg(F.max("mae").alias("mae"), F.coalesce(F.max("major_features"), F.lit(0)).cast("long").alias("major_features"),
                                          F.max("trained_at_ms").alias("trained_at_ms"), F.max("p95_ms").alias("p95_ms"))
    w = Window.partitionBy(F.col("trained_at_ms").isNull()).orderBy("trained_at_ms", "model_version")
    known = F.col("trained_at_ms").isNotNull()
    v = (v.withColumn("prev_mae", F.when(known, F.lag("mae").over(w)))
          .withColumn("prev_p95_ms", F.when(known, F.lag("p95_ms").over(w))))
    t_mae = F.coalesce(F.col("mae") >= mae_factor * F.col("prev_mae"), F.lit(False))
    t_psi = F.col("major_features") >= min_major
    t_lat = F.coalesce(F.col("p95_ms") >= latency_factor * F.col("prev_p95_ms"), F.lit(False))
    return v.select("model_version", "mae", "prev_mae", "major_features", "p95_ms", "prev_p95_ms",
                    t_mae.alias("mae_trigger"), t_psi.alias("drift_trigger"), t_lat.alias("latency_trigger"),
                    (t_mae | t_psi | t_lat).alias("rollback"))

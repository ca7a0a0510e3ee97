"""Safety guardrails on tables: A5 prediction_percentiles, A6 propose_bounds,
W3 anomaly_window. (Row rules F2-F4 are column functions in
``revlens.functions.columns``.)"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.operators import quantiles as qn

# Calibration policy defaults: fixed values.
FLOOR_MIN = 0.01
SAFETY_MULTIPLIER = 1.5
MIN_SAMPLE_SIZE = 10_000
MIN_CHANGE_RATIO = 0.10
LOOKBACK_HOURS = 168
PERCENTILES = [0.01, 0.99]

# Anomaly window defaults: zero-rate threshold, window length, minimum samples.
ANOMALY_THRESHOLD = 0.03
ANOMALY_WINDOW_MS = 300_000
ANOMALY_MIN_SAMPLES = 50


def model_source_filter(pred: DataFrame, since=None, until=None, ts: str = "predicted_at") -> DataFrame:
    """MODEL-source predictions, optionally published in [since, until). Plain
    predicates on scan columns, so they reach the parquet reader (PushedFilters)."""
    out = pred.where(F.col("source") == "MODEL")
    if since is not None:
        out = out.where(F.col(ts) >= F.lit(since).cast("timestamp"))
    if until is not None:
        out = out.where(F.col(ts) < F.lit(until).cast("timestamp"))
    return out


def prediction_percentiles(pred: DataFrame, as_of=None, hours: int = LOOKBACK_HOURS,
                           accuracy: int = 10_000, by=(), exact: bool = False) -> DataFrame:
    """A5: p1, p99 and n of MODEL predictions published in the ``hours`` before
    ``as_of`` (``as_of=None``: all of them), optionally per segment columns ``by``.
    ``percentile_approx`` is a mergeable sketch (partial aggregation per task); with
    ``exact`` the percentiles are exact ranks. An empty input yields 0.0 / 0.0 / 0."""
    if as_of is None:
        p = model_source_filter(pred)
    else:
        end = F.lit(as_of).cast("timestamp")
        p = model_source_filter(pred).where((F.col("predicted_at") >= end - F.make_interval(hours=F.lit(hours)))
                                            & (F.col("predicted_at") < end))
    if exact:
        agg = qn.exact_quantiles(p, "predicted_rpc", PERCENTILES, by)
        if not by:      # one row also for no prediction
            agg = agg.agg(F.max("q").alias("q"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    else:
        pct = F.percentile_approx("predicted_rpc", PERCENTILES, accuracy)
        agg = p.groupBy(*by).agg(pct.alias("q"), F.count("predicted_rpc").alias("n"))
    return _named(agg, by)


def _named(agg: DataFrame, by) -> DataFrame:
    return agg.select(*by, F.coalesce(F.col("q")[0], F.lit(0.0)).alias("p1"),
                      F.coalesce(F.col("q")[1], F.lit(0.0)).alias("p99"), "n")


def prediction_sketches(pred: DataFrame, by=("model_version",), k: int = qn.SKETCH_K) -> DataFrame:
    """A5, stored form: one KLL sketch of the MODEL predictions an hour and group."""
    p = model_source_filter(pred).withColumn("_ms", F.unix_millis("predicted_at"))
    return qn.hourly_sketches(p, "predicted_rpc", "_ms", by, k)


def stored_percentiles(sketches: DataFrame, hours: int = LOOKBACK_HOURS, by=("model_version",), k: int = qn.SKETCH_K) -> DataFrame:
    """A5 of every day from stored sketches: p1, p99 and n of the ``hours`` before the day
    (``as_of_day``: epoch day). No prediction is read again; ranks are off by at most
    ``quantiles.RANK_ERROR`` * n, and not at all up to ``k`` predictions."""
    merged = qn.trailing_sketches(sketches, hours, by, k)
    return _named(qn.sketch_quantiles(merged, PERCENTILES), ["day", *by]).withColumnRenamed("day", "as_of_day")


def propose_bounds(pct: DataFrame, current_min: float, current_max: float,
                   floor_min: float = FLOOR_MIN, mult: float = SAFETY_MULTIPLIER,
                   min_n: int = MIN_SAMPLE_SIZE, min_change: float = MIN_CHANGE_RATIO) -> DataFrame:
    """New bounds min = max(p1, floor), max = p99 * mult, each rounded to 4
    decimals; no proposal when n < min_n, max <= min, or both relative changes are
    below ``min_change``. Samples with negative or inverted percentiles are
    rejected (status ``invalid_sample``)."""
    p1, p99, n = F.col("p1"), F.col("p99"), F.col("n")
    new_min = F.greatest(p1, F.lit(floor_min))
    new_max = p99 * mult
    min_delta = F.abs(new_min - current_min) / max(current_min, 1e-9)
    max_delta = F.abs(new_max - current_max) / max(current_max, 1e-9)
    status = (F.when((p1 < 0) | (p99 < 0) | (p1 > p99) | (n < 0), F.lit("invalid_sample"))
               .when(n < min_n, F.lit("too_few_samples"))
               .when(new_max <= new_min, F.lit("inverted"))
               .when((min_delta < min_change) & (max_delta < min_change), F.lit("no_change"))
               .otherwise(F.lit("proposed")))
    proposed = status == "proposed"
    reason = F.format_string("n=%d, p1=%.4f, p99=%.4f", n, F.bround(p1, 4), F.bround(p99, 4))
    keep = [c for c in pct.columns if c not in ("p1", "p99", "n")]
    return pct.select(*keep, "p1", "p99", "n", status.alias("status"),
                      F.when(proposed, F.bround(new_min, 4)).alias("min_rpc"),
                      F.when(proposed, F.bround(new_max, 4)).alias("max_rpc"),
                      F.when(proposed, reason).alias("reason"))


def anomaly_window_range(samples: DataFrame, key: str = "shard", ts: str = "ts_ms",
                         value: str = "rpc", window_ms: int = ANOMALY_WINDOW_MS,
                         threshold: float = ANOMALY_THRESHOLD,
                         min_samples: int = ANOMALY_MIN_SAMPLES) -> DataFrame:
    """Reference form: one RANGE window per key (a hot key is one task)."""
    w = Window.partitionBy(key).orderBy(ts).rangeBetween(-window_ms, 0)
    out = (samples.withColumn("n", F.count(F.lit(1)).over(w))
                  .withColumn("zeros", F.count_if(F.col(value) == 0).over(w)))
    return out.withColumn("breached", (F.col("n") >= min_samples)
                          & (F.col("zeros") / F.col("n") > threshold))


def anomaly_window(samples: DataFrame, key: str = "shard", ts: str = "ts_ms", value: str = "rpc",
                   window_ms: int = ANOMALY_WINDOW_MS, threshold: float = ANOMALY_THRESHOLD,
                   min_samples: int = ANOMALY_MIN_SAMPLES, block_ms: int | None = None) -> DataFrame:
    """For every sample, the samples of its key in [ts - window_ms, ts] (the
    sample itself and same-millisecond peers included), the zero count, and the
    breach flag n >= min_samples and zeros / n > threshold. No feedback (see T3).

    Scale form: counts per (key, ms) first. A count enters the window at its own time and
    leaves it window_ms later, so the window's content is the sum of all entries up to ts
    less the exits before ts. Time is cut into blocks; the running sums are taken inside
    (key, block) and start from the block's carry-in, which comes from one row per
    block with data. Each count is added twice, whatever the window's length, and a hot
    key is split by time into bounded partitions.
    """
    block = int(block_ms or 3_600_000)
    per_ms = samples.groupBy(key, ts).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col(value) == 0).alias("z"))
    enter = per_ms.select(key, ts, "c", "z", F.lit(True).alias("own"))
    # an exit at ts + window_ms + 1 is out of every window that ends there or later
    leave = per_ms.select(key, (F.col(ts) + window_ms + 1).alias(ts), (-F.col("c")).alias("c"), (-F.col("z")).alias("z"), F.lit(False).alias("own"))
    events = (enter.unionByName(leave).groupBy(key, ts).agg(F.sum("c").alias("c"), F.sum("z").alias("z"), F.bool_or("own").alias("own"))
              .withColumn("blk", F.floor(F.col(ts) / block).cast("long")))
    before = Window.partitionBy(key).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = (events.groupBy(key, "blk").agg(F.sum("c").alias("c"), F.sum("z").alias("z"))
             .select(key, "blk", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), F.coalesce(F.sum("z").over(before), F.lit(0)).alias("z0")))
    so_far = Window.partitionBy(key, "blk").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    counted = (events.withColumn("n", F.sum("c").over(so_far)).withColumn("zeros", F.sum("z").over(so_far)).where("own")
               .join(carry, [key, "blk"])
               .select(key, ts, (F.col("n") + F.col("c0")).alias("n"), (F.col("zeros") + F.col("z0")).alias("zeros")))
    out = samples.join(counted, [key, ts], "left")
    return out.withColumn("breached", (F.col("n") >= min_samples)
                          & (F.col("zeros") / F.col("n") > threshold))

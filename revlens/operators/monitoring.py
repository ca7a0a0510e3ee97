"""Model monitoring: P4 unpivot_features, W2 feature_deciles, A1 feature_baseline,
J6 psi_bin_join, A2 psi_daily (+ psi_daily_binned), A3 drift_verdict,
A4 residuals_daily, S7 write_day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.columns import round_half_away
from revlens.schemas import MONITORED_FEATURES
from revlens.session import checkpoint_dir

# PSI verdict thresholds of the daily SQL table (strict >): fixed values.
PSI_MAJOR = 0.25
PSI_MODERATE = 0.10
# Verdict thresholds of the drift domain rule (healthy < 0.1 <= warn < 0.25 <= breach).
DRIFT_WARN = 0.1
DRIFT_BREACH = 0.25
DRIFT_LEVELS = ["healthy", "warn", "breach"]


def unpivot_features(df: DataFrame, ids=("click_id",), features=MONITORED_FEATURES) -> DataFrame:
    """Wide feature columns -> (ids..., feature, value DOUBLE)."""
    wide = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features])
    return wide.unpivot(list(ids), list(features), "feature", "value")


# ------------------------------------------------------------------ W2 deciles
def feature_deciles_window(long_df: DataFrame, bins: int = 10) -> DataFrame:
    """Reference form: NTILE over the whole feature (one task per feature)."""
    w = Window.partitionBy("feature").orderBy(F.col("value").asc_nulls_first())
    return long_df.withColumn("decile", F.ntile(bins).over(w))


def _bucket_of(p: Column, q: Column, r: Column) -> Column:
    """NTILE bucket (1-based) of 1-based position p for q = N div b, r = N mod b:
    the first r buckets hold q+1 rows, the rest q."""
    big = r * (q + 1)
    return F.when(p <= big, F.floor((p - 1) / (q + 1)) + 1).otherwise(
        r + F.floor((p - big - 1) / q) + 1).cast("long")


def _bucket_start(k: Column, q: Column, r: Column) -> Column:
    return F.when(k <= r, (k - 1) * (q + 1) + 1).otherwise(r * (q + 1) + (k - 1 - r) * q + 1)


def decile_counts(long_df: DataFrame, bins: int = 10, partitions: int | None = None) -> DataFrame:
    """W2 at scale: (feature, decile, value, count) rows such that grouping them by
    (feature, decile) gives exactly the MIN/MAX/COUNT of NTILE(bins) ordered by value.

    1. count rows per (feature, value): a hot value collapses map-side;
    2. range-partition the counts by (feature, value) and checkpoint them to the
       shared checkpoint folder, which pins the partition contents;
    3. per-(partition, feature) totals - at most partitions x features rows - give
       each partition's offset (broadcast, size bounded by that product);
    4. a running sum inside (partition, feature) gives each value's position range
       [start, end]; the NTILE rule maps it to deciles, and a value spanning a
       boundary is split with the exact overlap count.
    """
    spark = long_df.sparkSession
    checkpoint_dir(spark)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    vc = long_df.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    ranged = (vc.repartitionByRange(parts, F.col("feature"), F.col("value").asc_nulls_first())
                .checkpoint(eager=True)
                .withColumn("pid", F.spark_partition_id()))
    totals = ranged.groupBy("pid", "feature").agg(F.sum("n").alias("pn"))
    w_feat = Window.partitionBy("feature").orderBy("pid")
    offsets = (totals
               .withColumn("offset", F.coalesce(
                   F.sum("pn").over(w_feat.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .withColumn("total", F.sum("pn").over(Window.partitionBy("feature")))
               .drop("pn"))
    w_local = (Window.partitionBy("pid", "feature").orderBy(F.col("value").asc_nulls_first())
               .rowsBetween(Window.unboundedPreceding, -1))
    pos = (ranged.withColumn("before", F.coalesce(F.sum("n").over(w_local), F.lit(0)))
                 .join(F.broadcast(offsets), ["pid", "feature"])
                 .withColumn("start", F.col("offset") + F.col("before") + 1)
                 .withColumn("end", F.col("start") + F.col("n") - 1)
                 .withColumn("q", F.floor(F.col("total") / bins).cast("long"))
                 .withColumn("r", (F.col("total") % bins).cast("long")))
    q, r = F.col("q"), F.col("r")
    exploded = pos.withColumn(
        "decile", F.explode(F.sequence(_bucket_of(F.col("start"), q, r), _bucket_of(F.col("end"), q, r))))
    d = F.col("decile")
    b_start = _bucket_start(d, q, r)
    b_end = _bucket_start(d + 1, q, r) - 1
    overlap = F.least(F.col("end"), b_end) - F.greatest(F.col("start"), b_start) + 1
    return exploded.select("feature", "decile", "value", overlap.alias("n"))


def feature_baseline(frame: DataFrame, model_version: str = "unknown", bins: int = 10,
                     features=MONITORED_FEATURES, exact_window: bool = False) -> DataFrame:
    """A1: per feature and decile the MIN, MAX and COUNT of the training values,
    tagged with ``model_version``."""
    long_df = unpivot_features(frame, ids=(), features=features)
    if exact_window:
        ranked = feature_deciles_window(long_df, bins).withColumn("n", F.lit(1))
    else:
        ranked = decile_counts(long_df, bins)
    return (ranked.groupBy("feature", "decile")
                  .agg(F.min("value").alias("lower"), F.max("value").alias("upper"),
                       F.sum("n").alias("training_count"))
                  .select(F.lit(model_version).alias("model_version"), "feature", "decile",
                          "lower", "upper", "training_count"))


# ------------------------------------------------------------------ PSI
def live_feature_counts(clicks: DataFrame, as_of=None, features=MONITORED_FEATURES) -> DataFrame:
    """Live values per UTC day, reduced to (as_of_date, feature, value, n) before
    any join: many features have a small discrete domain."""
    c = clicks.withColumn("as_of_date", F.to_date("click_ts"))
    if as_of is not None:
        c = c.where(F.col("as_of_date") == F.lit(as_of).cast("date"))
    return (unpivot_features(c, ids=("as_of_date",), features=features)
            .groupBy("as_of_date", "feature", "value").agg(F.count(F.lit(1)).alias("n")))


def psi_bin_join(live_counts: DataFrame, baseline: DataFrame) -> DataFrame:
    """Live value -> baseline decile with lower <= value <= upper (both closed,
    as the daily table does: a value on a shared edge counts in every matching
    decile; values in gaps or outside the range match nothing). The baseline has
    features x bins rows per model version; see :func:`_band_join`."""
    b = baseline.select("model_version", "feature", "decile", "lower", "upper", "training_count")
    return (_band_join(live_counts, b, (F.col("value") >= F.col("lower")) & (F.col("value") <= F.col("upper")))
            .select("as_of_date", "model_version", "feature", "decile", "n", "training_count"))


# Bands are broadcast up to this many rows; more are joined on (feature, salt).
BROADCAST_BANDS = 100_000
BAND_SALTS = 64


def _band_join(live: DataFrame, bands: DataFrame, within: Column) -> DataFrame:
    """live(feature, value, ...) with the bands of the same feature that hold the value.
    The size of the bands (features x bins x model versions) is checked: few are
    broadcast; more are repeated per salt, so that a feature's live values spread over
    BAND_SALTS tasks instead of one."""
    if bands.limit(BROADCAST_BANDS + 1).count() <= BROADCAST_BANDS:
        return live.join(F.broadcast(bands), "feature").where(within)
    salted = bands.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(BAND_SALTS - 1))))
    spread = live.withColumn("_salt", F.pmod(F.xxhash64("as_of_date", "value"), F.lit(BAND_SALTS)).cast("int"))
    return spread.join(salted, ["feature", "_salt"]).where(within).drop("_salt")


def _psi_terms(live_count: Column, live_total: Column, train_count: Column, train_total: Column,
               bins: int) -> Column:
    p_live = (live_count + 1) / (live_total + bins)
    p_base = (train_count + 1) / (train_total + bins)
    ratio = p_live / p_base
    return (p_live - p_base) * F.when(ratio > 0, F.log(ratio))


def _verdict(raw: Column) -> Column:
    return (F.when(raw > PSI_MAJOR, F.lit("major_shift"))
             .when(raw > PSI_MODERATE, F.lit("moderate_shift")).otherwise(F.lit("stable")))


def psi_daily(clicks: DataFrame, baseline: DataFrame, as_of=None, bins: int = 10) -> DataFrame:
    """A2 (literal): PSI per (as_of_date, model_version, feature) over the bins the
    band join matched, Laplace-smoothed (+1 / +bins), rounded to 4 decimals; the
    verdict uses the unrounded sum. ``as_of=None`` recomputes every day."""
    binned = (psi_bin_join(live_feature_counts(clicks, as_of), baseline)
              .groupBy("as_of_date", "model_version", "feature", "decile")
              .agg(F.sum("n").alias("live_count"), F.any_value("training_count").alias("training_count")))
    w = Window.partitionBy("as_of_date", "model_version", "feature")
    terms = (binned.withColumn("live_total", F.sum("live_count").over(w))
                   .withColumn("train_total", F.sum("training_count").over(w))
                   .withColumn("term", _psi_terms(F.col("live_count"), F.col("live_total"),
                                                  F.col("training_count"), F.col("train_total"), bins)))
    return (terms.groupBy("as_of_date", "model_version", "feature")
                 .agg(F.sum("term").alias("raw"))
                 .select("as_of_date", "model_version", "feature",
                         round_half_away(F.col("raw"), 4).alias("psi"), _verdict(F.col("raw")).alias("verdict")))


def psi_daily_binned(clicks: DataFrame, baseline: DataFrame, as_of=None, bins: int = 10) -> DataFrame:
    """A2 (corrected): half-open bins [lower_k, lower_k+1) with open outer ends, so
    each live value lands in exactly one bin, and all ``bins`` bins are kept (empty
    ones get the smoothing they were meant to have). Counts are pivoted into one
    column per bin, so no cross product with the calendar is needed."""
    b = baseline.select("model_version", "feature", "decile", "lower", "training_count")
    w = Window.partitionBy("model_version", "feature").orderBy("decile")
    edges = (b.withColumn("lo", F.when(F.col("decile") == 1, F.lit(float("-inf"))).otherwise(F.col("lower")))
              .withColumn("hi", F.coalesce(F.lead("lower").over(w), F.lit(float("inf"))))
              .withColumn("hi", F.when(F.col("decile") == bins, F.lit(float("inf"))).otherwise(F.col("hi"))))
    live = live_feature_counts(clicks, as_of)
    decs = list(range(1, bins + 1))
    live_piv = (_band_join(live, edges.select("model_version", "feature", "decile", "lo", "hi"),
                           (F.col("value") >= F.col("lo")) & (F.col("value") < F.col("hi")))
                    .groupBy("as_of_date", "model_version", "feature")
                    .pivot("decile", decs).agg(F.sum("n")))
    base_piv = (b.groupBy("model_version", "feature").pivot("decile", decs)
                 .agg(F.first("training_count")))
    base_piv = base_piv.select("model_version", "feature", *[F.col(str(d)).alias(f"t{d}") for d in decs])
    j = live_piv.join(base_piv, ["model_version", "feature"])
    lc = [F.coalesce(F.col(str(d)), F.lit(0)) for d in decs]
    tc = [F.coalesce(F.col(f"t{d}"), F.lit(0)) for d in decs]
    lt, tt = sum(lc[1:], lc[0]), sum(tc[1:], tc[0])
    raw = sum((_psi_terms(lc[i], lt, tc[i], tt, bins) for i in range(1, bins)),
              _psi_terms(lc[0], lt, tc[0], tt, bins))
    return j.select("as_of_date", "model_version", "feature", round_half_away(raw, 4).alias("psi"),
                    _verdict(raw).alias("verdict"))


def drift_verdict(psi: DataFrame) -> DataFrame:
    """A3: per feature healthy < 0.1 <= warn < 0.25 <= breach; the overall verdict
    of a (day, model version) is the worst feature verdict."""
    level = (F.when(F.col("psi") < DRIFT_WARN, 0).when(F.col("psi") < DRIFT_BREACH, 1).otherwise(2))
    names = F.array(*[F.lit(x) for x in DRIFT_LEVELS])
    w = Window.partitionBy("as_of_date", "model_version")
    return (psi.withColumn("lvl", level)
               .withColumn("worst", F.max("lvl").over(w))
               .select("as_of_date", "model_version", "feature", "psi",
                       F.element_at(names, F.col("lvl") + 1).alias("feature_verdict"),
                       F.element_at(names, F.col("worst") + 1).alias("overall_verdict")))


def residuals_daily(realized: DataFrame) -> DataFrame:
    """A4: per (as_of_date, model_version) counts and mean errors of the MODEL
    predictions against realised revenue (output of J5)."""
    p, a = F.col("predicted_rpc"), F.col("actual_revenue")
    return (realized.groupBy("as_of_date", "model_version")
            .agg(F.count(F.lit(1)).alias("scored_clicks"),
                 F.count_if(a > 0).alias("converted_clicks"),
                 F.avg(p).alias("mean_predicted"),
                 F.avg(a).alias("mean_actual"),
                 F.avg(p - a).alias("mean_signed_residual"),
                 F.avg(F.abs(p - a)).alias("mae"),
                 F.avg(F.try_divide(F.abs(p - a), a)).alias("mape_converters")))


def write_day(df: DataFrame, path: str, day_col: str = "as_of_date") -> None:
    """Idempotent re-run of whole days: only the day partitions present in
    ``df`` are replaced (dynamic partition overwrite)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(day_col).parquet(path))


def backfill_days(df: DataFrame, path: str, start, end, day_col: str = "as_of_date") -> None:
    """Recompute every open day in [start, end] at once (``as_of=None`` outputs) and
    replace exactly those day partitions; late data for older days is picked up
    by widening the range instead of only re-running yesterday."""
    days = df.where(F.col(day_col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    write_day(days, path, day_col)

"""Quantiles in two forms: exact ranks (A5, A6) and stored sketches that merge.

A q-quantile of n values is the one of rank ceil(q n), at least 1, in ascending order."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.session import checkpoint_dir

# KLL parameter: up to SKETCH_K values a sketch is exact; beyond, ranks are off by at most
# RANK_ERROR * n with 99 % confidence (the published error of the algorithm at this k).
SKETCH_K = 8192
RANK_ERROR = 2.296 / SKETCH_K ** 0.9723
HOUR_MS = 3_600_000
DAY_MS = 86_400_000


def rank_of(q: float, n: Column) -> Column:
    """ceil(q n) in decimals, so that 0.07 * 100 is 7 and not 8."""
    return F.greatest(F.ceil(F.lit(Decimal(str(q))) * n.cast("decimal(20,0)")).cast("long"), F.lit(1).cast("long"))


def value_ranks(df: DataFrame, value: str, by=(), partitions: int | None = None) -> DataFrame:
    """(by..., value, start, end, total): the ranks that each distinct non-null value covers.

    Counts per value collapse hot values before any shuffle; the counts are range-partitioned
    and pinned in the shared checkpoint folder, a running sum inside a partition and the
    totals of the partitions before it give the ranks. No task holds a whole group."""
    spark, by = df.sparkSession, list(by)
    checkpoint_dir(spark)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranged = counts.repartitionByRange(parts, *by, value).checkpoint(eager=True).withColumn("_p", F.spark_partition_id())
    # at most partitions x groups rows, in truth partitions + groups (the ranges are sorted by group)
    totals = ranged.groupBy(*by, "_p").agg(F.sum("_n").alias("_t"))
    groups = Window.partitionBy(*by)
    before = groups.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_p", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"), F.sum("_t").over(groups).alias("total"))
    inside = Window.partitionBy(*by, "_p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("_o") + F.sum("_n").over(inside)
    # null-safe on the groups: a null group is a group
    o = offsets.select(F.col("_p").alias("_p2"), "_o", "total", *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)])
    same = F.col("_p") == F.col("_p2")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return ranged.join(o, same).select(*by, value, "_n", end.alias("end"), "total").select(*by, value, (F.col("end") - F.col("_n") + 1).alias("start"), "end", "total")


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by=(), partitions: int | None = None) -> DataFrame:
    """(by..., q array in the order of ``probs``, n), exact. Groups without a non-null value are absent."""
    ranks = value_ranks(df, value, by, partitions)

    def at(p: float) -> Column:
        return rank_of(p, F.col("total")).between(F.col("start"), F.col("end"))
    hit = at(probs[0])
    for p in probs[1:]:
        hit = hit | at(p)
    # at most len(probs) rows a group are left
    return (ranks.where(hit).groupBy(*by)
            .agg(F.array(*[F.max(F.when(at(p), F.col(value))) for p in probs]).alias("q"), F.max("total").alias("n")))


# ------------------------------------------------------------------ sketches
def quantile_sketches(df: DataFrame, value: str, by, k: int = SKETCH_K) -> DataFrame:
    """(by..., n, sketch): a KLL sketch of the non-null values of each group, to be stored.
    Partial sketches merge map-side; a sketch holds O(k) values whatever the group's size."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull()).groupBy(*by).agg(F.count(v).alias("n"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))


def hourly_sketches(df: DataFrame, value: str, ts_ms: str, by=(), k: int = SKETCH_K) -> DataFrame:
    """(hour, by..., n, sketch): one stored sketch an hour and group; hour = epoch hours."""
    return quantile_sketches(df.withColumn("hour", F.floor(F.col(ts_ms) / HOUR_MS).cast("long")), value, ["hour", *by], k)


def merge_sketches(sketches: DataFrame, by=(), k: int = SKETCH_K) -> DataFrame:
    """Sketches of disjoint parts merged per group."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, probs: list[float]) -> DataFrame:
    """The sketches' quantiles as the array ``q``."""
    q = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(p)) for p in probs]))
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], q.alias("q"))


def trailing_sketches(sketches: DataFrame, hours: int, by=(), k: int = SKETCH_K) -> DataFrame:
    """(day, by..., n, sketch) for every day (epoch day, as of 00:00 UTC) with a sketch in the
    ``hours`` before it. Whole days are merged once and sent to the days that see them; where
    the window begins inside a day, that day's later hours are merged for it alone."""
    per_day = 24
    whole, rest = divmod(hours, per_day)
    day = F.floor(F.col("hour") / per_day).cast("long")
    days = merge_sketches(sketches.withColumn("on", day), ["on", *by], k)
    seen = days.withColumn("day", F.explode(F.sequence(F.col("on") + 1, F.col("on") + whole))).drop("on") if whole else None
    if rest:
        late = sketches.where(F.col("hour") - day * per_day >= per_day - rest).withColumn("day", day + whole + 1).select("day", *by, "n", "sketch")
        seen = late if seen is None else seen.select("day", *by, "n", "sketch").unionByName(late)
    return merge_sketches(seen, ["day", *by], k)

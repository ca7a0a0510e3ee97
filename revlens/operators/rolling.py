"""W1 rolling_rpc: mean target revenue of earlier clicks of the same
(ad_creative_id, geo) bucket in the last n days, n in (7, 14, 30).

Frame per click at second t: clicks with t - n*86400 <= s <= t - 1 (RANGE frame on
unix seconds). One row per click (the intended meaning; the self-joined original
fanned out per bucket).

Scale form (default). A bucket may hold a third of all clicks, so no window is
partitioned by bucket alone over raw rows. With D = day(t) and sod = second of day:

    frame = head   : day D,       seconds of day <  sod
          + middle : days D-n+1 .. D-1 (whole days)
          + tail   : day D-n,     seconds of day >= sod

All three are computed on per-second (sum, count) aggregates:
  * head  - running sum inside (bucket, day) partitions: at most 86 400 rows each;
  * middle- RANGE frame over the per-(bucket, day) totals: one row per calendar day;
  * tail  - suffix sum inside (bucket, day) partitions (a running sum from the day's end),
            probed by rows shifted by n days.
Every partition is bounded by the calendar (seconds per day, days per bucket), not by
the data volume, and sums/counts are exact, so the mean equals the plain RANGE window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = ["ad_creative_id", "geo"]
DAY_S = 86_400


def rolling_rpc_window(click_rev: DataFrame, days=(7, 14, 30)) -> DataFrame:
    """Reference form: the plain RANGE window (one task per bucket). Used by tests."""
    out = click_rev.select("click_id", "click_ts", *BUCKET, "target_revenue",
                           F.unix_seconds("click_ts").alias("sec"))
    for n in days:
        w = Window.partitionBy(*BUCKET).orderBy("sec").rangeBetween(-n * DAY_S, -1)
        out = out.withColumn(f"rpc_{n}d", F.avg("target_revenue").over(w))
    return out.select("click_id", "click_ts", *[f"rpc_{n}d" for n in days])


def rolling_rpc(click_rev: DataFrame, days=(7, 14, 30), point_in_time: bool = False,
                ledger: DataFrame | None = None, with_counts: bool = False) -> DataFrame:
    if point_in_time:
        if ledger is None:
            raise ValueError("point_in_time needs the ledger")
        return rolling_rpc_point_in_time(click_rev, ledger, days)
    base = click_rev.select("click_id", "click_ts", *BUCKET, "target_revenue",
                            F.unix_seconds("click_ts").alias("sec"))
    # 1. per-second partial sums (map-side combined): a hot second collapses here
    per_sec = (base.groupBy(*BUCKET, "sec")
                   .agg(F.sum("target_revenue").alias("s"), F.count(F.lit(1)).alias("c"))
                   .withColumn("day", F.floor(F.col("sec") / DAY_S).cast("long"))
                   .withColumn("sod", F.col("sec") - F.col("day") * DAY_S))

    # 2. head: same day, earlier seconds
    w_head = (Window.partitionBy(*BUCKET, "day").orderBy("sod")
              .rowsBetween(Window.unboundedPreceding, -1))
    head = (per_sec.withColumn("head_s", F.coalesce(F.sum("s").over(w_head), F.lit(0.0)))
                   .withColumn("head_c", F.coalesce(F.sum("c").over(w_head), F.lit(0))))

    # 3. middle: whole days strictly between, from the per-day totals
    per_day = per_sec.groupBy(*BUCKET, "day").agg(F.sum("s").alias("ds"), F.sum("c").alias("dc"))
    mid = per_day
    for n in days:
        if n > 1:
            w_mid = Window.partitionBy(*BUCKET).orderBy("day").rangeBetween(-(n - 1), -1)
            mid = (mid.withColumn(f"mid_s_{n}", F.coalesce(F.sum("ds").over(w_mid), F.lit(0.0)))
                      .withColumn(f"mid_c_{n}", F.coalesce(F.sum("dc").over(w_mid), F.lit(0))))
        else:
            mid = mid.withColumn(f"mid_s_{n}", F.lit(0.0)).withColumn(f"mid_c_{n}", F.lit(0))
    mid = mid.drop("ds", "dc")

    # 4. tail: suffix of day D-n from second-of-day sod on; probes carry (day, n)
    probes = (per_sec.select(*BUCKET, "day", "sod")
              .withColumn("n", F.explode(F.array(*[F.lit(n) for n in days])))
              .select(*BUCKET, (F.col("day") - F.col("n")).alias("pday"), "sod",
                      F.col("day").alias("qday"), "n",
                      F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("c")))
    data = per_sec.select(*BUCKET, F.col("day").alias("pday"), "sod",
                          F.lit(None).cast("long").alias("qday"),
                          F.lit(None).cast("int").alias("n"), "s", "c")
    # from the day's end backwards: a frame that grows is one running sum, one that shrinks
    # towards the end of its partition is added up anew for every row
    w_tail = (Window.partitionBy(*BUCKET, "pday").orderBy(F.col("sod").desc())
              .rangeBetween(Window.unboundedPreceding, 0))
    tail = (data.unionByName(probes)
                .withColumn("tail_s", F.sum("s").over(w_tail))
                .withColumn("tail_c", F.sum("c").over(w_tail))
                .where(F.col("n").isNotNull())
                .groupBy(*BUCKET, F.col("qday").alias("day"), "sod")
                .agg(*[F.sum(F.when(F.col("n") == n, F.col("tail_s")).otherwise(0.0)).alias(f"tail_s_{n}")
                       for n in days],
                     *[F.sum(F.when(F.col("n") == n, F.col("tail_c")).otherwise(0)).alias(f"tail_c_{n}")
                       for n in days]))

    # 5. assemble per distinct second, then join back to the clicks
    parts = (head.join(mid, [*BUCKET, "day"], "left")
                 .join(tail, [*BUCKET, "day", "sod"], "left"))
    cols = []
    for n in days:
        s_tot = F.col("head_s") + F.col(f"mid_s_{n}") + F.coalesce(F.col(f"tail_s_{n}"), F.lit(0.0))
        c_tot = F.col("head_c") + F.col(f"mid_c_{n}") + F.coalesce(F.col(f"tail_c_{n}"), F.lit(0))
        cols.append(F.when(c_tot > 0, s_tot / c_tot).alias(f"rpc_{n}d"))
        if with_counts:
            cols.append(c_tot.alias(f"c_{n}"))
    per_sec_out = parts.select(*BUCKET, "sec", *cols)
    if with_counts:
        return per_sec_out
    return (base.select("click_id", "click_ts", *BUCKET, "sec")
                .join(per_sec_out, [*BUCKET, "sec"], "left")
                .select("click_id", "click_ts", *[f"rpc_{n}d" for n in days]))


def _prefix_at(events: DataFrame, probes: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of event ``amount`` with ``sec <= probe sec`` per ``keys``, evaluated at
    every probe (keys, sec). Two levels so that no partition grows with the data:
    totals of whole earlier days (one row per day) plus a running sum inside the
    probe's (keys, day) partition (at most one row per second plus probes)."""
    ev = events.withColumn("day", F.floor(F.col("sec") / DAY_S).cast("long"))
    pr = probes.withColumn("day", F.floor(F.col("sec") / DAY_S).cast("long"))
    day_tot = ev.groupBy(*keys, "day").agg(F.sum("amount").alias("amount"))
    w_days = (Window.partitionBy(*keys).orderBy("day")
              .rangeBetween(Window.unboundedPreceding, -1))
    before = (day_tot.withColumn("probe", F.lit(False))
              .unionByName(pr.select(*keys, "day").distinct()
                             .withColumn("amount", F.lit(0.0)).withColumn("probe", F.lit(True)))
              .withColumn("days_before", F.coalesce(F.sum("amount").over(w_days), F.lit(0.0)))
              .where("probe").select(*keys, "day", "days_before"))
    w_day = (Window.partitionBy(*keys, "day").orderBy("sec")
             .rangeBetween(Window.unboundedPreceding, 0))
    within = (ev.select(*keys, "day", "sec", "amount", F.lit(False).alias("probe"))
              .unionByName(pr.select(*keys, "day", "sec", F.lit(0.0).alias("amount"),
                                     F.lit(True).alias("probe")))
              .withColumn("in_day", F.sum("amount").over(w_day))
              .where("probe").select(*keys, "day", "sec", "in_day"))
    return (within.join(before, [*keys, "day"])
                  .select(*keys, "sec", (F.col("days_before") + F.col("in_day")).alias("value")))


def rolling_rpc_point_in_time(click_rev: DataFrame, ledger: DataFrame, days=(7, 14, 30),
                              window_days: int = 30) -> DataFrame:
    """W1 with ``point_in_time``: like :func:`rolling_rpc`, but an earlier click's
    revenue counts only where it was booked before the observing click
    (revenue_ts < click_ts), which removes the label leak of the complete target.

    A ledger row r of an earlier click e (within e's conversion window) adds its
    revenue to every observer of the bucket with click second in
    [max(t_e, r_ts) + 1, t_e + n days]: a range update, evaluated as +/- events and
    a prefix sum per bucket at the observers' seconds. The denominator (earlier
    clicks in the frame) is the one of the default form."""
    counts = rolling_counts(click_rev, days)
    c = click_rev.select("click_id", *BUCKET, F.unix_seconds("click_ts").alias("t_e"),
                         F.col("click_ts").alias("cts"))
    r = ledger.select(F.col("click_id").alias("rid"), "revenue", "revenue_ts")
    pairs = (c.join(r, (c.click_id == r.rid) & (r.revenue_ts >= c.cts)
                    & (r.revenue_ts <= c.cts + F.expr(f"INTERVAL {int(window_days)} DAYS")))
              .select(*BUCKET, "t_e", "revenue",
                      (F.floor(F.unix_micros("revenue_ts") / 1_000_000) + 1).cast("long").alias("r_next")))
    # both events of every frame from one pass over the pairs
    lo = F.greatest(F.col("t_e") + 1, F.col("r_next"))
    terms = []
    for n in days:
        hi = F.col("t_e") + n * DAY_S
        for sec, amount in ((lo, F.col("revenue")), (hi + 1, -F.col("revenue"))):
            terms.append(F.when(lo <= hi, F.struct(F.lit(n).alias("n"), sec.alias("sec"), amount.alias("amount"))))
    events = (pairs.select(*BUCKET, F.explode(F.array_compact(F.array(*terms))).alias("e")).select(*BUCKET, "e.*")
              .groupBy(*BUCKET, "n", "sec").agg(F.sum("amount").alias("amount")))
    secs = click_rev.select(*BUCKET, F.unix_seconds("click_ts").alias("sec")).distinct()
    probes = secs.withColumn("n", F.explode(F.array(*[F.lit(n) for n in days])))
    sums = _prefix_at(events, probes, [*BUCKET, "n"])
    piv = sums.groupBy(*BUCKET, "sec").pivot("n", list(days)).agg(F.first("value"))
    out = counts.join(piv, [*BUCKET, "sec"], "left")
    cols = [F.when(F.col(f"c_{n}") > 0, F.coalesce(F.col(str(n)), F.lit(0.0)) / F.col(f"c_{n}"))
            .alias(f"rpc_{n}d") for n in days]
    return (click_rev.select("click_id", "click_ts", *BUCKET, F.unix_seconds("click_ts").alias("sec"))
                     .join(out.select(*BUCKET, "sec", *cols), [*BUCKET, "sec"], "left")
                     .select("click_id", "click_ts", *[f"rpc_{n}d" for n in days]))


def rolling_counts(click_rev: DataFrame, days=(7, 14, 30)) -> DataFrame:
    """Number of earlier clicks of the bucket in each frame, per (bucket, second):
    the split form of :func:`rolling_rpc` with a count of 1 per click."""
    ones = click_rev.select("click_id", "click_ts", *BUCKET, F.lit(1.0).alias("target_revenue"))
    r = rolling_rpc(ones, days, with_counts=True)
    return r.select(*BUCKET, "sec", *[f"c_{n}" for n in days]).distinct()

"""Streams (availableNow) against their batch bodies and a sequential loop."""

import pandas as pd
from pyspark.sql import functions as F

from revlens.operators import guardrails as gr
from revlens.sources import fixtures as fx
from revlens.streaming import jobs as sj


def test_breaker_stream_equals_loop(spark, sf):
    win = 3 * 86_400_000
    s = fx.samples(spark, sf).withColumn("rpc", F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.col("rpc")))
    src = sj.stage(s, "samples", files=1)
    out = sj.scratch(spark, "t3")
    sj.run(sj.breaker_stream(spark, src, s.schema, out, sj.scratch(spark, "ck"), window_ms=win, min_samples=5))
    got = spark.read.parquet(out).toPandas().sort_values("event_id").reset_index(drop=True)
    exp = []
    for shard, g in s.toPandas().groupby("shard"):
        st = sj.BreakerState(win, gr.ANOMALY_THRESHOLD, 5, sj.BREAKER_COOL_OFF_MS)
        exp.append(sj.breaker_replay(g, shard, st))
    exp = pd.concat(exp).sort_values("event_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[exp.columns], exp, check_dtype=False)
    assert got["reason"].eq("anomaly").any()


def test_breaker_state_carries_across_batches(spark, sf):
    s = fx.samples(spark, sf)
    src = sj.stage(s, "samples", files=4)
    out = sj.scratch(spark, "t3m")
    sj.run(sj.breaker_stream(spark, src, s.schema, out, sj.scratch(spark, "ck"), max_files=1))
    assert spark.read.parquet(out).count() == s.count()


def test_breaker_stream_in_small_batches(spark, sf):
    """Micro-batches of one file each, read in Arrow batches of 50 rows, equal the loop over
    the files; the states lie next to the checkpoint."""
    s = fx.samples(spark, sf).withColumn("rpc", F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.col("rpc"))).cache()
    cuts = [r.ts_ms for r in s.selectExpr("percentile_approx(ts_ms, array(0.3, 0.6, 1.0)) AS q").selectExpr("explode(q) AS ts_ms").collect()]
    src, ck, out = sj.scratch(spark, "samples"), sj.scratch(spark, "ck"), sj.scratch(spark, "t3s")
    for lo, hi in zip([-1, *cuts], cuts):
        s.where((F.col("ts_ms") > lo) & (F.col("ts_ms") <= hi)).coalesce(1).write.mode("append").parquet(src)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        sj.run(sj.breaker_stream(spark, src, s.schema, out, ck, window_ms=3 * 86_400_000, min_samples=5, max_files=1))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    got = spark.read.parquet(out).toPandas().sort_values("event_id").reset_index(drop=True)
    exp = pd.concat([sj.breaker_replay(g, shard, sj.BreakerState(3 * 86_400_000, gr.ANOMALY_THRESHOLD, 5, sj.BREAKER_COOL_OFF_MS))
                     for shard, g in s.toPandas().groupby("shard")]).sort_values("event_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[exp.columns], exp, check_dtype=False)
    kept = spark.read.parquet(f"{ck}/_breaker_state").where("batch = 2")
    assert kept.count() == s.select("shard").distinct().count() and got["batch"].nunique() == 3


def test_land_stream_partitions(spark, sf):
    src = sj.stage(fx.landing_clicks(spark, sf), "landing", files=2)
    out = sj.scratch(spark, "raw")
    sj.run(sj.land_stream(spark, src, out, sj.scratch(spark, "ck"), "clicks"))
    r = spark.read.parquet(out)
    assert r.count() == fx.landing_clicks(spark, sf).count()
    assert "publish_date" in r.columns


def test_breaker_events_stream_engages_kill_switch_once(spark, sf):
    m = fx.anomaly_messages(spark, sf)
    src = sj.stage(m, "anomalies", files=2)
    config = sj.stage(fx.config_versions(spark, sf).where("NOT kill"), "config", files=1)
    newest = spark.read.parquet(config).agg(F.max("version")).first()[0]
    out = sj.scratch(spark, "decisions")
    sj.run(sj.breaker_events_stream(spark, src, m.schema, out, config, sj.scratch(spark, "ck")))
    cfg = spark.read.parquet(config)
    assert spark.read.parquet(out).where("trip").count() > 0
    added = cfg.where(F.col("version") > newest).collect()
    assert len(added) == 1 and added[0].kill and added[0].version == newest + 1
    # a second run over new events: the newest version is already killed, nothing appended
    src2 = sj.stage(m, "anomalies2", files=1)
    sj.run(sj.breaker_events_stream(spark, src2, m.schema, sj.scratch(spark, "d2"), config,
                                    sj.scratch(spark, "ck")))
    assert spark.read.parquet(config).count() == cfg.count()


def test_clicks_stream_last_write_wins(spark, sf):
    from revlens.operators import ingest as ing
    from revlens.plans import catalog as C
    src = sj.stage(fx.landing_clicks(spark, sf), "landing", files=2)
    out, dead = sj.scratch(spark, "clicks"), sj.scratch(spark, "dead")
    sj.run(sj.clicks_stream(spark, src, out, dead, sj.scratch(spark, "ck"), keep="last"))
    got = sj.latest_clicks(spark, out).select("click_id", "message_id", "visits_prev_30d")
    typed = ing.normalize_clicks(C.stored_typed_landing(spark, sf)).where(~F.col("corrupt"))
    valid = typed.where(ing.rejection_reason().isNull())
    exp = ing.dedup_clicks(valid).select("click_id", "message_id", "visits_prev_30d")
    assert got.count() == exp.count() and got.exceptAll(exp).count() == 0
    # re-emits won: their message ids end with '-r'
    assert got.where(F.col("message_id").endswith("-r")).count() > 0
    assert spark.read.parquet(dead).where("reason = 'corrupt_payload'").count() > 0


def test_activation_stream_dead_letter_and_channels(spark, sf):
    src = sj.stage(fx.push_bodies(spark, sf), "push", files=2)
    out, dead = sj.scratch(spark, "act"), sj.scratch(spark, "act-dead")
    sj.run(sj.activation_stream(spark, src, out, dead, sj.scratch(spark, "ck"), "hybrid"))
    routed = spark.read.parquet(out)
    assert {r.channel for r in routed.select("channel").distinct().collect()} == {"oci", "ssgtm"}
    reasons = {r.reason for r in spark.read.parquet(dead).select("reason").distinct().collect()}
    assert reasons == {"missing click_id", "malformed_json"}
    n_ok = routed.where("channel = 'oci'").count()
    assert n_ok + spark.read.parquet(dead).count() == fx.push_bodies(spark, sf).count()


def test_corrected_re_emits_are_kept_in_both_modes(spark, sf):
    """An invalid first emit (another file, an earlier batch) does not remove the corrected one."""
    landed = fx.landing_clicks(spark, sf)
    first, again = landed.where(~F.col("message_id").endswith("-r")), landed.where(F.col("message_id").endswith("-r"))
    key = F.regexp_extract("message_id", r"(\d+)", 1).cast("long")
    fixed = {f"c-{r.k}" for r in again.select(key.alias("k")).where("k % 211 = 0 AND k % 499 <> 0").collect()}
    assert fixed
    for keep in ("first", "last"):
        src, out, dead = sj.scratch(spark, "landing"), sj.scratch(spark, "clicks"), sj.scratch(spark, "dead")
        first.coalesce(1).write.mode("append").parquet(src)
        again.coalesce(1).write.mode("append").parquet(src)
        sj.run(sj.clicks_stream(spark, src, out, dead, sj.scratch(spark, "ck"), keep=keep, max_files=1))
        got = sj.latest_clicks(spark, out) if keep == "last" else spark.read.parquet(out)
        assert fixed <= {r.click_id for r in got.select("click_id").collect()}
        assert got.count() == got.select("click_id").distinct().count()


def test_freshness_out_of_order_files(spark, sf):
    """Files that overlap in time: no false gap, and every gap the watermark has passed."""
    from revlens.operators import quality as qual
    from revlens.plans import catalog as C
    src, schema = C.event_files(spark, sf, days=3)
    out = sj.scratch(spark, "gaps")
    sj.run(sj.freshness_stream(spark, src, schema, "ts", out, sj.scratch(spark, "ck"), lateness="7 days", max_files=1))
    got = {r.window_start_ms for r in spark.read.parquet(out).collect()}
    ev = spark.read.parquet(src)
    want = {r.window_start_ms for r in qual.freshness_gaps(ev, "ts", 15, 6, 22).collect()}
    newest = ev.agg(F.unix_millis(F.max("ts"))).first()[0]
    assert got <= want and got and {w for w in want if w < newest - 8 * 86_400_000} <= got


def test_replayed_batch_replaces_its_rows(spark, sf):
    """The same batch id written twice leaves one copy (a sink that failed half way runs again)."""
    out = sj.scratch(spark, "sink")
    df = spark.range(10)
    for _ in range(2):
        sj._write(df, out, 3)
    sj._write(df, out, 4)
    assert spark.read.parquet(out).count() == 20


def test_staged_files_grow_in_number(spark):
    """A landing zone of a larger table has more files, so no task reads a fixed share of it; a
    replay still takes its batches, and rows are those of the table."""
    from pyspark.sql import functions as F
    wide = spark.range(200_000).withColumn("v", F.sha2(F.col("id").cast("string"), 512))
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(name, "1m")
    try:
        src = sj.stage(wide, "wide", files=4)
    finally:
        spark.conf.unset(name)
    files = sj._files(spark, src)
    assert files > 8 and spark.read.parquet(src).exceptAll(wide).count() == 0 and spark.read.parquet(src).count() == 200_000
    assert sj.files_a_batch(spark, src, 4) == -(-files // 4)
    small = sj.stage(spark.range(10), "narrow", files=4)
    assert sj._files(spark, small) == 4 and sj.files_a_batch(spark, small, 4) == 1 and spark.read.parquet(small).count() == 10
    rows = spark.range(1000).withColumn("s", F.col("id") % 3)
    assert sj.slot_files(rows, F.col("s")) == sj.SLOT_FILES


def test_slot_files_follow_the_largest_slot(spark, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(sj, "SLOT_FILE_ROWS", 100)
    rows = spark.range(1000).withColumn("s", (F.col("id") >= 450).cast("long"))
    files = sj.slot_files(rows, F.col("s"))
    assert files == 6
    src = sj.stage_slots(rows, F.col("s"), "slots", files)
    assert sj._files(spark, src) == 12 and spark.read.parquet(src).count() == 1000

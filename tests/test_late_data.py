"""Quantile sketches, as-of configs, the publish gate, late revenue, upserts, silences, alerts."""

import datetime as dt
import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.operators import asof, gate
from revlens.operators import attribution as att
from revlens.operators import guardrails as gr
from revlens.operators import monitoring as mon
from revlens.operators import quantiles as qn
from revlens.operators import refresh as rf
from revlens.operators import scoring as sc
from revlens.plans import catalog as C
from revlens.sources import fixtures as fx
from revlens.streaming import jobs as sj


# ------------------------------------------------------------------ quantiles
@pytest.mark.parametrize("parts", [1, 7])
def test_exact_quantiles(spark, parts):
    r = random.Random(3)
    rows = [(r.choice("abc"), float(r.choice([r.randrange(5), r.random()]))) for _ in range(3000)] + [(None, 2.0)] * 700 + [("d", None), ("e", -1.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.01, 0.07, 0.5, 0.99, 1.0, 0.0]
    got = {x.g: (list(x.q), x.n) for x in qn.exact_quantiles(df, "v", probs, ["g"], parts).collect()}
    want = {}
    for g in {x[0] for x in rows}:
        v = sorted(x for k, x in rows if k == g and x is not None)
        if v:
            want[g] = ([v[max(1, -(-round(p * 100) * len(v) // 100)) - 1] for p in probs], len(v))
    assert got == want
    assert qn.exact_quantiles(df.limit(0), "v", probs, ["g"]).count() == 0


def test_exact_percentiles_of_nothing(spark):
    empty = spark.createDataFrame([], "predicted_rpc double, source string, model_version string, predicted_at timestamp")
    assert gr.prediction_percentiles(empty, exact=True).first()[:] == (0.0, 0.0, 0)


def test_sketches_merge_within_the_rank_error(spark):
    """Stored hourly sketches merged over a week and per version; ranks off by at most RANK_ERROR."""
    n, k = 200_000, 256
    df = (spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(14 * 24)) * qn.HOUR_MS).alias("ms"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("v"),
                                F.pow(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100_000)) / 1000.0, 2).alias("x")).cache())
    sketches = qn.hourly_sketches(df, "x", "ms", ["v"], k)
    error = 2.296 / k ** 0.9723
    probs = [0.01, 0.5, 0.95, 0.99]

    def check(values, q):
        values = np.sort(values)
        for p, x in zip(probs, q):
            lo, hi = np.searchsorted(values, x, "left") / len(values), np.searchsorted(values, x, "right") / len(values)
            assert lo - error <= p <= hi + error
    pdf = df.toPandas()
    for r in qn.sketch_quantiles(qn.merge_sketches(sketches, ["v"], k), probs).collect():
        check(pdf[pdf.v == r.v].x.to_numpy(), r.q)
        assert r.n == (pdf.v == r.v).sum()
    for hours in (168, 36):
        rows = qn.sketch_quantiles(qn.trailing_sketches(sketches, hours, ["v"], k), probs).where("day IN (5, 9, 15)").collect()
        assert len(rows) >= 4
        for r in rows:
            hour = pdf.ms // qn.HOUR_MS
            part = pdf[(pdf.v == r.v) & (hour < r.day * 24) & (hour >= r.day * 24 - hours)]
            assert r.n == len(part)
            check(part.x.to_numpy(), r.q)


def test_small_sketches_are_exact(spark):
    df = spark.createDataFrame([(0, float(i)) for i in range(1, 101)], "ms long, x double")
    assert list(qn.sketch_quantiles(qn.hourly_sketches(df, "x", "ms"), [0.01, 0.5, 0.95, 1.0]).first().q) == [1.0, 50.0, 95.0, 100.0]


# ------------------------------------------------------------------ anomaly window
@pytest.mark.parametrize("window_ms, block_ms", [(50, 1000), (5000, 70), (10 ** 7, 300), (0, 100)])
def test_anomaly_window_any_length(spark, window_ms, block_ms):
    """Windows shorter and much longer than a block, ties, idle blocks, a hot key."""
    r = random.Random(window_ms)
    rows = [(i, r.choice([1, 1, 1, 2]), r.choice([r.randrange(20_000), 500, 9000]) - 5000, r.choice([0.0, 1.0, 2.0])) for i in range(800)]
    df = spark.createDataFrame(rows, "event_id long, shard long, ts_ms long, rpc double")
    a, b = (f(df, window_ms=window_ms, threshold=0.3, min_samples=4, **kw) for f, kw in ((gr.anomaly_window, {"block_ms": block_ms}), (gr.anomaly_window_range, {})))
    assert sorted(tuple(x) for x in a.select(*b.columns).collect()) == sorted(tuple(x) for x in b.collect())


# ------------------------------------------------------------------ as-of configs
@pytest.mark.parametrize("per_task, block", [(1_000_000, 1000), (3, 50), (1, 10 ** 9)])
def test_as_of_equals_sql(spark, per_task, block):
    r = random.Random(5)
    calls = [(i, r.choice([r.randrange(-500, 3000), 700, None])) for i in range(300)] + [(5000, 700), (5000, 700)]
    versions = [(v, r.choice([r.randrange(-300, 2500), 700])) for v in range(40)] + [(99, None)]
    left, right = spark.createDataFrame(calls, "id long, ms long"), spark.createDataFrame(versions, "version long, at long")
    got = sorted((tuple(x) for x in asof.as_of(left, right, "ms", "at", ["version"], "version", block, per_task).collect()), key=repr)
    want = [(i, m, max(((a, v) for v, a in versions if a is not None and m is not None and a <= m), default=(0, None))[1]) for i, m in calls]
    assert got == sorted(want, key=repr)
    assert asof.as_of(left, right.limit(0), "ms", "at", ["version"], "version").where("version IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        asof.as_of(left.withColumn("version", F.lit(1)), right, "ms", "at", ["version"], "version")


def test_back_scoring_meets_the_config_of_the_time(spark, sf):
    rows = C.QUERIES["F1_score_clicks_at"](spark, sf).groupBy("reason").count().collect()
    assert {"kill_switch", "out_of_canary", "score.model", "bounds_rejected"} <= {r.reason for r in rows}


# ------------------------------------------------------------------ gate
def test_gate_publishes_or_keeps_the_target(spark, tmp_path):
    path = str(tmp_path / "t")
    good = spark.createDataFrame([(1, 0.5), (2, 0.7)], "id long, x double")
    with pytest.raises(ValueError):
        gate.read_published(spark, path)
    assert gate.publish(good, path, {"x": "x >= 0"}, {"id": ["id"]}) == gate.Publication(True, 2)
    bad = spark.createDataFrame([(1, -1.0), (2, None), (2, 3.0), (None, 1.0), (None, 2.0), (4, 1.0)], "id long, x double")
    result = gate.publish(bad, path, {"x": "x >= 0", "id": "id IS NOT NULL"}, {"unique": ["id"]})
    assert not result.published and result.rows == 6 and result.failed == {"x": 2, "id": 2, "unique": 4}
    assert sorted(tuple(r) for r in gate.read_published(spark, path).collect()) == [(1, 0.5), (2, 0.7)]
    held = spark.read.parquet(f"{path}/_quarantine")
    assert held.where("array_contains(failed, 'x')").count() == 2 and held.where("array_contains(failed, 'unique')").count() == 4
    assert gate.publish(good.limit(0), path, {"x": "x >= 0"}).published and gate.read_published(spark, path).count() == 0


def test_gate_reads_its_input_once(spark, tmp_path):
    from pyspark.accumulators import AccumulatorParam  # noqa: F401
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    df = spark.range(100).selectExpr("id", "CAST(id % 10 AS DOUBLE) AS x").mapInArrow(count, "id long, x double")
    gate.publish(df, str(tmp_path / "a"), {"x": "x < 10"}, {"u": ["id"]})
    gate.publish(df, str(tmp_path / "a"), {"x": "x < 9"}, {"u": ["x"]})
    assert seen.value == 200


# ------------------------------------------------------------------ late revenue
def test_refresh_touches_marked_partitions_only(spark, sf, tmp_path):
    import os
    ledger = fx.ledger(spark, sf)
    cut = F.lit("1997-02-10").cast("timestamp")
    end = F.lit("1997-05-20").cast("timestamp")
    late = ledger.where((F.col("revenue_ts") >= cut) & (F.col("revenue_ts") < end))
    known = ledger.where(~((F.col("revenue_ts") >= cut) & (F.col("revenue_ts") < end)))
    path = str(tmp_path / "cr")
    month = F.trunc("click_ts", "month")
    full = lambda led: att.click_revenue(fx.clicks(spark, sf), led).withColumn("month", month)
    mon.write_day(full(known).repartition("month"), path, "month")
    before = {p: {f: os.stat(f"{path}/{p}/{f}").st_mtime_ns for f in os.listdir(f"{path}/{p}")} for p in os.listdir(path) if p.startswith("month=")}
    days = rf.dirty_days(spark.read.parquet(path), late, "click_ts", "month")
    want = {r.month for r in full(ledger).join(full(known).select("click_id", F.col("target_revenue").alias("old")), "click_id").where("target_revenue <> old").select("month").distinct().collect()}
    assert want <= set(days) and set(days) <= {dt.date(1997, m, 1) for m in range(1, 6)} and days
    rf.refresh(spark, path, "month", days, lambda old: att.click_revenue(old, rf.window_ledger(ledger, days)).withColumn("month", month))
    got = spark.read.parquet(path)
    exp = full(ledger).select(*got.columns)
    assert got.count() == exp.count() and got.exceptAll(exp).count() == 0
    after = {p: {f: os.stat(f"{path}/{p}/{f}").st_mtime_ns for f in os.listdir(f"{path}/{p}")} for p in os.listdir(path) if p.startswith("month=")}
    changed = {p for p in before if before[p] != after[p]}
    assert changed == {f"month={d}" for d in days}
    assert rf.dirty_days(spark.read.parquet(path), late.limit(0), "click_ts", "month") == []
    rf.refresh(spark, path, "month", [], lambda old: old)


# ------------------------------------------------------------------ upserts
def test_upsert_table(spark):
    schema = spark.createDataFrame([], "k string, v long, at long").schema
    t = sj.UpsertTable(spark, sj.scratch(spark, "upsert"), schema, "k", ["at"], buckets=8)
    assert t.read().count() == 0

    def rows():
        return {r.k: r.v for r in t.read().collect()}
    make = lambda data: spark.createDataFrame(data, schema)
    t.merge(make([(f"k{i}", i, 1) for i in range(50)]), 0)
    assert rows() == {f"k{i}": i for i in range(50)} and t.read().count() == 50
    first = t.folders()
    touched = t.merge(make([("k3", 100, 2), ("k3", 90, 1), ("new", 7, 1), ("k4", -1, 0)]), 1)
    want = {**{f"k{i}": i for i in range(50)}, "k3": 100, "new": 7}
    assert rows() == want and len(touched) <= 3
    assert all(t.folders()[b] == first[b] for b in first if b not in touched)       # the others are as they were
    t.merge(make([("k3", 100, 2), ("k3", 90, 1), ("new", 7, 1), ("k4", -1, 0)]), 1)   # the batch runs again
    assert rows() == want
    for b in range(2, 6):
        t.merge(make([("k3", 100 + b, 2 + b)]), b)
    assert rows() == {**want, "k3": 105} and max(len(v) for v in t.folders().values()) <= 2
    assert t.merge(make([]), 9) == []


def test_clicks_upsert_replay(spark, sf):
    """The stream run twice over the same files and table leaves the same table."""
    src = sj.stage(fx.landing_clicks(spark, sf), "landing", files=3)
    from revlens.operators import ingest as ing
    schema = ing.normalize_clicks(C.typed_landing(spark, sf)).drop("corrupt").schema
    table = sj.UpsertTable(spark, sj.scratch(spark, "clicks"), schema, "click_id", ["ingested_at", "message_id"], buckets=4)
    results = []
    for _ in range(2):
        sj.run(sj.clicks_upsert_stream(spark, src, table, sj.scratch(spark, "dead"), sj.scratch(spark, "ck"), max_files=1))
        results.append(sorted(tuple(r) for r in table.read().select("click_id", "message_id").collect()))
    assert results[0] == results[1] and len(results[0]) == len({k for k, _ in results[0]})


# ------------------------------------------------------------------ breaker state
def test_breaker_state_folders_do_not_pile_up(spark):
    ck = sj.scratch(spark, "ck")
    state = f"{ck}/_breaker_state"
    for b in range(12):
        sj._state_before(spark, state, b)
        sj._write(spark.createDataFrame([(1, [b], [1], [0], None)], "shard long, ms array<long>, cnt array<long>, zer array<long>, opened_at long"), state, b)
        assert len(sj._batches(spark, state)) <= 3
    assert sj._state_before(spark, state, 12).first().ms == [11] and sj._state_before(spark, state, 11).first().ms == [10]


# ------------------------------------------------------------------ silences
def test_silence_is_reported_while_it_lasts(spark):
    """Two feeds stop, no file comes any more: windows are reported by the clock, one feed speaks
    again and is quiet no longer."""
    schema = "feed string, ts timestamp"
    src, out = sj.scratch(spark, "feed"), sj.scratch(spark, "silence")

    def send(feeds):
        spark.createDataFrame([(f, dt.datetime.now(dt.timezone.utc)) for f in feeds], schema).coalesce(1).write.mode("append").parquet(src)

    def reported():
        try:
            return [(r.feed, r.window_start_ms) for r in spark.read.schema(sj.SILENCE_OUT).parquet(out).collect()]
        except Exception:  # noqa: BLE001  (nothing written yet)
            return []
    send(["a", "a", "b"])
    begun = int(time.time() * 1000)
    q = sj.silence_stream(spark, src, spark.createDataFrame([], schema).schema, "ts", out, sj.scratch(spark, "ck"), feed=F.col("feed"),
                          window_ms=2000, grace_ms=500, from_hour=0, to_hour=24, interval="500 milliseconds")
    try:
        end = time.time() + 90
        while time.time() < end and {f for f, _ in reported()} != {"a", "b"}:
            time.sleep(1)
        first = reported()
        assert {f for f, _ in first} == {"a", "b"}
        count = len(first)
        while time.time() < end and len(reported()) < count + 4:
            time.sleep(1)
        assert len(reported()) >= count + 4                 # the silence lasts, and so do the reports
        send(["a"])
        spoken = int(time.time() * 1000)
        while time.time() < end and max(w for f, w in reported() if f == "b") < spoken + 6000:
            time.sleep(1)
    finally:
        q.stop()
    rows = reported()
    assert len(rows) == len(set(rows)) and all(w % 2000 == 0 and w >= begun - 4000 for _, w in rows)
    by = {f: sorted(w for g, w in rows if g == f) for f in "ab"}
    assert by["b"] == list(range(by["b"][0], by["b"][-1] + 1, 2000))        # no window of b is missed or repeated
    assert by["b"][-1] >= spoken


# ------------------------------------------------------------------ alerts
def test_alert_streams_equal_batch(spark, sf):
    """A busy log in one file a batch, with silences: every alert table equals its batch form."""
    from revlens.operators import ops_metrics as om
    r = random.Random(8)
    base = dt.datetime(2024, 3, 1)
    minutes = sorted(r.sample(range(0, 3 * 1440), 150)) + list(range(5000, 5040))
    rows = [(i, base + dt.timedelta(minutes=m, seconds=r.randrange(60), microseconds=r.randrange(10 ** 6)), r.choice(["/a", "/b"]), r.choice([200, 200, 200, 404, 500]), r.random() * 900)
            for i, m in enumerate(x for x in minutes for _ in range(r.randrange(1, 6)))]
    log = spark.createDataFrame(rows, "request_id long, ts timestamp, path string, status long, latency_ms double")
    src = C.time_ordered_files(spark, log)
    batch = {"latency": om.latency_alert(log, 300.0), "error_rate": om.error_rate_alert(log, 0.2), "availability": om.availability_slo(log, 0.6, 3)}
    options = {"latency": {"threshold_ms": 300.0}, "error_rate": {"threshold": 0.2}, "availability": {"goal": 0.6, "days": 3}}
    for kind, want in batch.items():
        out = sj.scratch(spark, "alerts")
        sj.run(sj.alert_stream(spark, src, log.schema, out, sj.scratch(spark, "ck"), kind, max_files=sj.SLOT_FILES, **options[kind]))
        got = spark.read.parquet(out).select(*want.columns)
        a, b = (sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in d.collect()) for d in (got, want))
        assert a == b and a, kind
        flag = want.columns[-1]
        assert {x[flag] for x in want.collect()} == {True, False}, kind


# ------------------------------------------------------------------ scoring reads its calls once
def test_model_runs_once_per_call(spark, sf):
    plan = sc.score_clicks(C.scoring_clicks(spark, sf), fx.config_versions(spark, sf), C.keyed_ledger(spark, sf), C.ml.STAND_IN, **C.sides(spark, sf))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "calls-" not in text and text.count("auction_pressure") <= 6      # the staged calls are read, the features are not


def test_keyed_tables_move_no_row(spark, sf):
    clicks = fx.clicks(spark, sf).select("click_id")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for df in (sc.ledger_fallback(clicks, C.keyed_ledger(spark, sf)),
                   clicks.join(C.keyed_store(spark, sf), "click_id", "left"), clicks.join(C.keyed_clv(spark, sf), "click_id", "left")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            side = plan[plan.rindex("FileScan parquet spark_catalog"):]
            assert "Bucketed: true" in side
            # the only exchanges are on the clicks' side
            assert plan.count("Exchange") == C.fx.clicks(spark, sf).select("click_id")._jdf.queryExecution().executedPlan().toString().count("Exchange") + 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_duckdb_is_the_twin_of_as_of():
    """The twin's ASOF JOIN takes the newest row at or before the call."""
    rows = duckdb.sql("SELECT c, v FROM (VALUES (5), (7), (1)) l(c) ASOF LEFT JOIN (VALUES (5, 'a'), (6, 'b')) r(t, v) ON c >= t").fetchall()
    assert sorted(rows) == [(1, None), (5, "a"), (7, "b")]

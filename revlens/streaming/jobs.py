"""Structured Streaming jobs: S5 land_stream, T1 clicks_stream, T2 freshness_stream,
T3 breaker_stream, T4 breaker_events_stream, T5 score_stream, T6 activation_stream,
T7 metrics_stream.

Each job takes a file source directory (the landing zone) and output / checkpoint
directories in shared storage, and returns the started ``StreamingQuery``. The
bodies are the batch operators; ``trigger`` defaults to ``availableNow`` (process
what is there, then stop) and can be a processing-time trigger in production.

``foreachBatch`` sinks write each micro-batch into its own folder (``batch=<id>``)
with overwrite, so a batch that is run again replaces its rows; readers see the id
as the column ``batch``. A batch with two sinks is persisted for them.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from revlens.operators import activation as act
from revlens.operators import ingest as ing
from revlens.operators.breaker import BREAKER_COOL_OFF_MS, STATE, BreakerPolicy, BreakerState, replay
from revlens.operators import ops_metrics as om
from revlens.operators import scoring as sc
from revlens.operators.guardrails import ANOMALY_MIN_SAMPLES, ANOMALY_THRESHOLD, ANOMALY_WINDOW_MS
from revlens.schemas import LANDING
from revlens.session import checkpoint_dir

def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _files(spark: SparkSession, path: str) -> int:
    """Number of data files in a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(f.getPath().getName().startswith("part-") for f in fs.listStatus(p)) if fs.exists(p) else 0


def stage(df: DataFrame, name: str, files: int | None = None) -> str:
    """Write a derived table as parquet files (the landing zone of a test stream). ``files`` is
    their least number: rows are rebalanced into partitions of the advisory size, so that the
    files become more, not larger, with the table; fewer than ``files`` are written again as that many."""
    spark = df.sparkSession
    path = scratch(spark, f"stage-{name}")
    (df.hint("rebalance") if files else df).write.parquet(path)
    if files and _files(spark, path) < files:
        small, path = path, scratch(spark, f"stage-{name}")
        spark.read.schema(df.schema).parquet(small).repartition(files).write.parquet(path)
    return path


def files_a_batch(spark: SparkSession, src: str, batches: int) -> int:
    """Files per trigger with which a stream reads a staged folder in at most ``batches`` micro-batches."""
    return max(1, -(-_files(spark, src) // batches))


SLOT_FILES = 2
SLOT_FILE_ROWS = 250_000


def slot_files(df: DataFrame, slot: Column) -> int:
    """Files per slot for :func:`stage_slots`: more than ``SLOT_FILES`` where the largest slot has
    more than ``SLOT_FILE_ROWS`` rows for each."""
    most = df.groupBy(slot.alias("_slot")).count().agg(F.max("count")).first()[0] or 0
    return max(SLOT_FILES, -(-most // SLOT_FILE_ROWS))


def stage_slots(df: DataFrame, slot: Column, name: str, files: int = SLOT_FILES) -> str:
    """Write a derived table as the landing zone of a replay: slot after slot (ascending), each in
    exactly ``files`` files, so that a stream with ``files`` files a trigger reads one slot a
    micro-batch. Every slot is written by ``files`` tasks; the driver sees slot numbers only."""
    spark = df.sparkSession
    store, path = scratch(spark, f"slots-{name}"), scratch(spark, f"stage-{name}")
    (df.withColumn("_slot", slot.cast("long")).withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(files)))
       .repartition("_slot", "_part").drop("_part").write.partitionBy("_slot").parquet(store))
    stored = spark.read.parquet(store)
    for s in sorted(r._slot for r in stored.select("_slot").distinct().collect()):
        before = _files(spark, path)
        part = stored.where(F.col("_slot") == s).select(*df.columns)
        part.repartition(files).write.mode("append").parquet(path)
        for _ in range(files - (_files(spark, path) - before)):       # fewer rows than files: empty ones
            spark.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(path)
    return path


def _write(df: DataFrame, out: str, batch_id: int, *partition: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition).parquet(f"{out.rstrip('/')}/batch={batch_id}")


@contextmanager
def _persisted(df: DataFrame) -> Iterator[DataFrame]:
    df = df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def _existing(spark: SparkSession, path: str) -> str | None:
    """path if it exists in its (Hadoop) file system, else None."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Ids of the batch folders under path, by name: no file in them is opened."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(int(n[6:]) for n in names if n.startswith("batch="))


def _state_before(spark: SparkSession, state_dir: str, batch_id: int) -> DataFrame | None:
    """Breaker states that the newest batch before ``batch_id`` left. Older folders but one go (a
    batch runs again at most with the state it began with), so their number stays the
    same however long the stream runs."""
    known = [b for b in _batches(spark, state_dir) if b < batch_id]
    if not known:
        return None
    p = spark._jvm.org.apache.hadoop.fs.Path(state_dir)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    for b in known[:-2]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(p, f"batch={b}"), True)
    return spark.read.parquet(f"{state_dir.rstrip('/')}/batch={known[-1]}")


def _trigger(w, available_now: bool, interval: str):
    return w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)


def _source(spark: SparkSession, src: str, schema: T.StructType, max_files: int | None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(src)


# ----------------------------------------------------------------- S5
def land_stream(spark: SparkSession, src: str, out: str, checkpoint: str, topic: str,
                available_now: bool = True, interval: str = "1 minute") -> StreamingQuery:
    """Continuous landing of bus messages into a raw table partitioned by
    publish date, envelope metadata kept, exactly-once through the checkpoint."""
    s = (_source(spark, src, LANDING, None)
         .withColumn("topic", F.lit(topic))
         .withColumn("publish_date", F.to_date("publish_time")))
    w = (s.writeStream.format("parquet").option("checkpointLocation", checkpoint)
          .partitionBy("publish_date").outputMode("append"))
    return _trigger(w, available_now, interval).start(out)


# ----------------------------------------------------------------- T1
def clicks_stream(spark: SparkSession, src: str, out: str, dead: str, checkpoint: str,
                  watermark: str = "24 hours", available_now: bool = True,
                  interval: str = "1 minute", max_files: int | None = None,
                  keep: str = "first") -> StreamingQuery:
    """Land -> type -> normalize -> validate -> de-duplicate. Valid clicks go to
    ``out``, rejected / corrupt ones with their reason to ``dead``.

    ``keep="first"``: re-emits of a click_id within the watermark are dropped in the
    stream (state bounded by the watermark). ``keep="last"``: every valid emit is
    appended as a version (an append-only sink cannot replace a row) and
    :func:`latest_clicks` resolves last-write-wins within 24 h on read (batch W5)."""
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    typed = ing.normalize_clicks(ing.typed_clicks(_source(spark, src, LANDING, max_files)))
    tagged = typed.withColumn(
        "reason", F.when(F.col("corrupt"), F.lit("corrupt_payload")).otherwise(ing.rejection_reason()))
    if keep == "first":
        # valid clicks by click_id, rejected ones by message_id: an invalid emit never
        # stands in for the corrected one that follows
        keyed = tagged.withColumn("_k", F.when(F.col("reason").isNull(), F.concat(F.lit("click:"), F.col("click_id")))
                                  .otherwise(F.concat(F.lit("msg:"), F.col("message_id"))))
        tagged = (keyed.withWatermark("ingested_at", watermark)
                       .dropDuplicatesWithinWatermark(["_k"]).drop("_k"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        with _persisted(batch) as rows:
            _write(rows.where(F.col("reason").isNull()).drop("reason", "corrupt"), out, batch_id)
            _write(rows.where(F.col("reason").isNotNull()), dead, batch_id)

    w = tagged.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return _trigger(w, available_now, interval).start()


def latest_clicks(spark: SparkSession, out: str, hours: int = 24) -> DataFrame:
    """Last-write-wins view over the versions written by ``clicks_stream(keep="last")``."""
    return ing.dedup_clicks(spark.read.parquet(out).drop("batch"), hours=hours)


class UpsertTable:
    """A last-write-wins table of one row per key, in ``buckets`` by hash of the key.

    Each micro-batch merges its rows into the buckets it touches and writes those anew, as
    ``bucket=<b>/batch=<id>``; the other buckets stay as they are. A bucket's newest folder is
    its content, so readers need no de-duplication. A batch that runs again starts from
    the folders before it and overwrites its own: nothing changes. Folders older than the one a
    repeated batch would start from are deleted."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, order: list[str], buckets: int = 64):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.key, self.order, self.buckets = key, order, buckets

    def folders(self, before: int | None = None) -> dict[int, list[int]]:
        """bucket -> its batches (ascending) with an id below ``before``."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return {}
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        out = {}
        for n in names:
            if n.startswith("bucket="):
                ids = [b for b in _batches(self.spark, f"{self.path}/{n}") if before is None or b < before]
                if ids:
                    out[int(n[7:])] = ids
        return out

    def _folder(self, bucket: int, batch: int) -> str:
        return f"{self.path}/bucket={bucket}/batch={batch}"

    def read(self) -> DataFrame:
        return self._of([self._folder(b, ids[-1]) for b, ids in sorted(self.folders().items())])

    def _of(self, paths: list[str]) -> DataFrame:
        r = self.spark.read.schema(self.schema)
        return r.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def merge(self, rows: DataFrame, batch_id: int) -> list[int]:
        """Merge a micro-batch; returns the buckets it touched. Of a key's rows the greatest by
        ``order`` stays (nulls first). The driver sees bucket numbers only."""
        new = rows.select(*self.schema.names).withColumn("bucket", self.bucket())
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
        if not touched:
            return []
        old = self.folders(before=batch_id)
        kept = self._of([self._folder(b, old[b][-1]) for b in touched if b in old]).withColumn("bucket", self.bucket())
        rank = F.struct(*self.order)
        # one aggregation per key: repeated emits collapse map-side
        last = new.unionByName(kept).groupBy(self.key, "bucket").agg(F.max_by(F.struct(*self.schema.names), rank).alias("r")).select("bucket", "r.*")
        scratch_at = f"{self.path}/_batch/{batch_id}"
        last.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(scratch_at)
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for b in touched:       # renames: a bucket appears whole or not at all
            target = fs_path(self._folder(b, batch_id))
            fs.delete(target, True)
            fs.mkdirs(target.getParent())
            if not fs.rename(fs_path(f"{scratch_at}/bucket={b}"), target):
                raise RuntimeError(f"bucket {b} of batch {batch_id} was not published")
            for gone in old.get(b, [])[:-1]:
                fs.delete(fs_path(self._folder(b, gone)), True)
        fs.delete(fs_path(scratch_at), True)
        return touched


def clicks_upsert_stream(spark: SparkSession, src: str, table: UpsertTable, dead: str, checkpoint: str, available_now: bool = True,
                         interval: str = "1 minute", max_files: int | None = None) -> StreamingQuery:
    """T1 with a last-write-wins sink: valid clicks are merged into ``table`` by click_id, rejected and
    corrupt ones go to ``dead``. (Any later valid emit wins, also after 24 hours; W5's
    limit is for the batch.)"""
    typed = ing.normalize_clicks(ing.typed_clicks(_source(spark, src, LANDING, max_files)))
    tagged = typed.withColumn("reason", F.when(F.col("corrupt"), F.lit("corrupt_payload")).otherwise(ing.rejection_reason()))

    def sink(batch: DataFrame, batch_id: int) -> None:
        with _persisted(batch) as rows:
            table.merge(rows.where(F.col("reason").isNull()), batch_id)
            _write(rows.where(F.col("reason").isNotNull()), dead, batch_id)

    w = tagged.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return _trigger(w, available_now, interval).start()


# ----------------------------------------------------------------- T2
def freshness_stream(spark: SparkSession, src: str, schema: T.StructType, ts: str, out: str,
                     checkpoint: str, minutes: int = 15, from_hour: int = 6, to_hour: int = 22,
                     lateness: str = "30 minutes", available_now: bool = True, interval: str = "5 minutes",
                     max_files: int | None = None) -> StreamingQuery:
    """Empty windows of a feed whose events may come ``lateness`` out of order.

    Windows with events are aggregated under a watermark and leave the state only
    once it has passed them, in time order, whatever files their events came in. A
    micro-batch reports the gaps between the windows it closes, and from the last
    one closed before (kept as one row per batch next to the checkpoint). A silence
    is reported once the watermark passes the window that ends it."""
    step_ms = minutes * 60_000
    marker_dir = f"{checkpoint.rstrip('/')}/_freshness_marker"
    marker_schema = T.StructType([T.StructField("w", T.LongType()), T.StructField("batch", T.LongType())])

    def sink(batch: DataFrame, batch_id: int) -> None:
        seen = spark.read.schema(marker_schema).parquet(_existing(spark, marker_dir)) if _existing(spark, marker_dir) else None
        closed = batch.select(F.floor(F.unix_millis("window.start") / step_ms).cast("long").alias("w"))
        if seen is not None:
            # the newest marker of earlier batches (a batch that is run again ignores its own)
            closed = closed.unionByName(seen.where(F.col("batch") < batch_id).agg(F.max("w").alias("w")).where("w IS NOT NULL"))
        with _persisted(closed) as rows:
            # at most one row per window of the closed span
            pairs = rows.select("w", F.lead("w").over(Window.orderBy("w")).alias("next"))
            gaps = (pairs.where(F.col("next") > F.col("w") + 1)
                         .select(F.explode(F.sequence(F.col("w") + 1, F.col("next") - 1)).alias("w")))
            hour = F.hour(F.timestamp_millis(F.col("w") * step_ms))
            _write(gaps.where((hour >= from_hour) & (hour < to_hour))
                       .select((F.col("w") * step_ms).alias("window_start_ms"),
                               ((F.col("w") + 1) * step_ms).alias("window_end_ms")), out, batch_id)
            _write(rows.agg(F.max("w").alias("w")), marker_dir, batch_id)

    windows = (_source(spark, src, schema, max_files).select(ts).withWatermark(ts, lateness)
               .groupBy(F.window(ts, f"{minutes} minutes")).count())
    w = windows.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return _trigger(w.foreachBatch(sink), available_now, interval).start()


# A silence that goes on: windows are judged by the clock, not by the next event.
SILENCE_OUT = "feed string, window_start_ms long, window_end_ms long"


class SilenceProcessor(StatefulProcessor):
    """Per feed: the next window to be judged, and a processing-time timer at its end.

    Events move the window on; a timer that fires reports every window that ended
    ``grace_ms`` ago without one, and sets the next timer. ``shift_ms`` is how far the
    feed's time lies behind the clock (0 in production; a replay of an old feed sets it)."""

    def __init__(self, step_ms: int, grace_ms: int, shift_ms: int, from_hour: int, to_hour: int):
        self.step, self.grace, self.shift = step_ms, grace_ms, shift_ms
        self.hours = (from_hour, to_hour)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "w long, timer long")

    def _wait(self, w: int) -> None:
        """Judge window w once it has ended and the grace is over."""
        timer = (w + 1) * self.step + self.grace + self.shift
        self.next.update((w, timer))
        self.handle.registerTimer(timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(part["w"].max()) for part in rows)
        old = self.next.get()
        if old is None or newest + 1 > old[0]:
            if old is not None:
                self.handle.deleteTimer(old[1])
            self._wait(newest + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.next.get()
        if state is None or expiredTimerInfo.getExpiryTimeInMs() != state[1]:
            return
        now = timerValues.getCurrentProcessingTimeInMs() - self.shift
        first, last = state[0], (now - self.grace) // self.step - 1     # last window that is over
        for lo in range(first, last + 1, 10_000):
            w = np.arange(lo, min(lo + 10_000, last + 1))
            hour = (w * self.step // 3_600_000) % 24
            w = w[(hour >= self.hours[0]) & (hour < self.hours[1])]
            if len(w):
                yield pd.DataFrame({"feed": key[0], "window_start_ms": w * self.step, "window_end_ms": (w + 1) * self.step})
        self._wait(max(last + 1, first))

    def close(self) -> None:
        pass


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """Arbitrary state needs the RocksDB store; a query takes the setting as it starts."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, old) if old else spark.conf.unset(name)


def silence_stream(spark: SparkSession, src: str, schema: T.StructType, ts: str, out: str, checkpoint: str,
                   feed: Column | None = None, window_ms: int = 15 * 60_000, grace_ms: int = 30 * 60_000,
                   from_hour: int = 6, to_hour: int = 22, shift_ms: int = 0, interval: str = "1 minute",
                   max_files: int | None = None) -> StreamingQuery:
    """T2, silent feeds: a window without an event is written as soon as
    it is ``grace_ms`` old by the clock, while the silence lasts and without a new file.

    State is one row a feed. Only the newest window of each feed and Arrow batch is sent to
    it, so a feed with most of the events loads no task. A window that late events fill
    afterwards stays reported; the gaps between events are :func:`freshness_stream`'s. A
    feed counts from its first event on. Timers keep the query going, so it has no
    availableNow form: stop it, or see :func:`run_for`."""
    def newest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.table([b.column(0), b.column(1)], ["feed", "w"]).group_by("feed").aggregate([("w", "max")])
            yield from pa.table([t["feed"], t["w_max"]], ["feed", "w"]).to_batches()
    events = (_source(spark, src, schema, max_files).where(F.col(ts).isNotNull())
              .select((feed if feed is not None else F.lit("feed")).cast("string").alias("feed"),
                      F.floor(F.unix_millis(F.col(ts).cast("timestamp")) / window_ms).cast("long").alias("w"))
              .mapInArrow(newest, "feed string, w long"))
    silent = events.groupBy("feed").transformWithStateInPandas(
        SilenceProcessor(window_ms, grace_ms, shift_ms, from_hour, to_hour), SILENCE_OUT, "Append", "ProcessingTime")
    w = silent.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    with _rocksdb(spark):
        return _trigger(w, False, interval).start(out)


def run_for(q: StreamingQuery, batches: int = 2, seconds: float = 300) -> StreamingQuery:
    """Run a query that timers keep going until its source is drained and ``batches`` more
    batches (those of the timers that are due) are done, then stop it. ``seconds`` bounds the wait."""
    end = time.monotonic() + seconds

    def done() -> int:
        p = q.lastProgress
        return p["batchId"] if p else -1
    try:
        drained = None
        while q.isActive and time.monotonic() < end:
            if drained is None and done() >= 0 and not q.status["isDataAvailable"]:
                drained = done()
            if drained is not None and done() >= drained + batches:
                break
            time.sleep(0.2)
        else:
            if q.exception() is None:
                raise TimeoutError("the query was not drained in time")
    finally:
        q.stop()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return q


# ----------------------------------------------------------------- T3
_T3_OUT = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("shard", T.LongType()),
    T.StructField("ts_ms", T.LongType()), T.StructField("rpc", T.DoubleType()),
    T.StructField("allowed", T.BooleanType()), T.StructField("n", T.LongType()),
    T.StructField("zeros", T.LongType()), T.StructField("breached", T.BooleanType()),
    T.StructField("source", T.StringType()), T.StructField("reason", T.StringType()),
])


def breaker_replay(rows: pd.DataFrame, shard, state: BreakerState) -> pd.DataFrame:
    """Reference form of T3 on one shard's rows in memory."""
    rows = rows.sort_values(["ts_ms", "event_id"], kind="mergesort")
    out = [(int(e), int(shard), int(t), float(r), *state.step(int(t), float(r)))
           for e, t, r in zip(rows["event_id"], rows["ts_ms"], rows["rpc"])]
    return pd.DataFrame(out, columns=[f.name for f in _T3_OUT.fields])


def breaker_stream(spark: SparkSession, src: str, schema: T.StructType, out: str, checkpoint: str,
                   key: str = "shard", window_ms: int = ANOMALY_WINDOW_MS,
                   threshold: float = ANOMALY_THRESHOLD, min_samples: int = ANOMALY_MIN_SAMPLES,
                   cool_off_ms: int = BREAKER_COOL_OFF_MS, available_now: bool = True,
                   interval: str = "10 seconds", max_files: int | None = None) -> StreamingQuery:
    """Anomaly window with breaker feedback, keyed by shard (the original keeps
    this state per serving process). Within a key and micro-batch rows are applied
    in (ts_ms, event_id) order; blocked rows are not sampled. The states are kept as
    in T5, next to the checkpoint."""
    policy = BreakerPolicy("lane", "ts_ms", window_ms, threshold, min_samples, cool_off_ms)
    state_dir = f"{checkpoint.rstrip('/')}/_breaker_state"

    def sink(batch: DataFrame, batch_id: int) -> None:
        calls = batch.select("event_id", F.col(key).cast("long").alias("lane"), "ts_ms", "rpc")
        done = replay(calls, policy, "event_id", _T3_OUT.fields[4:], lambda st, now, rpc, _: st.step(now, rpc),
                      _state_before(spark, state_dir, batch_id))
        with _persisted(done) as rows:
            _write(rows.where("is_state").select(*STATE.names), state_dir, batch_id)
            _write(rows.where("NOT is_state").drop("shard").withColumnRenamed("lane", "shard").select(*_T3_OUT.names), out, batch_id)

    w = _source(spark, src, schema, max_files).writeStream.option("checkpointLocation", checkpoint)
    return _trigger(w.foreachBatch(sink), available_now, interval).start()


# ----------------------------------------------------------------- T4
def breaker_events_stream(spark: SparkSession, src: str, schema: T.StructType, out: str, config: str,
                          checkpoint: str, available_now: bool = True,
                          interval: str = "10 seconds") -> StreamingQuery:
    """T4: anomaly events -> decisions (appended to ``out``); a trip appends one
    kill-switch config version to ``config`` unless the newest one is killed."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        with _persisted(act.breaker_events(batch)) as decisions:
            _write(decisions, out, batch_id)
            # a batch that is run again finds the newest version killed: no second row
            engage = act.engage_kill_switch(decisions, spark.read.parquet(config)).collect()  # <= 1 row
        if engage:
            (spark.createDataFrame(engage).select("version", "kill", "bounds_min", "bounds_max", "canary_bp")
                  .write.mode("append").parquet(config))

    w = _source(spark, src, schema, None).writeStream.option("checkpointLocation", checkpoint)
    return _trigger(w.foreachBatch(sink), available_now, interval).start()


# ----------------------------------------------------------------- T5
def score_stream(spark: SparkSession, src: str, log_out: str, audit_out: str, checkpoint: str,
                 config: str, ledger: DataFrame, model, model_version: str = "unknown",
                 clv: DataFrame | None = None, premium: dict | None = None,
                 store: DataFrame | None = None, policy: BreakerPolicy | None = None,
                 available_now: bool = True, interval: str = "10 seconds", max_files: int | None = None) -> StreamingQuery:
    """T5: F1 on the click stream. Ledger, CLV and feature store are static sides of
    stream-static joins, best stored by click (``sources.staged.keyed``), so that a
    micro-batch moves none of their rows; the runtime config is re-read every micro-batch; the
    prediction log and the audit trail are the two sinks. With a ``policy`` the breaker
    and its anomaly window guard the model; their state, one row per shard, is kept
    next to the checkpoint and read from the newest earlier batch."""
    clicks_schema = spark.read.parquet(src).schema
    state_dir = f"{checkpoint.rstrip('/')}/_breaker_state"

    def sink(batch: DataFrame, batch_id: int) -> None:
        args = dict(clicks=batch, config_versions=spark.read.parquet(config), ledger=ledger, model=model,
                    model_version=model_version, clv=clv, premium=premium, store=store)
        held: list[DataFrame] = []

        def hold(df: DataFrame) -> DataFrame:
            held.append(df.persist())
            return held[-1]
        if policy is None:
            scored = sc.score_clicks(**args, keep=("click_ts",), hold=hold)
        else:
            before = _state_before(spark, state_dir, batch_id)
            scored, state = sc.score_clicks_guarded(**args, policy=policy, state=before, keep=("click_ts",), hold=hold)
            _write(state, state_dir, batch_id)
        with _persisted(scored) as rows:
            _write(sc.log_predictions(rows, F.unix_millis("click_ts") + 50), log_out, batch_id)
            _write(sc.audit_events(rows), audit_out, batch_id)
        for df in held:
            df.unpersist()

    w = _source(spark, src, clicks_schema, max_files).writeStream.option("checkpointLocation", checkpoint)
    return _trigger(w.foreachBatch(sink), available_now, interval).start()


# ----------------------------------------------------------------- T6
def activation_stream(spark: SparkSession, src: str, out: str, dead: str, checkpoint: str,
                      mode: str = "hybrid", available_now: bool = True,
                      interval: str = "10 seconds") -> StreamingQuery:
    """Push bodies -> envelopes -> channel payloads (partitioned by channel);
    invalid envelopes to the dead letter."""
    body_schema = spark.read.parquet(src).schema

    def sink(batch: DataFrame, batch_id: int) -> None:
        tagged = act.tagged_envelopes(ing.decode_push_envelope(batch))
        # a message is held with its envelope, or whole if it is a dead letter
        dead_only = {c: F.when(F.col("reason").isNotNull(), F.col(c)) for c in (*batch.columns, "data")}
        with _persisted(tagged.withColumns(dead_only)) as rows:
            _write(act.activation_route(rows.where(F.col("reason").isNull()), mode), out, batch_id, "channel")
            _write(rows.where(F.col("reason").isNotNull()).select(*batch.columns, "data", "reason"), dead, batch_id)

    w = _source(spark, src, body_schema, None).writeStream.option("checkpointLocation", checkpoint)
    return _trigger(w.foreachBatch(sink), available_now, interval).start()


# ----------------------------------------------------------------- T7
def metrics_stream(spark: SparkSession, src: str, schema: T.StructType, out: str, checkpoint: str,
                   lateness: str = "2 minutes", available_now: bool = True,
                   interval: str = "1 minute") -> StreamingQuery:
    """RED metrics per 1-minute window, emitted once the watermark closes it."""
    s = _source(spark, src, schema, None).withWatermark("ts", lateness)
    w = (om.request_metrics(s).writeStream.format("parquet").option("checkpointLocation", checkpoint)
           .outputMode("append"))
    return _trigger(w, available_now, interval).start(out)


def _closed(spark: SparkSession, src: str, schema: T.StructType, lateness: str, max_files: int | None) -> DataFrame:
    """Request log under a watermark. Rows without a path are heartbeats: they move the
    watermark, so that minutes close while nobody calls, and count as no request."""
    log = _source(spark, src, schema, max_files).withWatermark("ts", lateness)
    # names ts, so that the filter stays above the watermark
    return log.where(F.col("path").isNotNull() | F.col("ts").isNull())


def _last_minutes(rows: DataFrame, minutes: int) -> tuple[DataFrame, Column]:
    """Closed one-minute rows (window column ``m``) grouped by the ``minutes`` minutes that end
    with each; the condition that the last of them has a row."""
    grouped = rows.withColumn("start", F.col("m.start")).groupBy(F.window("m", f"{minutes} minutes", "1 minute").alias("w"))
    return grouped, F.col("newest") == F.col("w.end") - F.make_interval(mins=F.lit(1))


def latency_alerts(log: DataFrame, threshold_ms: float, minutes: int = 5, accuracy: int = 10_000, series: str = "path") -> DataFrame:
    """A11 on a watermarked stream: p95 per minute and series, their mean per minute, then
    the last ``minutes`` minutes; three aggregations, each fed by the closed rows of the one before."""
    per = (log.groupBy(F.window("ts", "1 minute").alias("s"), series)
              .agg(F.percentile_approx("latency_ms", 0.95, accuracy).alias("p95")))
    per_minute = per.groupBy(F.window("s", "1 minute").alias("m")).agg(F.avg("p95").alias("p95_ms"))
    grouped, complete = _last_minutes(per_minute, minutes)
    r = grouped.agg(F.min("p95_ms").alias("lowest"), F.count(F.lit(1)).alias("n"), F.max("start").alias("newest"), F.max_by("p95_ms", "start").alias("p95_ms"))
    return r.where(complete).select(F.unix_millis("newest").alias("minute_ms"), "p95_ms",
                                    ((F.col("n") == minutes) & (F.col("lowest") > threshold_ms)).alias("alert"))


def error_rate_alerts(log: DataFrame, threshold: float = 0.01, minutes: int = 5) -> DataFrame:
    """A12 on a watermarked stream."""
    per_minute = (log.groupBy(F.window("ts", "1 minute").alias("m"))
                     .agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") >= 500).alias("errors")))
    grouped, complete = _last_minutes(per_minute, minutes)
    r = grouped.agg(F.sum("requests").alias("requests_5m"), F.sum("errors").alias("errors_5m"), F.max("start").alias("newest"))
    share = F.col("errors_5m") / F.col("requests_5m")
    return r.where(complete).select(F.unix_millis("newest").alias("minute_ms"), "requests_5m", "errors_5m",
                                    share.alias("error_share"), (share > threshold).alias("alert"))


def availability_alerts(log: DataFrame, goal: float = 0.995, days: int = 30) -> DataFrame:
    """A13 on a watermarked stream: days, then the last ``days`` days of each day with traffic."""
    per_day = (log.groupBy(F.window("ts", "1 day").alias("d"))
                  .agg(F.count(F.lit(1)).alias("total"), F.count_if((F.col("status") >= 200) & (F.col("status") < 300)).alias("good")))
    r = (per_day.withColumn("start", F.col("d.start")).groupBy(F.window("d", f"{days} days", "1 day").alias("w"))
                .agg(F.sum("good").alias("good_30d"), F.sum("total").alias("total_30d"), F.max("start").alias("newest")))
    r = r.where(F.unix_seconds("newest") == F.unix_seconds("w.end") - 86_400)
    av = F.col("good_30d") / F.col("total_30d")
    return r.select(F.unix_millis("newest").alias("day_ms"), "good_30d", "total_30d", av.alias("availability"), (av >= goal).alias("met"))


def trip_alerts(audit: DataFrame, reason: str = "source") -> DataFrame:
    """A14 on a watermarked audit stream."""
    # names ts, so that the filter stays above the watermark: every audit row moves it
    trips = audit.where(F.when(F.col("ts").isNotNull(), F.col(reason) == "anomaly"))
    return (trips.groupBy(F.window("ts", "1 minute").alias("m")).agg(F.count(F.lit(1)).alias("trips"))
                 .select(F.unix_millis("m.start").alias("minute_ms"), "trips", (F.col("trips") > 0).alias("alert")))


ALERTS = {"latency": latency_alerts, "error_rate": error_rate_alerts, "availability": availability_alerts}


def alert_stream(spark: SparkSession, src: str, schema: T.StructType, out: str, checkpoint: str, kind: str,
                 lateness: str = "2 minutes", available_now: bool = True, interval: str = "1 minute",
                 max_files: int | None = None, **options) -> StreamingQuery:
    """T7, alerts A11-A13 (``kind``: a key of ``ALERTS``) over the request log, appended as the
    minutes (days) close. State: the open minutes and the minutes of the open rolling windows."""
    alerts = ALERTS[kind](_closed(spark, src, schema, lateness, max_files), **options)
    w = alerts.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return _trigger(w, available_now, interval).start(out)


def trip_stream(spark: SparkSession, src: str, schema: T.StructType, out: str, checkpoint: str, reason: str = "source",
                lateness: str = "2 minutes", available_now: bool = True, interval: str = "1 minute",
                max_files: int | None = None) -> StreamingQuery:
    """T7, alert A14 over the audit trail (columns ``ts`` and ``reason``; a null reason is a heartbeat)."""
    audit = _source(spark, src, schema, max_files).withWatermark("ts", lateness)
    audit = audit.where(F.col(reason).isNotNull() | F.col("ts").isNull())
    w = trip_alerts(audit, reason).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return _trigger(w, available_now, interval).start(out)


def run(q: StreamingQuery) -> StreamingQuery:
    """Block until an availableNow query has drained its source; surface failures."""
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return q


__all__ = ["land_stream", "clicks_stream", "clicks_upsert_stream", "UpsertTable", "latest_clicks", "freshness_stream", "breaker_stream",
           "breaker_events_stream", "score_stream", "activation_stream", "metrics_stream", "silence_stream",
           "alert_stream", "trip_stream", "latency_alerts", "error_rate_alerts", "availability_alerts", "trip_alerts",
           "stage", "stage_slots", "slot_files", "files_a_batch", "scratch", "run", "run_for", "BreakerState"]

"""Breaker and anomaly window of one serving shard, and the guard that runs them over
model calls (used by T3, F1 and T5)."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from revlens.operators.guardrails import ANOMALY_MIN_SAMPLES, ANOMALY_THRESHOLD, ANOMALY_WINDOW_MS

# Breaker cool-off after a trip: fixed value of the service.
BREAKER_COOL_OFF_MS = 30_000


@dataclass(frozen=True)
class BreakerPolicy:
    """``key``: column of the serving shard (the original keeps this state per process);
    ``ts``: column of the call's time in ms."""
    key: str = "shard"
    ts: str = "ts_ms"
    window_ms: int = ANOMALY_WINDOW_MS
    threshold: float = ANOMALY_THRESHOLD
    min_samples: int = ANOMALY_MIN_SAMPLES
    cool_off_ms: int = BREAKER_COOL_OFF_MS


class BreakerState:
    """Anomaly window + breaker of one shard. Samples are kept per millisecond
    (count, zeros), so the state is bounded by the window length, not by traffic."""

    def __init__(self, window_ms: int, threshold: float, min_samples: int, cool_off_ms: int,
                 ms=(), cnt=(), zer=(), opened_at: int = -1):
        self.window_ms, self.threshold, self.min_samples, self.cool_off_ms = (
            window_ms, threshold, min_samples, cool_off_ms)
        self.ms, self.cnt, self.zer = deque(ms), deque(cnt), deque(zer)
        self.n, self.z, self.opened_at = sum(self.cnt), sum(self.zer), opened_at

    def blocked(self, now: int) -> bool:
        return self.opened_at >= 0 and now - self.opened_at < self.cool_off_ms

    def fail(self, now: int) -> str:
        """A call whose model output is an error: it opens the breaker, unless that blocks it."""
        if self.blocked(now):
            return "breaker_open"
        self.opened_at = now
        return "model_error"

    def step(self, now: int, rpc: float) -> tuple:
        """One realised call at ``now``: (allowed, n, zeros, breached, source, reason).
        Open blocks until the cool-off has passed; afterwards calls pass again and
        the state stays open until a new trip (there is no half-open state)."""
        if self.blocked(now):
            return False, self.n, self.z, False, "FALLBACK_DATA_LAYER", "breaker_open"
        cutoff = now - self.window_ms
        while self.ms and self.ms[0] < cutoff:
            self.n -= self.cnt.popleft()
            self.z -= self.zer.popleft()
            self.ms.popleft()
        zero = 1 if rpc == 0.0 else 0
        if self.ms and self.ms[-1] == now:
            self.cnt[-1] += 1
            self.zer[-1] += zero
        else:
            self.ms.append(now)
            self.cnt.append(1)
            self.zer.append(zero)
        self.n += 1
        self.z += zero
        breached = self.n >= self.min_samples and self.z / self.n > self.threshold
        if breached:
            self.opened_at = now
            return True, self.n, self.z, True, "FALLBACK_DATA_LAYER", "anomaly"
        return True, self.n, self.z, False, "MODEL", "score.model"


STATE = T.StructType([
    T.StructField("shard", T.LongType()), T.StructField("ms", T.ArrayType(T.LongType())), T.StructField("cnt", T.ArrayType(T.LongType())),
    T.StructField("zer", T.ArrayType(T.LongType())), T.StructField("opened_at", T.LongType())])


def replay(calls: DataFrame, policy: BreakerPolicy, order: str, fields: list[T.StructField],
           step: Callable[[BreakerState, int, float, bool], tuple], state: DataFrame | None = None) -> DataFrame:
    """calls(order, rpc, key, ts, ...) plus ``fields``, the values of ``step(state, ts, rpc,
    model_error)`` of each call, and one row per shard with ``is_state`` true and the shard's
    state after its calls. ``model_error`` is false where calls have no such column.

    A shard's calls are applied in (ts, order) order, each after the one before: one task
    reads them from a sorted partition, one Arrow batch at a time, and carries the state
    on. It holds one batch and the states' windows, however many calls a shard has; its
    time grows with the calls of its shards.
    """
    added = [*fields, T.StructField("is_state", T.BooleanType()), *STATE.fields]
    names = calls.columns
    clash = sorted({f.name for f in added} & set(names))
    if clash:
        raise ValueError(f"columns {clash} of the calls must be renamed: the result uses these names")
    state = state if state is not None else calls.sparkSession.createDataFrame([], STATE)
    rows = (calls.withColumns({"_key": F.col(policy.key).cast("long"), "_ts": F.col(policy.ts).cast("long"), "_held": F.lit(False)})
            .unionByName(state.select(F.col("shard").alias("_key"), F.lit(True).alias("_held"), *STATE.names[1:]), allowMissingColumns=True)
            .repartition("_key").sortWithinPartitions("_key", F.desc("_held"), "_ts", order))
    types = [to_arrow_type(f.dataType) for f in added]
    limits = (policy.window_ms, policy.threshold, policy.min_samples, policy.cool_off_ms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended(shards: list[tuple], like: pa.Schema) -> pa.RecordBatch:
            own = [[None] * len(shards) for _ in fields] + [[True] * len(shards), [k for k, _ in shards],
                   [list(s.ms) for _, s in shards], [list(s.cnt) for _, s in shards], [list(s.zer) for _, s in shards],
                   [s.opened_at for _, s in shards]]
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(shards), like.field(c).type) for c in names), *map(pa.array, own, types)],
                                              [*names, *(f.name for f in added)])

        shard, st, like = None, None, None
        for b in batches:
            like = b.schema
            col = {c: b.column(c) for c in like.names}
            errors = col["model_error"].to_pylist() if "model_error" in names else repeat(False)
            values, done = [], []
            for j, (k, held, ts, rpc, error) in enumerate(zip(*(col[c].to_pylist() for c in ("_key", "_held", "_ts", "rpc")), errors)):
                if st is None or k != shard:
                    if st is not None:
                        done.append((shard, st))
                    shard, st = k, BreakerState(*limits)
                if held:
                    st = BreakerState(*limits, *(col[c][j].as_py() for c in STATE.names[1:]))
                else:
                    values.append(step(st, ts, math.nan if rpc is None else rpc, bool(error)))
            calls_of = b.filter(pc.invert(col["_held"]))
            own = [[v[i] for v in values] for i in range(len(fields))] + [[False] * len(values)]
            new = [*map(pa.array, own, types), *(pa.nulls(len(values), t) for t in types[len(own):])]
            yield pa.RecordBatch.from_arrays([*(calls_of.column(c) for c in names), *new], [*names, *(f.name for f in added)])
            if done:
                yield ended(done, like)
        if st is not None:
            yield ended([(shard, st)], like)

    out = T.StructType([*(T.StructField(f.name, f.dataType) for f in calls.schema.fields), *added])
    return rows.mapInArrow(run, out)


def guard_calls(calls: DataFrame, policy: BreakerPolicy, state: DataFrame | None = None) -> DataFrame:
    """calls(click_id, rpc, model_error, key, ts, ...) -> their columns plus ``verdict``
    (NULL: passes; breaker_open, anomaly, model_error), and the state rows of :func:`replay`."""
    def step(st: BreakerState, now: int, rpc: float, error: bool) -> tuple:
        reason = st.fail(now) if error else st.step(now, rpc)[-1]
        return (None if reason == "score.model" else reason,)
    return replay(calls, policy, "click_id", [T.StructField("verdict", T.StringType())], step, state)

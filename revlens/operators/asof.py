"""As-of join by time blocks, and the runtime config in force at each call."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_MS = 3_600_000
ROWS_PER_TASK = 1_000_000
CONFIG = ["version", "kill", "bounds_min", "bounds_max", "canary_bp"]


def as_of(left: DataFrame, right: DataFrame, left_ms: str, right_ms: str, columns: list[str], tiebreak: str,
          block_ms: int = BLOCK_MS, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Every left row with ``columns`` of the newest right row at or before it (null: none).
    Of right rows at one time the one with the greatest ``tiebreak`` counts; rows with a
    null time match nothing.

    Both sides are cut into time blocks. Within a block a running last value finds the
    match; a block starts from the last right row of the blocks before it, which comes from
    one row per block with data. A block with more than ``rows_per_task`` left rows is dealt to
    several tasks, each with the block's right rows, so no sort is global and no task
    holds a hot hour."""
    clash = [c for c in columns if c in left.columns]
    if clash:
        raise ValueError(f"columns {clash} are on both sides")

    def block(c: str):
        return F.floor(F.col(c) / block_ms).cast("long")
    r = right.where(F.col(right_ms).isNotNull()).select(
        F.col(right_ms).alias("_t"), F.struct(F.col(tiebreak).alias("_k"), *columns).alias("_p"), block(right_ms).alias("_b"))
    ends = r.groupBy("_b").agg(F.max(F.struct("_t", "_p")).alias("_e")).select("_b", F.col("_e._p").alias("_last"))
    sizes = (left.where(F.col(left_ms).isNotNull()).groupBy(block(left_ms).alias("_b"))
             .agg(F.ceil(F.count(F.lit(1)) / rows_per_task).cast("int").alias("_n")))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # one row per block with data
    blocks = (ends.join(sizes, "_b", "full").withColumn("_carry", F.last("_last", ignorenulls=True).over(before))
                  .where("_n IS NOT NULL").select("_b", "_n", "_carry"))
    rows = left.withColumn("_t", F.col(left_ms)).withColumn("_b", block(left_ms)).join(blocks, "_b", "left")
    rows = rows.withColumn("_s", F.pmod(F.xxhash64(*left.columns), F.coalesce("_n", F.lit(1)))).withColumn("_own", F.lit(1)).drop("_n")
    spread = (r.join(blocks.select("_b", "_n"), "_b").withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
               .select("_t", "_p", "_b", F.col("_s").cast("long").alias("_s"), F.lit(0).alias("_own")))
    w = (Window.partitionBy("_b", "_s").orderBy("_t", "_own", F.col("_p._k"))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = rows.unionByName(spread, allowMissingColumns=True)
    found = both.withColumn("_m", F.last("_p", ignorenulls=True).over(w)).where("_own = 1")
    match = F.when(F.col(left_ms).isNotNull(), F.coalesce("_m", "_carry"))
    return found.select(*left.columns, *[match[c].alias(c) for c in columns])


def config_at_call(calls: DataFrame, config_versions: DataFrame, call_ms: str = "call_ms", valid_from: str = "valid_from_ms",
                   block_ms: int = BLOCK_MS) -> DataFrame:
    """S11 at call time: each call with the config version that was in force."""
    return as_of(calls, config_versions, call_ms, valid_from, CONFIG, "version", block_ms)

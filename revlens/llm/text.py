"""Helpers that the operators share: vectorised words and hashes over the UTF-8
buffers of Arrow batches, staging in the shared folder, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.session import checkpoint_dir

U64 = np.uint64
SLICE_BYTES = 1 << 20

# Byte classes. WHITE: the six ASCII white-space bytes; PUNCT: every ASCII byte that is
# no letter or digit (bytes from 0x80 on belong to letters of other scripts).
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_UNBASE = U64(pow(int(_BASE), -1, 1 << 64))
_pow = np.ones(1, U64)
_unpow = np.ones(1, U64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """splitmix64 finaliser: a 64-bit bijection that spreads every input bit."""
    x = x + U64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _unpow
    if len(_pow) < n:
        size = max(n, 2 * len(_pow), 1 << 16)
        _pow, _unpow = (np.concatenate(([U64(1)], np.full(size - 1, b, U64))).cumprod(dtype=U64)
                        for b in (_BASE, _UNBASE))
    return _pow, _unpow


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of a string column, of
    about ``max_bytes`` each (a longer text is a slice of its own). Nulls are empty."""
    if not len(column):
        return
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


class Words:
    """Words of the texts of one slice: byte spans, 64-bit hashes, first word of each text."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, sep: np.ndarray = WHITE):
        inside = ~sep[buf]
        before = np.zeros(len(buf), bool)
        before[1:] = inside[:-1]
        cuts = off[off < len(buf)]
        before[cuts] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(buf), bool)
        after[:-1] = inside[1:]
        cuts = off[(off > 0) & (off <= len(buf))]
        after[cuts - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, off)
        self.buf = buf

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        power, unpower = _powers(len(self.buf) + 1)
        sums = np.zeros(len(self.buf) + 1, U64)
        np.cumsum(_BYTE[self.buf] * power[:len(self.buf)], out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * unpower[self.start]
        return mix(h + (self.end - self.start).astype(U64) * U64(0xD6E8FEB86659FD93))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words (at every start; runs that cross texts are the caller's)."""
    k = len(words) - n + 1
    if k <= 0:
        return np.zeros(0, U64)
    out = np.zeros(k, U64)
    for i in range(n):
        out = out * _BASE + words[i:i + k]
    return mix(out, n)


def owner(first: np.ndarray) -> np.ndarray:
    """Text number of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


# ------------------------------------------------------------------ Spark helpers
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS texts or BATCH_BYTES (or one longer text): what a
    Python worker and its task hold at once. (Spark's defaults are meant for short rows.)"""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextmanager
def narrow_batches(spark: SparkSession, rows: int = 50 * BATCH_ROWS) -> Iterator[None]:
    """Larger Arrow batches (the bound on bytes stays) for jobs on rows of a few numbers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        yield
    finally:
        bounded_batches(spark)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared checkpoint folder and read back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def total_bytes(df: DataFrame, column: str) -> int:
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node of each connected component.

    nodes(node), edges(a, b): longs; edges may repeat, loops are ignored. Returns
    (node, comp), one row per distinct node. Hash-to-min over star contractions: each
    round every node takes the smallest label of its neighbours, then the label of its
    label (pointer jumping), so few rounds suffice for long chains. All state is staged in the shared folder; only a count of changed labels
    reaches the driver.
    """
    edges = stage(edges.where("a <> b").select("a", "b").distinct(), "edges")
    both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
    touched = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp"))
                    .withColumn("old", F.lit(None).cast("long")), "labels")
    for _ in range(max_rounds):
        own = touched.select("node", "comp")
        seen = both.join(own.selectExpr("node AS b", "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        low = stage(own.join(seen.withColumnRenamed("a", "node"), "node")
                    .select("node", F.least("comp", "near").alias("low"), F.col("comp").alias("old")), "low")
        touched = stage(low.join(low.selectExpr("node AS low", "low AS up"), "low")
                        .select("node", F.least("low", "up").alias("comp"), "old"), "labels")
        if not touched.where("comp <> old").limit(1).count():
            break
    else:
        raise RuntimeError("components did not converge")
    touched = touched.drop("old")
    return (nodes.select("node").distinct().join(touched, "node", "left")
            .select("node", F.coalesce("comp", "node").alias("comp")))

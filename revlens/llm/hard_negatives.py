"""Hard negatives by coordinate pruning of an inner-product search (LEMP).

Rows are put into buckets by length (range of the vector's norm), buckets are cut into blocks of
bounded size. A block holds the rows' directions as sorted coordinate lists: for every
coordinate the rows ordered by its value. An anchor q looks for rows x with q.x >= t,
that is cos(q, x) >= t / (|q| |x|) =: c, with |x| the block's greatest length. If c > 1
the block is skipped. Else, both directions of length 1, x_f must lie in

    q_f c -+ sqrt((1 - q_f^2) (1 - c^2))

for every coordinate f. The ranges of the anchor's focus coordinates, those in which
it is largest, are found in the lists by binary search; the shortest list gives the
candidates, the other ranges thin them, and exact integer products decide.

Positives are a top-k search among the rows of the anchor's label, negatives one among the
other labels in the ranges of scores that the positives set. Either starts from a floor: what
one block of the longest rows gives (k rows of it are surely reached). Anchors are the
smaller side and are what is sent, to the blocks whose length can reach their floor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.knn import matrix, products, quantise
from revlens.llm.text import bounded_batches, stage

SCALE = 256
BUCKETS = 16                # length buckets, by quantiles of the length
BLOCK_ROWS = 4096
ANCHOR_ROWS = 4096
FOCUS = 4
LOW, HIGH = 80, 100         # negatives' scores in percent of the positive's
NONE = -(1 << 63)           # no floor
ROW = "vec_id long, label long, q binary, length double, salt long"
FOUND = "anchor long, slot int, vec_id long, score long"
EXACT_FLOAT = float(1 << 53)


def participants(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, q binary of doubles, length, salt) of the rows that take part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            keep, out, length = [], [], []
            for i, v in enumerate(b.column(2)):
                if not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    x = quantise(x, scale)
                    keep.append(i)
                    out.append(x.tobytes())
                    length.append(float(np.linalg.norm(x)))
            at = pa.array(keep, pa.int64())
            salt = pa.array(np.arange(seen, seen + len(keep)))
            seen += len(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(out, pa.binary()), pa.array(length, pa.float64()), salt],
                                             ["vec_id", "label", "q", "length", "salt"])
    return (vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
            .select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").mapInArrow(run, ROW))


class Block:
    """Rows of one block as sorted coordinate lists."""

    def __init__(self, rows: list[bytes], ids: np.ndarray, labels: np.ndarray, width: int):
        order = np.argsort(ids, kind="stable")
        self.x = matrix([rows[i] for i in order], width)
        self.ids, self.labels = ids[order], labels[order]
        self.length = np.linalg.norm(self.x, axis=1)
        self.longest = float(self.length.max(initial=0))
        self.peak = float(np.abs(self.x).max(initial=0))
        self.unit = self.x / np.where(self.length > 0, self.length, 1)[:, None]
        self.order = np.argsort(self.unit, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.unit, self.order, axis=0)

    def candidates(self, q: np.ndarray, floor: float) -> np.ndarray:
        """Rows whose product with q may be ``floor`` or more (a superset)."""
        everyone = np.arange(len(self.ids))
        norm = float(np.linalg.norm(q))
        if floor <= 0 or norm == 0 or self.longest == 0:
            return everyone if floor <= 0 else everyone[:0]
        c = floor / (norm * self.longest) - 1e-9
        if c > 1:
            return everyone[:0]
        unit = q / norm
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        half = np.sqrt(np.maximum((1 - unit[focus] ** 2) * (1 - c * c), 0)) + 1e-9
        low, high = unit[focus] * c - half, unit[focus] * c + half
        # where the cone around q holds the axis, the range goes on to the axis' end
        high = np.where(unit[focus] >= c, np.inf, high)
        low = np.where(unit[focus] <= -c, -np.inf, low)
        lo = np.array([np.searchsorted(self.sorted[:, f], v, "left") for f, v in zip(focus, low)])
        hi = np.array([np.searchsorted(self.sorted[:, f], v, "right") for f, v in zip(focus, high)])
        best = int(np.argmin(hi - lo))
        out = self.order[lo[best]:hi[best], focus[best]]
        for i, f in enumerate(focus):
            if i != best and len(out):
                v = self.unit[out, f]
                out = out[(v >= low[i]) & (v <= high[i])]
        return np.sort(out)

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if float(np.abs(q).max(initial=0)) * self.peak * max(1, len(q)) < EXACT_FLOAT:
            return (self.x[rows] @ q).astype(np.int64)
        return products(q[None], self.x[rows])[0]


def solve(anchors: pa.Table, rows: pa.Table, k: int, same: bool) -> pa.Table:
    """anchors(anchor, vec_id, label, q, low, high, floor) and rows of one block: the k best rows
    of every slot (range of scores) of every anchor."""
    out: list[tuple[np.ndarray, ...]] = []
    if len(anchors) and len(rows):
        asked = anchors["q"].to_pylist()
        stored = rows["q"].to_pylist()
        width = max(len(v) for v in (*asked, *stored)) // 8
        block = Block(stored, rows["vec_id"].to_numpy(), rows["label"].to_numpy(), width)
        queries = matrix(asked, width)
        columns = [anchors[c].to_pylist() for c in ("anchor", "vec_id", "label", "low", "high", "floor")]
        for q, anchor, own, label, low, high, floor in zip(queries, *columns):
            at = block.candidates(q, min(floor))
            at = at[((block.labels[at] == label) == same) & (block.ids[at] != own)]
            if not len(at):
                continue
            score = block.scores(q, at)
            for slot, (a, b) in enumerate(zip(floor, high)):
                inside = np.flatnonzero((score >= a) & (score <= b))
                best = inside[np.argsort(-score[inside], kind="stable")[:k]]      # rows are in order of vec_id
                if len(best):
                    out.append((np.full(len(best), anchor), np.full(len(best), slot), block.ids[at[best]], score[best]))
    joined = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("anchor", "slot", "vec_id", "score"), joined, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))})


class Buckets:
    """Rows in length buckets and blocks. The driver holds one row a bucket."""

    def __init__(self, rows: DataFrame, n_buckets: int, block_rows: int):
        cuts = rows.approxQuantile("length", [i / n_buckets for i in range(1, n_buckets)], 0.001)
        bucket = sum((F.when(F.col("length") <= c, 1).otherwise(0) for c in cuts), F.lit(0))      # 0: the longest
        placed = rows.withColumn("bucket", bucket)
        self.summary = [(r.bucket, r.longest, -(-r.n // block_rows)) for r in
                        placed.groupBy("bucket").agg(F.max("length").alias("longest"), F.count("*").alias("n")).orderBy("bucket").collect()]
        blocks = F.create_map(*[x for b, _, n in self.summary for x in (F.lit(b), F.lit(n))])
        self.rows = placed.withColumn("block", F.pmod(F.xxhash64("vec_id", "salt"), blocks[F.col("bucket")]))

    def meet(self, anchors: DataFrame, n_groups: int, k: int, same: bool, first: bool = False) -> DataFrame:
        """Best rows of each slot, block by block; ``first``: only one block of the longest rows."""
        summary = self.summary[:1] if first else self.summary
        table = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(x).alias("longest"), F.lit(1 if first else n).alias("n")) for b, x, n in summary])
        least = F.array_min("floor")
        reach = F.filter(table, lambda b: (least <= 0) | (least <= F.col("length") * b["longest"] * (1 + 1e-9) + 1e-6))
        sent = (anchors.withColumn("part", F.pmod("anchor", F.lit(n_groups)))
                .select("*", F.explode(reach).alias("to")).select("*", "to.bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("to.n").cast("long") - 1)).alias("block")))
        rows = self.rows.where((F.col("bucket") == summary[0][0]) & (F.col("block") == 0)) if first else self.rows
        asked = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))))
        by = ["bucket", "block", "part"]
        found = (sent.select(*by, "anchor", "vec_id", "label", "q", "low", "high", "floor").groupBy(*by)
                 .cogroup(asked.select(*by, "vec_id", "label", "q").groupBy(*by))
                 .applyInArrow(lambda left, right: solve(left, right, k, same), FOUND))
        order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def search(self, anchors: DataFrame, n_groups: int, k: int, same: bool) -> DataFrame:
        """anchors(anchor, vec_id, label, q, length, low, high) -> (anchor, slot, rank, vec_id, score)."""
        start = anchors.withColumn("floor", F.col("low"))
        sure = (self.meet(start, n_groups, k, same, first=True).where(F.col("rank") == k)
                .groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("sure")))
        floor = F.transform("low", lambda v, i: F.greatest(v, F.coalesce(F.element_at("sure", i), v)))
        raised = start.join(sure, "anchor", "left").withColumn("floor", floor).drop("sure")
        return self.meet(raised, n_groups, k, same)


def hard_negatives(vectors: DataFrame, is_anchor: Column, k_positive: int = 5, k_negative: int = 5, low: int = LOW, high: int = HIGH,
                   scale: int = SCALE, n_buckets: int = BUCKETS, block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """vectors(vec_id integer, embedding array, label integer) -> anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score.

    Components are quantised to floor(scale * x). An anchor's positives are its ``k_positive``
    best other rows of its label; a positive's negatives the ``k_negative`` best rows of other labels with
    low * positive <= 100 * score <= high * positive. Best: higher inner product, then smaller
    vec_id. Rows with a null vec_id or label, a null vector or a null or non-finite
    component take no part. Equal anchor rows are one anchor; other rows with an anchor's
    vec_id are never its positives or negatives, and rows that repeat a vec_id otherwise
    count each. Shorter vectors are filled with zeros. Scores beyond a long are given as its
    end. No rows, or no anchors: no result.
    """
    bounded_batches(vectors.sparkSession)
    rows = stage(participants(vectors, scale), "negatives-rows")
    start = (rows.where(is_anchor).select("vec_id", "label", "q", "length").distinct()
             .withColumn("anchor", F.xxhash64("vec_id", "label", "q")))
    anchors = stage(start, "negatives-anchors")
    n_anchors = anchors.count()
    if not n_anchors:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    n_groups = -(-n_anchors // anchor_rows)
    buckets = Buckets(rows, n_buckets, block_rows)
    whole = F.array(F.lit(NONE).cast("long")), F.array(F.lit(-NONE - 1).cast("long"))
    positives = stage(buckets.search(anchors.withColumn("low", whole[0]).withColumn("high", whole[1]), n_groups, k_positive, True), "negatives-positives")
    # ranges in decimals: the products leave a long near its ends
    part = F.col("score").cast("decimal(38,0)")
    ranges = (positives.withColumn("low", F.ceil(part * low / 100).cast("long")).withColumn("high", F.floor(part * high / 100).cast("long"))
              .groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "low", "high"))).alias("r"))
              .select("anchor", F.col("r.low").alias("low"), F.col("r.high").alias("high")))
    found = buckets.search(anchors.join(ranges, "anchor"), n_groups, k_negative, False)
    return (found.join(positives.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor", "slot"])
            .join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))


def query(spark, sf_dir: str) -> DataFrame:
    """Anchors: every 100th vec_id; the label of every 7th moves on by one."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT vec_id, label, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM v),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(sum(a.x * b.x) AS BIGINT) AS score
      FROM c a JOIN c b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY ALL),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
        CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

"""Exact top-k search by a Voronoi join.

Vectors are quantised to floor(scale * x); scores are integer inner products. Data and
queries are grouped by their nearest pivot. Each data group has a summary: its radius
and the distances of the few vectors nearest to the pivot. For a query group with pivot p
and radius u, and a vector x at distance d from the pivot o of its group,

    |q.x - p.o| <= u |o| + |p| d + u d        (u and d: distances to the pivots)

so the summaries give every query group a score that k of its candidates surely reach,
and an upper bound for each data group; only pairs of groups whose upper bound reaches
it meet. The same bounds with the query itself (u = 0) then decide which of these data
groups a query is sent to. Queries are the smaller side, so they are what is replicated;
data groups stay where they are, cut into blocks of bounded size. A task holds one block
and reads the queries sent to it batch by batch, so no number of queries fills it; beyond
``QUERY_ROWS`` queries they are dealt to several tasks a block. The blocks' lists are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.text import bounded_batches, stage

SCALE = 256
PIVOT_SHARE = 8             # pivots: square root of the number of rows, divided by this
BLOCK_ROWS = 4096
QUERY_ROWS = 1 << 18
BOUNDS_AT_ONCE = 1 << 22
EXACT_FLOAT = float(1 << 53)
LONG = (1 << 63) - 1


def quantise(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.floor(values.astype(np.float64) * scale)


def _clean(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, q binary of doubles) of the vectors that take part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    ids.append(i)
                    out.append(quantise(x, scale).tobytes())
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64()), "q": pa.array(out, pa.binary())})
    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, q binary")


def matrix(rows: list[bytes], width: int | None = None) -> np.ndarray:
    """Stacks vectors; shorter ones are filled with zeros, which add nothing to a product."""
    vs = [np.frombuffer(r, np.float64) for r in rows]
    width = max([width or 0, *map(len, vs)], default=0)
    out = np.zeros((len(vs), width))
    for i, v in enumerate(vs):
        out[i, :len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products (a long each; beyond its range they stop at its ends)."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * width < EXACT_FLOAT:
        return (a @ b.T).astype(np.int64)
    whole = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    return np.array([[min(LONG, max(-LONG - 1, x)) for x in r] for r in whole], np.int64)


@dataclass
class Summaries:
    """Per pivot: its vector and norm, the radius of its data group, distances of the
    group's nearest vectors (inf: fewer), and how many blocks the group is cut into."""
    pivots: np.ndarray
    norm: np.ndarray
    radius: np.ndarray
    nearest: np.ndarray
    blocks: np.ndarray

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = max(x.shape[1], self.pivots.shape[1])
        x, p = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, self.pivots))
        d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1), 0)
        cell = d.argmin(axis=1)
        return cell, np.linalg.norm(x - p[cell], axis=1)

    def bounds(self, center: np.ndarray, spread: np.ndarray, k: int, own: int = 1) -> np.ndarray:
        """centers x groups: whether a group can hold one of the k best candidates of any
        query within ``spread`` of a center. ``own`` more are counted, as the rows of a
        query's own vec_id (at most so many) may be among the nearest; a slack covers rounding."""
        step = max(1, BOUNDS_AT_ONCE // self.nearest.size)
        if len(center) > step:
            return np.concatenate([self.bounds(center[i:i + step], spread[i:i + step], k, own) for i in range(0, len(center), step)])
        width = max(center.shape[1], self.pivots.shape[1])
        c, o = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (center, self.pivots))
        mid = c @ o.T
        cn, u = np.linalg.norm(c, axis=1)[:, None], spread[:, None]
        slack = 1e-9 * (cn + u + 1) * (self.norm + np.where(self.blocks > 0, self.radius, 0) + 1) + 1e-6
        upper = mid + u * self.norm + (cn + u) * self.radius + slack
        lower = (mid - u * self.norm - slack)[:, :, None] - (cn + u)[:, :, None] * self.nearest[None]
        flat = np.sort(lower.reshape(len(c), -1), axis=1)
        sure = flat[:, -(k + own)] if flat.shape[1] >= k + own else np.full(len(c), -np.inf)
        return (upper >= sure[:, None]) & (self.blocks > 0)


class BlockSolver:
    """Best candidates of the queries sent to one data block. The block comes first, whole (it is
    bounded); then the queries, those of one id one after the other, which are one query."""

    def __init__(self, key: tuple[int, int, int], k: int):
        self.key, self.k = key, k
        self.ids: list[np.ndarray] = []
        self.rows: list[bytes] = []
        self.x: np.ndarray | None = None
        self.asking: int | None = None
        self.best: np.ndarray | None = None
        self.out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids: np.ndarray, rows: list[bytes]) -> None:
        self.ids.append(ids)
        self.rows += rows

    def ask(self, ids: list[int], rows: list[bytes]) -> None:
        if not ids or not self.rows:
            return
        if self.x is None:      # data rows came in order of vec_id
            self.x, self.every = matrix(self.rows), np.concatenate(self.ids)
        for lo in range(0, len(ids), 256):
            for qid, s in zip(ids[lo:lo + 256], products(matrix(rows[lo:lo + 256]), self.x)):
                if qid == self.asking:
                    self.best = np.maximum(self.best, s)
                    continue
                self.choose()
                self.asking, self.best = qid, s

    def choose(self) -> None:
        if self.asking is None:
            return
        other = np.flatnonzero(self.every != self.asking)
        s = self.best[other]
        if len(s) > self.k:   # all above the k-th best score, then smaller ids first
            floor = np.partition(s, len(s) - self.k)[len(s) - self.k]
            above = np.flatnonzero(s > floor)
            pick = np.concatenate((above, np.flatnonzero(s == floor)[:self.k - len(above)]))
        else:
            pick = np.arange(len(s))
        self.out.append((np.full(len(pick), self.asking), self.every[other[pick]], s[pick]))
        self.asking = None

    def result(self, last: bool = False) -> pa.RecordBatch:
        if last:
            self.choose()
        out, self.out = self.out, []
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query, k: int, scale: int = SCALE, n_pivots: int | None = None, block_rows: int = BLOCK_ROWS,
          query_rows: int = QUERY_ROWS) -> DataFrame:
    """vectors(vec_id integer, embedding array) -> query_id, rank, vec_id, score.

    ``is_query``: condition on vec_id. Candidates of a query are all rows but those with
    its own vec_id; ties go to the smaller vec_id (rows that repeat a vec_id are
    candidates each). Query rows that repeat a vec_id are one query of several vectors: each
    candidate counts once, with its best score. Vectors that are null or hold null or
    non-finite components, and rows with a null vec_id, take no part. Vectors of different
    lengths: the shorter is filled with zeros. Scores beyond a long are given as its end; which of such candidates
    come first is not defined. The driver holds ``n_pivots`` pivots (by default in
    proportion to the square root of the number of rows) and their summaries.
    """
    bounded_batches(vectors.sparkSession)
    data = stage(_clean(vectors, scale), "vectors")
    n_pivots = n_pivots or max(16, isqrt(data.count()) // PIVOT_SHARE)
    sample = [r.q for r in data.select("q", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(n_pivots).collect()]
    if not sample:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = np.unique(matrix(sample), axis=0)
    none = np.zeros(len(pivots))
    index = Summaries(pivots, np.linalg.norm(pivots, axis=1), none, none[:, None], none)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                cell, dist = index.assign(matrix(b.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(dist, pa.float64())],
                                                 ["vec_id", "q", "cell", "dist"])
    placed = stage(data.mapInArrow(group, "vec_id long, q binary, cell int, dist double"), "placed")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the task's k + 1 nearest of each group: a bounded list per task and pivot
        best: dict[int, np.ndarray] = {}
        for b in batches:
            cell, dist = b.column(0).to_numpy(), b.column(1).to_numpy()
            for c in np.unique(cell):
                best[c] = np.sort(np.concatenate((best.get(c, np.zeros(0)), dist[cell == c])))[:k + 1]
        for c, d in best.items():
            yield pa.RecordBatch.from_pydict({"cell": pa.array([c] * len(d), pa.int32()), "dist": pa.array(d, pa.float64())})
    lists = placed.select("cell", "dist").mapInArrow(near, "cell int, dist double")
    order = Window.partitionBy("cell").orderBy("dist")
    nearest = np.full((len(pivots), k + 1), np.inf)
    for r in lists.withColumn("i", F.row_number().over(order)).where(F.col("i") <= k + 1).collect():
        nearest[r.cell, r.i - 1] = r.dist
    radius, blocks = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
    for r in placed.groupBy("cell").agg(F.max("dist").alias("radius"), F.count("*").alias("n")).collect():
        radius[r.cell], blocks[r.cell] = r.radius, -(-r.n // block_rows)
    index = Summaries(pivots, index.norm, radius, nearest, blocks)

    queries = placed.where(is_query)
    spread = np.full(len(pivots), -np.inf)
    for r in queries.groupBy("cell").agg(F.max("dist").alias("u")).collect():
        spread[r.cell] = r.u
    own = queries.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1
    meets = index.bounds(pivots, np.where(np.isfinite(spread), spread, 0), k, own)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = matrix(b.column(1).to_pylist())
            wanted = index.bounds(x, np.zeros(len(x)), k, own) & meets[b.column(2).to_numpy()]
            row, cell = np.nonzero(wanted)
            times = index.blocks[cell]
            row, cell = np.repeat(row, times), np.repeat(cell, times)
            block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            taken = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(taken), b.column(1).take(taken), pa.array(cell, pa.int32()),
                                              pa.array(block, pa.int32())], ["query_id", "q", "cell", "block"])
    asked = queries.mapInArrow(send, "query_id long, q binary, cell int, block int")
    cut = F.create_map(*[x for c, n in enumerate(blocks) for x in (F.lit(c), F.lit(int(max(1, n))))])
    kept = placed.select("vec_id", "q", "cell", F.pmod(F.xxhash64("vec_id", "q"), cut[F.col("cell")]).cast("int").alias("block"))

    # rows of a task: sorted by block, its data before its queries
    parts = -(-queries.count() // query_rows)
    data_rows = kept.select("cell", "block", F.explode(F.sequence(F.lit(0), F.lit(max(1, parts) - 1))).alias("part"), F.lit(0).alias("side"), F.col("vec_id").alias("id"), "q")
    query_side = asked.select("cell", "block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, parts))).cast("int").alias("part"), F.lit(1).alias("side"),
                              F.col("query_id").alias("id"), "q")
    rows = (data_rows.unionByName(query_side).repartition("cell", "block", "part")
            .sortWithinPartitions("cell", "block", "part", "side", "id"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = None
        for b in batches:
            key = [b.column(i).to_numpy() for i in range(3)]
            change = np.flatnonzero((np.diff(key[0]) != 0) | (np.diff(key[1]) != 0) | (np.diff(key[2]) != 0)) + 1
            for lo, hi in zip([0, *change], [*change, len(b)]):
                if lo == hi:
                    continue
                at = tuple(int(c[lo]) for c in key)
                if solver is None or solver.key != at:
                    if solver is not None:
                        yield solver.result(last=True)
                    solver = BlockSolver(at, k)
                side = b.column(3).to_numpy()[lo:hi]
                n_data = int((side == 0).sum())
                if n_data:
                    solver.add(b.column(4).slice(lo, n_data).to_numpy(), b.column(5).slice(lo, n_data).to_pylist())
                solver.ask(b.column(4).slice(lo + n_data, hi - lo - n_data).to_pylist(), b.column(5).slice(lo + n_data, hi - lo - n_data).to_pylist())
                yield solver.result()
        if solver is not None:
            yield solver.result(last=True)
    found = rows.mapInArrow(solve, "query_id long, vec_id long, score long")
    merge = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(merge)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def query(spark, sf_dir: str) -> DataFrame:
    """Queries: every 50th vec_id; the 5 highest scores of each."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT vec_id, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM v),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score
      FROM c a JOIN c b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

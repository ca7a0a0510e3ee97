"""Near-duplicates by BagMinHash.

A text is the multiset of its 5-word shingles (lower-cased words of letters and digits;
fewer than five words: one shingle of all). For every shingle and weight level a Poisson
process drops points on the line, each on one of ``m`` components at random; a signature
component is the first point over all shingles up to their weights. Two multisets agree
in a component with probability sum(min) / sum(max), their weighted Jaccard similarity.
Weights are discretised in whole counts; level ranges double ([0,1), [1,2), [2,4), ...),
and a point of a range that a weight covers in part descends by a random mark, which is
the range's repeated halving. Points are generated in order and only up to the time at
which all components are full, so the work is about n + m log m.

Bands of the signature propose pairs; each is verified by exact weighted Jaccard.
Exact copies (same words) are one class first. Within a bucket every member is compared
with its smallest member. Where a bucket's members end up in different components, those
outside its largest are compared with all members of other components, in blocks whose
tasks return a spanning forest: no link between components is lost, and a group's pairs
are never listed as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.text import PUNCT, U64, Words, components, grams, mix, slices, stage

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 24
ROWS = 4
BLOCK_SHINGLES = 1 << 19


def shingles(text_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the distinct shingles of a text's word hashes."""
    if not len(text_words):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.unique(grams(text_words, min(SHINGLE, len(text_words))), return_counts=True)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def signature(h: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
    """BagMinHash signature: per component the id of its first point."""
    # one process per shingle and level range that its weight reaches into
    levels = int(weight.max()).bit_length()
    seeds, low, width, top = [], [], [], []
    for k in range(levels + 1):
        start, size = (0, 1) if k == 0 else (1 << (k - 1), 1 << (k - 1))
        at = weight > start
        if at.any():
            seeds.append(mix(h[at], 100 + k))
            low.append(np.full(at.sum(), start))
            width.append(np.full(at.sum(), size))
            top.append(weight[at])
    seeds, low, width, top = map(np.concatenate, (seeds, low, width, top))
    limit = (np.log(m) + 4) / weight.sum()
    while True:
        # all points up to limit; few points per process: some at a time
        step = int(min(256, max(4, 1.2 * limit * m * width.max() + 4)))
        ids, times, comps = [], [], []
        alive = np.arange(len(seeds))
        time = np.zeros(len(seeds))
        first = 0
        while len(alive):
            number = (np.arange(first, first + step, dtype=np.uint64) + U64(1)) * U64(0xD1342543DE82EF95)
            point = mix(seeds[alive][:, None] ^ number[None, :], 7)
            gaps = -np.log(_uniform(mix(point, 11))) / (m * width[alive])[:, None]
            gaps[:, 0] += time[alive]
            at = np.cumsum(gaps, axis=1)
            mark = low[alive][:, None] + (_uniform(mix(point, 13)) * width[alive][:, None]).astype(np.int64)
            row, col = np.nonzero((at <= limit) & (mark < top[alive][:, None]))
            ids.append(point[row, col])
            times.append(at[row, col])
            comps.append((mix(ids[-1], 17) % U64(m)).astype(np.int64))
            time[alive] = at[:, -1]
            alive = alive[at[:, -1] <= limit]
            first += step
        ids, times, comps = map(np.concatenate, (ids, times, comps))
        order = np.argsort(times, kind="stable")
        found, where = np.unique(comps[order], return_index=True)
        if len(found) == m:
            return ids[order][where]
        limit *= 2


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    parts = sig.reshape(-1, rows)
    out = np.arange(len(parts), dtype=np.uint64)
    for i in range(rows):
        out = mix(out ^ parts[:, i], 23 + i)
    return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    (ha, wa), (hb, wb) = a, b
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    both = np.minimum(wa[ia], wb[ib]).sum()
    return float(both / (wa.sum() + wb.sum() - both)) if len(ha) or len(hb) else 0.0


def words_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """Word hashes of each text."""
    lower = pc.utf8_lower(texts.cast(pa.large_string()))
    for lo, hi, buf, off in slices(lower):
        w = Words(buf, off, PUNCT)
        h = w.hashes()
        for k in range(hi - lo):
            yield h[w.first[k]:w.first[k + 1]]


def sketch(docs: DataFrame, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, t0, t1, size, bands) of the texts with a word: 128-bit hash of the words
    in order, number of shingles with repeats, band hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, t0, t1, sizes, out = [], [], [], [], []
            for doc, words in zip(b.column(0).to_pylist(), words_of(b.column(1))):
                if not len(words):
                    continue
                place = np.arange(len(words), dtype=np.uint64)
                ids.append(doc)
                t0.append(mix(words + place, 1).sum(dtype=np.uint64).view(np.int64))
                t1.append((mix(words ^ mix(place, 3), 2)).sum(dtype=np.uint64).view(np.int64))
                h, n = shingles(words)
                sizes.append(int(n.sum()))
                out.append(bands(signature(h, n, n_bands * rows), rows).view(np.int64))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "t0": pa.array(t0, pa.int64()), "t1": pa.array(t1, pa.int64()),
                                              "size": pa.array(sizes, pa.int64()), "bands": pa.array(out, pa.list_(pa.int64()))})
    return (docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(run, "doc_id long, t0 long, t1 long, size long, bands array<long>"))


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """pairs(a, b) whose texts(doc_id, text) have a weighted Jaccard of at least threshold."""
    sides = (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
             .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                b = batch.slice(lo, 512)
                last, one, keep = None, None, []
                for center, x, y in zip(b.column(0).to_pylist(), words_of(b.column(2)), words_of(b.column(3))):
                    if center != last:
                        last, one = center, shingles(x)
                    keep.append(weighted_jaccard(one, shingles(y)) >= threshold)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return sides.mapInArrow(run, "a long, b long")


class Block:
    """Members of one bucket (or a block of it) with their multisets over local shingle ids."""

    def __init__(self, table: pa.Table):
        self.head, self.comp, self.main = (table[c].to_numpy() for c in ("head", "comp", "main"))
        self.bands = np.array(table["bands"].to_pylist(), np.int64).reshape(len(table), -1)
        self.sets = []
        for chunk in table["text"].chunks:
            self.sets += [shingles(w) for w in words_of(chunk)]
        self.weight = np.array([int(n.sum()) for _, n in self.sets], np.int64)


def linking(queries: Block, data: Block, band: int, threshold: float) -> list[tuple[int, int]]:
    """Links between queries (outside the bucket's largest component) and data of other
    components, as a spanning forest: a pair whose components are linked already adds
    nothing. A pair that shares an earlier band is met in that band's bucket."""
    length = np.array([len(h) for h, _ in data.sets])
    start = np.concatenate(([0], np.cumsum(length)))
    known, column = np.unique(np.concatenate([h for h, _ in data.sets]), return_inverse=True)
    counts = np.concatenate([n for _, n in data.sets])
    dense = np.zeros(len(known), np.int64)
    names, place = np.unique(np.concatenate((queries.comp, data.comp)), return_inverse=True)
    of_query, of_data = place[:len(queries.comp)], place[len(queries.comp):]
    group = np.arange(len(names))       # representative of each component's linked group
    out = []
    for q in range(len(queries.head)):
        h, n = queries.sets[q]
        both = (data.bands == queries.bands[q]).argmax(axis=1) == band
        ratio = np.minimum(queries.weight[q], data.weight) >= threshold * np.maximum(queries.weight[q], data.weight)
        once = (data.comp == data.main) | (queries.head[q] < data.head)
        pick = np.flatnonzero(both & ratio & once & (group[of_data] != group[of_query[q]]))
        if not len(pick):
            continue
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        same = known[at] == h
        dense[at[same]] = n[same]
        size = length[pick]
        cells = np.repeat(start[pick] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        both = np.add.reduceat(np.minimum(dense[column[cells]], counts[cells]), np.concatenate(([0], np.cumsum(size)[:-1])))
        dense[at[same]] = 0
        alike = pick[both >= threshold * (queries.weight[q] + data.weight[pick] - both)]
        for d in alike:
            x, y = group[of_query[q]], group[of_data[d]]
            if x != y:
                out.append((int(queries.head[q]), int(data.head[d])))
                group[group == x] = y
    return out


def _between_components(split: DataFrame, texts: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links between members of one bucket that are in different components.

    split: (band, value, head, size, comp, main) of buckets with several components.
    Members outside the largest one meet all members. Both sides of a bucket are cut
    into blocks of about ``block`` shingles, so a task's memory is bounded; a bucket of
    ordinary size is one block."""
    outside = F.col("comp") != F.col("main")
    sizes = split.groupBy("band", "value").agg(
        F.ceil(F.sum(F.when(outside, F.col("size"))) / block).cast("int").alias("nq"), F.ceil(F.sum("size") / block).cast("int").alias("nd"))
    rows = (split.join(sizes, ["band", "value"]).join(texts.withColumnRenamed("doc_id", "head"), "head")
            .withColumn("qb", F.pmod(F.xxhash64("head", F.lit(1)), F.col("nq")).cast("int"))
            .withColumn("db", F.pmod(F.xxhash64("head", F.lit(2)), F.col("nd")).cast("int")))
    keep = ["band", "value", "qb", "db", "head", "comp", "main", "bands", "text"]

    def spread(df: DataFrame, column: str, number: str) -> DataFrame:
        one = df.where(F.col(number) == 1).withColumn(column, F.lit(0))
        many = df.where(F.col(number) > 1).withColumn(column, F.explode(F.sequence(F.lit(0), F.col(number) - 1)))
        return one.unionByName(many).select(*keep)
    queries, data = spread(rows.where(outside), "db", "nd"), spread(rows, "qb", "nq").toDF(*keep)

    def solve(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = linking(Block(left), Block(right), key[0].as_py(), threshold) if len(left) and len(right) else []
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})
    by = ["band", "value", "qb", "db"]
    return queries.groupBy(*by).cogroup(data.groupBy(*by)).applyInArrow(solve, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n_bands: int = BANDS, rows: int = ROWS,
                    block: int = BLOCK_SHINGLES) -> DataFrame:
    """docs(doc_id integer, text) -> doc_id, class_id (smallest doc_id of the connected
    component of links), one row per distinct non-null doc_id.

    Links join texts of weighted Jaccard >= threshold. A pair at 0.8 is proposed with
    probability 1 - (1 - 0.8 ** rows) ** n_bands (0.999997 as set), a more similar one more
    surely; equal texts always link. Null, empty and wordless texts link with nothing:
    they are classes of their own. Rows with a null doc_id are left out. Rows that
    repeat a doc_id count as one document that has the links of each.
    """
    staged = stage(sketch(docs, n_bands, rows), "sketch")
    # exact classes: the smallest doc_id stands for all copies
    heads = stage(staged.groupBy("t0", "t1").agg(F.min("doc_id").alias("head"), F.first("size").alias("size"), F.first("bands").alias("bands")), "heads")
    copies = staged.select("doc_id", "t0", "t1").join(heads.select("t0", "t1", "head"), ["t0", "t1"]).select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    buckets = heads.select("head", "size", F.posexplode("bands").alias("band", "value"))
    low = buckets.groupBy("band", "value").agg(F.min("head").alias("center"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = stage(buckets.join(low, ["band", "value"]), "members")
    stars = stage(members.where("head <> center").select(F.col("center").alias("a"), F.col("head").alias("b")).distinct(), "stars")
    # texts of the proposed documents; the others are not moved on
    wanted = heads.select("head", "bands").join(members.select("head").distinct(), "head", "left_semi").withColumnRenamed("head", "doc_id")
    texts = stage(docs.select(F.col("doc_id").cast("long"), "text").join(wanted, "doc_id"), "texts")
    links = verify(stars, texts.drop("bands"), threshold)
    comp = stage(components(members.select(F.col("head").alias("node")), links), "comp")
    # members of one bucket in different components: compare each outside the largest with all others
    labelled = members.join(comp.withColumnRenamed("node", "head"), "head").select("band", "value", "head", "size", "comp")
    counts = labelled.groupBy("band", "value", "comp").agg(F.count("*").alias("n"))
    main = (counts.groupBy("band", "value").agg(F.max(F.struct("n", "comp")).alias("m"), F.count("*").alias("k"))
            .where("k > 1").select("band", "value", F.col("m.comp").alias("main")))
    split = stage(labelled.join(main, ["band", "value"]), "split")
    more = stage(_between_components(split, texts, threshold, block), "more")
    # the new links join components
    x, y = comp.selectExpr("node AS a", "comp AS ca"), comp.selectExpr("node AS b", "comp AS cb")
    joined = components(comp.select(F.col("comp").alias("node")), more.join(x, "a").join(y, "b").selectExpr("ca AS a", "cb AS b"))
    final = stage(comp.join(joined.selectExpr("node AS comp", "comp AS last"), "comp").selectExpr("node AS a", "last AS comp"), "classes")
    # copies follow their head; a document that repeats with other texts joins its classes
    member_of = copies.join(final, "a", "left").select(F.col("b").alias("node"), F.coalesce("comp", "a").alias("comp"))
    nodes = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("node"))
    if _repeats(docs):
        return components(nodes, member_of.selectExpr("node AS a", "comp AS b")).selectExpr("node AS doc_id", "comp AS class_id")
    return nodes.join(member_of, "node", "left").select(F.col("node").alias("doc_id"), F.coalesce("comp", "node").alias("class_id"))


def _repeats(docs: DataFrame) -> bool:
    return bool(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count())


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

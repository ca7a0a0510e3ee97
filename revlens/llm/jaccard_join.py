"""Exact Jaccard join of documents on word n-grams by T-occurrence search (DivideSkip).

A document is the set of its distinct 3-word shingles. Two sets of sizes a and b with
100 * both >= 90 * either share at least ceil(0.9 a) shingles, so a document's partners
are the ones that occur on at least T = ceil(0.9 a) of the inverted lists of its
shingles. DivideSkip keeps the L longest of these lists apart: the short ones are merged,
a document that occurs fewer than T - L times on them is out, and the rest are looked up
in the long lists by binary search.

The index is dealt to tasks so that linked documents surely meet. Their sets differ in
at most H = (a + b) / 19 shingles; shingles are hashed into more than H bins, so at least
one bin of the two holds the same shingles (a bin's signature is a hash of its contents).
Sizes are cut into classes with a common number of bins; a document takes part in its own
class and, near the upper end, in the next. Documents that share signatures, directly or
over others, are one group; each group is an inverted index, in blocks of bounded size
that meet pairwise. A block pair returns a spanning forest of its links, so a group's
pairs are never rows. Equal sets are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from revlens.llm.text import U64, Words, bounded_batches, components, grams, mix, narrow_batches, slices, stage

SHINGLE = 3
BLOCK_SHINGLES = 1 << 20
HEAD_BITS = 24
LEAST_ROOM = 128            # what a small set counts in a block: at most 8,192 sets
MU = 0.01                   # DivideSkip: L = T / (MU * log2(longest list) + 1)
PROBES = 1 << 20            # binary probes made at once
SMALLEST = 9                # smaller sets link with equal sets only
GROWTH = 1.25               # of the size classes; above 10 / 9, so that partners are in neighbouring classes
CLASS_BITS = 0x7F
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# ------------------------------------------------------------------ sets and signatures
def sets_of(texts: pa.Array, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted hashes of each text's distinct shingles (fewer than n words: all as one)."""
    for lo, hi, buf, off in slices(texts):
        w = Words(LOWER[buf], off)
        h = w.hashes()
        for k in range(hi - lo):
            words = h[w.first[k]:w.first[k + 1]]
            yield np.unique(grams(words, min(n, len(words)))) if len(words) else words


def lower_bounds() -> list[int]:
    out = [SMALLEST]
    while out[-1] < 1 << 40:
        out.append(int(out[-1] * GROWTH) + 1)
    return out


BOUNDS = lower_bounds()


def class_of(size: int) -> int:
    return int(np.searchsorted(BOUNDS, size, "right")) - 1


def differences(cls: int) -> int:
    """Most shingles in which two linked sets differ whose larger one is of the class."""
    return 2 * (BOUNDS[cls + 1] - 1) // 19


def signatures(tokens: np.ndarray) -> np.ndarray:
    """Signatures of a set (sorted hashes): two sets that link share at least one."""
    size = len(tokens)
    if size < SMALLEST:
        return np.zeros(0, U64)
    cls = class_of(size)
    out = []
    for c in [cls] + [cls + 1] * (10 * size >= 9 * BOUNDS[cls + 1]):
        most = differences(c)
        m = most + 2 + most // 16
        bins = (mix(tokens, 5) % U64(m)).astype(np.int64)
        order = np.argsort(bins, kind="stable")
        names, first = np.unique(bins[order], return_index=True)
        content = np.add.reduceat(mix(tokens, 6)[order], first)
        out.append(mix(mix(content, 7) ^ names.astype(U64), 8) & ~U64(0xFF) | U64(c))
        if len(names) <= most:      # too many empty bins for the guarantee: the prefix filter's tokens
            prefix = tokens[:size - -(-9 * size // 10) + 1]
            out.append(mix(prefix, 9) & ~U64(0xFF) | U64(0x80 | c))
    return np.concatenate(out)


def sketch(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, size, t0, t1, sigs) of every document: set size, 128-bit hash of the set, signatures."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, t0, t1, sigs = [], [], [], []
            for tokens in sets_of(b.column(1), n):
                size.append(len(tokens))
                t0.append(mix(tokens, 1).sum(dtype=np.uint64).view(np.int64))
                t1.append(mix(tokens, 2).sum(dtype=np.uint64).view(np.int64))
                sigs.append(signatures(tokens).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(t0, pa.int64()), pa.array(t1, pa.int64()), pa.array(sigs, pa.list_(pa.int64()))],
                ["doc_id", "size", "t0", "t1", "sigs"])
    return (docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(run, "doc_id long, size long, t0 long, t1 long, sigs array<long>"))


def sharing(heads: DataFrame) -> DataFrame:
    """heads(head, sigs) -> (cls, a, b): pairs that connect all documents that share a signature.

    Signatures repeated within an Arrow batch are connected there and go on once, so a
    signature that a large part of the documents shares is small before the shuffle. One
    exchange by signature and a sort bring the others together; rows that follow each other
    with one signature are connected with the first, whatever their number. The first is the
    smallest document, so a group's many signatures mostly give the same few pairs."""
    def stars(sig: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a row begins its signature, the first document of each row's signature)."""
        begins = np.concatenate(([True], sig[1:] != sig[:-1]))
        return begins, head[np.maximum.accumulate(np.where(begins, np.arange(len(sig)), 0))]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            sig = lists.flatten().to_numpy()
            if not len(sig):
                continue
            head = np.repeat(b.column(0).to_numpy(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            order = np.lexsort((head, sig))
            sig, head = sig[order], head[order]
            alone, center = stars(sig, head)
            pairs = np.unique(np.stack((sig[~alone] & CLASS_BITS, center[~alone], head[~alone])), axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((sig[alone], pairs[0]))), pa.array(np.concatenate((head[alone], pairs[1]))),
                 pa.concat_arrays([pa.nulls(int(alone.sum()), pa.int64()), pa.array(pairs[2])])], ["sig", "a", "b"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            known = batch.filter(pc.is_valid(batch.column(2)))
            new = batch.filter(pc.is_null(batch.column(2)))
            sig, head = new.column(0).to_numpy(), new.column(1).to_numpy()
            if last is not None:
                sig, head = np.concatenate((last[0], sig)), np.concatenate((last[1], head))
            if len(sig):
                begins, center = stars(sig, head)
                last = (sig[-1:], center[-1:])
                sig, center, head = sig[~begins], center[~begins], head[~begins]
            else:
                center = head
            found = np.stack((np.concatenate((known.column(0).to_numpy(), sig)) & CLASS_BITS,
                              np.concatenate((known.column(1).to_numpy(), center)), np.concatenate((known.column(2).to_numpy(), head))))
            found = np.unique(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["cls", "a", "b"])
    met = heads.select("head", "sigs").mapInArrow(first, "sig long, a long, b long")
    return (met.repartition("sig").sortWithinPartitions("sig", "a").mapInArrow(follow, "cls long, a long, b long")
            .where("a <> b").distinct())


# ------------------------------------------------------------------ T-occurrence search
class Index:
    """Inverted lists over the sets of a block: ``key`` holds list * n + document, sorted."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        self.size = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets) if sets else np.zeros(0, U64)
        document = np.repeat(np.arange(self.n), self.size)
        self.vocabulary, place = np.unique(tokens, return_inverse=True)
        self.key = np.sort(place * self.n + document)
        self.start = np.searchsorted(self.key, np.arange(len(self.vocabulary) + 1) * self.n)

    def partners(self, tokens: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Documents among ``wanted`` (booleans) whose set links with ``tokens``."""
        size = len(tokens)
        least = -(-9 * size // 10)
        at = np.minimum(np.searchsorted(self.vocabulary, tokens), len(self.vocabulary) - 1)
        lists = at[self.vocabulary[at] == tokens] if len(self.vocabulary) else at[:0]
        if not size or len(lists) < least:
            return np.zeros(0, np.int64)
        length = self.start[lists + 1] - self.start[lists]
        lists = lists[np.argsort(length, kind="stable")]
        longs = min(least - 1, int(least / (MU * np.log2(max(2, int(length.max()))) + 1)))
        short, probed = lists[:len(lists) - longs], lists[len(lists) - longs:]
        # merge of the sorted short lists: a stable sort joins their ascending runs
        merged = np.concatenate([self.key[self.start[x]:self.start[x + 1]] - x * self.n for x in short])
        merged = np.sort(merged, kind="stable")
        first = np.flatnonzero(np.diff(merged, prepend=-1))
        documents, seen = merged[first], np.diff(first, append=len(merged))
        need = -(-9 * (size + self.size[documents]) // 19)
        keep = (seen >= least - longs) & (seen + longs >= need) & wanted[documents]
        documents, seen, need = documents[keep], seen[keep], need[keep]
        step = max(1, PROBES // max(1, len(documents)))
        for lo in range(0, longs, step):
            if not len(documents):
                break
            part = probed[lo:lo + step]
            probe = part[:, None] * self.n + documents[None, :]
            place = np.minimum(np.searchsorted(self.key, probe), len(self.key) - 1)
            seen = seen + (self.key[place] == probe).sum(axis=0)
            keep = seen + (longs - lo - len(part)) >= need
            documents, seen, need = documents[keep], seen[keep], need[keep]
        return documents[seen >= need]


class Forest:
    """Which documents of a task are linked already (union by relabelling the smaller side's root)."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: int, b: int) -> bool:
        x, y = self.label[a], self.label[b]
        if x != y:
            self.label[self.label == y] = x
        return x != y


def links(left: list[np.ndarray], right: list[np.ndarray], same: bool) -> list[tuple[int, int]]:
    """Spanning forest of the links between two blocks (or within one): positions in each."""
    index = Index(right)
    forest = Forest(len(right) if same else len(left) + len(right))
    offset = 0 if same else len(left)
    order = np.argsort([len(s) for s in left], kind="stable")
    out = []
    for q in order:
        size = len(left[q])
        wanted = forest.label[offset:offset + len(right)] != forest.label[q]
        wanted &= 10 * np.minimum(size, index.size) >= 9 * np.maximum(size, index.size)
        if same:    # the smaller (then earlier) one asks
            wanted &= (index.size > size) | ((index.size == size) & (np.arange(len(right)) > q))
        if wanted.any():
            out += [(int(q), int(d)) for d in index.partners(left[q], wanted) if forest.join(int(q), offset + int(d))]
    return out


def _group_links(groups: DataFrame, n: int, block: int) -> DataFrame:
    """groups(comp, head, size, text) -> links (a, b) between heads of one group."""
    sizes = groups.groupBy("comp").agg(F.ceil(F.sum(F.greatest("size", F.lit(LEAST_ROOM))) / block).cast("int").alias("blocks"))
    rows = groups.join(sizes, "comp").withColumn("own", F.pmod(F.xxhash64("head"), F.col("blocks")).cast("int"))
    # block pairs (q, d), q <= d: a document asks in (own, d) and is asked in (q, own)
    asks = rows.select("comp", F.col("own").alias("q"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("d"), "head", "text")
    asked = rows.where("own > 0").select("comp", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("q"), F.col("own").alias("d"), "head", "text")
    asked = asked.toDF("comp", "q", "d", "head", "text")

    def read(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
        return t["head"].to_numpy(), [s for chunk in t["text"].chunks for s in sets_of(chunk, n)]

    def solve(key, left: pa.Table, right: pa.Table) -> pa.Table:
        same = key[1].as_py() == key[2].as_py()
        a, mine = read(left)
        b, other = (a, mine) if same else read(right)
        found = links(mine, other, same) if len(a) and len(b) else []
        return pa.table({"a": pa.array([int(a[x]) for x, _ in found], pa.int64()), "b": pa.array([int(b[y]) for _, y in found], pa.int64())})
    by = ["comp", "q", "d"]
    return asks.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(solve, "a long, b long")


def _likely(text: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of text(head, text) that may be in groups: the heads' hashes in a bit table of fixed size
    (2 MB), so that the join moves few other texts. Where there are more heads than bits it lets
    all through."""
    bit = F.pmod(F.xxhash64("head"), F.lit(1 << HEAD_BITS))
    words = (groups.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).cast("int").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits")).toPandas())
    table = np.zeros(1 << (HEAD_BITS - 6), np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = text.sparkSession.sparkContext.broadcast(table)

    @pandas_udf("boolean")
    def may(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series((shared.value[at >> 6] >> (at & 63) & 1).astype(bool))
    return text.where(may(bit))


def jaccard_join(docs: DataFrame, n: int = SHINGLE, block: int = BLOCK_SHINGLES) -> DataFrame:
    """docs(doc_id integer, text) -> doc_id, n_shingles, component_id (smallest doc_id
    reachable over links), one row per distinct non-null doc_id.

    Words are maximal runs of bytes other than ASCII white space, A-Z lower-cased. Null
    and wordless texts have no shingle and link with nothing; a text of fewer than ``n``
    words is one shingle. Rows with a null doc_id are left out; rows that repeat a
    doc_id are one document with the links of each and the largest of their sizes.
    Shingles are compared by 64-bit hashes, sets for equality by 128 bits.
    """
    bounded_batches(docs.sparkSession)
    staged = stage(sketch(docs, n), "join-sketch")
    heads = stage(staged.where("size > 0").groupBy("t0", "t1", "size").agg(F.min("doc_id").alias("head"), F.first("sigs").alias("sigs")), "join-heads")
    copies = (staged.where("size > 0").select("doc_id", "t0", "t1", "size")
              .join(heads.select("t0", "t1", "size", "head"), ["t0", "t1", "size"]).select("doc_id", "head"))
    # one node per document and size class; which documents of a class share signatures
    with narrow_batches(docs.sparkSession):
        meets = stage(sharing(heads), "join-meets")
    ends = meets.select("cls", F.col("a").alias("head")).unionByName(meets.select("cls", F.col("b").alias("head"))).distinct()
    nodes = ends.withColumn("node", F.xxhash64("head", "cls"))
    grouped = components(nodes.select("node"), meets.select(F.xxhash64("a", "cls").alias("a"), F.xxhash64("b", "cls").alias("b")))
    groups = stage(nodes.join(grouped, "node").join(heads.select("head", "size"), "head").select("comp", "head", "size").distinct(), "join-groups")
    text = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("head"), "text")
    texts = stage(groups.join(_likely(text, groups), "head"), "join-texts")
    found = stage(_group_links(texts, n, block).distinct(), "join-links")
    linked = components(groups.select(F.col("head").alias("node")), found)
    member_of = copies.join(linked.selectExpr("node AS head", "comp"), "head", "left").select("doc_id", F.coalesce("comp", "head").alias("comp"))
    sizes = staged.groupBy("doc_id").agg(F.max("size").alias("n_shingles"))
    if _repeats(docs):
        of = components(sizes.select(F.col("doc_id").alias("node")), member_of.selectExpr("doc_id AS a", "comp AS b")).selectExpr("node AS doc_id", "comp")
    else:
        of = member_of
    return sizes.join(of, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))


def _repeats(docs: DataFrame) -> bool:
    return bool(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count())


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS g FROM w),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
u AS (SELECT doc_id, unnest(g) AS g FROM s),
overlap AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM overlap JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON link.x = reach.r)
SELECT n.doc_id, n.n AS n_shingles, min(r) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY ALL
"""

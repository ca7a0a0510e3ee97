"""Filter interaction audit: what each filter removes in every order of application.

A byte transducer reads every text once. Its state after a byte (between words, at the
end of a code point of a word, inside one) is given by that byte's class, so one table
of (state, class) gives the actions of all positions of a slice at once: word starts and
ends, code points, capitals, symbols. The word spans go into an open-addressing hash
table; a span that meets an occupied slot is compared with the slot's word byte by byte
and moves on if they differ, so distinct counts are exact.

A text's failures are a mask of five bits. Rows of equal part, mask and labels are
counted; the 120 orders are then arithmetic on 32 counts a part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import permutations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.text import U64, WHITE, bounded_batches, mix, slices, stage

FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 2
SYMBOLS = b"#$%&*|"
WIDE = 64                   # words of more bytes are compared one by one

# byte classes: white space, capital, symbol, other ASCII, lead byte, continuation byte
SPACE, CAPITAL, SYMBOL, PLAIN, LEAD, CONTINUATION = range(6)
CLASS = np.full(256, PLAIN, np.uint8)
CLASS[WHITE] = SPACE
CLASS[65:91] = CAPITAL
CLASS[list(SYMBOLS)] = SYMBOL
CLASS[0x80:0xC0] = CONTINUATION
CLASS[0xC0:] = LEAD
# states and the state that a byte of each class leads to
BETWEEN, WORD, INSIDE = range(3)
NEXT = np.array([BETWEEN, WORD, WORD, WORD, INSIDE, INSIDE], np.uint8)
# actions, as bits of ACTION[state, class]
STARTS, ENDS, POINT, IS_CAPITAL, IS_SYMBOL = 1, 2, 4, 8, 16
ACTION = np.array([[(STARTS if state == BETWEEN and c != SPACE else 0) | (ENDS if state != BETWEEN and c == SPACE else 0)
                    | (POINT if c != CONTINUATION else 0) | (IS_CAPITAL if c == CAPITAL else 0) | (IS_SYMBOL if c == SYMBOL else 0)
                    for c in range(6)] for state in range(3)], np.uint8)


class Transducer:
    """One pass over the texts of a slice: word spans and counts per text."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        kind = CLASS[buf]
        state = np.empty(len(buf), np.uint8)
        state[1:] = NEXT[kind[:-1]]
        state[off[:-1][off[:-1] < len(buf)]] = BETWEEN        # every text starts between words
        action = ACTION[state, kind]
        self.start = np.flatnonzero(action & STARTS)
        # a word ends at its white space or with its text
        last = np.unique(off[1:][off[1:] > off[:-1]]) - 1
        end = np.concatenate((np.flatnonzero(action & ENDS), last[kind[last] != SPACE] + 1))
        self.end = np.sort(end)
        self.text = np.searchsorted(off, self.start, "right") - 1
        self.buf, n = buf, len(off) - 1
        self.words = np.bincount(self.text, minlength=n)

        def per_text(bit: int) -> np.ndarray:
            return np.diff(np.searchsorted(np.flatnonzero(action & bit), off))
        self.points, self.capitals, self.symbols = per_text(POINT), per_text(IS_CAPITAL), per_text(IS_SYMBOL)

    def distinct(self) -> np.ndarray:
        """Distinct words of each text: spans inserted into one hash table of (text, word)."""
        n = len(self.words)
        count = np.zeros(n, np.int64)
        if not len(self.start):
            return count
        length = self.end - self.start
        # the 8 bytes from each position on, little-endian
        eight = np.concatenate((self.buf, np.zeros(8, np.uint8))).astype(U64)
        for shift in (1, 2, 4):
            eight[:-shift] |= eight[shift:] << U64(8 * shift)
        tail = (U64(1) << (U64(8) * np.arange(8, dtype=U64))) - U64(1)

        def chunk(word: np.ndarray, k: int) -> np.ndarray:
            """Bytes k .. k + 7 of the words, zero beyond their end."""
            left = length[word] - k
            return np.where(left >= 8, eight[self.start[word] + np.minimum(k, length[word])], eight[self.start[word] + np.minimum(k, length[word])] & tail[np.clip(left, 0, 7)])
        everyone = np.arange(len(length))
        h = mix(self.text.astype(U64) ^ (length.astype(U64) << U64(32)))
        wide = length > WIDE
        rest = everyone
        for k in range(0, min(WIDE, int(length.max())), 8):
            rest = rest[length[rest] > k]
            h[rest] = mix(h[rest] ^ chunk(rest, k), 1)
        for i in np.flatnonzero(wide):
            h[i] ^= U64(crc32(self.buf[self.start[i]:self.end[i]]))

        def equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            same = (self.text[a] == self.text[b]) & (length[a] == length[b]) & (h[a] == h[b])
            at = np.flatnonzero(same)
            for k in range(0, WIDE, 8):
                at = at[length[a[at]] > k]
                if not len(at):
                    break
                same[at] &= chunk(a[at], k) == chunk(b[at], k)
                at = at[same[at]]
            for i in np.flatnonzero(same & wide[a]):
                x, y, size = self.start[a[i]], self.start[b[i]], length[a[i]]
                same[i] = np.array_equal(self.buf[x:x + size], self.buf[y:y + size])
            return same
        slots = 1 << int(2 * len(length) - 1).bit_length()
        table = np.full(slots, -1, np.int64)
        probe = (h & U64(slots - 1)).astype(np.int64)
        waiting = everyone
        while len(waiting):
            slot = probe[waiting]
            free = table[slot] < 0
            table[slot[free][::-1]] = waiting[free][::-1]      # of several, the first stays
            owner = table[slot]
            new = owner == waiting
            count += np.bincount(self.text[waiting[new]], minlength=n)
            waiting, owner = waiting[~new], owner[~new]
            waiting = waiting[~equal(waiting, owner)]
            probe[waiting] = (probe[waiting] + 1) & (slots - 1)
        return count


def failures(texts: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Mask of the failed filters A to D of each text (bit 0: A), and the text's digest."""
    masks, digests = [np.zeros(0, np.int64)], []
    for _, _, buf, off in slices(texts):
        t = Transducer(buf, off)
        fails = (t.words < MIN_WORDS, 100 * t.distinct() < DISTINCT_PERCENT * t.words,
                 100 * t.capitals > CAPITAL_PERCENT * t.points, t.symbols > 0)
        masks.append(sum(f.astype(np.int64) << i for i, f in enumerate(fails)))
        raw = memoryview(np.ascontiguousarray(buf))
        digests += [sha256(raw[a:b]).digest() for a, b in zip(off[:-1], off[1:])]
    return np.concatenate(masks), digests


def masks(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source) -> (doc_id, part, digest, mask of A to D)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask, digest = failures(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digest, pa.binary()), pa.array(mask, pa.int32())],
                                             ["doc_id", "part", "digest", "mask"])
    return (docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, part string, digest binary, mask int"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text, source), labels(doc_id, quality, toxic) -> one row per part,
    filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null texts are empty, null sources the part ''. A document is good (toxic) if any label row
    of its doc_id says 1; without one, or with a null doc_id, it is neither. Rows that repeat a
    doc_id are counted each. Filter E: equal text under a smaller doc_id; a null doc_id is
    neither smaller nor larger than another. Equality of texts is that of their SHA-256. An empty table has no part.
    """
    bounded_batches(docs.sparkSession)
    rows = stage(masks(docs), "audit-masks")
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    marks = (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))
    repeated = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    counted = (rows.join(first, "digest", "left").join(marks, "doc_id", "left")
               .groupBy("part", (F.col("mask") + F.when(repeated, 16).otherwise(0)).alias("mask"))
               .agg(F.count("*").alias("n"), F.count_if(F.col("good")).alias("g"), F.count_if(F.col("toxic")).alias("t")))
    # at most 32 counts a part; 600 steps: an order, the filters before the step, its own filter
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "g", "t")).alias("counts"))
    steps = []
    for order in permutations(range(5)):
        before = 0
        for step, i in enumerate(order, 1):
            steps.append(F.struct(F.lit("".join(FILTERS[x] for x in order)).alias("filter_order"), F.lit(step).alias("step"),
                                  F.lit(before).alias("before"), F.lit(1 << i).alias("own")))
            before |= 1 << i
    placed = parts.select("part", "counts", F.explode(F.array(*steps)).alias("s")).select("part", "counts", "s.*")

    def total(column: str, condition: Callable[[Column], Column]) -> Column:
        chosen = F.filter("counts", lambda c: condition(c["mask"]))
        return F.aggregate(chosen, F.lit(0).cast("long"), lambda sum_, c: sum_ + c[column])
    before, own = F.col("before"), F.col("own")

    def removed(m: Column) -> Column:
        return (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) == 0)
    out = placed.select(
        "part", "filter_order", "step", "own", total("n", lambda m: m.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        total("n", removed).alias("removed"), total("n", lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"), total("g", removed).alias("good_lost"), total("t", removed).alias("toxic_lost"))
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")


def query(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
        [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
         regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), FALSE)] AS x
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
i AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, i AS step, o[i] AS mine FROM o, i),
r AS (SELECT part, list_reduce(list_transform(o, lambda k: substr('ABCDE', k, 1)), lambda p, q: concat(p, q)) AS filter_order, step, mine,
        x[mine] AS fails, len(list_filter(o[1:step - 1], lambda k: x[k])) > 0 AS gone,
        len(list_filter(o, lambda k: k <> mine AND x[k])) = 0 AS alone, good, toxic FROM f, s),
c AS (SELECT part, filter_order, step, mine, count(*) FILTER (NOT gone AND NOT fails) AS kept, count(*) FILTER (fails AND NOT gone) AS removed,
        count(*) FILTER (fails AND gone) AS redundant, count(*) FILTER (fails AND alone) AS unique_fails,
        count(*) FILTER (fails AND NOT gone AND good = 1) AS good_lost, count(*) FILTER (fails AND NOT gone AND toxic = 1) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, mine) AS BIGINT) AS shapley FROM c
"""

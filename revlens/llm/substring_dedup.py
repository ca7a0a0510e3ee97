"""Substring dedup by difference-cover anchors.

Words are runs of bytes other than the six ASCII white-space characters. A window is 13
consecutive words of one document; a word goes if a window that covers it also starts in
a document with a smaller doc_id (windows are judged on the input).

A set D of residues is a difference cover modulo v if for any two positions some shift
below v brings both to residues in D. So two equal windows share an aligned pair of
shorter windows (anchors) that start at cover positions: it is enough to hash anchors at
3 of 7 positions (D = {0, 1, 3}, v = 7, anchors of 7 words). Where an anchor occurs in
two documents, it is extended to the 13-word windows around it; those are compared.

Layout: texts are dealt once into buckets of about ``bucket_bytes``; every step reads
that one exchange. A bucket sends sorted runs of distinct hashes, cut by hash range, so a
passage that a third of all documents share is one entry per bucket; ranges answer each
bucket with the hashes that matter to it. No pair of documents is ever listed.
Anchors are 48-bit hashes (a collision only adds windows to compare), windows 64-bit.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.text import U64, Words, grams, partitions, slices, total_bytes

WINDOW = 13
COVER = (0, 1, 3)
PERIOD = 7
ANCHOR = WINDOW - PERIOD + 1
BUCKET_BYTES = 4 << 20
HASH_BITS = 48
_MESSAGE = "b int, p int, hashes binary, docs binary"


def _in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Membership of values in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def _ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    col = table["doc_id"].combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.int64())
    return col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(col.is_valid())


def _parts(table: pa.Table):
    """(first row, Words, word hashes) of the slices of a bucket's texts."""
    row = 0
    for chunk in table["text"].chunks:
        for lo, hi, buf, off in slices(chunk):
            w = Words(buf, off)
            yield row + lo, w, w.hashes()
        row += len(chunk)


def _whole(first: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of the runs of ``size`` words that start at each word lie within one text."""
    ok = np.zeros(max(0, n - size + 1), bool)
    left = np.repeat(first[1:], np.diff(first))[:len(ok)]
    ok[:] = np.arange(len(ok)) + size <= left
    return ok


def _anchors(w: Words, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the anchor at every word, which are whole and at a cover position)."""
    h = grams(words, ANCHOR) >> U64(64 - HASH_BITS)
    place = (np.arange(len(h)) - np.repeat(w.first[:-1], np.diff(w.first))[:len(h)]) % PERIOD
    return h, _whole(w.first, ANCHOR, len(words)) & np.isin(place, COVER)


def _pack(h: np.ndarray) -> bytes:
    """Sorted hashes as first value and differences, in 32 bits where they fit."""
    d = np.diff(h, prepend=U64(0))
    if len(d) > 1 and d[1:].max() < 1 << 32:
        return b"4" + d[:1].tobytes() + d[1:].astype(np.uint32).tobytes()
    return b"8" + d.tobytes()


def _unpack(b: bytes) -> np.ndarray:
    if b[:1] == b"4":
        d = np.concatenate((np.frombuffer(b, U64, 1, 1), np.frombuffer(b, np.uint32, -1, 9).astype(U64)))
    else:
        d = np.frombuffer(b, U64, -1, 1)
    return np.cumsum(d, dtype=U64)


def _message(b: int, rows: list[tuple]) -> pa.Table:
    return pa.table({"b": pa.array([b if r[0] is None else r[0] for r in rows], pa.int32()),
                     "p": pa.array([r[1] for r in rows], pa.int32()),
                     "hashes": pa.array([r[2] for r in rows], pa.binary()),
                     "docs": pa.array([r[3] for r in rows], pa.binary())})


def _cut(h: np.ndarray, bits: int, ranges: int):
    """Bounds of the equal hash ranges in sorted hashes: (range, lo, hi) of those with rows."""
    step = ((1 << bits) + ranges - 1) // ranges
    edges = np.searchsorted(h, np.array([min(step * i, (1 << bits) - 1) for i in range(1, ranges)], U64))
    edges = np.concatenate(([0], edges, [len(h)]))
    return ((p, edges[p], edges[p + 1]) for p in range(ranges) if edges[p] < edges[p + 1])


def _bucket_number(table: pa.Table) -> int:
    return table["b"][0].as_py()


def deduplicate(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs(doc_id integer, text) -> doc_id, n_words, n_removed, kept_text; a row per row.

    kept_text: the kept words joined by one space. Null or empty texts: no words, kept
    text empty. A null doc_id neither removes nor loses words. Rows that repeat a doc_id
    don't remove from one another (neither id is smaller). Other columns are not read.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tasks = partitions(spark)
    buckets = max(tasks, -(-total_bytes(docs, "text") // bucket_bytes))
    ranges = buckets
    base = (docs.withColumn("b", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))
            .repartition(max(tasks, min(buckets, 4 * tasks)), "b"))

    def send_anchors(table: pa.Table) -> pa.Table:
        ids, valid = _ids(table)
        hs, ds = [], []
        for row, w, words in _parts(table):
            h, at = _anchors(w, words)
            doc = row + np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))[:len(h)]
            at = at & valid[doc] if len(h) else at
            hs.append(h[at])
            ds.append(ids[doc[at]])
        h, d = (np.concatenate(x) if x else np.zeros(0, U64) for x in (hs, ds))
        if not len(h):
            return _message(0, [])
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        # equal hashes of one document stand together, so a second document shows between neighbours
        other = np.zeros(len(h), bool)
        other[1:] = ~new[1:] & (d[1:] != d[:-1])
        many = np.add.reduceat(other, np.flatnonzero(new)) > 0
        h = h[new]
        return _message(_bucket_number(table), [
            (None, p, _pack(h[lo:hi]), np.packbits(many[lo:hi]).tobytes()) for p, lo, hi in _cut(h, HASH_BITS, ranges)])

    def share_anchors(table: pa.Table) -> pa.Table:
        """Answers each bucket with those of its anchors that occur in two documents."""
        bs = table["b"].to_pylist()
        runs = [_unpack(x) for x in table["hashes"].to_pylist()]
        many = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(r)).astype(bool)
                for m, r in zip(table["docs"].to_pylist(), runs)]
        h = np.concatenate(runs)
        known, count = np.unique(h, return_counts=True)
        shared = np.union1d(known[count > 1], np.concatenate([r[m] for r, m in zip(runs, many)]))
        rows = [(b, 0, _pack(x), None) for b, r in zip(bs, runs) if len(x := r[_in(r, shared)])]
        return _message(0, rows)

    def send_windows(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(texts) or not len(answers):
            return _message(0, [])
        ids, valid = _ids(texts)
        shared = np.sort(np.concatenate([_unpack(x) for x in answers["hashes"].to_pylist()]))
        hs, ds = [], []
        for row, w, words in _parts(texts):
            if len(words) < WINDOW:
                continue
            h, at = _anchors(w, words)
            hit = np.zeros(len(h) + 1, np.int64)
            found = np.flatnonzero(at)
            hit[found[_in(h[found], shared)] + 1] = 1
            hit = np.cumsum(hit)
            near = _whole(w.first, WINDOW, len(words))
            # extend: the windows in which an anchor begins within the first PERIOD words
            start = np.arange(len(near))
            near &= hit[start + PERIOD] > hit[start]
            doc = row + np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))[:len(near)]
            near &= valid[doc]
            hs.append(grams(words, WINDOW)[near])
            ds.append(ids[doc[near]])
        h, d = (np.concatenate(x) if x else np.zeros(0, U64) for x in (hs, ds))
        if not len(h):
            return _message(0, [])
        order = np.lexsort((d, h))
        h, d = h[order], d[order].astype(np.int64)
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        h, d = h[new], d[new]
        return _message(_bucket_number(texts), [
            (None, p, h[lo:hi].tobytes(), d[lo:hi].tobytes()) for p, lo, hi in _cut(h, 64, ranges)])

    def share_windows(table: pa.Table) -> pa.Table:
        """Answers each bucket with those of its windows that a smaller document elsewhere has."""
        bs = table["b"].to_pylist()
        runs = [np.frombuffer(x, U64) for x in table["hashes"].to_pylist()]
        least = [np.frombuffer(x, np.int64) for x in table["docs"].to_pylist()]
        h, d = np.concatenate(runs), np.concatenate(least)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        h, d = h[new], d[new]
        rows = [(b, 0, x.tobytes(), None) for b, r, m in zip(bs, runs, least)
                if len(x := r[d[np.searchsorted(h, r)] < m])]
        return _message(0, rows)

    def drop(texts: pa.Table, answers: pa.Table) -> pa.Table:
        ids, valid = _ids(texts)
        outside = (np.sort(np.concatenate([np.frombuffer(x, U64) for x in answers["hashes"].to_pylist()]))
                   if len(answers) else np.zeros(0, U64))
        hs, ds, parts = [], [], []
        for row, w, words in _parts(texts):
            h = grams(words, WINDOW)
            ok = _whole(w.first, WINDOW, len(words))
            doc = row + np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))[:len(h)]
            ok &= valid[doc]
            hs.append(h[ok])
            ds.append(ids[doc[ok]])
            parts.append((w, len(h), np.flatnonzero(ok)))
        h, d = (np.concatenate(x) if x else np.zeros(0, U64) for x in (hs, ds))
        gone = _in(h, outside)
        if len(h):   # and the windows that a smaller document of the same bucket has
            order = np.lexsort((d, h))
            new = np.ones(len(h), bool)
            new[1:] = h[order][1:] != h[order][:-1]
            least = d[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
            gone[order] |= least < d[order]
        kept, total, removed = [], [], []
        at = 0
        for w, _, ok in parts:
            cover = np.zeros(len(w) + 1, np.int64)
            starts = ok[gone[at:at + len(ok)]]
            at += len(ok)
            np.add.at(cover, starts, 1)
            np.add.at(cover, np.minimum(starts + WINDOW, len(w)), -1)
            keep = np.cumsum(cover[:-1]) == 0
            raw = w.buf.tobytes()
            for k in range(len(w.first) - 1):
                lo, hi = w.first[k], w.first[k + 1]
                total.append(hi - lo)
                own = keep[lo:hi]
                n = int(own.sum())
                removed.append(hi - lo - n)
                if not n:
                    kept.append("")
                    continue
                all_words = raw[w.start[lo]:w.end[hi - 1]].split()
                kept.append(b" ".join(all_words if n == hi - lo else itertools.compress(all_words, own)).decode("utf-8", "replace"))
        out = pa.table({"doc_id": texts["doc_id"], "n_words": pa.array(total, pa.int64()),
                        "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.large_string())})
        return out.set_column(3, "kept_text", out["kept_text"].cast(pa.string()))

    anchors = base.groupBy("b").applyInArrow(send_anchors, _MESSAGE)
    shared = anchors.groupBy("p").applyInArrow(share_anchors, _MESSAGE)
    windows = base.groupBy("b").cogroup(shared.groupBy("b")).applyInArrow(send_windows, _MESSAGE)
    removal = windows.groupBy("p").applyInArrow(share_windows, _MESSAGE)
    out = base.groupBy("b").cogroup(removal.groupBy("b")).applyInArrow(
        drop, "doc_id long, n_words long, n_removed long, kept_text string")
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return deduplicate(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s
        FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
low AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
gone AS (SELECT DISTINCT r, i + k AS j FROM (SELECT win.r, win.i FROM win JOIN low USING (s) WHERE low.least < win.doc_id),
         (SELECT unnest(range(0, 13)) AS k)),
words AS (SELECT r, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""

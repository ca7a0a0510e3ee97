"""Benchmark decontamination by q-gram lemma filtering.

Texts are lower-cased and white space is one space. The tiles of a benchmark item are its
windows of ``tile`` characters at every ``step`` (and one at its end; a shorter item is one
tile); by default at every character, so each of its passages of that length. A document
is contaminated by an item if a tile aligns with some part of it within ``rate`` edits a
character.

Filter: an alignment of a tile of w characters with at most e edits keeps at least
t = w - q + 1 - q e of the tile's q-grams, all within 2 e diagonals. Diagonals are covered
by bands of 4 e that overlap by half, so one band holds them all; bands with t hits of
one tile are retained: q-grams are indexed once per item, and in a band's sorted hits
those t that lie within a tile's length name the tiles. Verification: verbatim tiles by
comparison, the others by edit distance of the tile against the document along the
band's diagonals, all retained tiles of a batch at once.
No passage of ``tile`` characters that is within the edit budget is lost; shorter ones out
of a longer item are not searched. Tests compare with a full scan over all substrings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from revlens.llm.text import U64, bounded_batches

Q = 10
TILE = 50
STEP = 1
RATE = 0.06
MIN_CHARS = 20
BLOCK_CHARS = 4 << 20
FILTER_BITS = 22
SLICE_CHARS = 1 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def tiles_of(n: int, tile: int = TILE, step: int = STEP) -> list[tuple[int, int]]:
    """(start, length) of the tiles of an item of n characters."""
    if n <= tile:
        return [(0, n)]
    return [(s, tile) for s in sorted({*range(0, n - tile + 1, step), n - tile})]


def budget(length: int, rate: float = RATE, q: int = Q) -> int:
    """Edits allowed for a tile: rate * length, but no more than the lemma can filter."""
    return max(0, min(int(rate * length), (length - q) // q))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")


def _qgrams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hash of the q-gram at each place."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, U64)
    c = codes.astype(U64)
    h = np.zeros(n, U64)
    for i in range(q):
        h = h * U64(0x9E3779B97F4A7C15) + c[i:i + n]
    return h * U64(0xD6E8FEB86659FD93)


@dataclass
class Index:
    """q-gram index of one block of items."""
    size: np.ndarray      # of each item: tile length, edits, hits needed, last tile's start
    edits: np.ndarray
    need: np.ndarray
    last: np.ndarray
    codes: list[np.ndarray]
    numbers: np.ndarray   # of each indexed item: its number among the texts
    grams: np.ndarray     # sorted q-grams of the items, with item and place
    item: np.ndarray
    place: np.ndarray
    filter: np.ndarray
    step: int

    @staticmethod
    def build(texts: list[str], tile: int, step: int, rate: float, min_chars: int) -> "Index":
        rows, codes, grams, owner, place = [], [], [], [], []
        for number, text in enumerate(texts):
            whole = _codes(normal(text))
            if len(whole) < max(min_chars, Q):
                continue
            n = min(tile, len(whole))
            e = budget(n, rate)
            g = _qgrams(whole)
            grams.append(g)
            owner.append(np.full(len(g), len(rows)))
            place.append(np.arange(len(g)))
            rows.append((n, e, n - Q + 1 - Q * e, len(whole) - n, number))
            codes.append(whole)
        size, edits, need, last, numbers = np.array(rows, np.int64).reshape(-1, 5).T
        g, o, p = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((grams, U64), (owner, np.int64), (place, np.int64)))
        order = np.argsort(g, kind="stable")
        seen = np.zeros(1 << FILTER_BITS, bool)
        seen[(g >> U64(64 - FILTER_BITS)).astype(np.int64)] = True
        return Index(size, edits, need, last, codes, numbers, g[order], o[order], p[order], seen, step)

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item number, tile start, end in the normalised text, edits) of
        the tiles that align with a text within their budget."""
        found: list[tuple[int, int, int, int, int]] = []
        if not len(self.numbers):
            return found
        lo, size, batch = 0, 0, []
        for i, t in enumerate(texts):
            batch.append(_codes(normal(t)))
            size += len(batch[-1])
            if size >= SLICE_CHARS or i == len(texts) - 1:
                found += self._batch(lo, batch)
                lo, size, batch = i + 1, 0, []
        return found

    def _batch(self, first: int, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        begin = np.cumsum([0] + [len(t) for t in texts])
        text = np.concatenate(texts)
        h = _qgrams(text)
        at = np.flatnonzero(self.filter[(h >> U64(64 - FILTER_BITS)).astype(np.int64)])
        lo, hi = np.searchsorted(self.grams, h[at], "left"), np.searchsorted(self.grams, h[at], "right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        doc = np.searchsorted(begin, at, "right") - 1
        inside = at + Q <= begin[doc + 1]
        at, lo, n, doc = at[inside], lo[inside], n[inside], doc[inside]
        # one hit per q-gram of a text and equal q-gram of an item; their number is bounded by
        # cutting the hits into runs
        out = []
        step = max(1, int(4e6 // max(1, n.max()))) if len(n) else 1
        cuts = [0]
        while cuts[-1] < len(at):
            end = min(len(at), cuts[-1] + step)
            while end < len(at) and doc[end] == doc[end - 1]:
                end += 1      # texts stay whole
            cuts.append(end)
        for a, b in zip(cuts, cuts[1:]):
            out += self._bands(first, texts, begin, at[a:b], lo[a:b], n[a:b], doc[a:b])
        return out

    def _bands(self, first, texts, begin, at, lo, n, doc) -> list[tuple[int, int, int, int, int]]:
        hit = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, place = self.item[hit], self.place[hit]
        doc = np.repeat(doc, n)
        # the diagonal on which the item would start in the text (it may begin before it)
        diagonal = np.repeat(at, n) - begin[doc] - place
        found = self._exact(first, texts, doc, item, diagonal, place)
        half = 2 * self.edits[item] + 1
        keys = [np.stack((doc, item, 2 * ((diagonal + shift * half) // (2 * half)) - shift, place)) for shift in (0, 1)]
        key = np.concatenate(keys, axis=1)
        key = key[:, np.lexsort(key[::-1])]
        # different q-gram places of the item in the band
        key = key[:, _changes(key)]
        group = np.cumsum(_changes(key[:3]))
        d, t, band, place = key
        # need places within a tile: the tiles that hold them all start at a..b
        to = np.arange(len(d)) + self.need[t] - 1
        good = np.flatnonzero(to < len(d))
        to = to[good]
        good, to = (x[(group[to] == group[good]) & (place[to] - place[good] <= self.size[t[good]] - Q)] for x in (good, to))
        a, b = np.maximum(0, place[to] - self.size[t[good]] + Q), np.minimum(place[good], self.last[t[good]])
        again = np.zeros(len(good), bool)
        again[1:] = group[good[1:]] == group[good[:-1]]
        a[1:] = np.where(again[1:], np.maximum(a[1:], b[:-1] + 1), a[1:])
        count = np.maximum(0, b - a + 1)
        start = np.repeat(a - np.cumsum(count) + count, count) + np.arange(count.sum())
        d, t, band = (np.repeat(x[good], count) for x in (d, t, band))
        keep = self._is_tile(t, start)
        if found:
            sure = np.array(list(found), np.int64).T
            sure[0] -= first
            keep &= ~np.isin(self._code(d, t, start), self._code(*sure))
        d, t, band, start = d[keep], t[keep], band[keep], start[keep]
        half = 2 * self.edits[t] + 1
        low = band * half + start
        self._verify(first, texts, d, t, start, low, low + 2 * half - 1, found)
        return [(i, int(self.numbers[t]), s, end, e) for (i, t, s), (e, end) in sorted(found.items())]

    def _is_tile(self, item: np.ndarray, start: np.ndarray) -> np.ndarray:
        return (start % self.step == 0) | (start == self.last[item])

    def _code(self, doc, item, start) -> np.ndarray:
        return (doc * len(self.numbers) + item) * (self.last.max() + 1) + start

    def _exact(self, first, texts, doc, item, diagonal, place) -> dict[tuple[int, int, int], tuple[int, int]]:
        """Tiles that stand in a text verbatim, (text number, item, start) -> (0, end): runs of
        hits on one diagonal, compared letter by letter; they need no alignment."""
        found: dict[tuple[int, int, int], tuple[int, int]] = {}
        order = np.lexsort((place, diagonal, item, doc))
        key = np.stack((doc, item, diagonal, place))[:, order]
        new = _changes(np.stack((*key[:3], key[3] - np.arange(key.shape[1]))))
        starts = np.flatnonzero(new)
        length = np.diff(np.append(starts, key.shape[1]))
        long = length > self.size[key[1, starts]] - Q
        for (d, t, diag, p), n in zip(key[:, starts[long]].T.tolist(), length[long].tolist()):
            size, end = int(self.size[t]), p + n + Q - 1
            if not np.array_equal(texts[d][diag + p:diag + end], self.codes[t][p:end]):
                continue      # equal hashes of different q-grams: left to the alignment
            s = np.arange(p, end - size + 1)
            for x in s[self._is_tile(t, s)].tolist():
                k, value = (first + d, t, x), (0, diag + x + size)
                found[k] = min(found.get(k, value), value)
        return found

    def _verify(self, first, texts, doc, item, start, low, high, found) -> None:
        """Banded alignment of each tile with its text along the diagonals low..high, those of
        the tile's own start; adds to found."""
        for size in np.unique(self.size[item]):
            for edits in np.unique(self.edits[item[self.size[item] == size]]):
                group = np.flatnonzero((self.size[item] == size) & (self.edits[item] == edits))
                for a in range(0, len(group), 2048):
                    own = group[a:a + 2048]
                    # the part of the text under the band; outside the text nothing matches
                    width = int(high[own[0]] - low[own[0]]) + 1 + 2 * int(edits)
                    span = int(size) + width
                    part = np.full((len(own), span), -1, np.int32)
                    origin = low[own] - edits
                    for r, (dn, o) in enumerate(zip(doc[own], origin)):
                        s, e = max(0, o), min(len(texts[dn]), o + span)
                        if e > s:
                            part[r, s - o:e - o] = texts[dn][s:e]
                    query = np.stack([self.codes[x][s:s + size] for x, s in zip(item[own], start[own])]).astype(np.int32)
                    best, end = banded(query, part, width, int(edits))
                    for r in np.flatnonzero(best <= edits):
                        k = (first + int(doc[own[r]]), int(item[own[r]]), int(start[own[r]]))
                        new = (int(best[r]), int(origin[r] + end[r]))
                        found[k] = min(found.get(k, new), new)


def _changes(key: np.ndarray) -> np.ndarray:
    """Columns of a sorted key that differ from the one before."""
    new = np.ones(key.shape[1], bool)
    new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
    return new


def banded(query: np.ndarray, part: np.ndarray, width: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each row's query against any substring of its part that starts
    within the first ``width`` places and stays in the band; and where it ends.

    cost[r, j]: cells of row i sit at part position i + j. Places outside the text hold
    -1, which matches nothing; aligning with them only costs.
    """
    rows, n = query.shape
    big = np.int16(30000)
    steps = np.arange(width, dtype=np.int16)
    cost = np.zeros((rows, width), np.int16)    # row 0: an alignment may begin anywhere
    for i in range(n):
        differ = (part[:, i:i + width] != query[:, i:i + 1]).astype(np.int16)
        new = cost + differ                                   # substitute or match
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)   # letter of the query left out
        # letters of the text left out: running minimum along the row
        cost = np.minimum(np.minimum.accumulate(new - steps, axis=1) + steps, big)
    end = cost.argmin(axis=1)
    return cost[np.arange(rows), end].astype(np.int64), end + n


def contaminated(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, step: int = STEP, rate: float = RATE,
                 min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All columns of docs, plus hits: array of (item_id, tile_start, doc_end, edits), one
    per tile that aligns; empty for clean documents. One row per row of docs.

    Null or empty texts have no hits; items with a null text and items of fewer than
    ``min_chars`` normalised characters (too short to be evidence) match nothing; hits of an
    item with a null item_id have that null. Rows of the
    benchmark that repeat an item_id are items each. A column of docs named hits is
    replaced. Documents are compared with the benchmark in blocks of about
    ``block_chars`` characters (one broadcast each, a pass over docs each), however large
    the benchmark is; a single longer item is a block of its own.
    """
    bounded_batches(docs.sparkSession)
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_chars))
    out = docs.drop("hits")
    columns = list(out.columns)
    names = []
    for block in range(n_blocks):
        rows = (items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).orderBy("item_id", "text").collect())
        if not rows:
            continue
        index = Index.build([r.text for r in rows], tile, step, rate, min_chars)
        shared = docs.sparkSession.sparkContext.broadcast((index, [r.item_id for r in rows]))
        names.append(f"__hits{block}")
        out = out.withColumn(names[-1], _hits(shared)(F.col("text")))
    empty = F.array().cast("array<struct<item_id:long,tile_start:int,doc_end:int,edits:int>>")
    return out.select(*columns, F.concat(empty, *names).alias("hits"))


def _hits(shared):

    @pandas_udf("array<struct<item_id:long,tile_start:int,doc_end:int,edits:int>>")
    def hits(texts: pd.Series) -> pd.Series:
        index, ids = shared.value
        out: list[list[dict]] = [[] for _ in texts]
        for i, item, start, end, edits in index.matches(list(texts)):
            out[i].append({"item_id": ids[item], "tile_start": start, "doc_end": end, "edits": edits})
        return pd.Series(out)
    return hits


def query(spark, sf_dir: str) -> DataFrame:
    """Per document: whether it is contaminated, and the items, in order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", (F.size("hits") > 0).alias("contaminated"),
                      F.array_sort(F.array_distinct("hits.item_id")).alias("item_ids"))

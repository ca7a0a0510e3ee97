"""Jaccard join, filter audit and hard negatives against plain versions."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from revlens.llm import filter_audit, hard_negatives, jaccard_join

from .helpers import prose

DOCS = "doc_id long, text string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


# ------------------------------------------------------------------ Jaccard join
def shingles(text):
    w = [x.lower() for x in words(text)]      # bytes.lower touches A-Z only
    return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()


def expected_join(rows):
    """doc_id -> (largest set, smallest reachable doc_id) by all pairs."""
    rows = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (max(len(s) for j, s in rows if j == i), root(i)) for i in parent}


def joined(df, **options):
    out = jaccard_join.jaccard_join(df, **options).collect()
    assert len({r.doc_id for r in out}) == len(out)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in out}


def test_signatures_meet_for_every_linked_pair():
    """Random pairs on both sides of the threshold, many of them exactly at it."""
    rng = np.random.default_rng(1)
    linked = 0
    for k in range(6000):
        a = np.unique(rng.integers(0, 1 << 63, rng.choice([9, 10, 11, 12, 19, 20, 38, 57, 95, 190, 400]), dtype=np.uint64))
        drop, add = rng.integers(0, max(2, len(a) // 12) + 1, 2)
        b = np.unique(np.concatenate((a[rng.permutation(len(a))[drop:]], rng.integers(0, 1 << 63, add, dtype=np.uint64))))
        both = len(np.intersect1d(a, b))
        if len(b) and 10 * both >= 9 * (len(a) + len(b) - both) and both < max(len(a), len(b)):
            linked += 1
            assert len(np.intersect1d(jaccard_join.signatures(a), jaccard_join.signatures(b))), (len(a), len(b), both)
    assert linked > 1000


def test_few_bins_are_filled():
    """Sets whose shingles fall into too few bins are met over the prefix."""
    found = 0
    pool = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 4000, dtype=np.uint64))
    most = jaccard_join.differences(0)
    one = pool[(jaccard_join.mix(pool, 5) % np.uint64(most + 2 + most // 16)) == 0]
    for lo in range(0, 400, 10):
        a, b = one[lo:lo + 10], one[lo:lo + 9]
        found += 1
        common = np.intersect1d(jaccard_join.signatures(a), jaccard_join.signatures(b))
        assert len(common) and (common & np.uint64(0x80)).any()
    assert found == 40


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(3)
    for _ in range(200):
        base = rng.integers(0, 500, rng.integers(5, 120))
        sets = []
        for _ in range(rng.integers(1, 40)):
            s = base.copy()
            change = rng.random(len(s)) < rng.choice([0, 0.02, 0.05, 0.3])
            s[change] = rng.integers(0, 500, change.sum())
            sets.append(np.unique(s).astype(np.uint64))
        index = jaccard_join.Index(sets)
        q = sets[0]
        want = [i for i, s in enumerate(sets) if 19 * len(np.intersect1d(q, s)) >= 9 * (len(q) + len(s))]
        assert index.partners(q, np.ones(len(sets), bool)).tolist() == want


def family(seed):
    r = random.Random(seed)
    rows, k = [], 0
    for f in range(25):
        base = prose(f + seed, r.choice([2, 11, 12, 13, 22, 60, 150, 400])).split()
        for _ in range(r.choice([1, 2, 8])):
            ws = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                ws[r.randrange(len(ws))] = f"new{r.randrange(99)}"
            rows.append((k, " ".join(ws[:len(ws) - r.choice([0, 0, 1])]) + r.choice(["", "\n"])))
            k += 1
    # a chain: each like the next, the ends unlike
    ws = prose(99 + seed, 300).split()
    for c in range(8):
        rows.append((k, " ".join(ws).title() if c % 2 else " ".join(ws)))
        k += 1
        ws[30 * c:30 * c + 3] = [f"c{c}"] * 3
    return rows


@pytest.mark.parametrize("block", [1 << 20, 600])
def test_join_equals_all_pairs(spark, block):
    rows = family(1)
    r = random.Random(5)
    base = prose(777, 80).split()      # one group: every member like the base, most unlike each other
    rows.append((500, " ".join(base)))
    rows += [(501 + i, " ".join(base[:j] + [f"z{i}"] + base[j + 1:])) for i, j in enumerate(r.sample(range(5, 75), 40))]
    assert joined(spark.createDataFrame(rows, DOCS), block=block) == expected_join(rows)


def test_join_odd_inputs(spark, odd, odd_rows, none):
    assert joined(odd) == expected_join([r[:2] for r in odd_rows])
    assert jaccard_join.jaccard_join(none).count() == 0
    rows = [(1, prose(1, 50)), (2, prose(1, 50)), (2, prose(2, 50)), (3, prose(2, 50)), (4, None), (5, " "), (6, ""), (7, "a b"), (8, "A  B"), (9, "a b c")]
    got = joined(spark.createDataFrame(rows, DOCS))
    assert got == expected_join(rows) and {got[i][1] for i in (1, 2, 3)} == {1} and got[8] == (1, 7) and got[6] == (0, 6)


# ------------------------------------------------------------------ filter audit
def plain_audit(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    marks = defaultdict(lambda: [False, False])
    for i, good, toxic in labels:
        if i is not None:
            marks[i] = [marks[i][0] or good == 1, marks[i][1] or toxic == 1]
    rows = []
    for i, t, source in docs:
        t, w = t or "", words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t]}
        rows.append((source or "", {f for f, x in fails.items() if x}, *(marks[i] if i is not None else (False, False))))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r[1:] for r in rows if r[0] == part]
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[:step - 1])
                here = [r for r in mine if f in r[0] and not r[0] & before]
                total[f] += len(here)
                out[part, order, step] = [sum(not r[0] & (before | {f}) for r in mine), len(here), sum(f in r[0] and bool(r[0] & before) for r in mine),
                                          sum(r[0] == {f} for r in mine), sum(r[1] for r in here), sum(r[2] for r in here)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


FIELDS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_transducer_counts():
    r = random.Random(4)
    texts = ["", " ", "a", "A b\tA\x0bb", "日本 日本 x", "\x1c \x1c\x00", "#", "é" * 70 + " " + "é" * 70 + " " + "é" * 69 + "e", "tail\n"]
    texts += [" ".join(r.choice(["Ab", "ab", "é|", "x" * 100, "x" * 99 + "y", "long-word-of-17-b"]) for _ in range(r.randrange(60))) for _ in range(50)]
    lo = 0
    for a, b, buf, off in jaccard_join.slices(pa.array(texts), 300):
        t = filter_audit.Transducer(buf, off)
        distinct = t.distinct()
        for k in range(b - a):
            text, w = texts[a + k], words(texts[a + k])
            assert (t.words[k], distinct[k], t.points[k], t.capitals[k], t.symbols[k]) == (
                len(w), len(set(w)), len(text), sum("A" <= c <= "Z" for c in text), sum(c in "#$%&*|" for c in text)), text
        lo = b
    assert lo == len(texts)


def test_hash_table_verifies_spans(monkeypatch):
    """With one hash for all spans every insertion meets the others and must compare bytes."""
    monkeypatch.setattr(filter_audit, "mix", lambda x, salt=0: x * np.uint64(0))
    text = " ".join(["ab", "ba", "ab", "abcdefghi", "abcdefghj", "x" * 70, "x" * 69 + "y", "x" * 70])
    data = np.frombuffer((text + text).encode(), np.uint8)
    t = filter_audit.Transducer(data, np.array([0, len(text), 2 * len(text)]))
    assert t.distinct().tolist() == [6, 6]


def test_audit_equals_plain(spark, odd, odd_rows, none):
    r = random.Random(9)
    docs = [(x[0], x[1], x[3]) for x in odd_rows]
    base = [prose(i, r.choice([20, 250, 400])) for i in range(12)] + ["Same Same " * 150, "low low " * 150, "Pay 5 % & more " * 90]
    docs2 = docs + [(100 + i, r.choice(base) + r.choice(["", "", " #", " QQQQQQQQQQQQQQQQQQQQQQQQQQQQQQQQQQ"]), r.choice(["s", "t", None, ""])) for i in range(150)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 240, 2)] + [(100, 1, 1), (100, 0, 0), (None, 1, 1)]
    for rows in (docs2, docs):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mask", F.lit("clash")).withColumn("part", F.lit("clash"))
        lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("clash"))
        got = filter_audit.audit(df, lab).collect()
        assert {(x["part"], x.filter_order, x.step): [x[f] for f in FIELDS] for x in got} == plain_audit(rows, labels) and len(got) == 600 * len({x[2] or "" for x in rows})
    nobody = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, nobody).count() == 0
    assert {x.good_lost + x.toxic_lost for x in filter_audit.audit(df, nobody).collect()} == {0}


# ------------------------------------------------------------------ hard negatives
def plain_negatives(rows, is_anchor, low=80, high=100, k=5):
    vs = [(i, lab, np.floor(np.array(v, float) * 256)) for i, v, lab in rows
          if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, seen = [], set()
    for i, lab, q in vs:
        if not is_anchor(i) or (i, lab, q.tobytes()) in seen:
            continue
        seen.add((i, lab, q.tobytes()))
        scored = []
        for j, other, x in vs:
            n = min(len(q), len(x))
            if j != i:
                scored.append((-int(sum(int(a) * int(b) for a, b in zip(q[:n], x[:n]))), j, other == lab))
        scored.sort()
        for s, p, _ in [t for t in scored if t[2]][:k]:
            fit = [(t, j) for t, j, same in scored if not same and low * -s <= 100 * -t <= high * -s][:k]
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j) in enumerate(fit)]
    return sorted(out)


def test_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(6, 12))
    rows = [(i, (centers[i % 6] * rng.uniform(0.3, 3) + rng.normal(size=12) * 0.4).tolist(), int((i % 6 + rng.integers(0, 2)) % 4)) for i in range(500)]
    rows += [(500 + i, [0.5] * 12, i % 2) for i in range(130)]      # copies: ties
    rows += [(700, None, 1), (701, [None] * 12, 1), (710, [float("nan")] * 12, 1), (711, [float("inf")] * 12, 1), (None, [1.0] * 12, 1), (712, [1.0] * 12, None),
             (720, [1.0, 2.0], 1), (730, [], 1), (740, [0.0] * 12, 2), (750, [-9.0] * 12, 9), (13, rows[12][1], 0), (20, rows[20][1], rows[20][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("*", *[F.lit("clash").alias(c) for c in ("bucket", "block", "floor", "anchor", "rank")])
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    for options in ({}, {"n_buckets": 5, "block_rows": 30, "anchor_rows": 7}, {"low": 50, "high": 95}):
        got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **options)
        want = plain_negatives(rows, lambda i: i % 10 == 0, options.get("low", 80), options.get("high", 100))
        assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 300, options


def test_coordinate_pruning_loses_nothing_and_prunes():
    rng = np.random.default_rng(7)
    kept = total = 0
    for trial in range(60):
        x = rng.normal(size=(300, 6)) * rng.uniform(1, 1.2, (300, 1)) * 100 + rng.choice([0, 150], (300, 1)) * np.eye(6)[trial % 6]
        x = np.floor(x)
        block = hard_negatives.Block([v.tobytes() for v in x], np.arange(300), np.zeros(300), 6)
        q = np.floor(rng.normal(size=6) * 100) + 300 * np.eye(6)[trial % 6]
        score = x @ q
        for floor in np.quantile(score, [0.1, 0.5, 0.9, 0.99, 1]):
            at = block.candidates(q, float(floor))
            assert set(np.flatnonzero(score >= floor)) <= set(at)
            kept, total = kept + len(at), total + 300
    assert kept < 0.8 * total
    assert not len(block.candidates(q, float(np.linalg.norm(q) * block.longest * 1.01)))


def test_negatives_large_and_empty(spark):
    rows = [(i, [5e5 * (i + 1), 3e6], i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 5 == 0).collect())
    assert got == plain_negatives(rows, lambda i: i % 5 == 0) and got
    for d, a in ((df.limit(0), F.col("vec_id") == 0), (df, F.col("vec_id") == -1), (df.where("label = 0"), F.col("vec_id") == 0)):
        out = hard_negatives.hard_negatives(d, a)
        assert out.count() == 0 and "negative_score" in out.columns


def test_sql_twin_on_odd_embeddings(spark, tmp_path):
    rows = [(i, [((i * 7 + j * 3) % 11 - 4) / 8 for j in range(4)], i % 10 if i % 13 else None) for i in range(0, 420)] + [(800, None, 1), (900, [None] * 4, 1), (1000, [float("nan")] * 4, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in hard_negatives.query(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    rel = con.execute(hard_negatives.SQL)
    at = [[d[0] for d in rel.description].index(c) for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")]
    assert got == sorted(tuple(r[i] for i in at) for r in rel.fetchall()) and got

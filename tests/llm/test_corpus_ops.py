"""Near-dedup, line dedup, top-k, substring dedup, WARC and the pipeline against plain versions."""

import hashlib
import random
import re
import uuid
import zlib
from base64 import b32encode
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.llm import catalog, knn, line_dedup, near_dup, substring_dedup, warc
from revlens.llm.text import components
from revlens.session import checkpoint_dir

from .helpers import prose, rows_by_id

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def duck(sql, **frames):
    con = duckdb.connect()
    for name, f in frames.items():
        con.register(name, f)
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    return sorted((tuple(dict(zip(cols, r))[c] for c in sorted(cols)) for r in rel.fetchall()), key=repr)


def spark_rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


# ------------------------------------------------------------------ components
def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(200 + i, 200) for i in range(1, 30)] + [(7, 7), (300, 301), (301, 300), (140, 90)]
    nodes = [(n,) for n in {x for e in edges for x in e} | {5}]
    got = {r.node: r.comp for r in components(spark.createDataFrame(nodes, "node long"), spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {n: n for (n,) in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert got == {n: root(n) for (n,) in nodes}
    empty = components(spark.createDataFrame([], "node long"), spark.createDataFrame([], "a long, b long"))
    assert empty.count() == 0


# ------------------------------------------------------------------ near-dedup
def multiset(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    n = min(5, len(w))
    return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if n else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum((a | b).values()))


def classes(rows, threshold=near_dup.THRESHOLD):
    sets = [(i, multiset(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and jaccard(a, b) >= threshold:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def test_signature_is_unbiased():
    rng = np.random.default_rng(4)
    errors = []
    for k in range(60):
        h = np.unique(rng.integers(1, 1 << 62, 40).astype(np.uint64))
        a = rng.integers(0, 9, len(h))
        b = np.where(rng.random(len(h)) < 0.7, a, rng.integers(0, 9, len(h)))
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        x, y = (near_dup.signature(h[w > 0], w[w > 0], 512) for w in (a, b))
        errors.append((x == y).mean() - want)
        assert near_dup.weighted_jaccard((h[a > 0], a[a > 0]), (h[b > 0], b[b > 0])) == pytest.approx(want)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04
    # big weights, one shingle: heavier sets share points up to the smaller weight
    one = np.array([77], np.uint64)
    same = (near_dup.signature(one, np.array([1000]), 512) == near_dup.signature(one, np.array([800]), 512)).mean()
    assert same == pytest.approx(0.8, abs=0.08)


def test_near_duplicates_equal_all_pairs(spark):
    r = random.Random(2)
    rows, k = [], 0
    for f in range(12):
        base = prose(f, r.choice([3, 9, 40, 150])).split()
        for _ in range(r.choice([1, 2, 6])):
            ws = list(base)
            for _ in range(r.randrange(0, 4)):
                ws[r.randrange(len(ws))] = f"new{r.randrange(99)}"
            rows.append((k, " ".join(ws)))
            k += 1
    # a chain: each like the next, the ends unlike
    ws = prose(99, 200).split()
    for c in range(6):
        rows.append((k, " ".join(ws)))
        k += 1
        ws[30 * c:30 * c + 3] = [f"c{c}"] * 3
    # a repeated line makes weights matter: same shingle sets, other counts
    rows += [(k, "one two three four five six seven. " * 10), (k + 1, "one two three four five six seven. " * 5)]
    df = spark.createDataFrame(rows, DOCS)
    assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(df).collect()} == classes(rows)


def test_near_duplicates_of_the_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert {r.doc_id: r.class_id for r in near_dup.query(spark, SMALL).collect()} == classes(rows)


def test_near_duplicates_bridge_between_buckets(spark, monkeypatch):
    """Members that only a second round links: the star's centre is unlike both."""
    monkeypatch.setattr(near_dup, "bands", lambda sig, rows: np.zeros(1, np.uint64))   # one bucket for all
    rows = [(0, prose(1, 60)), (1, prose(2, 60)), (2, prose(2, 60) + " more"), (3, prose(3, 60)), (4, prose(3, 60) + " x"), (5, prose(1, 60) + " y")]
    sketches = spark.createDataFrame([], "doc_id long, t0 long, t1 long, size long, bands array<long>")
    for k, (i, t) in enumerate(rows):
        sketches = sketches.unionByName(spark.createDataFrame([(i, k, 0, len(t.split()) - 4, [0])], sketches.schema))
    monkeypatch.setattr(near_dup, "sketch", lambda *a: sketches)
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == classes(rows) == {0: 0, 5: 0, 1: 1, 2: 1, 3: 3, 4: 3}


def test_near_duplicates_odd_inputs(spark, odd, none, odd_rows):
    out = rows_by_id(near_dup.near_duplicates(odd))
    assert {i: rs[0].class_id for i, rs in out.items()} == classes([r[:2] for r in odd_rows])
    assert all(len(rs) == 1 for rs in out.values()) and None not in out
    assert near_dup.near_duplicates(none).count() == 0


# ------------------------------------------------------------------ line dedup
def test_line_templates(spark):
    rows = [(i, f"{prose(i, 8)}\nuser {i} logged in from host{i} at noon today ok\n\n{prose(900 + i, 30)}\nAccept all cookies now") for i in range(12)]
    rows += [(50 + i, f"user {i} logged in from host{i} at noon today ok") for i in range(2)] + [(60, "Accept all cookies now\nAccept all cookies now")]
    out = rows_by_id(line_dedup.deduplicate(spark.createDataFrame(rows, DOCS)))
    for i, t in rows:
        lines = [x for x in t.split("\n")]
        keep = [x for x in lines if i == 0 or not re.match("user|Accept", x)]
        r = out[i][0]
        assert r.kept_text == "\n".join(keep) and (r.n_lines, r.n_dropped) == (len(lines), len(lines) - len(keep))


def test_line_dedup_equals_sql(spark, odd_rows):
    r = random.Random(8)
    shapes = ["a b c {} e f", "x {} 12 z", "{}", "one two three four five six seven eight {}", "{} {} {}", "12 {} 14"]
    rows = [(i, "\n".join(r.choice(shapes).format(*r.choices(["red", "blue", "7", "k9", "green"], k=3)) for _ in range(r.randrange(6)))) for i in range(150)]
    rows += [x[:2] for x in odd_rows if x[0] is not None and x[0] != 13]
    rows = [(i + 1000 * (k >= 150), t) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, DOCS)
    got = line_dedup.deduplicate(df).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
    want = duck(line_dedup.SQL, documents=df.toPandas())
    assert spark_rows(got) == want and sum(x[3] for x in want) > 100


def test_line_dedup_odd_inputs(spark, odd, none):
    out = rows_by_id(line_dedup.deduplicate(odd, min_docs=2))
    assert sum(map(len, out.values())) == odd.count()
    assert out[4][0].kept_text is None and out[4][0].n_lines == 0 and out[5][0].kept_text == ""
    assert out[1][0].n_dropped == 0 and out[2][0].kept_text == "" and out[7][0].kept_text == "word" and out[8][0].kept_text == ""
    assert all(r.n_dropped == 0 for r in out[None])
    assert line_dedup.deduplicate(none).count() == 0


# ------------------------------------------------------------------ top-k
def brute_top(rows, every, k, scale=256):
    vs = [(i, np.floor(np.array(v, float) * scale)) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in vs:
        if i % every == 0:
            s = []
            for j, x in vs:
                if j != i:
                    n = min(len(q), len(x))
                    s.append((-int(sum(int(a) * int(b) for a, b in zip(q[:n], x[:n]))), j))
            out += [(i, r + 1, j, -v) for r, (v, j) in enumerate(sorted(s)[:k])]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) + 3 * (i % 3)).tolist()) for i in range(400)]
    rows += [(400 + i, [0.5] * 8) for i in range(120)]   # one common vector: ties
    rows += [(600, None), (601, [None] * 8), (602, [float("nan")] * 8), (None, [1.0] * 8), (603, [1.0, 2.0]), (604, []), (610, [float("inf")] * 8),
             (10, [9.0] * 8), (10, [9.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit("clash"))
    for options in ({}, {"n_pivots": 7, "block_rows": 20, "query_rows": 9}, {"n_pivots": 1}):
        got = knn.top_k(df, F.col("vec_id") % 10 == 0, 5, **options)
        want = brute_top(rows, 10, 5)
        # rows that repeat a query's id are one query each: compare as sets of rows per query
        assert {tuple(r) for r in got.select("query_id", "vec_id", "score").collect() if r.query_id != 10} == {(a, c, d) for a, _, c, d in want if a != 10}
        ranks = defaultdict(list)
        for r in got.collect():
            ranks[r.query_id].append((r["rank"], -r.score, r.vec_id))
        assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) and [x[1:] for x in sorted(v)] == sorted(x[1:] for x in v) for v in ranks.values())


def test_top_k_repeated_queries(spark):
    """Rows of one query id are one query: each candidate once, with its best score; their own
    rows, many and near a pivot, hide no candidate."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) + 4 * (i % 3)).tolist()) for i in range(1, 200)]
    rows += [(50, [30.0, 30.0, 30.0, 30.0])] * 40 + [(100, rows[99][1])] + [(7, rows[6][1])] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vs = [(i, np.floor(np.array(v) * 256)) for i, v in rows]
    want = []
    for qid in (50, 100, 150):
        best = sorted((-max(int(q @ x) for i, q in vs if i == qid), j) for j, x in vs if j != qid)
        want += [(qid, r + 1, j, -v) for r, (v, j) in enumerate(best[:5])]
    for options in ({}, {"n_pivots": 200, "block_rows": 20, "query_rows": 2}, {"n_pivots": 3}):
        got = knn.top_k(df, F.col("vec_id") % 50 == 0, 5, **options)
        assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == want, options


def test_top_k_large_values_and_empty(spark):
    rows = [(i, [1e17 * (i + 1), -3.0, float(i)]) for i in range(7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = knn.top_k(df, F.col("vec_id") == 0, 3).collect()
    assert [r.score for r in got] == [knn.LONG] * 3 and len({r.vec_id for r in got}) == 3
    assert knn.top_k(df.limit(0), F.col("vec_id") == 0, 3).count() == 0
    assert knn.top_k(df, F.col("vec_id") == -1, 3).count() == 0


# ------------------------------------------------------------------ substring dedup
def test_difference_cover():
    d, v = substring_dedup.COVER, substring_dedup.PERIOD
    assert all(any((i + s) % v in d and (j + s) % v in d for s in range(v)) for i in range(v) for j in range(v))


def test_substring_dedup_equals_sql(spark, odd_rows):
    r = random.Random(6)
    shared = [prose(500 + i, r.randrange(10, 40)) for i in range(15)]
    rows = []
    for i in range(120):
        parts = [prose(i * 7, r.randrange(0, 30))] + [r.choice(shared) for _ in range(r.randrange(3))] + [prose(i * 7 + 1, r.randrange(0, 20))]
        rows.append((i, r.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(200, "same " * 100), (201, "same " * 14), (202, "\x1cw " * 20), (203, " w " * 20)]
    rows += [(300 + k, t) for k, (_, t, *_) in enumerate(odd_rows)]
    df = spark.createDataFrame(rows, DOCS)
    want = duck(substring_dedup.SQL, documents=df.toPandas())
    for size in (1 << 22, 500):
        got = substring_dedup.deduplicate(df, bucket_bytes=size).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
        assert spark_rows(got) == want
    assert sum(x[2] for x in want) > 500


def test_substring_dedup_odd_inputs(spark, odd, none):
    out = rows_by_id(substring_dedup.deduplicate(odd))
    assert sum(map(len, out.values())) == odd.count()
    assert out[1][0].n_removed == 0 and out[2][0].n_removed == out[2][0].n_words == 120
    assert {r.n_removed for r in out[None]} == {0} and {r.n_removed for r in out[13]} == {0}
    assert out[4][0].kept_text == out[5][0].kept_text == out[6][0].kept_text == ""
    assert substring_dedup.deduplicate(none).count() == 0


# ------------------------------------------------------------------ WARC
PAGES = [(1, "http://a/1", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://a/3\r\nx", None), (4, "u", ""), (5, "u", "é" * 50 + "\r\n\r\nWARC/1.1\r\n" + "日本" * 40),
         (6, "u", "é" * 50 + "\r\n\r\nWARC/1.1\r\n" + "日本" * 40), (None, "u", "<p>one</p>"), (7, "u", "x" * 10_000), (8, "u", "<p>one</p>"), (8, "u", "<p>one</p>"),
         (9, "u", "only\n"), (9, "u", "only\n"), (10, "u", "line\r\n\r\n")]


def expected(rows, least=0):
    first = {}
    for i, _, t in rows:
        b = (t or "").encode()
        if i is not None and len(b) >= least:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, t in rows:
        b = (t or "").encode()
        f = first.get(b)
        again = i is not None and f is not None and i > f
        out.append((i, b32encode(hashlib.sha1(b).digest()).decode(), len(b), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk, least", [(1 << 16, 0), (7, 0), (64, 5)])
def test_warc_round_trip(spark, chunk, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("record", F.lit("clash"))
    path = f"{checkpoint_dir(spark)}/w-{uuid.uuid4().hex}"
    archive = warc.write_archive(pages, path, chunk, least)
    out = warc.read_archive(spark, path, archive).collect()
    assert all(r.valid for r in out)
    assert sorted(((r.page_id, r.payload_digest, r.payload_bytes, r.record_type, r.refers_to) for r in out), key=repr) == expected(PAGES, least)
    parts = warc.read_segments(spark, path, archive).where("type <> 'revisit'").select("record", "copy", "segment", "data").collect()
    texts = defaultdict(list)
    for r in parts:
        texts[r.record, r.copy].append((r.segment or 1, r.data))
    whole = Counter("".join(d for _, d in sorted(v)) for v in texts.values())
    assert whole == Counter(t or "" for (i, _, t), e in ((p, p) for p in PAGES)
                            if (i, b32encode(hashlib.sha1((t or "").encode()).digest()).decode(), len((t or "").encode()), "response", None) in expected(PAGES, least))


def test_warc_running_digests(spark):
    df = spark.createDataFrame([(1, "abcdefg"), (2, "")], "page_id long, payload string")
    got = sorted((r.page_id, r.chunk, r.chunks, r.data, r.running_digest) for r in warc.chunk_table(df, 3).collect())
    dig = lambda t: b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert got == [(1, 1, 3, "abc", dig("abc")), (1, 2, 3, "def", dig("abcdef")), (1, 3, 3, "g", dig("abcdefg")), (2, 1, 1, "", dig(""))]


def test_warc_empty_table(spark):
    path = f"{checkpoint_dir(spark)}/w-{uuid.uuid4().hex}"
    archive = warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archive(spark, path, archive).count() == 0


# ------------------------------------------------------------------ pipeline
def test_stages(spark, odd, none):
    import corpus_pipeline as P
    odd = odd.select(*P.COLUMNS)
    sf = SMALL
    kept = {}
    docs = odd
    for name, f in P.STAGES:
        assert f(spark, none, sf).count() == 0
        out = f(spark, docs, sf)
        if name != "bpe":
            assert out.columns == P.COLUMNS
            kept[name] = {r.doc_id for r in out.collect()}
            docs = out
        else:
            assert {r.doc_id for r in out.collect()} == kept["decontamination"]
    assert not {4, 5, 6, 12} & kept["language_id"] and {1, 2, 3, 9, 11} <= kept["language_id"]
    assert kept["line_dedup"] == kept["language_id"]
    assert 2 not in kept["near_dup"] and 3 not in kept["near_dup"] and 8 not in kept["near_dup"] and {1, 7, 9, None} <= kept["near_dup"]


def test_pipeline_equals_plain_stages(spark):
    import corpus_pipeline as P
    from revlens.llm import decontam
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [decontam.normal(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs = {r[0]: r[1] for r in rows if r[1] and any(c.isalpha() for c in r[1])}
    after = spark_rows(line_dedup.deduplicate(spark.createDataFrame(sorted(docs.items()), DOCS)).select("doc_id", "kept_text"))
    docs = {i: t for i, t in after if t.strip() or t == docs[i]}
    cls = classes(sorted(docs.items()))
    docs = {i: t for i, t in docs.items() if cls[i] == i}
    index = decontam.Index.build(items, decontam.TILE, decontam.STEP, decontam.RATE, decontam.MIN_CHARS)
    ids = sorted(docs)
    bad = {ids[m[0]] for m in index.matches([docs[i] for i in ids])}
    got = {r.doc_id: r.decoded for r in P.run(spark, SMALL).collect()}
    assert set(got) == set(ids) - bad
    from tokenizers import Tokenizer
    from revlens.llm import bpe
    lib = Tokenizer.from_file(bpe.vocabulary())
    assert all(got[i] == lib.decode(lib.encode(docs[i], add_special_tokens=False).ids, skip_special_tokens=False) for i in got)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))


def test_line_stage_cuts_each_text_once(spark):
    """The stage's filter on the cut texts must not bring a second copy of the cut (a second Python worker per task)."""
    import corpus_pipeline
    rows = [(i, f"Sent from my phone {i}\n{'abcdefghijklmnopqrst'[i]} line of its own", "en", "s", 40) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.line_stage(spark, docs, "")
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {r.doc_id: r.text.count("\n") for r in out.collect()} == {i: int(i == 0) for i in range(20)}


def test_packed_leaf_table(spark):
    """Every leaf that min_docs documents have is found, bit by bit; the workers hold no byte a bit."""
    docs = spark.createDataFrame([(i, f"alpha beta gamma delta\n{'x' * i}y z w only") for i in range(12)], "doc_id long, text string")
    table = line_dedup._hot_leaves(docs, 3, 10)
    assert table.nbytes == 1 << line_dedup.TABLE_BITS - 3 and int(np.unpackbits(table).sum()) == 1
    assert line_dedup._is_hot(table.tobytes(), zlib.crc32(b"4 alpha beta gamma") >> 32 - line_dedup.TABLE_BITS)


def _plans(monkeypatch):
    """Physical plan of each table that line_dedup stages, by name."""
    plans, stage = {}, line_dedup.stage

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, name)
    monkeypatch.setattr(line_dedup, "stage", noted)
    return plans


def test_exploded_tokens_are_not_broadcast(spark, monkeypatch):
    """the planner takes the rows of the tokens to be as many as the lines."""
    plans = _plans(monkeypatch)
    lines = [(i, 0, i, "4 a b c", f"a b c {'xy'[i % 2]}", f"a b c {'xy'[i % 2]}") for i in range(24)]
    df = spark.createDataFrame(lines, "doc_id long, i int, h long, leaf string, masked string, raw string")
    out = line_dedup.with_templates(df, 3, 0.8, 10)
    assert sorted({r.template for r in out.collect()}) == ["T a b c x", "T a b c y"]
    assert "posexplode" in plans["shapes"] and "Broadcast" not in plans["shapes"]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_repeated_templates_are_not_broadcast(spark, monkeypatch):
    """a column of few templates is small in its file, by which the planner sizes it, and large in memory."""
    plans = _plans(monkeypatch)
    docs = spark.createDataFrame([(i, f"alpha beta gamma delta\n{'x' * i}y z w only") for i in range(12)], DOCS)
    out = line_dedup.dropped_lines(docs, 3, 0.8, 10)
    assert sorted(r.doc_id for r in out.collect()) == list(range(1, 12))
    assert "Broadcast" not in plans["firsts"] + out._jdf.queryExecution().executedPlan().toString()

"""Language ID, toxicity, license scan, BPE, decontamination against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from revlens.llm import bpe, decontam, langid, license_scan, toxicity

from .helpers import prose, rows_by_id

SMALL = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ language ID
def test_profiles_equal_the_definition():
    """Bundle and cosine computed gram by gram, as the docstring says."""
    text, dim, seed = "Abc, été 𐐨𐐩 abc ß日", 192, 3
    letters = {c: langid.letter_vectors(np.array([ord(c)]), dim, seed)[0].astype(float) for c in set(text.lower())}
    letters[" "] = langid.letter_vectors(np.array([0]), dim, seed)[0].astype(float)
    assert len({tuple(v) for c, v in letters.items()}) == len(letters)      # a vector of its own for each letter
    bundle = np.zeros(dim)
    line = " " + text.lower().replace(",", "") + " "
    for a, b, c in zip(line, line[1:], line[2:]):
        bundle += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    codes, n = np.unique(langid.ngram_codes(text), return_counts=True)
    assert np.allclose(n @ langid.ngram_vectors(codes, dim, seed), bundle)
    for dense in (langid.DENSE, 1):         # counted in a table, and by sorting
        langid.DENSE, old = dense, langid.DENSE
        got, counts = langid.counted([langid.symbols(text), langid.symbols("abc")])
        langid.DENSE = old
        assert dict(zip(got.tolist(), counts[0].tolist())) == {**dict.fromkeys(got.tolist(), 0), **dict(zip(codes.tolist(), n.tolist()))}
        assert counts[1].sum() == 3
    proto = np.random.default_rng(0).normal(size=(2, dim))
    proto /= np.linalg.norm(proto, axis=1)[:, None]
    found, score = langid.Profiles(["x", "y"], proto.astype(np.float32), dim, seed).predict([text, None, "12 !"])
    cos = proto @ bundle / np.linalg.norm(bundle)
    assert found == [["x", "y"][int(cos.argmax())], "und", "und"]
    assert score[0] == pytest.approx(max(0, cos.max()), abs=1e-4) and score[1:] == [0.0, 0.0]


def test_language_accuracy_on_held_out_rows(spark):
    out = langid.query(spark, SMALL.replace("0.001", "0.01")).toPandas()
    truth = spark.read.parquet(SMALL.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "lang").toPandas()
    m = out.merge(truth, on="doc_id")
    held = m[m.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert len(out) == len(truth) and (held.lang == held.lang_pred).mean() > 0.98
    assert m.score.between(0, 1).all()


def test_language_odd_inputs(spark, odd, none):
    profiles = langid.fit(odd)
    assert set(profiles.langs) == {"en", "fr", "ja"}
    out = langid.identify(odd, profiles)
    assert out.count() == odd.count() and set(out.columns) == set(odd.columns)
    by = rows_by_id(out)
    assert all(by[i][0].lang_pred == "und" and by[i][0].score == 0 for i in (4, 5, 6, 12)) and by[11][0].lang_pred == "ja"
    empty = langid.fit(none)
    assert empty.langs == [] and langid.identify(none, empty).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}


def test_letters_beyond_the_basic_plane(spark):
    """A text of such letters only has a letter, so it has a language; scripts do not meet."""
    rows = [(i, t * 20, lang) for i, (t, lang) in enumerate([("𐐨𐐩𐐪 𐐫𐐬 ", "dsrt"), ("слово за словом ", "ru"), ("日本語の本 ", "ja"), ("une phrase ici ", "fr")])]
    profiles = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["𐐩𐐪 𐐫𐐬", "𐐨", "за словом", "日本語の", "phrase", "12 !", ""]
    found, scores = profiles.predict(texts)
    assert found[1] != "und"        # one letter, in an n-gram that no profile holds
    assert [found[0], *found[2:]] == ["dsrt", "ru", "ja", "fr", "und", "und"] and min(scores[0], *scores[2:5]) > 0.1


# ------------------------------------------------------------------ toxicity
def test_nnpu_finds_planted_words():
    r = random.Random(5)
    clean = [set(prose(1000 + i, 60).split()) for i in range(400)]
    toxic = [set(prose(5000 + i, 60).split()) | set(r.sample(["scoundrel", "dimwit", "blockhead"], 2)) for i in range(160)]
    model = toxicity.train(toxic[:60], clean[:300] + toxic[60:100], 0.12)
    score = lambda docs: np.array(model.score([" ".join(d) for d in docs]))
    assert (score(toxic[100:]) >= 0.7).mean() > 0.95 and (score(clean[300:]) < 0.5).mean() > 0.97


@pytest.mark.parametrize("prior", [0.05, 0.9])
def test_nnpu_equals_dense_risk(prior):
    """The risk as the docstring states it, on a dense matrix with slopes by differences: the same
    steps (those that go up the corrected part's slope too), weights and scores."""
    r = random.Random(11)
    pool = [f"w{i}" for i in range(12)]
    pos = [set(r.sample(pool[:6], 3)) | {"bad"} for _ in range(25)]
    unl = [set(r.sample(pool, 4)) | ({"bad"} if i % 5 == 0 else set()) for i in range(60)]
    steps, rate, decay = 60, 0.05, 2e-4
    model = toxicity.train(pos, unl, prior, models=1, steps=steps, rate=rate, decay=decay, least=2.0)
    names = list(model.weights)
    assert len(names) > 3
    copies = lambda sample: [set(t) for t in sorted({tuple(sorted(d)) for d in sample})]
    dense = lambda sample: np.array([[any(n == w or (n[0] == "^" and w.startswith(n[1:]) and len(w) > len(n) - 1) for w in d) for n in names] for d in copies(sample)], float)
    a, b = dense(pos), dense(unl)
    plus, minus = (lambda z: np.logaddexp(0, -z).mean()), (lambda z: np.logaddexp(0, z).mean())

    def parts(x):
        zp, zu = a @ x[:-1] + x[-1], b @ x[:-1] + x[-1]
        return prior * plus(zp), minus(zu) - prior * minus(zp)

    def slope(f, x):
        return np.array([(f(x + e) - f(x - e)) / 2e-6 for e in np.eye(len(x)) * 1e-6])
    x = np.append(np.zeros(len(names)), np.log(prior / (1 - prior)))
    m, v, turned = np.zeros(len(x)), np.zeros(len(x)), 0
    for t in range(1, steps + 1):
        up = parts(x)[1] < 0
        turned += up
        g = -slope(lambda y: parts(y)[1], x) if up else slope(lambda y: sum(parts(y)), x)
        g[:-1] += decay * x[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    assert turned > 0 or prior < 0.5
    got = np.append([model.weights[n][0] for n in names], model.bias[0])
    assert np.allclose(got, x, atol=2e-2), np.abs(got - x).max()
    z = b @ x[:-1] + x[-1]
    assert np.allclose(model.score([" ".join(d) for d in copies(unl)]), 1 / (1 + np.exp(-z)), atol=1e-2)


def test_toxicity_held_out(spark):
    sf = SMALL.replace("0.001", "0.1")
    out = toxicity.query(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    m = out.merge(labels, on="doc_id")
    held = m[m.held_out]
    rank = held.score.rank()
    n1, n0 = (held.toxic == 1).sum(), (held.toxic == 0).sum()
    auc = (rank[held.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    assert auc > 0.93 and (held.predicted == held.toxic).mean() > 0.95
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.7)).all()


def test_toxicity_odd_inputs(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (10, 0)], "doc_id long, toxic int")
    from pyspark.sql import functions as F
    model = toxicity.fit(odd, labels, F.lit(True))
    out = rows_by_id(toxicity.score(odd, model))
    assert sum(map(len, out.values())) == odd.count() and out[4][0].score == out[5][0].score
    assert toxicity.score(none, toxicity.fit(none, labels.limit(0), F.lit(True))).count() == 0


# ------------------------------------------------------------------ license scan
def test_patience_alignment():
    t = "a b c d e f".split()
    assert [x for _, x in license_scan.align("x a b y c d z f".split(), t)] == [0, 1, 2, 3, 5]
    # repeated words are no anchors, but align inside the gaps
    assert len(license_scan.align("the cat the dog the end".split(), "the cat the dog the end".split())) == 6
    for seed in range(30):
        r = random.Random(seed)
        a, b = r.choices("abcdefgh", k=12), r.choices("abcdefgh", k=9)
        pairs = license_scan.align(a, b)
        assert all(a[x] == b[y] for x, y in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_scan_equals_scan_without_filter():
    s = license_scan.Scanner()
    notice = list(license_scan.TEMPLATES.values())
    for seed in range(40):
        r = random.Random(seed)
        ws = notice[seed % len(notice)].split()
        if r.random() < 0.5:
            ws.insert(r.randrange(len(ws)), "really")
        text = prose(seed, 60) + " " + " ".join(ws) + ". " + prose(seed + 100, 60)
        got = {n: c for n, c, _, _ in s.scan(text)}
        full = {}
        words = license_scan.words(text)
        for name, template in s.templates.items():
            span = 4 * len(template) + 1
            full[name] = max(len(license_scan.align(words[i:i + span], template)) / len(template) for i in range(len(words)))
        best = max(full, key=lambda n: (full[n], len(s.templates[n])))
        assert full[best] >= s.min_coverage and got.get(best, 0) >= s.min_coverage
        assert all(full[n] >= s.min_coverage for n in got)


def test_repeated_notices_in_one_paragraph():
    s = license_scan.Scanner()
    assert [f[:2] for f in s.scan("x All rights reserved. y All rights reserved. z")] == [("all-rights-reserved", 1.0)]
    for k, (name, notice) in enumerate(license_scan.TEMPLATES.items()):
        for copies in (2, 3):
            for gap in (1, 4, 13):
                text = prose(k, 3) + " " + "".join(f"{notice} {prose(50 + i, gap)} " for i in range(copies))
                assert (name, 1.0) in [f[:2] for f in s.scan(text)], (name, copies, gap)
        ws = notice.split()
        if len(ws) > 6:
            ws.insert(3, "really")
            text = f"x {' '.join(ws)} y {' '.join(ws)} z"
            assert (name, 1.0) in [f[:2] for f in s.scan(text)], name


def test_license_texts_headers_and_distinct_words(spark):
    every = license_scan.all_templates()
    mit, bsd3, agpl = every["MIT#text"], every["BSD-3-Clause#text"], every["GPL-3.0#text"].replace("29 June", "19 November")
    rows = [(mit.replace("AUTHORS OR COPYRIGHT HOLDERS", "ACME"), ["MIT"]), (bsd3.replace("COPYRIGHT HOLDER", "REGENTS"), ["BSD-3-Clause"]),
            (every["BSD-2-Clause#text"].replace("COPYRIGHT HOLDER", "REGENTS"), ["BSD-2-Clause"]),
            (every["GPL-2.0#header"] + ", or (at your option) any later version.", ["GPL-2.0"]),
            (every["LGPL-2.1#header"], ["LGPL-2.1"]), (every["AGPL-3.0#header"], ["AGPL-3.0"]),
            (prose(1, 30) + every["GPL-3.0#text"].replace("warranty", "guarantee") + prose(2, 30), ["GPL-3.0"]), (agpl, []),
            ("Released under the BSD License", []), ("Released under the MIT License", ["MIT"]), ("Licensed under CC BY 4.0", ["CC-BY-4.0"]),
            ("Licensed under CC BY-NC 4.0", ["CC-BY-NC-4.0"]), ("Licensed under CC BY-NC-SA 4.0", ["CC-BY-NC-SA-4.0"]),
            ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["CC-BY-SA-4.0"]),
            *((t, [n.split("#")[0]]) for n, t in every.items())]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string").repartition(8)
    got = {r.doc_id: [x.name for x in r.licenses] for r in license_scan.scan(docs).collect()}
    assert {i: (rows[i][0][:40], g) for i, g in got.items() if g != rows[i][1]} == {}


def test_two_notices_in_one_text():
    """Ordered pairs of templates, next to each other and apart: both licenses are found, no other."""
    every = license_scan.all_templates()
    s = license_scan.Scanner(every)
    short = [n for n, t in every.items() if len(license_scan.words(t)) <= 60]
    long = [n for n in every if n not in short]
    r = random.Random(3)
    cases = [(x, y, r.choice([0, 10])) for x in short for y in short]
    cases += [(x, y, 10) for x in long for y in [*r.sample(short, 2), r.choice(long)]] + [(x, y, 3) for y in long for x in r.sample(short, 2)]
    wrong = []
    for x, y, gap in cases:
        text = f"{prose(1, 5)} {every[x]} {prose(2, gap)} {every[y]} {prose(3, 5)}"
        names = [f[0] for f in s.scan(text)]
        if names != sorted({x.split("#")[0], y.split("#")[0]}):
            wrong.append((x, y, gap, names))
    assert not wrong and len(cases) > 1000
    assert [f[0] for f in s.scan("Licensed under CC BY-NC 4.0 and Licensed under CC BY-SA 4.0")] == ["CC-BY-NC-4.0", "CC-BY-SA-4.0"]


def test_license_odd_inputs(spark, odd, none):
    out = rows_by_id(license_scan.scan(odd))
    assert sum(map(len, out.values())) == odd.count() and all(r.licenses == [] for rs in out.values() for r in rs)
    assert license_scan.scan(none).count() == 0
    assert not any(n for n, *_ in license_scan.Scanner().scan(prose(7, 3000)))


# ------------------------------------------------------------------ BPE
TEXTS = ["", None, "Hello  wörld's it's 123 foo<|endoftext|> bar ÀÉ́ ​ x!?? 日本", "İstanbul ΑΣ ΟΔΟΣ ǅ", "a" * 5000,
         "the " * 50 + "<|startoftext|><|endoftext|>", "<|endoftext", "x\x1cy\x85z\xa0w", "'s'S'll'LL don't I'VE", "０１²³¼ ⅷ", "ﬁ ﬀ",
         "é", "😀🎉 emoji", "ÿſȿɏ", "ab\x00c", "ʼn't", "!" * 300, "\n\t ", "ab" * 400 + "日" * 50]


@pytest.mark.parametrize("kept", [10, 500_000])
def test_bpe_equals_the_library(monkeypatch, kept):
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer
    monkeypatch.setattr(bpe, "KEPT_WORDS", kept)   # 10: the kept words are dropped again and again
    spec = open(bpe.vocabulary(), encoding="utf-8").read()
    own, lib = bpe.Codec(spec), Tokenizer.from_str(spec)
    texts = TEXTS + pq.read_table(f"{SMALL}/documents.parquet")["text"].to_pylist()[:60 if kept == 10 else 200]
    for lo in range(0, len(texts), 50):
        part = texts[lo:lo + 50]
        for t, ids in zip(part, own.encode(part)):
            e = lib.encode(t or "", add_special_tokens=False)
            assert ids.tolist() == e.ids
            assert own.decode(ids) == lib.decode(e.ids, skip_special_tokens=False)


def test_bpe_random_words():
    from tokenizers import Tokenizer
    spec = open(bpe.vocabulary(), encoding="utf-8").read()
    own, lib = bpe.Codec(spec), Tokenizer.from_str(spec)
    r = random.Random(1)
    texts = [" ".join("".join(r.choices("aeinrstlo", k=r.randrange(1, 30))) for _ in range(60)) for _ in range(100)]
    for t, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids


def test_bpe_spark(spark, odd, none):
    out = rows_by_id(bpe.encode(odd, bpe.vocabulary()))
    assert sum(map(len, out.values())) == odd.count()
    for i in (4, 5, 6):
        r = out[i][0]
        assert (r.n_tokens, r.ids, r.decoded) == (0, [], "") and r.ids_sha256 == hashlib.sha256(b"").hexdigest()
    r = out[1][0]
    assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() and r.n_tokens == len(r.ids)
    assert bpe.encode(none, bpe.vocabulary()).count() == 0


# ------------------------------------------------------------------ decontamination
def least_edits(p, t):
    """Least edit distance of p to any substring of t."""
    prev = list(range(len(p) + 1))
    best = prev[-1]
    for c in t:
        cur = [0]
        for i in range(1, len(p) + 1):
            cur.append(min(prev[i] + 1, cur[i - 1] + 1, prev[i - 1] + (p[i - 1] != c)))
        prev = cur
        best = min(best, prev[-1])
    return best


def test_tiles_equal_full_scan():
    r = random.Random(3)
    for k in range(25):
        item = prose(200 + k, r.choice([5, 12, 30, 45]))
        s = decontam.normal(item)
        start = r.randrange(0, max(1, len(s) - 120))
        piece = list(s[start:start + 120])
        for _ in range(r.randrange(0, 9)):
            j = r.randrange(len(piece))
            kind = r.random()
            if kind < 0.34:
                piece[j] = r.choice("abcde")
            elif kind < 0.67:
                piece.insert(j, r.choice("xyz"))
            else:
                del piece[j]
        doc = r.choice(["", prose(k, 20) + "  "]) + "".join(piece).upper() + r.choice(["", "\n" + prose(k + 50, 20)])
        index = decontam.Index.build([item], decontam.TILE, decontam.STEP, decontam.RATE, decontam.MIN_CHARS)
        got = {m[2]: m[4] for m in index.matches(["", doc, None])}
        want = {}
        for a, n in decontam.tiles_of(len(s)):
            e = least_edits(s[a:a + n], decontam.normal(doc))
            if len(s) >= decontam.MIN_CHARS and e <= decontam.budget(n):
                want[a] = e
        assert got == want


def test_every_passage_of_an_item_is_searched():
    """Against all substrings of an item: a passage counts wherever it starts, edited or not."""
    r = random.Random(9)
    for k in range(30):
        s = decontam.normal(prose(400 + k, r.choice([16, 20, 60])))
        n = decontam.TILE + r.randrange(0, 12)
        start = r.randrange(0, len(s) - n + 1)
        piece = list(s[start:start + n])
        for _ in range(k % 4):
            piece[r.randrange(len(piece))] = "~"
        doc = decontam.normal(prose(k + 900, 15) + " " + "".join(piece) + " " + prose(k + 950, 15))
        index = decontam.Index.build([s], decontam.TILE, decontam.STEP, decontam.RATE, decontam.MIN_CHARS)
        got = {m[2]: m[4] for m in index.matches([doc])}
        want = {}
        for a in range(len(s) - decontam.TILE + 1):
            e = least_edits(s[a:a + decontam.TILE], doc)
            if e <= int(decontam.RATE * decontam.TILE):
                want[a] = e
        assert got == want and (k % 4 or start in got)


def test_short_passages_and_items_without_id(spark):
    s = decontam.normal(prose(600, 200))
    docs = spark.createDataFrame([(i, prose(700 + i, 10) + " " + s[i:i + 60] + " " + prose(800 + i, 10)) for i in range(7, 600, 31)],
                                 "doc_id long, text string")
    for item in (1, None):
        out = decontam.contaminated(docs, spark.createDataFrame([(item, s)], "item_id long, text string")).collect()
        assert len(out) == docs.count() and all({h.item_id for h in r.hits} == {item} for r in out)


def test_decontamination_blocks_and_odd_inputs(spark, odd, none, odd_rows):
    items = [(1, odd_rows[0][1][:200]), (1, prose(2, 80)[20:150]), (2, None), (3, ""), (4, "word"), (None, odd_rows[0][1]), (5, prose(77, 40))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = rows_by_id(decontam.contaminated(odd, bench))
    many = rows_by_id(decontam.contaminated(odd, bench, block_chars=100))
    found = {i: {h.item_id for r in rs for h in r.hits} for i, rs in one.items()}
    assert found == {i: {h.item_id for r in rs for h in r.hits} for i, rs in many.items()}
    assert {i for i, f in found.items() if f} == {1, 2, 3, 10, None} and sum(map(len, one.values())) == odd.count()
    assert all(r.hits == [] for r in decontam.contaminated(odd, bench.limit(0)).collect())
    assert decontam.contaminated(none, bench).count() == 0


def test_decontamination_query_finds_whole_items(spark):
    sf = SMALL.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [decontam.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    out = {r.doc_id: r.contaminated for r in decontam.query(spark, sf).collect()}
    for d in docs:
        assert out[d.doc_id] == any(t in decontam.normal(d.text) for t in items)

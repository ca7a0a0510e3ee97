"""Language identification by hyperdimensional profiles.

Every letter has a random +-1 vector of ``dim`` components, drawn by hashing its code
point. A letter n-gram is the componentwise product (binding) of its letters' vectors, each
rotated by its place (permutation). A text is the sum (bundle) of its n-gram vectors, a
language the bundle of its learning texts; a text gets the language of largest cosine.

Bundles are sums of integers: tasks add the bundles of their texts per language, and the
sums of the tasks add in any order to the same prototype, so a lost and repeated task
changes nothing. A text's own bundle is computed in full, for its cosine.
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

from revlens.llm.text import U64, bounded_batches, mix

UNKNOWN = "und"
N_GRAM = 3
DIM = 512
# An n-gram's code is its letters' code points side by side; 0 stands for any run of other characters.
LETTER_BITS = 21
LETTER = (1 << LETTER_BITS) - 1
TEXTS_AT_ONCE = 128
DENSE = 1 << 20             # n-grams over so few different letters are counted in a table
VECTORS = 1 << 12           # n-gram vectors made at once
HELD = 1 << 18              # n-grams whose counts a task holds per language before it bundles them

_letters: np.ndarray | None = None
_rank: np.ndarray | None = None
_EDGE = np.zeros(1, np.int32)


def is_letter() -> np.ndarray:
    """For every code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(cp).isalpha() for cp in range(0x110000)), bool, 0x110000)
    return _letters


def symbols(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, each run of other characters as one 0, and a 0 at
    both ends. No letter: empty."""
    s = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<i4")
    s = s * is_letter()[s]
    if not s.any():
        return np.zeros(0, np.int32)
    s = np.concatenate((_EDGE, s, _EDGE))
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    return s[keep]


def ngram_codes(text: str) -> np.ndarray:
    """Codes of the letter n-grams of a text, in order."""
    s = symbols(text)
    code = np.zeros(max(0, len(s) - N_GRAM + 1), np.int64)
    for i in range(N_GRAM):
        code = code << LETTER_BITS | s[i:i + len(code)]
    return code


def counted(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, texts x codes counts) of the n-grams of some texts, given their symbols."""
    global _rank
    if _rank is None:
        _rank = np.zeros(LETTER + 1, np.int32)
    line = np.concatenate(texts)
    used = np.zeros(LETTER + 1, bool)
    used[line] = True
    alphabet = np.flatnonzero(used)
    width = len(alphabet)
    _rank[alphabet] = np.arange(width)
    place = _rank[line].astype(np.int32 if width ** N_GRAM < 1 << 31 else np.int64)
    grams, at = [], 0
    for s in texts:
        local = place[at:at + len(s)]
        at += len(s)
        code = np.zeros(max(0, len(s) - N_GRAM + 1), place.dtype)
        for i in range(N_GRAM):
            code = code * place.dtype.type(width) + local[i:i + len(code)]
        grams.append(code)
    if width ** N_GRAM <= DENSE:
        used = np.zeros(width ** N_GRAM, bool)
        for g in grams:
            used[g] = True
        codes = np.flatnonzero(used)
        rank = np.cumsum(used, dtype=np.int32) - 1
        places = [rank[g] for g in grams]
    else:
        codes, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        places = np.split(inverse, np.cumsum([len(g) for g in grams])[:-1])
    counts = np.zeros((len(texts), len(codes)), np.int32)
    for i, p in enumerate(places):
        counts[i] = np.bincount(p, minlength=len(codes))
    letters = [alphabet[codes // width ** (N_GRAM - 1 - i) % width] for i in range(N_GRAM)]
    whole = letters[0]
    for x in letters[1:]:
        whole = whole << LETTER_BITS | x
    return whole, counts


def letter_vectors(letters: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """+-1 vectors of code points: bits of hashes of (code point, block of 64 components)."""
    blocks = -(-dim // 64)
    key = letters.astype(U64)[:, None] * U64(1 << 16) + np.arange(blocks, dtype=np.uint64)[None, :]
    bits = np.unpackbits(mix(mix(key, seed), 1).astype("<u8").view(np.uint8).reshape(len(letters), -1), axis=1)
    return bits[:, :dim].astype(np.int8) * 2 - 1


def ngram_vectors(codes: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """Bound vectors of n-grams: product of the rotated letter vectors (the last letter by 0)."""
    out = np.ones((len(codes), dim), np.int8)
    for turn in range(N_GRAM):
        letters, place = np.unique(codes >> LETTER_BITS * turn & LETTER, return_inverse=True)
        out *= np.roll(letter_vectors(letters, dim, seed), turn, axis=1)[place]
    return out.astype(np.float32)


@dataclass
class Profiles:
    langs: list[str]
    prototypes: np.ndarray   # one unit row per language
    dim: int
    seed: int

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and cosine (negative counts as 0) of each text; ``und`` and 0.0 for
        null or letterless texts, or when there are no prototypes. Ties go to the
        language that sorts first."""
        found, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for lo in range(0, len(texts), TEXTS_AT_ONCE):
            found_symbols = [symbols(t or "") for t in texts[lo:lo + TEXTS_AT_ONCE]]
            rows = [i for i, c in enumerate(found_symbols) if len(c)]
            if not rows or not self.langs:
                continue
            codes, counts = counted([found_symbols[i] for i in rows])
            bundle = np.zeros((len(rows), self.dim), np.float32)
            for at in range(0, len(codes), VECTORS):
                part = slice(at, at + VECTORS)
                bundle += counts[:, part].astype(np.float32) @ ngram_vectors(codes[part], self.dim, self.seed)
            norm = np.maximum(np.linalg.norm(bundle, axis=1), 1e-9)
            cos = (bundle @ self.prototypes.T) / norm[:, None]
            best = cos.argmax(axis=1)
            for k, i in enumerate(rows):
                found[lo + i] = self.langs[best[k]]
                scores[lo + i] = float(min(1.0, max(0.0, cos[k, best[k]])))
        return found, scores


def fit(docs: DataFrame, dim: int = DIM, seed: int = 7) -> Profiles:
    """Prototypes from all rows of docs(text, lang) with a non-null lang.

    A task bundles its texts per language (holding the counts of at most HELD n-grams a
    language at once) and sends ``dim`` sums a language; the driver receives as many.
    """
    bounded_batches(docs.sparkSession)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        held: dict[str, dict[int, int]] = {}

        def add(lang: str) -> None:
            counts = held.pop(lang, {})
            codes = np.fromiter(counts.keys(), np.int64, len(counts))
            n = np.fromiter(counts.values(), np.int64, len(counts))
            for lo in range(0, len(codes), VECTORS):
                # whole numbers below 2^53: exact in doubles
                part = n[lo:lo + VECTORS].astype(np.float64) @ ngram_vectors(codes[lo:lo + VECTORS], dim, seed).astype(np.float64)
                sums[lang] = sums.get(lang, np.zeros(dim, np.int64)) + part.astype(np.int64)
        for b in batches:
            for lo in range(0, len(b), TEXTS_AT_ONCE):
                by: dict[str, list[np.ndarray]] = {}
                part = b.slice(lo, TEXTS_AT_ONCE)
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    s = symbols(text or "")
                    sums.setdefault(lang, np.zeros(dim, np.int64))
                    if len(s):
                        by.setdefault(lang, []).append(s)
                for lang, texts in by.items():
                    codes, counts = counted(texts)
                    own = held.setdefault(lang, {})
                    for code, n in zip(codes.tolist(), counts.sum(axis=0).tolist()):
                        own[code] = own.get(code, 0) + n
                    if len(own) > HELD:
                        add(lang)
        for lang in list(held):
            add(lang)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * dim, pa.string()), "i": pa.array(np.arange(dim), pa.int64()), "v": pa.array(v, pa.int64())})

    rows = (docs.where("lang IS NOT NULL").select("text", "lang")
            .mapInArrow(bundle, "lang string, i long, v long")
            .groupBy("lang", "i").agg(F.sum("v").alias("v")).toPandas())
    langs = sorted(rows["lang"].unique()) if len(rows) else []
    protos = np.zeros((len(langs), dim), np.float32)
    for k, lang in enumerate(langs):
        own = rows[rows["lang"] == lang].sort_values("i")
        v = own["v"].to_numpy(np.float64)
        protos[k] = v / max(np.linalg.norm(v), 1e-9)
    return Profiles(list(langs), protos, dim, seed)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """docs plus lang_pred and score, whole texts; one row per row of docs.

    Null, empty and letterless texts get ``und`` and 0.0. Other columns pass through;
    columns of docs named like the two results are replaced.
    """

    bounded_batches(docs.sparkSession)

    @pandas_udf("lang_pred string, score double")
    def predict(text):
        found, scores = profiles.predict(list(text))
        return pd.DataFrame({"lang_pred": found, "score": scores})

    base = docs.drop("lang_pred", "score")
    out = base.withColumn("__lid", predict(F.col("text")))
    return out.select(*base.columns, F.col("__lid.lang_pred").alias("lang_pred"), F.col("__lid.score").alias("score"))


def fold(modulus: int):
    """crc32 of doc_id as text, modulo ``modulus``; a null doc_id is fold -1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus, F.lit(-1))


def query(spark, sf_dir: str) -> DataFrame:
    """Learns from the rows outside fold 2 of 4, predicts every row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = fold(4) == 2
    profiles = fit(docs.where(~held))
    out = identify(docs.drop("lang"), profiles)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")

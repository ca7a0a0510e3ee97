"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; texts drawn from all learning rows are the
unlabelled ones (some are toxic). With class prior pi and a logistic loss l, the risk of a classifier is

    pi E_pos[l(+)] + max(0, E_unl[l(-)] - pi E_pos[l(-)])

where the second part is the corrected risk of the negatives. Where it falls below
zero the classifier has begun to memorise, and the step goes up its slope instead
(the non-negative estimator). Numpy classifiers, each with an own part of the unlabelled
texts, are averaged. Features are the words present in a text (lower-cased runs of
letters and digits) and the words' beginnings, chosen by their rate among positives against the prior-corrected
rate among negatives.

Learning takes a sample of bounded size (``max_positive``, ``max_unlabelled`` rows by hash
of doc_id); scoring covers every whole text.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from revlens.llm.text import bounded_batches

MAX_POSITIVE = 3000
MAX_UNLABELLED = 9000
MAX_FEATURES = 4096
MODELS = 3
LEAST_GAIN = 20.0
THRESHOLD = 0.7
STEMS = (4, 5, 6, 7)
_WORD = re.compile(r"\w+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def word_features(word: str) -> list[str]:
    """The word, and its beginnings (insults share stems)."""
    return [word, *("^" + word[:n] for n in STEMS if len(word) > n)]


@dataclass
class Classifier:
    """weights[feature]: one weight per model; bias: one per model."""
    weights: dict[str, np.ndarray]
    bias: np.ndarray

    def score(self, texts) -> list[float]:
        out = []
        for t in texts:
            own = words(t)
            found = self.weights.keys() & own
            for n in STEMS:
                found |= self.weights.keys() & {"^" + w[:n] for w in own if len(w) > n}
            z = self.bias + sum(self.weights[f] for f in found)
            out.append(float(np.mean(1 / (1 + np.exp(-np.clip(z, -60, 60))))))
        return out


class Features:
    """Features of a sample: its words and, per text, the numbers of its features."""

    def __init__(self, *samples: list):
        word: dict[str, int] = {}
        feature: dict[str, int] = {}
        of_word: list[list[int]] = []
        self.rows: list[list[np.ndarray]] = []
        for sample in samples:
            texts = set()
            for text in sample:   # copies of a text count once
                ids = []
                for w in text:
                    if w not in word:
                        word[w] = len(word)
                        of_word.append([feature.setdefault(f, len(feature)) for f in word_features(w)])
                    ids.append(word[w])
                texts.add(np.unique(np.array(ids, np.int32)).tobytes())
            self.rows.append([np.frombuffer(t, np.int32) for t in sorted(texts)])
        width = 1 + len(STEMS)
        table = np.array([f + [f[0]] * (width - len(f)) for f in of_word], np.int32).reshape(-1, width)
        self.rows = [[np.unique(table[t]) for t in sample] for sample in self.rows]
        self.names = list(feature)

    def counts(self, sample: int) -> np.ndarray:
        return np.bincount(np.concatenate([np.zeros(0, np.int32), *self.rows[sample]]), minlength=len(self.names))

    def choose(self, prior: float, limit: int, least: float) -> np.ndarray:
        """Features whose text rate differs most (by log-likelihood ratio) between the
        positives and the prior-corrected negatives, of those where twice the ratio is at
        least ``least`` (chance passes 20 about once in 100,000); ties by the name."""
        n, m = len(self.rows[0]), len(self.rows[1])
        p, u = self.counts(0), self.counts(1)
        rp, ru = p / n, u / m
        rn = np.clip((ru - prior * rp) / (1 - prior), 0, 1)
        a, b = (rp * n + 0.5) / (n + 1), (rn * m + 0.5) / (m + 1)
        gain = 2 * n * (a * np.log(a / b) + (1 - a) * np.log((1 - a) / (1 - b)))
        ok = np.flatnonzero((gain >= least) & (p + u >= 3))
        return np.array(sorted(ok, key=lambda i: (-gain[i], self.names[i]))[:limit], np.int64)

    def matrix(self, texts: list[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of the chosen features' occurrences."""
        column = np.full(len(self.names), -1)
        column[chosen] = np.arange(len(chosen))
        cols = [column[t] for t in texts]
        cols = [c[c >= 0] for c in cols]
        return np.repeat(np.arange(len(cols)), [len(c) for c in cols]), np.concatenate([np.zeros(0, np.int64), *cols])


def train(pos: list, unl: list, prior: float, max_features: int = MAX_FEATURES, least: float = LEAST_GAIN, models: int = MODELS,
          steps: int = 400, rate: float = 0.05, decay: float = 2e-4, slack: float = 0.0, step_back: float = 1.0) -> Classifier:
    """Fits ``models`` linear classifiers by full-batch Adam on the non-negative risk.
    pos, unl: collections of words."""
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    start = np.log(prior / (1 - prior))
    if not pos or not unl:
        return Classifier({}, np.full(models, start))
    known = Features(pos, unl)
    chosen = known.choose(prior, max_features, least)
    names = [known.names[i] for i in chosen]
    pos, unl = known.rows
    weights, bias = np.zeros((models, len(names))), np.zeros(models)
    for k in range(models):
        part = [d for i, d in enumerate(unl) if models == 1 or len(unl) < 10 * models or i % models != k]
        (pr, pc), (ur, uc) = known.matrix(pos, chosen), known.matrix(part, chosen)
        w, b = np.zeros(len(names)), start
        m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
        for t in range(1, steps + 1):
            zp = np.bincount(pr, w[pc], minlength=len(pos)) + b
            zu = np.bincount(ur, w[uc], minlength=len(part)) + b
            sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            gp_pos = prior * (sp - 1) / len(pos)         # slope of pi E_pos[l(+)]
            gu, gp_neg = su / len(part), -prior * sp / len(pos)   # slopes of the negatives' risk
            if negative >= -slack:
                on_p, on_u = gp_pos + gp_neg, gu
            else:                                        # climb out: reverse the negative part
                on_p, on_u = -step_back * gp_neg, -step_back * gu
            g = np.append(np.bincount(pc, on_p[pr], minlength=len(names)) + np.bincount(uc, on_u[ur], minlength=len(names)) + decay * w,
                          on_p.sum() + on_u.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
        weights[k], bias[k] = w, b
    return Classifier({n: weights[:, i] for i, n in enumerate(names)}, bias)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED,
        **options) -> Classifier:
    """Classifier from docs(doc_id, text) and labels(doc_id, toxic) of the rows where
    ``learn`` (a condition on doc_id) holds.

    The class prior is the share of toxic labels among the labelled learning rows. A
    doc_id with several labels is toxic if one of them says so; null labels are none.
    """
    marks = labels.where(learn).where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = marks.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    by_hash = F.xxhash64(F.col("doc_id"))
    pos_ids = marks.where("toxic = 1").select("doc_id").orderBy(by_hash, "doc_id").limit(max_positive)
    rest_ids = (docs.where(learn).where("doc_id IS NOT NULL").select("doc_id").distinct()
                .orderBy(by_hash, "doc_id").limit(max_unlabelled))
    chosen = (pos_ids.withColumn("pos", F.lit(1)).unionByName(rest_ids.withColumn("pos", F.lit(0)))
              .groupBy("doc_id").agg(F.max("pos").alias("pos"), F.min("pos").alias("unl")))
    # at most max_positive + max_unlabelled ids: a proven bound for the broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


    bounded_batches(docs.sparkSession)

    @pandas_udf("array<string>")
    def present(text):
        return text.map(lambda t: sorted(words(t)))
    pos, unl = [], []
    for r in rows.select("doc_id", "pos", "unl", present("text").alias("w")).orderBy("doc_id").toLocalIterator():
        if r.pos:
            pos.append([sys.intern(w) for w in r.w])
        if not r.unl:
            unl.append([sys.intern(w) for w in r.w])
    return train(pos, unl, float(toxic) / n if n else 0.5, **options)


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs plus score (0 to 1); null and empty texts get the score of no words. A column
    of docs named score is replaced."""

    bounded_batches(docs.sparkSession)

    @pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(text), dtype="float64")
    return docs.drop("score").withColumn("score", of("text"))


def query(spark, sf_dir: str) -> DataFrame:
    """Learns from the rows outside fold 1 of 3, scores every row."""
    from revlens.llm.langid import fold
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held = fold(3) == 1
    out = score(docs, fit(docs, labels, ~held))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

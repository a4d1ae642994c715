"""Operator 2, toxicity: multiple-instance learning over sentences.

A document is a bag of sentences.  A sentence scores
``p = sigmoid(bias + sum of the weights of its features)``; the document's
score is their noisy-or, ``1 - prod((1 - p) / (1 - floor))``: toxic if any
sentence is.  ``floor = sigmoid(bias)`` is what a sentence without features
has, so such sentences add nothing, however many a text has.  Only
documents have labels; the weights are learned through the noisy-or by
gradient steps, so the model finds out which sentences carry the label, and
``offending`` names them.  Features are words, the beginnings of words and
five-letter parts of words.

The model is fitted on a bounded sample: at most ``MAX_LABELS`` labelled
documents (smallest hashed ids), each with its whole text.  Spark counts in how many toxic and other documents of the sample each feature
occurs; features that a log-likelihood test finds commoner in toxic ones, at
most ``MAX_FEATURES``, take part.  Of a document only the distinct sentences with
such features, and how often each occurs, reach the fit.  The model has a fixed size and travels
with the tasks.  Every document is scored whole, where it lies, by the same
model.

Defined cases: null and empty texts have no sentence and score 0; null ids or
labels teach nothing; several labels of an id count as toxic if one says so;
without labels of both kinds nothing is learned, there is no floor and every
score is that of the prior bias; repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.llm.common import crc32_text, ship_package, spread, stored, text_or_empty

MAX_LABELS = 8_000
MAX_FEATURES = 4_000
MIN_G2 = 15.0
EPOCHS = 150
PRIOR = -6.0
START = 0.1  # weight before the first step; at 0 every sentence is at the floor

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
TOKEN = re.compile(r"\w+|[.!?\n]+")
MEMO = 400_000


def features(word: str) -> set[int]:
    """Hashed features of a (lower-case) word."""
    parts = {f"^{word[:k]}" for k in (3, 4, 5, 6) if k < len(word)}
    parts |= {word[k:k + 5] for k in range(len(word) - 4)}
    parts.add(f"^{word}$")
    return {zlib.crc32(p.encode()) for p in parts}


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never used (null for a null id)."""
    return crc32_text(doc_id) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """The bounded training sample ``(t, toxic)``, stored."""
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("long").alias("k")).agg(F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("k"), "k").limit(max_labels))
    rows = spread(docs.select(F.col(f"`{id_col}`").cast("long").alias("k"), text_or_empty(text_col).alias("t")))
    return stored(rows.join(F.broadcast(known), "k")  # at most max_labels rows
                  .dropDuplicates(["k"]).select("t", (F.col("toxic") > 0).alias("toxic")), "sample")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each kind with each feature, per batch of documents."""
    known: dict[str, np.ndarray] = {}
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            some = b.slice(lo, 512)
            if len(known) > MEMO:
                known = {}
            seen: tuple[list, list] = ([], [])
            for t, toxic in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                words = set(WORD.findall(t.lower()))
                for w in words:
                    if w not in known:
                        known[w] = np.array(list(features(w)), np.int64)
                if words:
                    seen[toxic].append(np.unique(np.concatenate([known[w] for w in words])))
            none = np.zeros(0, np.int64)
            other, bad = (np.unique(np.concatenate([none, *x]), return_counts=True) for x in seen)
            f = np.union1d(other[0], bad[0])
            n = np.zeros((2, len(f)), np.int64)
            n[0, np.searchsorted(f, other[0])], n[1, np.searchsorted(f, bad[0])] = other[1], bad[1]
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(n[0]), pa.array(n[1])], names=["f", "other", "bad"])


def select_features(rows: DataFrame, max_features: int = MAX_FEATURES, min_g2: float = MIN_G2) -> list[int]:
    """Features commoner in toxic documents, the strongest first."""
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return []
    n0, n1 = n[False], n[True]
    a, b = F.col("bad").cast("double"), F.col("other").cast("double")
    share = (a + b) / (n0 + n1)

    def part(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)

    g2 = 2 * (part(a, n1 * share) + part(b, n0 * share) + part(n1 - a, n1 * (1 - share)) + part(n0 - b, n0 * (1 - share)))
    counted = (rows.mapInArrow(_counts, "f long, other long, bad long").groupBy("f")
               .agg(F.sum("other").alias("other"), F.sum("bad").alias("bad")))
    best = (counted.filter(a * n0 > b * n1).select("f", g2.alias("g2")).filter(F.col("g2") >= min_g2)
            .orderBy(F.desc("g2"), "f").limit(max_features))
    return [r["f"] for r in best.collect()]  # at most max_features rows


def _bags(chosen: dict[int, int]):
    """Per document its distinct sentences with features: how often each
    occurs, and which features occur in which."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for b in batches:
            times, spot, feat = [], [], []
            for t in b.column(0).to_pylist():
                alike: dict[tuple[int, ...], int] = {}
                for s in SENTENCE.findall(t.lower()):
                    here: list[int] = []
                    for w in WORD.findall(s):
                        if w not in known:
                            known[w] = [chosen[f] for f in features(w) if f in chosen]
                        here += known[w]
                    if here:
                        key = tuple(sorted(here))
                        alike[key] = alike.get(key, 0) + 1
                some = sorted(alike)
                times.append([alike[x] for x in some])
                spot.append([k for k, x in enumerate(some) for _ in x])
                feat.append([f for x in some for f in x])
                if len(known) > MEMO:
                    known = {}
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(times, pa.list_(pa.int64())),
                                              pa.array(spot, pa.list_(pa.int32())), pa.array(feat, pa.list_(pa.int32()))],
                                             names=["toxic", "times", "spots", "feats"])
    return run


def fit(bags: list[tuple[bool, np.ndarray, np.ndarray, np.ndarray]], n_features: int, epochs: int = EPOCHS, rate: float = 0.1,
        decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias from ``(toxic, times of each distinct sentence with
    features, sentence of each occurrence, feature of each occurrence)``."""
    n_docs, kinds = len(bags), {x[0] for x in bags}
    bags = [x for x in bags if len(x[1])]
    if len(kinds) < 2 or not bags:
        return np.zeros(n_features), PRIOR
    theta, bias = np.full(n_features, START), PRIOR
    y = np.array([x[0] for x in bags], bool)
    n_sent = np.array([len(x[1]) for x in bags])
    times = np.concatenate([x[1] for x in bags]).astype(np.float64)
    bag_at = np.cumsum(n_sent) - n_sent
    sent = np.concatenate([at + x[2] for at, x in zip(bag_at, bags)]).astype(np.int64)
    feat = np.concatenate([x[3] for x in bags]).astype(np.int64)
    y_of, total = np.repeat(y, n_sent), int(n_sent.sum())
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, epochs + 1):
        z = bias + np.bincount(sent, theta[feat], total)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        floor = 1 / (1 + np.exp(-np.clip(bias, -30, 30)))
        log_none = np.add.reduceat(times * (np.logaddexp(0, bias) - np.logaddexp(0, z)), bag_at)  # log of "no sentence is toxic"
        ratio = np.exp(log_none) / np.maximum(-np.expm1(log_none), 0.1 * floor)
        each = np.where(y_of, -np.repeat(ratio, n_sent), 1.0) * times / n_docs
        g = each * p
        grad = np.append(np.bincount(feat, g[sent], n_features) + decay * theta, (each * (p - floor)).sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        theta, bias = np.maximum(theta - move[:-1], 0), bias - move[-1]
    return theta, float(bias)


def train(docs: DataFrame, labels: DataFrame, **params) -> tuple[dict[int, float], float]:
    """``(weight of each feature, bias)`` from the bounded sample."""
    ship_package(docs.sparkSession)
    rows = sample(docs, labels, **params)
    chosen = {f: k for k, f in enumerate(select_features(rows))}
    got = rows.mapInArrow(_bags(chosen), "toxic boolean, times array<long>, spots array<int>, feats array<int>").toPandas()
    bags = [(bool(t), np.asarray(n, np.int64), np.asarray(s, np.int64), np.asarray(f, np.int64))
            for t, n, s, f in zip(got["toxic"], got["times"], got["spots"], got["feats"])]
    bags.sort(key=lambda b: (b[0], len(b[1]), b[1].tobytes(), b[2].tobytes(), b[3].tobytes()))
    theta, bias = fit(bags, len(chosen))
    return {f: float(theta[k]) for f, k in chosen.items() if theta[k] > 0}, bias


class Scorer:
    """Scores whole texts; a bounded memo from word to weight."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias, self.memo = weights, bias, {}
        self.floor = float(np.logaddexp(0, bias)) if weights else 0.0

    def _values(self, tokens: list[str]) -> np.ndarray:
        memo, weights = self.memo, self.weights
        if len(memo) > MEMO:
            memo.clear()
        for t in tokens:
            if t not in memo:
                memo[t] = np.inf if t[0] in ".!?\n" else sum(weights[f] for f in features(t) if f in weights)
        return np.fromiter(map(memo.__getitem__, tokens), np.float64, len(tokens))

    def sentences(self, text: str) -> np.ndarray:
        """Logits of the sentences that have a word."""
        v = self._values(TOKEN.findall(text.lower()))
        word = np.isfinite(v)
        if not word.any():
            return np.zeros(0)
        sentence = np.cumsum(~word)[word]
        at = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
        return self.bias + np.add.reduceat(v[word], at)

    def score(self, text: str) -> float:
        return float(0.0 - np.expm1((self.floor - np.logaddexp(0, self.sentences(text))).sum()))

    def locate(self, text: str, least: float) -> list[dict]:
        """Spans, in text order, of the sentences that score ``least`` or
        more; where none does, of the strongest ones (ties: the earlier) up to
        the first that brings their own noisy-or to ``least`` (if all stay
        below it, of none)."""
        found, total = [], 0.0
        for s in SENTENCE.finditer(text):
            z = self.sentences(s[0])
            if len(z) and (none := float(self.floor - np.logaddexp(0, z[0]))) < 0:
                found.append((none, s.start(), s.end()))
        enough = [x for x in found if 0.0 - np.expm1(x[0]) >= least]
        if not enough:
            for k, x in enumerate(found := sorted(found), 1):
                total += x[0]
                if 0.0 - np.expm1(total) >= least:
                    enough = found[:k]
                    break
        return [{"start": a, "end": b, "score": float(0.0 - np.expm1(none))}
                for none, a, b in sorted(enough, key=lambda x: x[1:])]


def _score(weights: dict[int, float], bias: float, least: float):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights, bias)
        for b in batches:
            texts = b.column(1).to_pylist()
            scores = [scorer.score(t) for t in texts]
            found = [scorer.locate(t, least) if s >= least else [] for t, s in zip(texts, scores)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(found, pa.list_(span))],
                                             names=["doc_id", "score", "offending"])
    return run


def score(docs: DataFrame, model: tuple[dict[int, float], float], least: float = 0.5, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``(doc_id, score, offending)``: ``offending`` has the spans (code
    points) and scores of the sentences at or above ``least`` in documents at
    or above it, and where there are none, of the strongest sentences that
    reach it together."""
    ship_package(docs.sparkSession)
    rows = spread(docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("t")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_score(*model, least), f"doc_id {kind}, score double, "
                                                  "offending array<struct<start:bigint,end:bigint,score:double>>")

"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

A text is its lower-case letters with single spaces for everything between them. Its 1- to 3-grams fall into BUCKETS hash
buckets; a bucket's weight is its count times the inverse document frequency, over all documents that may be learned from,
and a text's vector has length 1. Training is follow-the-regularised-leader (McMahan et al. 2013) with L1 and
L2 penalties for each coordinate, so that most weights are exactly zero; a temperature, fitted on sampled documents that
weren't trained on, makes the largest probability the score.

The classifier is fitted on a bounded sample: about BOUND documents, an equal share for each language, taken by hash.
Document frequencies cover every document that may be learned from. Predicting is one pass without a
shuffle; weights and frequencies, of fixed size per language, are broadcast.

Defined cases: null and empty texts, and texts without a letter, are `und` with score 0; with nothing to learn from every
text is `und`; with one language all texts with letters get it; numerals (², Ⅷ) are no letters; of equal probabilities the
language that sorts first counts; very long texts are read whole, each as a step of its own; repeated rows get equal results; an empty table gives
an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import crc_fold, letter_runs, persisted, slices

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Sampled documents over all languages, as expected of the hash; every fifth calibrates.
BOUND = 4000
#: Learning rate's two numbers, and the penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.3, 0.3
EPOCHS = 3
#: N-grams of a text up to which sorting them is cheaper than counting in all buckets.
SHORT = 2000
UNKNOWN = "und"

_odd = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def grams(text: str) -> np.ndarray:
    """Buckets of the n-grams of a text, repeats included; empty without letters."""
    text = " ".join(letter_runs(text.lower())[1])
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32)
    out = []
    for n in ORDERS:
        h = np.full(max(0, len(points) - n + 1), n, np.uint32)
        for j in range(n):
            h = (h ^ points[j : len(h) + j]) * _odd[j]
        h ^= h >> np.uint32(15)
        out.append(h & np.uint32(BUCKETS - 1))
    return np.concatenate(out).astype(np.int64)


def weighted(g: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of the TF-IDF vector of length 1 of a text's n-grams."""
    if len(g) <= SHORT:
        at, counts = np.unique(g, return_counts=True)
    else:
        counts = np.bincount(g, minlength=BUCKETS)
        at = np.flatnonzero(counts)
        counts = counts[at]
    x = counts * idf[at]
    length = np.sqrt(x @ x)
    return at, x / length if length else x


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket and the task's number of documents with it; bucket -1: all documents."""
    total, n = np.zeros(BUCKETS, np.int64), 0
    for batch in slices(batches, "text"):
        for text in batch.column("text").to_pylist():
            here = np.zeros(BUCKETS, bool)
            here[grams(text or "")] = True
            total += here
            n += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *total[at].tolist()], pa.int64())], names=["bucket", "n"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """One weight a bucket: the logarithm of documents over documents with it, plus one."""
    counts = docs.select("text").mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    found = np.zeros(BUCKETS)
    own = counts[counts["bucket"] >= 0]
    found[own["bucket"].to_numpy()] = own["n"].to_numpy()
    n = int(counts.loc[counts["bucket"] < 0, "n"].sum())
    return np.log((1 + n) / (1 + found)) + 1


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return weighted(grams(text or ""), idf)


@dataclass
class Model:
    """Weights of the buckets that any language has a weight in: slot gives a bucket's row, or the row of zeros at the end."""

    langs: list[str] = field(default_factory=list)
    idf: np.ndarray = field(default_factory=lambda: np.ones(BUCKETS))
    slot: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1, 0)))
    temperature: float = 1.0

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[self.slot[at]]

    def predict(self, text: str | None) -> tuple[str, float]:
        g = grams(text or "")
        if not len(g) or not self.langs:
            return UNKNOWN, 0.0
        p = softmax(self.logits(*weighted(g, self.idf)) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights (BUCKETS, classes) by follow-the-regularised-leader, one row after another."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zs) * np.maximum(0, np.abs(zs) - L1)
        return -shrunk / ((BETA + np.sqrt(ns)) / ALPHA + L2)

    order = np.random.default_rng(7)
    scale = 20.0  # vectors of length 1 have small coordinates
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x, label = rows[i]
            x = scale * x
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            error = softmax(x @ w)
            error[label] -= 1
            g = x[:, None] * error
            step = (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA
            z[at] = zs + g - step * w
            n[at] = ns + g * g
    return scale * weights(z, n)


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of least log loss, over a grid of powers."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(50), 400))
    loss = [-np.log(np.maximum(1e-12, softmax(logits / t)[np.arange(len(labels)), labels])).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _sample(docs: DataFrame, bound: int) -> DataFrame:
    """doc_id, lang, h of about bound documents, an equal share for each language."""
    light = docs.select("doc_id", "lang", F.xxhash64("doc_id", F.lit(3)).alias("h"))
    counts = persisted(light.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-counts")
    share = bound / max(1, counts.count())
    picked = light.join(counts, "lang").where(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < share / F.col("n"))
    return persisted(picked.select("doc_id", "lang", "h").dropDuplicates(["doc_id"]), "language-sample")


def fit(docs: DataFrame, bound: int = BOUND) -> Model:
    """The model of docs (doc_id, text, lang), all of which may be learned from."""
    idf = inverse_frequencies(docs)
    labelled = docs.where("lang is not null and doc_id is not null")
    ids = _sample(labelled, bound)
    texts = labelled.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [vector(t, shared.value) for t in batch.column("text").to_pylist()]
            columns = [batch.column("h"), batch.column("lang"), pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in found], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "lang", "at", "x"])

    rows = texts.select("h", "lang", "text").mapInArrow(run, "h long, lang string, at array<int>, x array<float>").toPandas()
    rows = rows[rows["at"].map(len) > 0].sort_values(["h", "lang"], kind="stable")
    langs = sorted(set(rows["lang"]))
    if not langs:
        return Model(idf=idf)
    data = [(np.asarray(a, np.int64), np.asarray(x, np.float64), langs.index(y)) for a, x, y in zip(rows["at"], rows["x"], rows["lang"], strict=True)]
    apart = [i % 5 == 4 for i in range(len(data))]
    weights = train([d for d, a in zip(data, apart, strict=True) if not a], len(langs))
    used = np.flatnonzero(np.abs(weights).sum(axis=1) > 0)
    slot = np.full(BUCKETS, len(used))
    slot[used] = np.arange(len(used))
    model = Model(langs, idf, slot, np.vstack([weights[used], np.zeros((1, len(langs)))]))
    held = [d for d, a in zip(data, apart, strict=True) if a]
    if held:
        model.temperature = _temperature(np.stack([model.logits(a, x) for a, x, _ in held]), np.array([y for _, _, y in held]))
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, "text"):
            found = [m.predict(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def language(docs: DataFrame, bound: int = BOUND) -> DataFrame:
    """doc_id, held_out, lang_pred, score: the model fitted on three folds of four, applied to every row."""
    fold = F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False))
    model = fit(docs.select("doc_id", "text", "lang").where(~fold & F.col("doc_id").isNotNull()), bound)
    return identify(docs, model).select("doc_id", fold.alias("held_out"), "lang_pred", "score")

"""Toxicity by maximum-scoring segments.

Words get log-odds of toxic against clean text under a Dirichlet prior that is proportional to their pooled
frequency (Monroe, Colaresi and Quinn 2008), drawn towards zero by one standard deviation and lowered by a drift, so that
ordinary text scores below zero. A linear-time scan (Ruzzo and Tompa 1999) finds all maximal scoring segments of
a whole text. Their scores follow an extreme-value law: lambda solves sum(p * exp(lambda * s)) = 1 over the scores of
clean words, K fits the clean documents' largest segments, and a segment of score s in a text of n words has
the expected number K * n * exp(-lambda * s). A document's evidence is the sum of the negative logarithms of its
significant segments' numbers; a logistic curve over it, fitted on labelled documents that weren't counted, weighted
back to the labels' rate, is the score.

The classifier is fitted on a bounded sample of labelled rows: at most bound toxic and CLEAN * bound clean ones, by hash. Scoring is
one pass over the rows without a shuffle; the model, bounded by the sample, is broadcast.

Defined cases: null and empty texts, and texts without letters, have no words, no passages and the least
evidence; a document with several label rows is toxic if one says so; null labels are none; without toxic (or clean)
labels every score is 0, and where the calibrating part has no toxic (or no clean) documents the whole sample calibrates; a null doc_id is
not held out; very long texts are scanned whole; of segments with equal scores each counts; repeated rows get equal results; an empty table gives an
empty result; other columns don't matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import crc_fold, letter_runs, persisted, slices

#: Most sampled toxic documents, and how many times as many clean ones.
BOUND, CLEAN = 4096, 4
#: The prior's total, as a share of the counted words.
PRIOR = 0.1
DRIFT = 1.8
#: Scores are cut here.
LOW, HIGH = -3.0, 8.0
#: Sampled documents that a word must be in.
LEAST = 3
#: Evidence of a text without any segment.
NOTHING = -12.0
THRESHOLD = 0.7


@dataclass
class Model:
    """Scores of words, the extreme-value law's lambda and K, and the logistic curve's two numbers."""

    scores: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    size: float = 1.0
    offset: float = -50.0
    slope: float = 0.0


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in order, in time linear in the number of scores."""
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    # of each candidate: start, end, the sum before it, the sum up to its end, and the nearest candidate before it with a smaller sum before
    found: list[tuple[int, int, float, float]] = []
    smaller: list[int] = []
    for i in positive.tolist():
        start, end, left, right = i, i + 1, float(sums[i]), float(sums[i + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = smaller[j]
            if j < 0 or found[j][3] >= right:
                found.append((start, end, left, right))
                smaller.append(j)
                break
            start, _, left, _ = found[j]  # the new candidate takes in everything from j on
            del found[j:], smaller[j:]
    return [(s, e, right - left) for s, e, left, right in found]


def word_scores(words: list[str], known: dict[str, float]) -> np.ndarray:
    get = known.get
    return np.array([get(w, -DRIFT) for w in words])


def evidence(parts: list[tuple[int, int, float]], n: int, rate: float, size: float) -> tuple[float, list[float]]:
    """The document's evidence, and the expected number of each segment."""
    if not parts:
        return NOTHING, []
    logs = [math.log(size * n) - rate * s for _, _, s in parts]
    significant = [x for x in logs if x < 0]
    return max(NOTHING, -sum(significant) if significant else -min(logs)), [math.exp(min(x, 700.0)) for x in logs]


def _labelled(labels: DataFrame, bound: int) -> tuple[DataFrame, float]:
    """doc_id, toxic, part of the sample (part 0 is counted, part 1 calibrates), and the share of toxic documents among all labels."""
    by_doc = labels.where("doc_id is not null and toxic is not null").where(crc_fold("doc_id", 3) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_doc = by_doc.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"), F.xxhash64("doc_id", F.lit(4)).alias("h"))
    by_doc = persisted(by_doc, "toxicity-labels")
    share = by_doc.agg(F.avg("toxic")).first()[0]
    sides = [by_doc.where(F.col("toxic") == t).orderBy("h", "doc_id").limit(n) for t, n in ((0, CLEAN * bound), (1, bound))]
    return sides[0].unionAll(sides[1]).select("doc_id", "toxic", (F.pmod("h", F.lit(4)) == 3).cast("int").alias("part")), share or 0.0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        total, docs = [Counter(), Counter()], Counter()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = letter_runs((text or "").lower())[1]
            total[toxic].update(words)
            docs.update(set(words))
        keys = list(docs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (total[1], total[0], docs))], names=["word", "toxic", "clean", "docs"]
        )


def _log_odds(toxic: np.ndarray, clean: np.ndarray, all_toxic: float, all_clean: float) -> np.ndarray:
    mass = PRIOR * (all_toxic + all_clean)
    prior = mass * (toxic + clean) / (all_toxic + all_clean)
    odds = lambda x, total: np.log((x + prior) / (total + mass - x - prior))
    delta = odds(toxic, all_toxic) - odds(clean, all_clean)
    spread = np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    return np.clip(np.sign(delta) * np.maximum(0, np.abs(delta) - spread) - DRIFT, LOW, HIGH)


def _stats(known: dict[str, float]):
    """Rows of two kinds: toxic, words and segment scores of a document, and the task's histogram of clean words' scores (in hundredths)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, histogram = ["toxic", "n", "parts", "key", "count"], Counter()
        for batch in slices(batches, "text"):
            n, parts = [], []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                s = word_scores(letter_runs((text or "").lower())[1], known)
                n.append(len(s))
                parts.append([x for _, _, x in segments(s)])
                if not toxic:
                    k, c = np.unique(np.round(s * 100).astype(np.int64), return_counts=True)
                    histogram.update(dict(zip(k.tolist(), c.tolist(), strict=True)))
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(n, pa.int64()), pa.array(parts, pa.list_(pa.float64())), none, none], names=names)
        keys = list(histogram)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(keys), pa.int32()), pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.list_(pa.float64())), pa.array(keys, pa.int64()), pa.array([histogram[k] for k in keys], pa.int64())],
            names=names,
        )

    return run


def _evidences(rate: float, size: float):
    """toxic and evidence of each document, from its segment scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [evidence([(0, 0, s) for s in parts], n, rate, size)[0] for n, parts in zip(batch.column("n").to_pylist(), batch.column("parts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.float64())], names=["toxic", "x"])

    return run


def _rate(scores: np.ndarray, weight: np.ndarray) -> float:
    """The positive solution of sum(p * exp(rate * s)) = 1, by halving; the mean score is below zero."""
    p, low, high = weight / weight.sum(), 1e-6, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        if np.log(p @ np.exp(np.minimum(mid * scores, 700))) > 0:
            high = mid
        else:
            low = mid
    return low


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Offset and slope by Newton's method, with a small ridge."""
    scale = max(1.0, float(np.abs(x).max()))
    a = np.stack([np.ones(len(x)), x / scale], axis=1)
    theta, ridge = np.zeros(2), np.array([1e-3, 1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + ridge * theta
        curvature = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        step = np.linalg.solve(curvature, gradient)
        theta = theta - step * min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
    return float(theta[0]), max(0.0, float(theta[1]) / scale)


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Model:
    """The model. What comes to the driver is bounded by the sample."""
    ids, share = _labelled(labels, bound)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic", "part")  # at most (1 + CLEAN) * bound ids
    sample = persisted(sample, "toxicity-sample")
    words = sample.where("part = 0").mapInArrow(_count, "word string, toxic long, clean long, docs long")
    words = persisted(words.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "docs")]), "toxicity-words")
    all_toxic, all_clean = words.agg(F.sum("toxic"), F.sum("clean")).first()
    if not all_toxic or not all_clean:
        return Model()
    table = words.where(F.col("docs") >= LEAST).select("word", "toxic", "clean").toPandas()
    scores = _log_odds(table["toxic"].to_numpy(float), table["clean"].to_numpy(float), all_toxic, all_clean)
    model = Model({w: s for w, s in zip(table["word"], scores.tolist(), strict=True) if s != -DRIFT})
    both = sample.where("part = 1").select("toxic").distinct().count() == 2
    stats = (sample.where("part = 1") if both else sample).mapInArrow(_stats(model.scores), "toxic int, n long, parts array<double>, key long, count long")
    stats = persisted(stats, "toxicity-stats")
    histogram = Counter({r.key: r.n for r in stats.where("key is not null").groupBy("key").agg(F.sum("count").alias("n")).collect()})
    top = max([1.0, *model.scores.values()])
    histogram[round(100 * top)] += 1  # a toxic word can turn up in clean text
    at = sorted(histogram)
    model.rate = _rate(np.array(at) / 100, np.array([histogram[k] for k in at], float))
    # of each clean document two numbers, and of every document its evidence: what comes here is bounded by the sample's documents
    clean = stats.where("toxic = 0 and n > 0").select("n", F.coalesce(F.array_max("parts"), F.lit(0.0)).alias("most")).toPandas().sort_values(["n", "most"])
    model.size = max(1e-9, len(clean) / max(1e-9, float((clean["n"] * np.exp(-model.rate * clean["most"])).sum())))
    found = stats.where("toxic is not null").select("toxic", "n", "parts").mapInArrow(_evidences(model.rate, model.size), "toxic int, x double").toPandas()
    found = found.sort_values(["toxic", "x"])  # sums of floats in one order, so that reruns agree
    x, y = found["x"].to_numpy(float), found["toxic"].to_numpy(float)
    weight = np.where(y > 0, share / y.sum(), (1 - share) / (len(y) - y.sum())) * len(y)
    model.offset, model.slope = _logistic(x, y, weight)
    return model


PASSAGES = "array<struct<start:int,end:int,score:double,expected:double>>"
_passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and passages (significant segments, as code points of the lower-cased text) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, "text"):
            out, passages = [], []
            for text in batch.column("text").to_pylist():
                text = (text or "").lower()
                pattern, words = letter_runs(text)
                parts = segments(word_scores(words, m.scores))
                x, expected = evidence(parts, len(words), m.rate, m.size)
                out.append(1 / (1 + math.exp(-max(-50.0, min(50.0, m.offset + m.slope * x)))))
                hits = [(s, e, v, n) for (s, e, v), n in zip(parts, expected, strict=True) if n < 1]
                at = [w.span() for w in pattern.finditer(text)] if hits else []
                passages.append([{"start": at[s][0], "end": at[e - 1][1], "score": v, "expected": n} for s, e, v, n in hits])
            columns = [batch.column("doc_id"), pa.array(out, pa.float64()), pa.array([int(s >= THRESHOLD) for s in out], pa.int32()), pa.array(passages, _passage)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted", "passages"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, score double, predicted int, passages {PASSAGES}")


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> DataFrame:
    """doc_id, held_out, score, predicted, passages: the model fitted on the labels of two folds of three, applied to every row."""
    scored = score(docs, fit(docs, labels, bound))
    return scored.select("doc_id", F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted", "passages")

"""Toxicity as severity grades, by cumulative-link ordinal regression.

Words are stretches of ASCII letters, digits and bytes from 128 on, lower-cased
A-Z. From labelled documents:

1. Words are counted per label, a document counting once. A word is indicative
   if it is in at least ``LEAST`` documents and its log-likelihood ratio is at
   least twice the logarithm of the number of labelled documents (so a language
   with few of them is learned from few); at most ``FEATURES`` words, by ratio, become features.
2. A document labelled clean has grade 0; a toxic one grade 1 to 3 by the share
   of its words that indicate toxicity (``CUTS``).
3. P(grade <= k) = sigmoid(threshold_k - w.x), with the same w for every
   threshold and ascending thresholds; x holds 1 + log(count) for each feature
   and the scaled share of toxic words. Fitted by Adam on the whole sample.

Fitting uses at most ``SAMPLE`` labelled documents, the first by hash of their
id, each text once; a document's label is the larger one if it has several. Scoring reads every
whole text: severity is the expected grade, toxic says that grade 1 or more has
a probability of one half or more. Rows without id are scored like all others
and never fitted; a null text is empty; an empty text has no features. Without
labels of both kinds nothing is toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govaudit.llm.common import LOWER, byte_hashes, slices, stored, text_bytes
from govaudit.session import ship_package

#: The bound of the labelled sample that the classifier is fitted on.
SAMPLE = 20_000
FEATURES, LEAST = 4096, 3
SLICE = 1 << 19  # bytes of text worked on at a time
CUTS = (0.01, 0.025)
GRADES = 4

WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


@dataclass
class Model:
    """Features (ascending hashes), whether they indicate toxicity, weights (the last one of the share), thresholds."""
    features: np.ndarray
    positive: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and each one's row."""
    part = LOWER[data]
    inside = WORD[part]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    begins, ends = offsets[:-1][full], offsets[1:][full] - 1
    first[begins] |= inside[begins]
    last[ends] |= inside[ends]
    starts = np.flatnonzero(first)
    return byte_hashes(part, starts, np.flatnonzero(last) + 1), np.searchsorted(offsets, starts, "right") - 1


def _words_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        toxic = batch.column(0).to_numpy()
        for a, b in slices(offsets, SLICE):
            hashes, row = words(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
            order = np.lexsort((hashes, row))
            hashes, row = hashes[order], row[order]
            new = np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[new].view(np.int64)), pa.array(toxic[a + row[new]].astype(np.int64))], names=["word", "toxic"])


def _active(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and count of every feature present; each row's share of words that indicate toxicity."""
    hashes, row = words(data, offsets)
    n = len(offsets) - 1
    size = len(model.features)
    at = np.searchsorted(model.features, hashes)
    hit = at < size
    hit[hit] = model.features[at[hit]] == hashes[hit]
    key, count = np.unique(row[hit] * max(size, 1) + at[hit], return_counts=True)
    rows, features = key // max(size, 1), key % max(size, 1)
    toxic = np.bincount(rows, count * model.positive[features] if size else None, minlength=n)[:n]
    return rows, features, 1 + np.log(count), toxic / np.maximum(np.bincount(row, minlength=n), 1)


def _scaled(share: np.ndarray) -> np.ndarray:
    return np.log1p(100 * share)


def _examples(model: Model):
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for a, b in slices(offsets, SLICE):
                rows, features, values, share = _active(model, data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
                bounds = np.searchsorted(rows, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(share),
                     pa.array([features[x:y].astype("<i4").tobytes() for x, y in zip(bounds[:-1], bounds[1:])], pa.binary()),
                     pa.array([values[x:y].astype("<f4").tobytes() for x, y in zip(bounds[:-1], bounds[1:])], pa.binary())],
                    names=["doc_id", "toxic", "share", "features", "values"])

    return collect


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_ordinal(rows: np.ndarray, features: np.ndarray, values: np.ndarray, grades: np.ndarray, size: int,
                steps: int = 400, rate: float = 0.05, decay: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of P(grade <= k) = sigmoid(threshold_k - w.x); decay is the share
    of a squared weight in the mean loss."""
    n = len(grades)
    w, free = np.zeros(size), np.zeros(GRADES - 1)  # thresholds: the first, then logs of the steps up
    free[0] = 1.0
    m, v = [np.zeros_like(w), np.zeros_like(free)], [np.zeros_like(w), np.zeros_like(free)]
    for t in range(1, steps + 1):
        thresholds = np.cumsum(np.append(free[0], np.exp(free[1:])))
        z = np.bincount(rows, values * w[features], minlength=n)
        below = np.concatenate([np.zeros((n, 1)), _sigmoid(thresholds - z[:, None]), np.ones((n, 1))], 1)
        slope = below * (1 - below)
        k = np.arange(n)
        p = np.maximum(below[k, grades + 1] - below[k, grades], 1e-12)
        dz = (slope[k, grades + 1] - slope[k, grades]) / p / n  # of the loss, -log p
        dt = np.zeros(GRADES + 1)
        np.add.at(dt, grades + 1, -slope[k, grades + 1] / p / n)
        np.add.at(dt, grades, slope[k, grades] / p / n)
        dt = dt[1:-1]
        tail = np.cumsum(dt[::-1])[::-1]
        gradients = [np.bincount(features, values * dz[rows], minlength=size) + decay * w, np.append(tail[0], tail[1:] * np.exp(free[1:]))]
        for i, (x, g) in enumerate(zip((w, free), gradients)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            x -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return w, np.cumsum(np.append(free[0], np.exp(free[1:])))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0/1). Starts jobs."""
    ship_package(docs.sparkSession)
    one = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
           .agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic")))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most ``sample`` rows of two numbers
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    examples = stored(labelled.select("doc_id", "toxic", "text").dropDuplicates(["text", "toxic"]), "labelled")
    totals = {r.toxic: r.n for r in examples.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(1), np.full(GRADES - 1, 50.0))
    counted = (examples.select("toxic", "text").mapInArrow(_words_once, "word long, toxic long")
               .groupBy("word").agg(F.sum("toxic").cast("double").alias("a"), F.count("*").cast("double").alias("n")).where(f"n >= {LEAST}"))
    # log-likelihood ratio of a word's share of toxic documents against the share of all
    part = lambda x, e: f"CASE WHEN {x} > 0 THEN {x} * ln({x} / ({e})) ELSE 0 END"
    p, a, b = bad / (bad + good), "a", "(n - a)"
    ratio = (f"2 * ({part(a, f'n * {p}')} + {part(b, f'n * {1 - p}')} + {part(f'({bad} - a)', f'({bad + good} - n) * {p}')}"
             f" + {part(f'({good} - n + a)', f'({bad + good} - n) * {1 - p}')})")
    rows = (counted.where(f"n < {bad + good}").withColumn("ratio", F.expr(ratio)).where(f"ratio >= {2 * np.log(bad + good)}")
            .orderBy(F.desc("ratio"), "word").limit(FEATURES).selectExpr("word", f"a > n * {p} AS positive").collect())
    rows.sort(key=lambda r: r.word & 0xFFFFFFFFFFFFFFFF)
    model = Model(np.array([r.word for r in rows], dtype=np.int64).view(np.uint64), np.array([float(r.positive) for r in rows]), np.zeros(0), np.zeros(0))
    # bounded by the sample and the number of features
    seen = sorted(examples.mapInArrow(_examples(model), "doc_id long, toxic int, share double, features binary, values binary").collect(),
                  key=lambda r: (r.doc_id, r.toxic, r.share, r.features))
    share = np.array([r.share for r in seen])
    grades = np.array([r.toxic for r in seen]) * (1 + np.searchsorted(CUTS, share, "right"))
    counts = [len(r.features) // 4 for r in seen]
    size = len(rows)
    index = np.concatenate([np.repeat(np.arange(len(seen)), counts), np.arange(len(seen))])
    features = np.concatenate([np.frombuffer(b"".join(r.features for r in seen), "<i4").astype(np.int64), np.full(len(seen), size)])
    values = np.concatenate([np.frombuffer(b"".join(r["values"] for r in seen), "<f4").astype(np.float64), _scaled(share)])
    model.weights, model.thresholds = fit_ordinal(index, features, values, grades, size + 1)
    return model


def _score(model: Model, name: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            for a, b in slices(offsets, SLICE):
                rows, features, values, share = _active(model, data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
                z = np.bincount(rows, values * model.weights[features], minlength=b - a) + model.weights[-1] * _scaled(share)
                above = 1 - _sigmoid(model.thresholds - z[:, None])
                chances = -np.diff(np.concatenate([np.ones((b - a, 1)), above, np.zeros((b - a, 1))], 1), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(above.sum(1)), pa.array(chances.argmax(1).astype(np.int64)),
                                                  pa.array(above[:, 0] >= 0.5), *[batch.column(k).slice(a, b - a) for k in range(1, batch.num_columns)]],
                                                 names=["doc_id", "severity", "grade", "toxic", *batch.schema.names[1:]])

    return score


def score(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """doc_id, severity (expected grade), grade (the likeliest), toxic for each row of ``docs`` (doc_id, text).
    keep: also a column ``row``, a struct of all columns of ``docs``."""
    ship_package(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *([F.struct(*docs.columns).alias("row")] if keep else []), F.col("text").alias("text"))
    kind = ids.schema["row"].dataType.simpleString() if keep else ""
    scored = ids.mapInArrow(_score(model, "row"), "doc_id long, severity double, grade long, toxic boolean, " + (f"row {kind}, " if keep else "") + "text string")
    return scored.select("doc_id", "severity", "grade", "toxic", *(["row"] if keep else []))

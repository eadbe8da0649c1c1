"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

A grade ``y`` in 0..K-1 has ``P(y >= k) = sigmoid(w.x - t_k)`` with one weight vector for all
thresholds ``t_1 < t_2 < ...``. Features are the presence of words and of word beginnings,
hashed. The model is fitted on a bounded sample of labelled rows; scoring reads every row
once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.common import (
    BYTE_CODES,
    NOT_LETTER,
    WORD_BASE,
    distinct_per_doc,
    mix,
    split_words,
    text_slices,
)


@dataclass(frozen=True)
class Settings:
    """Grades run from 0 to ``top``. ``train_rows`` labelled rows at most are fitted on, those with the smallest id hash.

    ``bits`` of feature hash; ``beginnings`` in bytes; a feature needs ``min_rows`` rows and a
    score of ``min_z`` to enter; ``ridge`` penalises weights.
    """

    top: int = 2
    train_rows: int = 8_000
    bits: int = 20
    beginnings: tuple[int, ...] = (4, 5, 6)
    min_rows: int = 4
    min_z: float = 5.0
    ridge: float = 5e-5
    steps: int = 60


def text_features(data: np.ndarray, offsets: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """``(number of the text, feature)`` for each word and beginning, repeats included."""
    words = split_words(data, offsets, NOT_LETTER)
    docs, hashes = [words.doc], [mix(words.hashes)]
    powers = np.cumprod(np.full(max(settings.beginnings), WORD_BASE, np.uint64))
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    for size in settings.beginnings:
        at = np.flatnonzero(words.ends - words.starts >= size)
        letters = low[words.starts[at][:, None] + np.arange(size)[None, :]]
        docs.append(words.doc[at])
        hashes.append(mix((BYTE_CODES[letters] * powers[:size]).sum(axis=1, dtype=np.uint64) + np.uint64(size)))
    feature = np.concatenate(hashes) >> np.uint64(64 - settings.bits)
    return np.concatenate(docs), feature.astype(np.int64)


@dataclass(frozen=True)
class OrdinalModel:
    """Weights by hashed feature and ascending thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """``P(y >= k)`` for k = 1.. (rows x thresholds)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def choose_features(row: np.ndarray, feature: np.ndarray, grade: np.ndarray, settings: Settings) -> np.ndarray:
    """Features whose share of rows differs beyond chance between the two sides of a threshold."""
    size = 1 << settings.bits
    with_all = np.bincount(feature, minlength=size)
    p = np.clip(with_all / max(1, grade.size), 1e-12, 1 - 1e-12)
    z = np.zeros(size)
    for k in range(1, settings.top + 1):
        bad = grade >= k
        n1, n0 = max(1, int(bad.sum())), max(1, int((~bad).sum()))
        with_bad = np.bincount(feature[bad[row]], minlength=size)
        gap = with_bad / n1 - (with_all - with_bad) / n0
        z = np.maximum(z, np.abs(gap) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)))
    return np.flatnonzero((with_all >= settings.min_rows) & (z >= settings.min_z))


def conjugate_gradients(multiply, right: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """Solve ``A x = right`` to a hundredth for a positive definite ``A`` given by its products, scaled by its diagonal.

    A step of Newton's method needs no more far from the optimum, and near it the steps get small themselves.
    """
    x = np.zeros_like(right)
    rest = right.copy()
    scaled = rest / diagonal
    along, size = scaled.copy(), float(rest @ scaled)
    end = 1e-4 * size
    for _ in range(200):
        if size <= end:
            break
        product = multiply(along)
        pace = size / float(along @ product)
        x += pace * along
        rest -= pace * product
        scaled = rest / diagonal
        new = float(rest @ scaled)
        along, size = scaled + new / size * along, new
    return x


def fit_ordinal(row: np.ndarray, feature: np.ndarray, grade: np.ndarray, settings: Settings) -> OrdinalModel:
    """Penalised maximum likelihood by Newton steps with halving; each step is found by conjugate gradients.

    ``row`` and ``feature`` are the nonzeros of a 0/1 matrix, of at most ``train_rows`` rows. With ``a = P(y >= grade)`` and
    ``b = P(y >= grade + 1)`` the log-likelihood has slope ``1 - a - b`` and curvature
    ``a(1 - a) + b(1 - b)`` in the score. Thresholds are kept in order.
    """
    n, top = grade.size, settings.top
    weights = np.zeros(1 << settings.bits, np.float32)
    chosen = choose_features(row, feature, grade, settings)
    share = np.array([((grade >= k).sum() + 0.5) / (n + 2) for k in range(1, top + 1)])
    t = np.maximum.accumulate(np.log(1 / share - 1) + np.arange(top) * 1e-3)
    if not chosen.size:
        return OrdinalModel(weights, t)
    at = np.minimum(np.searchsorted(chosen, feature), chosen.size - 1)
    ok = chosen[at] == feature
    row, at = row[ok], at[ok]
    w = np.zeros(chosen.size)

    def times(v: np.ndarray) -> np.ndarray:
        return np.bincount(row, v[at], n)

    def times_back(v: np.ndarray) -> np.ndarray:
        return np.bincount(at, v[row], chosen.size)

    def tails(w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score, edges = times(w), np.concatenate(([-np.inf], t, [np.inf]))
        return tuple(1 / (1 + np.exp(np.clip(edges[grade + k] - score, -50, 50))) for k in (0, 1))

    def loss(w: np.ndarray, t: np.ndarray) -> float:
        a, b = tails(w, t)
        return -np.log(np.maximum(a - b, 1e-300)).mean() + settings.ridge / 2 * (w @ w + t @ t)

    for _ in range(settings.steps):
        a, b = tails(w, t)
        da, db, inside = a * (1 - a), b * (1 - b), np.maximum(a - b, 1e-12)
        slope = times_back(1 - a - b) / n - settings.ridge * w
        bend = da + db
        up = np.bincount(grade, da / inside, top + 1)[1:]
        down = np.bincount(grade, db / inside, top + 1)[:-1]
        curve = np.bincount(grade, da, top + 1)[1:] + np.bincount(grade, db, top + 1)[:-1]
        step = ((down - up) / n - settings.ridge * t) / (curve / n + settings.ridge)
        diagonal = times_back(bend) / n + settings.ridge
        move = conjugate_gradients(lambda v: times_back(bend * times(v)) / n + settings.ridge * v, slope, diagonal)
        moves = (move, 0 * t), (0 * w, np.clip(step, -1, 1))
        before = best = loss(w, t)
        for dw, dt in moves:
            pace = 1.0
            while pace > 1e-4:
                new_t = np.maximum.accumulate(t + pace * dt + np.arange(top) * 1e-9)
                now = loss(w + pace * dw, new_t)
                if now <= best:
                    w, t, best = w + pace * dw, new_t, now
                    break
                pace /= 2
        if before - best < 1e-7 * best:
            break
    weights[chosen] = w
    return OrdinalModel(weights, t)


def training_rows(docs: DataFrame, graded: DataFrame, settings: Settings) -> DataFrame:
    """``(grade, text)`` of at most about ``train_rows`` rows of ``docs``.

    ``graded`` is ``(doc_id, grade)``; rows without a grade are no labels, and of several grades
    of one id the highest counts. Only the chosen ids are broadcast.
    """
    labels = graded.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(
        F.max("grade").cast("int").alias("grade")
    )
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.train_rows)
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Rows repeated under one id would lift the bound; the choice must not depend on their order.
    return picked.groupBy("doc_id").agg(
        F.max("grade").alias("grade"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    )


def train(docs: DataFrame, graded: DataFrame, settings: Settings) -> OrdinalModel:
    """Features are made by the executors; the driver gets those of the bounded sample only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                doc, feature = distinct_per_doc(*text_features(data, offsets, settings))
                counts = np.bincount(doc, minlength=hi - lo)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)),
                    pa.array(feature.astype(np.int32)),
                )
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["grade", "features"])

    rows = training_rows(docs, graded, settings).select("grade", "text")
    table = rows.mapInArrow(run, "grade int, features array<int>").toArrow()
    lists = table["features"].combine_chunks()
    grade = table["grade"].to_numpy().astype(np.int64)
    if not grade.size:
        return fit_ordinal(np.empty(0, np.int64), np.empty(0, np.int64), grade, settings)
    counts = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(grade.size), counts)
    return fit_ordinal(row, lists.flatten().to_numpy().astype(np.int64), grade, settings)


def grade_toxicity(docs: DataFrame, model: OrdinalModel, settings: Settings = Settings()) -> DataFrame:
    """``(doc_id, severity, grade, toxic)`` per row of ``docs``.

    ``severity`` is the expected grade, ``grade`` the highest with ``P(y >= grade) >= 1/2`` and
    ``toxic`` whether that is the top one. Null and empty texts have no features, so only the thresholds
    speak. Repeated rows and null ids stay; other columns are ignored.
    """
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("severity", T.DoubleType()),
            T.StructField("grade", T.IntegerType()),
            T.StructField("toxic", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                doc, feature = text_features(data, offsets, settings)
                used = model.weights[feature] != 0
                doc, feature = distinct_per_doc(doc[used], feature[used])
                score = np.bincount(doc, model.weights[feature], hi - lo)
                above = model.at_least(score)
                grade = (above >= 0.5).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(above.sum(axis=1)),
                        pa.array(grade, pa.int32()),
                        pa.array(grade == len(model.thresholds)),
                    ],
                    schema.names,
                )

    return docs.select("doc_id", "text").mapInArrow(run, schema)

"""Quality scores by a support vector machine on naive Bayes features.

Indicators of word and word-shape n-grams are hashed into 2^BITS places, scaled by their
class log-count ratio (counted over all rows to learn from), and a linear hinge-loss model
is fitted to them by dual coordinate descent on a sample of at most PER_CLASS documents per
class. A logistic curve, fitted on a fifth of the sample that the machine did not see and
shifted to the class shares of all labelled rows, turns margins into scores.

Defined cases: a null or empty text has no n-grams and gets the score of the intercept;
without rows of both classes every score is the share of class 1 (0.5 without any row);
rows of `labels` without an id or label are left out, an id with several labels takes the
highest; repeated documents get equal scores; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import LOWER, U64, Rolling, batch_of, fields, in_split, mix, slices, word_spans
from ledgerlens.llm.labels import class_counts, distinct_pairs, labelled_texts, sample, sigmoid, train_labels

BITS = 18
PER_CLASS = 1_500  # most documents of each class that the machine is fitted to
SHARE = 0.25  # of the fitted weights; the rest is their mean size, as naive Bayes alone has it
WORDS = Rolling(11)
KIND = np.arange(256, dtype=np.uint64)  # what a byte is in a word's shape: itself, but for letters and digits
KIND[97:123], KIND[65:91], KIND[48:58], KIND[128:] = 1, 2, 3, 4


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs: words and pairs of words; runs of one to three word shapes."""
    starts, ends, first = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lower = LOWER[data]
    word = WORDS.spans(WORDS.sums(lower), starts, ends)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    nth = np.arange(len(word)) - first[text]  # place in its text

    def back(values: np.ndarray, k: int) -> np.ndarray:
        """The value k words before, 0 before the start of the text."""
        out = np.zeros_like(values)
        out[k:] = values[:-k] if k < len(values) else 0
        out[nth < k] = 0
        return out

    kind = KIND[data]
    shape = kind[starts] | kind[np.minimum(starts + 1, ends - 1)] << U64(8) | kind[ends - 1] << U64(16) | kind[np.maximum(ends - 2, starts)] << U64(24)
    shape = mix(shape | (back(word, 1) == word).astype(U64) << U64(32) | (back(word, 2) == word).astype(U64) << U64(33))
    pair = mix(back(shape, 1) * U64(3) + shape)
    all_hashes = [word, mix(back(word, 1) * U64(3) + word), shape + U64(1), pair, mix(back(shape, 2) * U64(5) + pair)]
    features = np.concatenate([h >> U64(64 - BITS) for h in all_hashes])
    return distinct_pairs(np.tile(text, len(all_hashes)), features, BITS)


@dataclass
class Model:
    """Weights of the features (ratio and fitted weight in one), and the score's slope and intercept."""

    weights: np.ndarray
    slope: float
    intercept: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        text, feature = ngrams(data, offsets)
        n = np.bincount(text, minlength=len(offsets) - 1)
        margin = np.bincount(text, self.weights[feature], minlength=len(n)) / np.sqrt(np.maximum(n, 1))
        return sigmoid(self.slope * margin + self.intercept)


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, c: float = 1.0, epochs: int = 12) -> np.ndarray:
    """Weights of the hinge-loss machine; a row lists its features, whose values are ratio / sqrt(number).

    One dual variable per row is moved to its best value within [0, c] at a time, with
    the weights kept up to date.
    """
    rng, w, alpha = np.random.default_rng(7), np.zeros_like(ratios), np.zeros(len(rows))
    values = [ratios[f] / np.sqrt(max(len(f), 1)) for f in rows]
    squares = np.array([v @ v for v in values]) + 1e-12
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i]) - 1
            moved = min(max(alpha[i] - gradient / squares[i], 0.0), c)
            if moved != alpha[i]:
                w[rows[i]] += (moved - alpha[i]) * y[i] * values[i]
                alpha[i] = moved
    return w


def logistic_line(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of a lightly bound logistic curve, by Newton's method."""
    beta, design = np.zeros(2), np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(steps):
        p = sigmoid(design @ beta)
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + np.diag([1e-3, 1e-6])
        beta += np.linalg.solve(hessian, design.T @ (y - p) - np.array([1e-3, 1e-6]) * beta)
    return float(beta[0]), float(beta[1])


def fit(df: DataFrame, labels: DataFrame, learnable, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Model:
    known = train_labels(labels, label, learnable, id_col)
    counts, totals = class_counts(labelled_texts(df, known, id_col, text_col), ngrams, BITS)
    if not totals.all():
        share = totals[1] / totals.sum() if totals.sum() else 0.5
        return Model(np.zeros(1 << BITS), 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    p, q = counts[1] + 1, counts[0] + 1
    ratios = np.log((p / (totals[1] + 2)) / (q / (totals[0] + 2)))
    ratios[counts.sum(axis=0) == 0] = 0

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "text"):
            text, feature = ngrams(data, offsets)
            cuts = np.searchsorted(text, np.arange(len(offsets)))
            yield batch_of(pa.schema([("y", pa.int32()), ("f", pa.binary())]), rows.column("y"), [feature[a:b].astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:])])

    picked = sample(known, per_class)
    drawn = sorted((r["y"], bytes(r["f"])) for r in labelled_texts(df, picked, id_col, text_col).mapInArrow(listed, "y int, f binary").collect())
    rows, y = [np.frombuffer(f, np.int32) for _, f in drawn], np.array([1.0 if y else -1.0 for y, _ in drawn])
    seen = np.arange(len(rows)) % 5 != 0
    w = dual_coordinate_descent([r for r, s in zip(rows, seen) if s], y[seen], ratios)
    weights = ratios * (SHARE * w + (1 - SHARE) * np.abs(w).mean())
    margins = np.array([weights[r].sum() / np.sqrt(max(len(r), 1)) for r in rows])
    held = ~seen if len(set(y[~seen])) == 2 else seen
    scale = margins.std() or 1.0
    slope, intercept = logistic_line(margins[held] / scale, (y[held] > 0).astype(float))
    drawn_odds = np.log((y[held] > 0).sum() / max((y[held] < 0).sum(), 1))
    return Model(weights, slope / scale, intercept + float(np.log(totals[1] / totals[0]) - drawn_odds))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, score and predicted for every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2^BITS numbers, whatever the data
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = fields(rows.schema["doc_id"], "score double, predicted int")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "text"):
            found, ids = shared.value.scores(data, offsets), part.column("doc_id")
            yield batch_of(pa.schema([("doc_id", ids.type), ("score", pa.float64()), ("predicted", pa.int32())]), ids, found, (found >= threshold).astype(np.int32))

    return rows.mapInArrow(scored, schema)


def quality_classifier(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted; learned from the two thirds of the ids that are not held out."""
    model = fit(df, labels, ~in_split(id_col, 3, 1), id_col=id_col, text_col=text_col)
    return score(df, model, id_col, text_col).select("doc_id", in_split("doc_id", 3, 1).alias("held_out"), "score", "predicted")

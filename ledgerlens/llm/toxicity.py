"""Toxicity by multiple-instance learning: a document is as toxic as its sentences make it.

Each sentence has a logistic score; a document's score is their noisy-or, and only that is
compared with the labels when the sentence model is trained. The features of a sentence are
its words and their first bytes (for inflected forms). Which features take part is decided
by class counts over all rows to learn from; the weights are fitted on a sample of at most
PER_CLASS documents per class. The same sentence scores then point out offending sentences.

Defined cases: a null or empty text has no sentence and scores 0; a text without sentence
marks is one sentence; without rows of both classes every score is 0; labels are treated as
in the quality classifier; repeated documents get equal scores; other columns are not
looked at.
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

BITS = 20
PER_CLASS = 5_000  # most documents of each class that the sentence model is fitted to
PREFIXES = (4, 5, 6)  # bytes
LEAST_TEXTS = 3  # toxic texts that a feature must be in
LEAST_G2 = 20.0  # log-likelihood ratio of a feature against chance
THRESHOLD = 0.3
WORDS = Rolling(23)
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
BREAK = np.zeros(256, bool)
BREAK[[10, 33, 46, 63]] = True  # \n ! . ?


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first byte and feature of every word and word beginning."""
    starts, ends, first = word_spans(data, offsets, LETTER[data])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    sums = WORDS.sums(LOWER[data])
    kinds = [(text, starts, WORDS.spans(sums, starts, ends))]
    for n in PREFIXES:
        long = ends - starts >= n
        kinds.append((text[long], starts[long], mix(WORDS.spans(sums, starts[long], starts[long] + n) + U64(n))))
    text, at, hashed = (np.concatenate(c) for c in zip(*kinds))
    return text, at, (hashed >> U64(64 - BITS)).astype(np.int64)


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    text, _, feature = word_features(data, offsets)
    return distinct_pairs(text, feature, BITS)


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sentences begin (after a mark, and with each text), and for each text (and the end) its first sentence."""
    begins = np.union1d(np.flatnonzero(BREAK[data]) + 1, offsets[:-1])
    begins = begins[begins < len(data)]
    return begins, np.searchsorted(begins, offsets)


def active(data: np.ndarray, offsets: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentence and model place of each feature that takes part, once per sentence; sentence begins and first sentences."""
    begins, first = sentences(data, offsets)
    _, at, feature = word_features(data, offsets)
    known = place[feature]
    at, known = at[known >= 0], known[known >= 0]
    sentence = np.searchsorted(begins, at, side="right") - 1
    pairs = np.unique((sentence << BITS) | known)
    return pairs >> BITS, pairs & ((1 << BITS) - 1), begins, first


@dataclass
class Model:
    """place: position of each feature among the weights, -1 if it takes no part."""

    place: np.ndarray
    weights: np.ndarray
    bias: float

    def sentence_scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sentence, known, begins, first = active(data, offsets, self.place)
        z = np.bincount(sentence, self.weights[known], minlength=len(begins)) if len(begins) else np.zeros(0)
        return sigmoid(z + self.bias), begins, first

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        p, _, first = self.sentence_scores(data, offsets)
        clean = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))])
        return np.clip(-np.expm1(clean[first[1:]] - clean[first[:-1]]), 0.0, 1.0)


def choose(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Features that toxic texts have more often than chance allows."""
    k, n = counts[1], counts.sum(axis=0)
    share = totals[1] / totals.sum()

    def part(observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return observed * np.log(np.maximum(observed, 1e-9) / np.maximum(expected, 1e-9))

    m, rest = totals[1] - k, totals.sum() - n
    g2 = 2 * (part(k, n * share) + part(n - k, n * (1 - share)) + part(m, rest * share) + part(totals[0] - (n - k), rest * (1 - share)))
    return np.flatnonzero((k >= LEAST_TEXTS) & (k > n * share) & (g2 > LEAST_G2))


def train(docs: list[tuple[int, int, np.ndarray, np.ndarray]], n_weights: int, share: float, epochs: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias from (label, number of sentences, sentence, place) of each document, by Adam on all of them.

    With P the noisy-or, the loss is the log-likelihood of the labels, weighted so that
    the classes count as in all labelled rows.
    """
    y = np.array([d[0] for d in docs], float)
    n = np.array([d[1] for d in docs], float)
    spans = [len(np.unique(d[2])) for d in docs]
    doc = np.repeat(np.arange(len(docs)), spans)  # of each sentence with features
    ids = [np.unique(d[2], return_inverse=True)[1] for d in docs]
    base = np.concatenate([[0], np.cumsum(spans)])
    sentence = np.concatenate([i + b for i, b in zip(ids, base)]) if len(docs) else np.zeros(0, int)
    place = np.concatenate([d[3] for d in docs]) if len(docs) else np.zeros(0, int)
    idle = n - np.array(spans, float)
    weight = np.where(y > 0, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9)) / len(docs)
    theta = np.append(np.full(n_weights, 1.0), -7.0)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, epochs + 1):
        z = np.bincount(sentence, theta[place], minlength=base[-1]) + theta[-1]
        p, p0 = sigmoid(z), sigmoid(theta[-1:])[0]
        clean = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(docs)) + idle * np.log1p(-p0)
        whole = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-9)
        # d loss / d log(1 - P): -(y (1 - P) / P) for toxic texts, + 1 for the others, times the weight
        slope = weight * np.where(y > 0, (1 - whole) / whole, -1.0)
        by_sentence = -slope[doc] * p  # times d log(1 - p) / dz = -p
        gradient = np.append(np.bincount(place, by_sentence[sentence], minlength=n_weights), by_sentence.sum() - (slope * idle).sum() * p0)
        gradient[:-1] += 1e-5 * theta[:-1]
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return theta[:-1], float(theta[-1])


def fit(df: DataFrame, labels: DataFrame, learnable, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Model:
    known = train_labels(labels, label, learnable, id_col)
    counts, totals = class_counts(labelled_texts(df, known, id_col, text_col), text_features, BITS)
    place = np.full(1 << BITS, -1, np.int64)
    if not totals.all():
        return Model(place, np.zeros(1), -60.0)
    chosen = choose(counts, totals)
    place[chosen] = np.arange(len(chosen))
    shared = df.sparkSession.sparkContext.broadcast(place)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = pa.schema([("y", pa.int32()), ("n", pa.int64()), ("s", pa.binary()), ("f", pa.binary())])
        for rows, data, offsets in slices(batches, "text"):
            sentence, known_place, begins, first = active(data, offsets, shared.value)
            cuts = np.searchsorted(sentence, first)
            pairs = list(zip(cuts, cuts[1:]))
            yield batch_of(columns, rows.column("y"), np.diff(first), [sentence[a:b].tobytes() for a, b in pairs], [known_place[a:b].tobytes() for a, b in pairs])

    drawn = labelled_texts(df, sample(known, per_class), id_col, text_col).mapInArrow(bags, "y int, n long, s binary, f binary").collect()
    docs = sorted(((r["y"], r["n"], bytes(r["f"]), bytes(r["s"])) for r in drawn))
    docs = [(y, n, np.frombuffer(s, np.int64), np.frombuffer(f, np.int64)) for y, n, f, s in docs]
    weights, bias = train(docs, len(chosen), totals[1] / totals.sum())
    return Model(place, weights if len(chosen) else np.zeros(1), bias)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted for every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2^BITS numbers, whatever the data
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = fields(rows.schema["doc_id"], "score double, predicted int")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "text"):
            found, ids = shared.value.scores(data, offsets), part.column("doc_id")
            yield batch_of(pa.schema([("doc_id", ids.type), ("score", pa.float64()), ("predicted", pa.int32())]), ids, found, (found >= threshold).astype(np.int32))

    return rows.mapInArrow(scored, schema)


def offending_sentences(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, nth (from 0), start and stop (bytes of the text), sentence and score of each sentence at the threshold."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = fields(rows.schema["doc_id"], "nth long, start long, stop long, sentence string, score double")

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "text"):
            p, begins, first = shared.value.sentence_scores(data, offsets)
            found = np.flatnonzero(p >= threshold)
            text = np.searchsorted(first, found, side="right") - 1
            stops = np.append(begins, len(data))[found + 1] if len(found) else found
            ids = part.column("doc_id").take(pa.array(text))
            columns = pa.schema([("doc_id", ids.type), ("nth", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("sentence", pa.string()), ("score", pa.float64())])
            spans = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(begins[found], stops)]
            yield batch_of(columns, ids, found - first[text], begins[found] - offsets[text], stops - offsets[text], spans, p[found])

    return rows.mapInArrow(located, schema)


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted; learned from the three quarters of the ids that are not held out."""
    model = fit(df, labels, ~in_split(id_col, 4, 2), id_col=id_col, text_col=text_col)
    return score(df, model, id_col, text_col).select("doc_id", in_split("doc_id", 4, 2).alias("held_out"), "score", "predicted")

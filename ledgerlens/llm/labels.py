"""Labelled rows for the classifiers: one label per document, bounded samples, class counts of hashed features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import batch_of, bounded, slices, stage
from ledgerlens.operators.ordering import top_k

Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]  # bytes, offsets -> (text, feature) pairs, each once


def train_labels(labels: DataFrame, label: str, learnable, id_col: str = "doc_id") -> DataFrame:
    """doc_id and y (0 or 1) of the rows to learn from; an id with several labels takes the highest."""
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & learnable)
    return stage(known.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y")), "labels")


def sample(known: DataFrame, per_class: int) -> DataFrame:
    """At most `per_class` labelled documents of each class, picked by a hash of the id."""
    return stage(top_k(known, ["y"], [F.xxhash64("doc_id"), F.col("doc_id")], per_class).select("doc_id", "y"), "sample")


def labelled_texts(df: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(bounded(known), "doc_id").select("y", "text")


def class_counts(texts: DataFrame, features: Features, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each feature the texts of class 0 and of class 1 that have it, and the number of texts of both.

    Every task sums its own texts; the driver gets one row per feature, 2^bits at most.
    """
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, totals = np.zeros((2, size), np.int64), np.zeros(2, np.int64)
        for rows, data, offsets in slices(batches, "text"):
            y = np.asarray(rows.column("y"))
            text, feature = features(data, offsets)
            sums += np.bincount(y[text] * size + feature, minlength=2 * size).reshape(2, size)
            totals += np.bincount(y, minlength=2)
        found = np.flatnonzero(sums.any(axis=0))
        yield batch_of(SCHEMA, np.append(found, -1), np.append(sums[0, found], totals[0]), np.append(sums[1, found], totals[1]))

    counted = texts.mapInArrow(count, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts, totals = np.zeros((2, size)), np.zeros(2)
    for row in counted.toLocalIterator():
        if row["feature"] < 0:
            totals[:] = row["n0"], row["n1"]
        else:
            counts[:, row["feature"]] = row["n0"], row["n1"]
    return counts, totals


SCHEMA = pa.schema([("feature", pa.int64()), ("n0", pa.int64()), ("n1", pa.int64())])


def distinct_pairs(text: np.ndarray, feature: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique((text.astype(np.int64) << bits) | feature.astype(np.int64))
    return keys >> bits, keys & ((1 << bits) - 1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

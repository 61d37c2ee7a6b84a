"""Language identification by a convolutional network over bytes, trained here in numpy.

Texts are cut into windows of WINDOW bytes; the network embeds bytes, slides filters of
WIDTHS bytes over a window, keeps each filter's maximum and puts a softmax on the maxima. It
is trained by Adam on at most PER_LANGUAGE documents per language with WINDOWS_EACH windows
spread over each whole text. A text's probabilities are the mean over all of its windows,
weighted by their letters.

Defined cases: a null text, or one without a letter, is `und` with score 0; a text shorter
than a window is padded with zero bytes; without a row to learn from every text is `und`;
rows with a null language or id are not learned from; repeated rows get equal results;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import batch_of, bounded, fields, in_split, slices, stage
from ledgerlens.operators.ordering import top_k

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
EMBEDDING = 8
PER_LANGUAGE = 400  # most documents of a language that are learned from
WINDOWS_EACH = 6
UNDETERMINED = "und"
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
TAPS = max(WIDTHS)


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: np.ndarray  # TAPS * EMBEDDING x all filters; a narrow filter's last taps are zero
    filter_bias: np.ndarray
    output: np.ndarray
    output_bias: np.ndarray

    def frames(self, windows: np.ndarray) -> np.ndarray:
        """The embedded bytes under each filter position: windows x positions x TAPS * EMBEDDING."""
        embedded = self.embedding[windows]
        places = windows.shape[1] - TAPS + 1
        return np.concatenate([embedded[:, t : t + places] for t in range(TAPS)], axis=2)

    def maxima(self, frames: np.ndarray) -> np.ndarray:
        """Filter responses: windows x positions x filters."""
        return (frames.reshape(-1, frames.shape[2]) @ self.filters).reshape(*frames.shape[:2], -1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        pooled = self.maxima(self.frames(windows)).max(axis=1) + self.filter_bias
        return softmax(np.maximum(pooled, 0) @ self.output + self.output_bias)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 6, batch: int = 64) -> Network:
    """Adam on the cross entropy, classes weighted alike."""
    rng = np.random.default_rng(5)
    n_filters = FILTERS * len(WIDTHS)
    mask = np.zeros((TAPS, EMBEDDING, n_filters), np.float32)
    for i, width in enumerate(WIDTHS):
        mask[:width, :, i * FILTERS : (i + 1) * FILTERS] = 1
    mask = mask.reshape(TAPS * EMBEDDING, n_filters)
    net = Network(
        languages, rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32), (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32),
        np.zeros(n_filters, np.float32), rng.normal(0, 0.2, (n_filters, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32),
    )
    names = ["embedding", "filters", "filter_bias", "output", "output_bias"]
    first, second = ({n: np.zeros_like(getattr(net, n)) for n in names} for _ in range(2))
    weight = (len(y) / (len(languages) * np.maximum(np.bincount(y, minlength=len(languages)), 1))).astype(np.float32)
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for start in range(0, len(order), batch):
            pick = order[start : start + batch]
            x, step = windows[pick], step + 1
            frames = net.frames(x)
            responses = net.maxima(frames)
            best = responses.argmax(axis=1)  # position of each filter's maximum
            pooled = np.take_along_axis(responses, best[:, None, :], axis=1)[:, 0] + net.filter_bias
            hidden = np.maximum(pooled, 0)
            error = softmax(hidden @ net.output + net.output_bias)
            error[np.arange(len(pick)), y[pick]] -= 1
            error *= (weight[y[pick]] / len(pick))[:, None]
            back = (error @ net.output.T) * (pooled > 0)
            rows = np.take_along_axis(frames, best[:, :, None], axis=1)  # what stood under each maximum
            to_frames = back[:, :, None] * net.filters.T[None]  # windows x filters x taps * embedding
            gradient = {
                "output": hidden.T @ error, "output_bias": error.sum(axis=0), "filter_bias": back.sum(axis=0),
                "filters": np.einsum("bf,bfk->kf", back, rows) * mask, "embedding": np.zeros_like(net.embedding),
            }
            at = best[:, :, None] + np.arange(TAPS)  # byte positions
            under = np.take_along_axis(x, at.reshape(len(pick), -1), axis=1).reshape(-1)
            np.add.at(gradient["embedding"], under, to_frames.reshape(-1, EMBEDDING))
            rate = 0.01 * (1 - 0.9 * epoch / epochs)
            for n in names:
                first[n] = 0.9 * first[n] + 0.1 * gradient[n]
                second[n] = 0.999 * second[n] + 0.001 * gradient[n] ** 2
                value = getattr(net, n)
                value -= (rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def cut(data: np.ndarray, start: int, stop: int) -> np.ndarray:
    """A text's bytes as rows of WINDOW bytes; the last is filled with zeros."""
    n = max(1, -(-(stop - start) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: stop - start] = data[start:stop]
    return out.reshape(n, WINDOW)


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to WINDOWS_EACH windows evenly spread over each whole text."""
    columns = pa.schema([("lang", pa.string()), ("windows", pa.binary())])
    for rows, data, offsets in slices(batches, "text"):
        found = []
        for a, b in zip(offsets, offsets[1:]):
            windows = cut(data, a, b)
            windows = windows[LETTER[windows].sum(axis=1) >= 8]
            found.append(windows[np.linspace(0, len(windows) - 1, min(WINDOWS_EACH, len(windows))).astype(int)].tobytes() if len(windows) else b"")
        yield batch_of(columns, rows.column("lang"), found)


def fit(df: DataFrame, learnable, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Network | None:
    rows = df.filter(learnable & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    picked = stage(top_k(rows.select("doc_id", "lang"), ["lang"], [F.xxhash64("doc_id"), F.col("doc_id")], per_language).select("doc_id", "lang").distinct(), "langs")
    drawn = rows.join(bounded(picked), ["doc_id", "lang"]).select("lang", "text").mapInArrow(_drawn, "lang string, windows binary")
    drawn = sorted((r["lang"], bytes(r["windows"])) for r in drawn.collect() if r["windows"])
    if not drawn:
        return None
    languages = sorted({lang for lang, _ in drawn})
    y = np.concatenate([np.full(len(w) // WINDOW, languages.index(lang)) for lang, w in drawn])
    return train(np.frombuffer(b"".join(w for _, w in drawn), np.uint8).reshape(-1, WINDOW), y, languages)


def predict(df: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score for every row, from all windows of the whole text."""
    shared = df.sparkSession.sparkContext.broadcast(network)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), text.alias("text"), text.rlike(r"\p{L}").alias("letters"))
    schema = fields(rows.schema["doc_id"], "lang_pred string, score double")

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for part, data, offsets in slices(batches, "text", 1 << 17):
            windows = [cut(data, a, b) for a, b in zip(offsets, offsets[1:])]
            text = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
            windows = np.concatenate(windows)
            sums = np.zeros((len(offsets) - 1, len(net.languages) if net else 1))
            for start in range(0, len(windows) if net else 0, 64):
                block = windows[start : start + 64]
                weight = LETTER[block].sum(axis=1) + 1e-3
                np.add.at(sums, text[start : start + 64], net.probabilities(block) * weight[:, None])
            sums /= np.maximum(sums.sum(axis=1, keepdims=True), 1e-12)
            letters = np.asarray(part.column("letters")) & bool(net)
            best, ids = sums.argmax(axis=1), part.column("doc_id")
            named = [net.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters)]
            columns = pa.schema([("doc_id", ids.type), ("lang_pred", pa.string()), ("score", pa.float64())])
            yield batch_of(columns, ids, named, np.clip(np.where(letters, sums[np.arange(len(best)), best], 0.0), 0.0, 1.0))

    return rows.mapInArrow(predicted, schema)


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the two thirds of the ids that are not held out."""
    network = fit(df, ~in_split(id_col, 3, 1), id_col, text_col, lang_col)
    return predict(df, network, id_col, text_col).select("doc_id", in_split("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")

"""Ranked lexical search: term at a time with a limit on accumulators, over a stored index.

Index. Every task tokenises whole texts and writes shards: the inverted lists of about
SHARD_BYTES of text (a longer text is a shard of its own), one row each, with the lengths of
its documents and, per term, the places and counts of its documents, the highest count and
the shortest document. Terms and lists are stored as bytes (whole numbers of the least
width), so that only Python takes them apart: the JVM moves them whole and never holds a
value of its own per term or place. Number of documents, tokens and document frequencies are
aggregates over the stored shards.

Search. The questions' terms, with their weights, go to the shards, in blocks of at most
ASKED_ROWS terms; every shard answers each question on its own. Its terms are taken from
the rarest (by document frequency over all shards) to the most frequent. A document gets an
accumulator when a list names it, as long as documents without one could still matter: once
k accumulators exist and the bounds of all terms left, together, are below the k-th partial
score, no new ones are made, and the lists left only update those that exist. The bound of a
term in a shard is its weight times the impact of its highest count in its shortest
document, so nothing that could be among the k highest is ever left out, and the scores
returned are whole. The k highest per shard and question are merged.

Nothing grows with a frequent term but its lists, which stay in their shards; what is
shuffled is k rows per shard and question.

Defined cases: a null or empty text, or one without a term, is no document: it is not counted
and never found; a question without text or known terms gives no rows; rows that repeat an
id are documents (or questions) of their own; null document ids come last among equal scores;
an empty table gives an empty result; texts of any length are indexed whole; other columns
are not looked at.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ledgerlens.llm.common import SLICE_BYTES, batch_of, bounded, stage
from ledgerlens.operators.ordering import top_k

K = 10
SHARD_BYTES = 8 << 20
GROUP_BYTES = 16 << 20  # of the index that a writer or reader holds at once
HIT_ROWS = 100_000  # hits of a shard that are handed on at once
ASKED_ROWS = 200_000  # question terms that are sent to every task at once
# bytes of terms as they are compared: digits, letters (A-Z lower-cased) and all beyond ASCII; others end a term
TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERM).split()


# --- index --------------------------------------------------------------------------


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on as bytes of their least width, which the last byte tells."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return values.astype(kind.newbyteorder("<")).tobytes() + bytes([kind.itemsize])


def unpacked(raw) -> np.ndarray:
    width = raw[-1]
    return np.frombuffer(raw, f"<u{width}", (len(raw) - 1) // width)


class _Shard:
    """Documents and tokens that are gathered for one row of the index."""

    def __init__(self):
        self.number = defaultdict(itertools.count().__next__)  # of each term
        self.ids: list = []
        self.lengths: list[int] = []
        self.tokens: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id, found: list[bytes], size: int) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(found))
        self.tokens.append(np.fromiter(map(self.number.__getitem__, found), np.int64, len(found)))
        self.bytes += size

    def row(self, kind: pa.DataType) -> pa.RecordBatch:
        lengths, docs = np.array(self.lengths), len(self.ids)
        pairs = np.concatenate(self.tokens) * docs + np.repeat(np.arange(docs), lengths)
        pairs, counts = np.unique(pairs, return_counts=True)  # by term, then document
        starts = np.searchsorted(pairs // docs, np.arange(len(self.number) + 1))
        places = pairs % docs
        lists = [starts, places, counts, np.maximum.reduceat(counts, starts[:-1]), np.minimum.reduceat(lengths[places], starts[:-1])]
        blobs = [b" ".join(self.number), *map(packed, lists)]
        first = [pa.array([self.ids], pa.list_(kind)), pa.array([lengths], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([*first, *(pa.array([b], pa.binary()) for b in blobs)], NAMES)


NAMES = ["ids", "lengths", "terms", "starts", "places", "counts", "most", "shortest"]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, kind = _Shard(), None
    for batch in batches:
        kind = batch.column(0).type
        texts = batch.column(1)
        for start in range(0, batch.num_rows, 256):
            for doc_id, text in zip(batch.column(0).slice(start, 256).to_pylist(), texts.slice(start, 256).to_pylist()):
                found = terms(text)
                if found:
                    shard.add(doc_id, found, len(text))
                if shard.bytes >= SHARD_BYTES:
                    yield shard.row(kind)
                    shard = _Shard()
    if shard.ids:
        yield shard.row(kind)


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored shards."""
    kind = df.schema[id_col].dataType
    lists = "lengths array<int>, terms binary, starts binary, places binary, counts binary, most binary, shortest binary"
    schema = StructType([StructField("ids", ArrayType(kind)), *StructType.fromDDL(lists).fields])
    return stage(df.select(id_col, text_col).mapInArrow(_shards, schema), "shards", GROUP_BYTES)


def corpus_size(index: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""
    row = index.agg(F.sum(F.size("ids")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n))).first()
    return row[0] or 0, row[1] or 0


def _list_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("term", pa.binary()), ("n", pa.int64())])
    for batch in batches:
        for at in range(batch.num_rows):
            held, starts = (batch.column(i)[at].as_buffer() for i in range(2))
            yield batch_of(kind, held.to_pybytes().split(), np.diff(unpacked(starts).astype(np.int64)))


def document_frequencies(index: DataFrame) -> DataFrame:
    """term and df over all shards."""
    return index.select("terms", "starts").mapInArrow(_list_sizes, "term binary, n long").groupBy("term").agg(F.sum("n").alias("df"))


# --- search -------------------------------------------------------------------------


def _question_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("question", pa.int64()), ("term", pa.binary())])
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            found = [(q, t) for q, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for t in terms(text)]
            yield batch_of(kind, [q for q, _ in found], [t for _, t in found])


class Scores:
    """Impacts of a corpus: 64-bit whole numbers, div rounding down."""

    def __init__(self, documents: int, tokens: int):
        self.documents, self.tokens = documents, tokens

    def norms(self, lengths: np.ndarray) -> np.ndarray:
        if 75 * int(lengths.max(initial=0)) * self.documents < 1 << 63:
            return 25 + 75 * lengths.astype(np.int64) * self.documents // self.tokens
        return np.array([25 + 75 * int(n) * self.documents // self.tokens for n in lengths])

    @staticmethod
    def impacts(counts: np.ndarray, norms: np.ndarray) -> np.ndarray:
        counts = counts.astype(np.int64)
        return 1_000_000_000 * counts // (1000 * counts + 8 * norms)


def ranked(asked: list[tuple[int, np.ndarray, np.ndarray, int]], documents: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and whole scores of all documents that can be among the k highest.

    asked: weight, places, impacts and bound of each term, the rarest first.
    """
    score, opened = np.zeros(documents, np.int64), np.zeros(documents, bool)
    left = np.append(np.cumsum([bound for *_, bound in asked][::-1])[::-1], 0)  # bounds of this term and all after it
    closed = False
    for i, (weight, places, impacts, _) in enumerate(asked):
        if not closed and i:
            have = np.flatnonzero(opened)
            closed = len(have) >= k and left[i] < np.partition(score[have], len(have) - k)[len(have) - k]
        if closed:
            known = opened[places]
            places, impacts = places[known], impacts[known]
        else:
            opened[places] = True
        score[places] += weight * impacts
    have = np.flatnonzero(score > 0)
    return have, score[have]


def _hits(ids: pa.Array, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    number, docs, score = (np.concatenate(c) for c in zip(*found))
    return pa.RecordBatch.from_arrays([pa.array(number), ids.take(pa.array(docs, pa.int64())), pa.array(score)], ["question", "doc_id", "score"])


def _answers(questions: list[tuple[int, list[tuple[bytes, int]]]], scores: Scores, k: int, kind: pa.DataType | None = None):
    """Each shard's k best (and their equals) per question. questions: number, and (term, weight) from the rarest."""
    wanted = sorted({t for _, asked in questions for t, _ in asked})

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, lengths = (batch.column(i)[at].values for i in range(2))
                held, *blobs = (batch.column(i)[at].as_buffer() for i in range(2, len(NAMES)))
                starts, places, counts, most, shortest = map(unpacked, blobs)
                norms, lists = scores.norms(np.asarray(lengths)), {}
                for term, i in zip(wanted, pc.index_in(pa.array(wanted, pa.binary()), value_set=pa.array(held.to_pybytes().split(), pa.binary())).to_pylist()):
                    if i is not None:
                        own = places[starts[i] : starts[i + 1]]
                        bound = int(scores.impacts(most[i : i + 1], scores.norms(shortest[i : i + 1]))[0])
                        lists[term] = own, scores.impacts(counts[starts[i] : starts[i + 1]], norms[own]), bound
                found, rows = [], 0
                for number, asked in questions:
                    here = [(w, *lists[t][:2], w * lists[t][2]) for t, w in asked if t in lists]
                    docs, score = ranked(here, len(lengths), k)
                    if len(docs) > k:
                        near = score >= np.partition(score, len(score) - k)[len(score) - k]
                        docs, score = docs[near], score[near]
                    found.append((np.full(len(docs), number), docs, score))
                    rows += len(docs)
                    if rows >= HIT_ROWS:
                        yield _hits(ids, found)
                        found, rows = [], 0
                if found:
                    yield _hits(ids, found)

    return answered


def ranked_search(
    df: DataFrame, questions: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = K,
) -> DataFrame:
    """item_id, rank, doc_id and score of the k highest-scoring documents of each question."""
    index = build_index(df, id_col, text_col)
    documents, tokens = corpus_size(index)
    items = stage(questions.select(F.monotonically_increasing_id().alias("question"), F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), "questions")
    named = items.select("question", "text").mapInArrow(_question_terms, "question long, term binary")
    named = stage(named.groupBy("question", "term").agg(F.count(F.lit(1)).alias("times")), "asked")
    known = stage(named.select("term").distinct(), "terms")
    df_of = stage(document_frequencies(index).join(bounded(known), "term", "left_semi"), "frequencies")
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = stage(named.join(df_of, "term").select("question", "term", "df", (weight * F.col("times")).alias("weight")), "weighed")
    blocks = max(1, -(-weighed.count() // ASKED_ROWS))
    kind = StructType([StructField("question", items.schema["question"].dataType), StructField("doc_id", df.schema[id_col].dataType), *StructType.fromDDL("score long").fields])
    found = None
    for block in range(blocks):  # each scans the shards once
        rows = weighed.filter(F.pmod(F.xxhash64("question"), F.lit(blocks)) == block)
        asked = rows.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("df", "term", "weight"))).alias("asked")).collect()
        block_questions = [(r["question"], [(bytes(a["term"]), a["weight"]) for a in r["asked"]]) for r in asked]
        hits = index.mapInArrow(_answers(block_questions, Scores(documents, tokens), k), kind)
        found = hits if found is None else found.unionByName(hits)
    best = top_k(found, ["question"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], k)
    return best.join(bounded(items.select("question", "item_id")), "question").select("item_id", "rank", "doc_id", "score")

"""Inverted lists of a shard of texts, in blocks with their largest weight, and exact search over them.

Plain helpers that run inside Arrow tasks on one bounded shard at a time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Ship these helpers inside the task, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARD = 4096  # texts of one shard
BLOCK = 64  # neighbouring texts whose postings of a term share one largest weight
PROBE = 4  # blocks that are scored before the others are held against the k-th score
DIGITS = 12  # decimals in which scores are compared
LISTS = "terms array<string>, starts array<int>, places array<int>, counts array<int>"
WEIGHED = "terms array<string>, term_at array<int>, blocks array<int>, tops array<double>, block_at array<int>, places array<int>, weights array<double>"


def shard_row(ids: list, tokens: list[list[str]] | pa.Array) -> dict:
    """The texts' order by their ids, and per term, numbered as they come in it, the places and counts of its texts."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    tokens = (tokens if isinstance(tokens, pa.Array) else pa.array(tokens, pa.list_(pa.string()))).take(pa.array(order, pa.int64()))
    place = np.repeat(np.arange(len(ids)), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
    coded = tokens.flatten().dictionary_encode()
    flat = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    said = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    if not said.all():  # what a text without words is split into
        number = np.cumsum(said) - 1
        place, flat = place[said[flat]], number[flat[said[flat]]]
    terms = coded.dictionary.filter(pa.array(said)).to_pylist()
    pairs, counts = np.unique(flat * len(ids) + place, return_counts=True)
    starts = np.searchsorted(pairs // len(ids), np.arange(len(terms) + 1))
    return {"order": order, "terms": terms, "starts": starts, "places": pairs % len(ids), "counts": counts}


def _one(values, kind: pa.DataType) -> pa.Array:
    """One row that holds the values as its list."""
    values = values.cast(kind.value_type) if isinstance(values, pa.Array) else pa.array(values, kind.value_type)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values).cast(kind)


def _joined(parts: list[pa.Array]) -> pa.Array:
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)


def shards(scope: int, keys: list[str], schema: pa.Schema, size: int = SHARD):
    """Rows of (scope columns, id struct, words joined by blanks) in runs of equal scopes -> one row per shard."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, words, held = None, [], [], 0

        def row():
            own = _joined(ids)
            tokens = pc.split_pattern(pc.fill_null(_joined(words), ""), " ")
            lists = shard_row(list(zip(*(own.field(k).to_pylist() for k in keys))), tokens)
            lists["ids"] = own.take(pa.array(lists["order"], pa.int64()))
            return pa.RecordBatch.from_arrays([*(pa.array([v], f.type) for v, f in zip(current, schema)), *(_one(lists[f.name], f.type) for f in list(schema)[scope:])], schema=schema)

        for batch in batches:
            rows = batch.num_rows
            scopes = list(zip(*(batch.column(i).to_pylist() for i in range(scope)))) if scope else [()] * rows
            edges = [0, *(i for i in range(1, rows) if scopes[i] != scopes[i - 1]), rows] if rows else []
            for low, high in zip(edges, edges[1:]):
                while low < high:
                    if held and (scopes[low] != current or held >= size):
                        yield row()
                        ids, words, held = [], [], 0
                    current, taken = scopes[low], min(high - low, size - held)
                    ids.append(batch.column(scope).slice(low, taken))
                    words.append(batch.column(scope + 1).slice(low, taken))
                    low, held = low + taken, held + taken
        if held:
            yield row()

    return built


def frequencies(scope: int, schema: pa.Schema):
    """Shards as (scope columns, terms, starts) -> a row per term with the number of texts that hold it."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                terms, starts = (batch.column(scope + i)[at].values for i in range(2))
                own = [batch.column(i).take(pa.array(np.full(len(terms), at))) for i in range(scope)]
                yield pa.RecordBatch.from_arrays([*own, terms, pa.array(np.diff(np.asarray(starts)), pa.int64())], schema=schema)

    return counted


def weigh(starts: np.ndarray, places: np.ndarray, counts: np.ndarray, idf: np.ndarray, texts: int, block: int = BLOCK) -> dict:
    """Weights of unit length per text, and the largest of each term's blocks."""
    raw = counts * np.repeat(idf, np.diff(starts))
    squares = raw * raw
    order = np.lexsort((squares, places))  # of each text in order of size, so that equal texts get equal lengths
    edges = np.searchsorted(places[order], np.arange(texts))
    edges = edges[edges < len(places)]
    length = np.ones(texts)
    if len(places):
        held = np.unique(places)
        length[held] = np.sqrt(np.add.reduceat(squares[order], np.searchsorted(places[order], held)))
    weights = raw / length[places]
    term = np.repeat(np.arange(len(idf)), np.diff(starts))
    cut = np.flatnonzero(np.append(True, (np.diff(term) != 0) | (np.diff(places // block) != 0))) if len(places) else np.zeros(0, np.int64)
    return {
        "term_at": np.searchsorted(term[cut], np.arange(len(idf) + 1)), "blocks": places[cut] // block, "places": places, "weights": weights,
        "tops": np.maximum.reduceat(weights, cut) if len(cut) else weights, "block_at": np.append(cut, len(places)),
    }


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (shard, idf) in order of shard and term -> the numbers of each shard as one list."""
    current, parts = None, []

    def row() -> pa.RecordBatch:
        lists = pa.array([np.concatenate(parts)], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), lists], ["shard", "idf"])

    for batch in batches:
        shard, idf = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo == hi:
                continue
            if parts and shard[lo] != current:
                yield row()
                parts = []
            current = int(shard[lo])
            parts.append(idf[lo:hi].copy())
    if parts:
        yield row()


def weighed(kept: int, schema: pa.Schema, block: int = BLOCK):
    """Shards with the idf of each term -> shards of weights in blocks; the first `kept` columns stay."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            for at in range(batch.num_rows):
                values = [np.asarray(column[c][at].values) for c in ("starts", "places", "counts", "idf")]
                row = weigh(*values, len(column["ids"][at]), block)
                row["terms"] = column["terms"][at].values
                rest = [_one(row[f.name], f.type) for f in list(schema)[kept:]]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, 1) for i in range(kept)), *rest], schema=schema)

    return made


class Shard:
    """Weights of one shard, and the k best texts of a question in it."""

    def __init__(self, terms: list[str] | dict[str, int], term_at, blocks, tops, block_at, places, weights, texts: int, block: int = BLOCK):
        self.number = terms if isinstance(terms, dict) else {t: i for i, t in enumerate(terms)}
        self.term_at, self.blocks, self.tops, self.block_at, self.places, self.weights = term_at, blocks, tops, block_at, places, weights
        self.texts, self.block, self.scored = texts, block, 0

    def _score(self, entries: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the texts in some blocks, given as entries of all asked terms; only their postings are read."""
        at, size = _ranges(self.block_at[entries], self.block_at[entries + 1])
        self.scored += len(at)
        score = np.bincount(self.places[at], np.repeat(weight, size) * self.weights[at], self.texts)
        held = np.flatnonzero(score > 0)
        return held, np.round(score[held], DIGITS)

    def best(self, asked: list[tuple[str, float]], k: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Up to k places by falling score, equal ones in order of place; none that is below `least`.

        Blocks whose terms' largest weights cannot add up to the k-th score of the most
        promising ones are skipped; equal scores are not, as the order of ids decides there.
        """
        known = [(i, w) for t, w in sorted(asked) if (i := self.number.get(t)) is not None]
        if not known:
            return np.zeros(0, np.int64), np.zeros(0)
        number = np.array([i for i, _ in known])
        entries, size = _ranges(self.term_at[number], self.term_at[number + 1])
        weight, block = np.repeat([w for _, w in known], size), self.blocks[entries]
        slack = 2 * 10.0**-DIGITS  # sums of doubles, and rounding
        bound = np.bincount(block, weight * self.tops[entries], self.texts // self.block + 1)
        open_ = (bound > 0) & (bound + slack >= least)
        first = np.zeros(len(bound), bool)
        order = np.flatnonzero(open_)
        first[order[np.argsort(-bound[order], kind="stable")[:PROBE]]] = True
        take = first[block]
        places, score = self._score(entries[take], weight[take])
        if len(score) >= k:
            least = max(least, np.partition(score, len(score) - k)[len(score) - k])
        rest = open_ & ~first & (bound + slack >= least)
        if rest.any():
            take = rest[block]
            more, scores = self._score(entries[take], weight[take])
            places, score = np.concatenate([places, more]), np.concatenate([score, scores])
        keep = score >= least
        places, score = places[keep], score[keep]
        order = np.lexsort((places, -score))[:k]
        return places[order], score[order]


def _ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of several ranges, one after the other, and their sizes."""
    size = (stops - starts).astype(np.int64)
    return np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum()), size


def searched(k: int, schema: pa.Schema, block: int = BLOCK):
    """Shards with the questions asked of them -> question, id and score of each shard's k best.

    A task remembers the k-th best score of every question over the shards it has seen and
    skips what is below it.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            column = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            for at in range(batch.num_rows):
                ids, asked = column["ids"][at].values, column["asked"][at].values
                lists = [np.asarray(column[c][at].values) for c in ("term_at", "blocks", "tops", "block_at", "places", "weights")]
                wanted = pc.unique(asked.field(1))
                number = pc.index_in(wanted, value_set=column["terms"][at].values)
                shard = Shard({t: i for t, i in zip(wanted.to_pylist(), number.to_pylist()) if i is not None}, *lists, len(ids), block)
                questions: dict[int, list[tuple[str, float]]] = {}
                for q, t, w in zip(*(asked.field(i).to_pylist() for i in range(3))):
                    questions.setdefault(q, []).append((t, w))
                numbers, places, scores = [], [], []
                for q, terms in questions.items():
                    before = seen.get(q, np.zeros(0))
                    own, score = shard.best(terms, k, before[k - 1] if len(before) >= k else 0.0)
                    if len(own):
                        seen[q] = np.sort(np.concatenate([before, score]))[::-1][:k]
                        numbers.append(np.full(len(own), q))
                        places.append(own)
                        scores.append(score)
                if numbers:
                    taken = ids.take(pa.array(np.concatenate(places)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(numbers)), taken, pa.array(np.concatenate(scores))], schema=schema)

    return found

"""Blocks of vectors with their ranges of distance to fixed pivots, and exact nearest neighbours over them.

Plain helpers that run inside Arrow tasks on bounded blocks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Ship these helpers inside the task, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 256  # vectors of one block
RUN = 64  # blocks' worth of vectors that are dealt to blocks together
AT_ONCE = 64  # queries compared with a block at once


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None, :] - pivots) ** 2).sum(axis=2))


def blocks(x: np.ndarray, pivots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, least and largest distance to each pivot, of blocks of vectors that are near the same pivot at a like distance."""
    far = distances(x, pivots)
    cell = far.argmin(axis=1)
    order = np.lexsort((far.min(axis=1), cell))
    cuts = np.flatnonzero(np.diff(cell[order])) + 1
    out = []
    for run in np.split(order, cuts):
        for part in np.array_split(run, -(-len(run) // size)):
            part = np.sort(part)
            out.append((part, far[part].min(axis=0), far[part].max(axis=0)))
    return out


def built(schema: pa.Schema, scope: int, pivots: np.ndarray, size: int = BLOCK):
    """Rows of (scope, id, v), scopes in runs, -> blocks (scope, ids, vectors, low, high)."""

    def rows_of(own: tuple, ids: list, vectors: list) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(ids)), key=ids.__getitem__)  # of equal distances the lower id comes first
        x = np.array([vectors[i] for i in order], np.float64)
        for part, low, high in blocks(x, pivots, size):
            values = [*own, [ids[order[i]] for i in part], x[part].ravel(), low, high]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, vectors = None, [], []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(scope)]
            for i, (id_, v) in enumerate(zip(batch.column(scope).to_pylist(), batch.column(scope + 1).to_pylist())):
                own = tuple(c[i] for c in columns)
                if ids and (own != current or len(ids) >= RUN * size):
                    yield from rows_of(current, ids, vectors)
                    ids, vectors = [], []
                current = own
                ids.append(id_)
                vectors.append(v)
        if ids:
            yield from rows_of(current, ids, vectors)

    return build


class Nearest:
    """The `limit` nearest distances of some queries so far, and what a block adds to them."""

    def __init__(self, queries: np.ndarray, pivots: np.ndarray, limit: int):
        self.queries, self.limit, self.compared = queries, limit, 0
        self.far = distances(queries, pivots)
        self.best = np.full((len(queries), limit), np.inf)

    def add(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, place and squared distance of the block's vectors that are among the nearest so far.

        No vector of the block is nearer to a query than the gap between the query's distance
        to a pivot and the block's range of distances to it (triangle inequality), so blocks
        beyond the last kept distance are skipped.
        """
        gap = np.maximum(self.far - high, low - self.far).max(axis=1)
        reach = np.flatnonzero(gap <= np.sqrt(self.best[:, -1]) * (1 + 1e-9) + 1e-9)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for start in range(0, len(reach), AT_ONCE):
            asked = reach[start : start + AT_ONCE]
            diff = x[None, :, :] - self.queries[asked][:, None, :]
            score = np.einsum("qnd,qnd->qn", diff, diff)
            self.compared += score.size
            for q, own in zip(asked, score):
                near = np.flatnonzero(own <= self.best[q, -1])
                near = near[np.argsort(own[near], kind="stable")[: self.limit]]
                if len(near):
                    self.best[q] = np.sort(np.append(self.best[q], own[near]))[: self.limit]
                    out.append((np.full(len(near), q), near, own[near]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(c) for c in zip(*out))


def searched(schema: pa.Schema, pivots: np.ndarray, limit: int):
    """Blocks with the queries asked of them (numbers, and their vectors in one list) -> query, id and score."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, Nearest] = {}
        dims = pivots.shape[1]
        for batch in batches:
            column = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            for at in range(batch.num_rows):
                asked = column["asked"][at].values
                numbers = np.asarray(asked.field(0))
                pack = (int(numbers[0]), len(numbers))
                if pack not in seen:
                    seen[pack] = Nearest(np.asarray(asked.field(1).flatten(), dtype=np.float64).reshape(-1, dims), pivots, limit)
                x = np.asarray(column["vectors"][at].values).reshape(-1, dims)
                q, place, score = seen[pack].add(x, np.asarray(column["low"][at].values), np.asarray(column["high"][at].values))
                if len(q):
                    ids = column["ids"][at].values.take(pa.array(place))
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[q]), ids, pa.array(score)], schema=schema)

    return search

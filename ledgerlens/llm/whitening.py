"""Whitening of embeddings by incremental eigendecomposition.

An entry c becomes the whole number x = floor(64 * c) + 1000000. Each partition keeps the
spectrum of its centred scatter matrix and changes it only by rank-one updates: the new
eigenvalues are the roots of the secular equation, found by bisection between the old ones;
entries of the update that do nothing, and old eigenvalues that agree, are deflated; the
eigenvectors follow from the update vector that has exactly those roots, so they stay
orthogonal. BLOCK rows at a time are first reduced to their triangular factor, whose at most
`dims` rows have the same scatter as the block, so a block takes dims + 1 updates; fewer rows
than dims are taken one by one. Spectra of partitions are combined the same way, FAN at a
time, until one is left. A last pass over all rows projects them on its vectors, and the small
matrix of that projection (Rayleigh-Ritz) gives eigenvalues and vectors to double precision.

What passes between tasks or through the driver is dims * dims numbers a partition.

Defined cases: rows whose vector is null or holds null, NaN or infinite entries are left out,
and so are vectors whose length is not the most frequent one (of equal counts the longest);
64 * c beyond +-2^62 counts as that bound; rows that repeat an id are rows of their own, null
ids stay null; equal vectors are counted as often as they stand; a direction without variance
(e <= 1e-12 of the trace) has no whitened value (null) and does not count in identity_error;
a deviation that does not fit a long is null; fewer than 32 dimensions give fewer components;
an empty table, or one without vectors, gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import batch_of, fields, stage

OFFSET = 1_000_000
COMPONENTS = 32
BLOCK = 16_384  # rows that are reduced to a triangular factor at once
FAN = 8  # spectra that one task combines
FLAT = 1e-12  # share of the trace below which a direction counts as without variance
EPS = np.finfo(float).eps
STATE = "part long, n long, sums array<decimal(38,0)>, numbers binary"
STATE_COLUMNS = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("numbers", pa.binary())])


# --- one rank-one update ------------------------------------------------------------


def _deflated(d: np.ndarray, z: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Which entries take part in the secular equation; rotates agreeing eigenvalues so that one of them drops out."""
    tol = 8 * EPS * max(np.abs(d).max(), z @ z)
    live = np.abs(z) * np.sqrt(z @ z) > tol
    last = -1
    for i in np.flatnonzero(live):
        if last >= 0:
            tau = np.hypot(z[last], z[i])
            c, s = z[i] / tau, z[last] / tau
            if abs((d[i] - d[last]) * c * s) <= tol:
                d[last], d[i] = d[last] * c * c + d[i] * s * s, d[last] * s * s + d[i] * c * c
                z[last], z[i] = 0.0, tau
                u[:, last], u[:, i] = c * u[:, last] - s * u[:, i], s * u[:, last] + c * u[:, i]
                live[last] = False
        last = i
    return live


def secular(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z^2 / (d - x)) = 0 for ascending, different d; and x_i - d_j, each to full relative precision.

    Root i lies between d_i and d_{i+1}, the last one up to z'z further. It is measured from
    the nearer of the two, so that the difference to it is not rounded away.
    """
    k, w = len(d), z * z
    gap = np.append(np.diff(d), z @ z)

    def value(from_: np.ndarray, x: np.ndarray) -> np.ndarray:
        return 1 + (w / (from_ - x[:, None])).sum(axis=1)

    near = value(d - d[:, None], gap / 2) >= 0
    near[-1] = True
    origin = np.arange(k) + ~near
    from_ = d - d[origin][:, None]
    low, high = np.where(near, 0.0, -gap / 2), np.where(near, gap / 2, 0.0)
    high[-1] = gap[-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(64):
            x = (low + high) / 2
            over = value(from_, x) > 0
            high, low = np.where(over, x, high), np.where(over, low, x)
    x = np.where(near, high, low)
    return d[origin] + x, x[:, None] - from_


def rank_one(d: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and the vectors (columns) of u diag(d) u' + v v'."""
    z = u.T @ v
    if not z.any():
        return d, u
    d, u = d.copy(), u.copy()
    live = _deflated(d, z, u)
    at = np.flatnonzero(live)
    at = at[np.argsort(d[at], kind="stable")]
    if len(at):
        old = d[at]
        roots, diff = secular(old, z[at])
        k = len(at)
        below = np.arange(k)[:, None] < np.arange(k)
        poles = np.where(below, old[:, None], np.append(old[1:], 0)[:, None]) - old
        poles[-1] = np.where(below[-1], poles[-1], 1.0)
        exact = np.sqrt(np.abs(np.prod(diff / poles, axis=0))) * np.sign(z[at])  # the update that has just these roots
        q = exact / -diff
        q /= np.sqrt((q * q).sum(axis=1))[:, None]
        u[:, at] = u[:, at] @ q.T
        d[at] = roots
    order = np.argsort(d, kind="stable")
    return d[order], u[:, order]


class Spectrum:
    """Rows seen, their mean, and the eigenvalues and vectors of their centred scatter matrix."""

    def __init__(self, dims: int):
        self.n, self.mean, self.d, self.u = 0, np.zeros(dims), np.zeros(dims), np.eye(dims)

    def absorb(self, n: int, mean: np.ndarray, rows: np.ndarray) -> None:
        """Rows given by their number, mean and any vectors with the same centred scatter."""
        if not n:
            return
        for row in rows:
            self.d, self.u = rank_one(self.d, self.u, row)
        if self.n:
            self.d, self.u = rank_one(self.d, self.u, (mean - self.mean) * np.sqrt(self.n * n / (self.n + n)))
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n += n

    def add(self, x: np.ndarray) -> None:
        if len(x) <= x.shape[1]:
            for row in x:
                self.absorb(1, row, np.zeros((0, len(row))))
        else:
            mean = x.mean(axis=0)
            self.absorb(len(x), mean, np.linalg.qr(x - mean, mode="r"))

    def scatter_rows(self) -> np.ndarray:
        return (self.u * np.sqrt(np.maximum(self.d, 0))).T

    def numbers(self) -> bytes:
        return np.concatenate([self.mean, self.d, self.u.ravel()]).tobytes()

    @classmethod
    def of(cls, n: int, numbers: bytes, dims: int) -> Spectrum:
        values, out = np.frombuffer(numbers), cls(dims)
        out.n, out.mean, out.d, out.u = n, values[:dims], values[dims : 2 * dims], values[2 * dims :].reshape(dims, dims)
        return out


# --- rows in tasks ------------------------------------------------------------------


def steps(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """floor(64 * c) of each entry as whole numbers."""
    flat = batch.column(batch.schema.get_field_index("v")).flatten()
    values = np.floor(64 * np.asarray(flat, dtype=np.float64))
    return np.clip(values, -(2.0**62), 2.0**62).astype(np.int64).reshape(-1, dims)


def exact_sums(x: np.ndarray) -> list[int]:
    if len(x) and float(np.abs(x).max()) * len(x) >= 2.0**62:
        return [sum(map(int, column)) for column in x.T]
    return [int(s) for s in x.sum(axis=0)]


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    held: list[np.ndarray] = []
    for batch in batches:
        if batch.num_rows:
            held.append(steps(batch, dims))
        if sum(map(len, held)) >= BLOCK:
            yield np.concatenate(held)
            held = []
    if held:
        yield np.concatenate(held)


def _spectra(dims: int):
    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum, sums = Spectrum(dims), [0] * dims
        for x in _blocks(batches, dims):
            sums = [a + b for a, b in zip(sums, exact_sums(x))]
            for start in range(0, len(x), BLOCK):
                spectrum.add(x[start : start + BLOCK].astype(np.float64))
        if spectrum.n:
            yield batch_of(STATE_COLUMNS, [TaskContext.get().partitionId()], [spectrum.n], [[Decimal(s) for s in sums]], [spectrum.numbers()])

    return built


def _combined(dims: int):
    def combined(key, rows):
        total, sums = Spectrum(dims), [Decimal(0)] * dims
        rows = rows.sort_values("part")
        for n, own, numbers in zip(rows["n"], rows["sums"], rows["numbers"]):
            other = Spectrum.of(int(n), numbers, dims)
            total.absorb(other.n, other.mean, other.scatter_rows())
            sums = [a + b for a, b in zip(sums, own)]
        return type(rows)({"part": [key[0]], "n": [total.n], "sums": [sums], "numbers": [total.numbers()]})

    return combined


def _added(key, rows):
    """Numbers of several states added up."""
    total = np.sum([np.frombuffer(b) for b in rows.sort_values("part")["numbers"]], axis=0)
    return type(rows)({"part": [key[0]], "n": [int(rows["n"].sum())], "sums": [[]], "numbers": [total.tobytes()]})


def to_one(states: DataFrame, combine) -> dict | None:
    """States of partitions combined FAN at a time, level by level, until one is left."""
    states = stage(states, "states")
    left = states.agg(F.max("part")).first()[0]
    while left:
        states = states.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInPandas(combine, STATE)
        left //= FAN
    row = states.first()
    return row and row.asDict()


def _ritz(dims: int, n: int, sums: list[int], u: np.ndarray):
    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((dims, dims)), 0
        for x in _blocks(batches, dims):
            y = centred(x, n, sums)[0] @ u
            total, seen = total + y.T @ y, seen + len(x)
        if seen:
            yield batch_of(STATE_COLUMNS, [TaskContext.get().partitionId()], [seen], [[]], [total.tobytes()])

    return projected


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """x - S / n as doubles from the exact n * x - S, and the sum of the squares of those whole numbers (null beyond a long)."""
    most = n * int(np.abs(x).max()) + max(map(abs, sums)) if len(x) else 0
    if most * most * len(sums) < 2**63:
        whole = n * x - np.array(sums)
        return whole / n, (whole * whole).sum(axis=1).tolist()
    whole = [[n * int(c) - s for c, s in zip(row, sums)] for row in x]
    squares = [sum(c * c for c in row) for row in whole]
    return np.array([[c / n for c in row] for row in whole]), [s if s < 2**63 else None for s in squares]


def _whitened(dims: int, n: int, sums: list[int], basis: np.ndarray, root: np.ndarray):
    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y, deviation = centred(steps(batch, dims), n, sums)
                w = np.divide(y @ basis, root, out=np.full((len(y), len(root)), np.nan), where=root > 0)
                lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), pa.array(w.ravel(), from_pandas=True))
                row = batch.column(0)
                yield batch_of(pa.schema([(batch.schema.names[0], row.type), ("deviation", pa.int64()), ("w", lists.type)]), row, deviation, lists)

    return whitened


def _products(k: int):
    """Sum of the rows and of their products with each other, null entries as zero."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((k + 1, k)), 0
        for batch in batches:
            w = np.nan_to_num(np.asarray(batch.column(0).flatten(), dtype=np.float64).reshape(-1, k))
            total += np.vstack([w.sum(axis=0), w.T @ w])
            seen += len(w)
        if seen:
            yield batch_of(STATE_COLUMNS, [TaskContext.get().partitionId()], [seen], [[]], [total.tobytes()])

    return summed


# --- operator -----------------------------------------------------------------------


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """The id and v of the rows with a whole finite vector of the most frequent length, and that length (0 if there is none)."""
    c = F.col(vector_col)
    finite = F.forall(c, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = df.select(id_col, c.alias("v")).filter(c.isNotNull() & finite)
    sizes = rows.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max_by("dims", F.struct("n", "dims"))).first()[0] or 0
    return rows.filter(F.size("v") == most), most


def fit(rows: DataFrame, dims: int) -> tuple[int, list[int], np.ndarray, np.ndarray]:
    """n, the exact sums of floor(64 * c) per dimension, eigenvalues of the covariance (falling) and their vectors (columns)."""
    vectors = rows.select("v")
    state = to_one(vectors.mapInArrow(_spectra(dims), STATE), _combined(dims))
    n, sums = state["n"], [int(s) for s in state["sums"]]
    u = np.linalg.qr(Spectrum.of(n, state["numbers"], dims).u)[0]
    total = to_one(vectors.mapInArrow(_ritz(dims, n, sums, u), STATE), _added)
    h = np.frombuffer(total["numbers"]).reshape(dims, dims) / n
    e, turn = np.linalg.eigh((h + h.T) / 2)
    return n, sums, e[::-1], (u @ turn)[:, ::-1]


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The id, component, n, deviation, whitened, explained and identity_error of every kept row and component."""
    rows, dims = valid_vectors(df, id_col, vector_col)
    own = rows.schema[id_col]
    columns = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dims:
        return df.sparkSession.createDataFrame([], fields(own, columns))
    n, sums, e, vectors = fit(rows, dims)
    k, trace = min(components, dims), float(np.maximum(e, 0).sum())
    root = np.where(e[:k] > FLAT * trace, np.sqrt(np.maximum(e[:k], 0)), 0.0)
    white = rows.mapInArrow(_whitened(dims, n, sums, vectors[:, :k].copy(), root), fields(own, "deviation long, w array<double>"))
    white = stage(white, "white")
    total = np.frombuffer(to_one(white.select("w").mapInArrow(_products(k), STATE), _added)["numbers"]).reshape(k + 1, k) / n
    error = np.abs(total[1:] - np.outer(total[0], total[0]) - np.diag((root > 0).astype(float))).max()
    explained = F.array(*[F.lit(float(x)) if trace else F.lit(None).cast("double") for x in e[:k] / (trace or 1)])
    out = white.select(id_col, "deviation", F.posexplode("w").alias("component", "whitened"))
    return out.select(
        id_col, (F.col("component") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("component")).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )

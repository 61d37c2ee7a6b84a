"""Staged tables, bounded broadcasts, and texts as numpy arrays inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ledgerlens.session import scratch_path

BROADCAST_ROWS = 200_000  # most rows of a staged, narrow table that is sent to every task
KEY_ROWS = 2_000_000  # most 64-bit numbers that are sent to every task, some 16 bytes each
SLICE_BYTES = 1 << 20  # text handled at once by a task; a longer text is a slice of its own

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U64 = np.uint64


_recorded: list[list[str]] = []  # of the scopes that are open


@contextmanager
def staged_paths():
    """The list of tables that are staged within the scope."""
    _recorded.append([])
    try:
        yield _recorded[-1]
    finally:
        _recorded.pop()


def drop_staged(spark, paths: list[str]) -> None:
    """Removes staged tables that no frame reads any more."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """The rows written once to the shared folder and read back; cuts the lineage, survives lost executors.

    group_bytes: for rows of megabytes, of which a writer and a reader hold a row group at
    once; unless told, the writer looks at its size only after 100 rows.
    """
    path = scratch_path(df.sparkSession, f"llm-{name}")
    for paths in _recorded:
        paths.append(path)
    writer = df.write.option("compression", "zstd")
    if group_bytes:
        writer = writer.option("parquet.block.size", group_bytes).option("parquet.page.size.row.check.min", 1)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(staged: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A staged narrow table, marked for broadcast only if counting shows at most `rows` rows."""
    return F.broadcast(staged) if staged.limit(rows + 1).count() <= rows else staged


def left_by_key(rows: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """`rows` left-joined to a staged table of one row per key; rows that it surely does not hold stay where they are.

    They are told by 64-bit hashes of its keys, sent to every task if at most KEY_ROWS; a
    row that only shares a hash goes through the join and finds nothing there.
    """
    hashes = stage(staged.select(F.xxhash64(key).alias("_held")).distinct(), "held-keys")
    if hashes.limit(KEY_ROWS + 1).count() > KEY_ROWS:
        return rows.join(staged, key, "left")
    held = F.broadcast(hashes)
    same = F.xxhash64(key) == F.col("_held")
    found = rows.join(held, same, "left_semi").join(staged, key, "left")
    return found.unionByName(rows.join(held, same, "left_anti"), allowMissingColumns=True)


def ascii_lower(text: Column | str) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_words(text: Column, separators: str) -> Column:
    """The words between runs of separators; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def in_split(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls in one part of the ids; null ids never do."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with about `limit` bytes of text: the rows, their bytes, and where each text begins (and the end)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        array = batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).cast(pa.large_binary())
        offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
        raw = array.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        start = 0
        while start < len(array):
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
            stop = min(stop, len(array))
            yield batch.slice(start, stop - start), data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
            start = stop


def word_spans(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text, and for each text (and the end) its first word."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~SPACE[data] if solid is None else solid
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:n]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_values(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of each text (A-Z lower-cased on request), and for each text (and the end) its first word."""
    own = LOWER[data] if lower else data
    each = [own[a:b].tobytes().split() for a, b in zip(offsets, offsets[1:])]
    first = np.cumsum([0, *map(len, each)])
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for words in each for w in words), U64, int(first[-1])), first


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Rolling:
    """Polynomial fingerprints modulo 2^64 of any span of an array of bytes or of hashes, from one running sum.

    For spans of 1,024 and more there are different ones that agree whatever the base (a
    Thue-Morse sequence and its mirror image), so nothing that long is told apart by it alone.
    """

    def __init__(self, seed: int):
        self.seed = U64(seed)
        self.table = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
        self.base = int(mix(np.array([seed + 77], U64))[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(data):
            n = max(SLICE_BYTES, len(data)) + 1
            self.up, self.down = np.full(n, self.base, U64), np.full(n, self.inverse, U64)
            self.up[0] = self.down[0] = 1
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)
        out = np.zeros(len(data) + 1, U64)
        values = self.table[data] if data.dtype == np.uint8 else mix(data + self.seed)
        np.cumsum(values * self.up[: len(data)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(U64))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def fields(first: StructField, rest: str) -> StructType:
    """A schema of one given field and others in DDL."""
    return StructType([first, *StructType.fromDDL(rest).fields])

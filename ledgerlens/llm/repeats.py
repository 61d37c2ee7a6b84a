"""Repeated strings of a fixed length in bytes or in words, by minimizers and fingerprints of windows.

A window is a suffix cut to `length` bytes (or words, whatever stands between them); two
windows are repeats if they are equal in all of them. No suffix is sorted, in place of a radix sort by leading bytes windows are dealt by
what equal windows must share, and grouped by fingerprint. They are first dealt by the
window's least gram (GRAM bytes or WORD_GRAM words, the least by fingerprint of all in the window): neighbours
share it, so one row stands for a run of some 170 windows, and a gram that stands once ends
its windows at once. Within a gram a pass compares ever smaller parts of a run:

* whole runs: equal hulls (all bytes of a run's windows) make all windows of both repeats;
* blocks of BLOCK windows: equal hulls do the same; windows whose block shares its core (the
  bytes common to all of a block's windows) with no other block are not repeated;
* single windows of the blocks that are left: equal groups are exactly the repeats.

Equality is by 128-bit fingerprints. Rows of one gram are never gathered: every pass is
counts per fingerprint, combined before the shuffle, and joins with one row per key.

Defined cases: a null or empty text has no bytes; texts shorter than the length have no
windows; a document that stands more than once repeats all its windows; matches never
cross documents; with words, the bytes from the first word of a window to its last are cut; an empty table gives an empty result; cutting may split a UTF-8 character,
so the remaining bytes are binary (`kept_text` leaves split characters out); other columns
are carried where stated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import U64, Rolling, batch_of, bounded, fields, left_by_key, slices, stage, word_spans, word_values

LENGTH = 400
GRAM, WORD_GRAM = 64, 8
BLOCK = 16
ONE, TWO = Rolling(41), Rolling(43)
LOW = U64(0xFFFFFFFF)
RUN = "key binary, first long, last long, anchor long, gram long, hull binary, n long"
RUN_COLUMNS = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("last", pa.int64()), ("anchor", pa.int64()), ("gram", pa.int64()), ("hull", pa.binary()), ("n", pa.int64())])


def text_key(text: Column) -> Column:
    """128 bits of a text's SHA-256; equal texts are looked at as one where that is enough."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


class Prints:
    """128-bit fingerprints of spans of one array of bytes or of hashes of words."""

    def __init__(self, data: np.ndarray):
        self.one, self.two = ONE.sums(data), TWO.sums(data)

    def of(self, starts: np.ndarray, stops: np.ndarray, *marks: np.ndarray) -> list[bytes]:
        """A fingerprint per span; numbers in `marks` are part of it."""
        pairs = [ONE.spans(self.one, starts, stops), TWO.spans(self.two, starts, stops), *(np.asarray(m).astype(U64) for m in marks)]
        raw = np.ascontiguousarray(np.stack(pairs, axis=1)).tobytes()
        if not marks:
            return [raw[i : i + 16] for i in range(0, len(raw), 16)]
        width = 8 * len(pairs)
        return [hashlib.blake2b(raw[i : i + width], digest_size=16).digest() for i in range(0, len(raw), width)]


def _symbols(batches: Iterator[pa.RecordBatch], words: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with what their texts consist of: bytes, or hashes of words; and where each text begins."""
    for part, data, offsets in slices(batches, "text"):
        yield (part, *word_values(data, offsets)) if words else (part, data, offsets)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, from running minima within blocks of that width."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs_of(prints: Prints, start: int, stop: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start, anchor (place of the least gram) and gram of each run of a text; places within the text."""
    at = np.arange(start, stop - gram + 1)
    grams = ONE.spans(prints.one, at, at + gram)
    # the upper half orders grams; equal ones are taken from the left
    anchors = (window_minima((grams & ~LOW) | np.arange(len(grams), dtype=U64), length - gram + 1) & LOW).astype(np.int64)
    first = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
    return first, np.append(first[1:], len(anchors)) - 1, anchors[first], grams[anchors[first]]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _runs(length: int, gram: int, words: bool):
    """A row per distinct run of a text with its number there; what repeats within the text comes as spans (no gram)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in _symbols(batches, words):
            prints, keys, rows = Prints(data), part.column("key").to_pylist(), []
            for key, a, b in zip(keys, offsets, offsets[1:]):
                if b - a < length:
                    continue
                first, last, anchor, grams = runs_of(prints, a, b, length, gram)
                hulls, seen = prints.of(first + a, last + a + length), {}
                for i, hull in enumerate(hulls):
                    seen.setdefault(hull, []).append(i)
                again = [i for same in seen.values() if len(same) > 1 for i in same]
                rows += [(key, s, e, None, None, None, None) for s, e in merged([(int(first[i]), int(last[i]) + length) for i in again])]
                grams = grams.astype(np.int64)
                rows += [(key, int(first[i]), int(last[i]), int(anchor[i]), int(grams[i]), hull, len(same)) for hull, same in seen.items() for i in same[:1]]
            yield batch_of(RUN_COLUMNS, *([list(c) for c in zip(*rows)] or [[]] * 7))

    return found


def _blocks(length: int, words: bool):
    """The blocks of each run: offset range, hull and core."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = pa.schema([("key", pa.binary()), ("anchor", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("core", pa.binary()), ("hull", pa.binary())])
        for part, data, offsets in _symbols(batches, words):
            prints, rows = Prints(data), []
            for key, runs, base in zip(part.column("key").to_pylist(), part.column("runs").to_pylist(), offsets):
                for run in runs:
                    anchor, near, far = run["anchor"], run["anchor"] - run["last"], run["anchor"] - run["first"]
                    block = np.arange(near // BLOCK, far // BLOCK + 1)
                    low, high = np.maximum(block * BLOCK, near), np.minimum(block * BLOCK + BLOCK - 1, far)
                    place = base + anchor  # a window with offset o begins o bytes before its anchor
                    gram = np.full(len(block), run["gram"])
                    hulls = prints.of(place - high, place - low + length, gram, low, high)
                    cores = prints.of(place - block * BLOCK, place - block * BLOCK - BLOCK + 1 + length, gram, block)
                    rows += [(key, anchor, int(lo), int(hi), core, hull) for lo, hi, core, hull in zip(low, high, cores, hulls)]
            yield batch_of(columns, *([list(c) for c in zip(*rows)] or [[]] * 6))

    return found


def _windows(length: int, words: bool):
    """Every window of each block."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = pa.schema([("key", pa.binary()), ("start", pa.int64()), ("window", pa.binary())])
        for part, data, offsets in _symbols(batches, words):
            prints, rows = Prints(data), []
            for key, blocks, base in zip(part.column("key").to_pylist(), part.column("blocks").to_pylist(), offsets):
                starts = np.concatenate([np.arange(b["anchor"] - b["high"], b["anchor"] - b["low"] + 1) for b in blocks])
                rows += [(key, int(s), w) for s, w in zip(starts, prints.of(base + starts, base + starts + length))]
            yield batch_of(columns, *([list(c) for c in zip(*rows)] or [[]] * 3))

    return found


def repeated_spans(df: DataFrame, text_col: str = "text", length: int = LENGTH, words: bool = False) -> DataFrame:
    """key (see text_key) and spans (sorted by start, they may overlap) for every text with repeated windows; in bytes or words, stop excluded."""
    gram = min(WORD_GRAM if words else GRAM, length)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = df.select(text_key(F.col(text_col)).alias("key"), text.alias("text")).filter(F.octet_length("text") >= length)
    runs = stage(texts.mapInArrow(_runs(length, gram, words), RUN), "runs")

    # grams that stand more than once
    grams = stage(runs.filter("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1").select("gram"), "grams")
    shared = runs.join(grams, "gram").groupBy("gram", "hull", "key", "first", "last", "anchor").agg(F.sum("n").alias("n"))
    shared = stage(shared, "shared")

    # whole runs
    one = F.struct("key", "first", "last", "anchor")
    hulls = stage(shared.groupBy("gram", "hull").agg(F.sum("n").alias("n"), F.min(one).alias("one")), "hulls")
    again = stage(hulls.filter("n > 1").select("gram", "hull"), "again")
    covers = shared.join(again, ["gram", "hull"]).select("key", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))
    within = runs.filter("gram IS NULL").select("key", F.col("first").alias("start"), F.col("last").alias("stop"))
    covers = covers.unionByName(within)

    # blocks, in grams with different runs of which some stand once
    mixed = stage(hulls.groupBy("gram").agg(F.count(F.lit(1)).alias("runs"), F.min("n").alias("least")).filter("runs > 1 AND least = 1").select("gram"), "mixed")
    open_runs = hulls.join(mixed, "gram").select("one.*", "gram")
    open_runs = stage(open_runs.groupBy("key").agg(F.collect_list(F.struct("first", "last", "anchor", "gram")).alias("runs")), "open-runs")
    wanted = bounded(stage(open_runs.select("key"), "open-keys"))
    open_texts = stage(texts.join(wanted, "key").groupBy("key").agg(F.first("text").alias("text")), "open-texts")
    blocks = open_texts.join(open_runs, "key").select("key", "text", "runs").mapInArrow(_blocks(length, words), "key binary, anchor long, low long, high long, core binary, hull binary")
    blocks = stage(blocks, "blocks")
    one = F.struct("key", "anchor", "low", "high")
    block_hulls = stage(blocks.groupBy("core", "hull").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("one")), "block-hulls")
    again = stage(block_hulls.filter("n > 1").select("core", "hull"), "again")
    covered = blocks.join(again, ["core", "hull"])
    covers = covers.unionByName(covered.select("key", (F.col("anchor") - F.col("high")).alias("start"), (F.col("anchor") - F.col("low") + length).alias("stop")))

    # single windows, in blocks that share their core but not their hull
    mixed = stage(block_hulls.groupBy("core").agg(F.count(F.lit(1)).alias("hulls"), F.min("n").alias("least")).filter("hulls > 1 AND least = 1").select("core"), "mixed")
    open_blocks = block_hulls.join(mixed, "core").select("one.*")
    open_blocks = stage(open_blocks.groupBy("key").agg(F.collect_list(F.struct("anchor", "low", "high")).alias("blocks")), "open-blocks")
    windows = open_texts.join(open_blocks, "key").select("key", "text", "blocks").mapInArrow(_windows(length, words), "key binary, start long, window binary")
    windows = stage(windows, "windows")
    again = stage(windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("window"), "again")
    covers = covers.unionByName(windows.join(again, "window").select("key", "start", (F.col("start") + length).alias("stop")))

    return covers.distinct().groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def _cut(words: bool):
    return lambda batches: _cut_rows(batches, words)


def _cut_rows(batches: Iterator[pa.RecordBatch], words: bool) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in slices(batches, "text"):
        rows, given = [], part.column("text").is_valid().to_pylist()
        starts, ends, first = word_spans(data, offsets) if words else (None, None, offsets)
        for spans, valid, a, b, w in zip(part.column("spans").to_pylist(), given, offsets, offsets[1:], first):
            removed = merged([(s["start"], s["stop"]) for s in spans or []])
            if words:
                removed = [(int(starts[w + s] - a), int(ends[w + e - 1] - a)) for s, e in removed]
            edges = [0, *(p for s in removed for p in s), int(b - a)]
            kept = b"".join(data[a + s : a + e].tobytes() for s, e in zip(edges[::2], edges[1::2]))
            rows.append((int(b - a), int(b - a) - len(kept), [{"start": s, "stop": e} for s, e in removed], kept, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if valid else None))
        row = part.column("row")
        span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
        columns = pa.schema([("row", row.type), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(span)), ("kept", pa.binary()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
        yield batch_of(columns, row, *[list(c) for c in zip(*rows)])


def remove_repeats(df: DataFrame, text_col: str = "text", length: int = LENGTH, carried: list[str] | None = None, words: bool = False) -> DataFrame:
    """row (the carried columns), n_bytes, n_removed, removed (spans), kept (bytes), kept_sha256 and kept_text (null for a null text) of every row."""
    spans = stage(repeated_spans(df, text_col, length, words), "spans")
    rows = df.select(F.struct(*(carried or df.columns)).alias("row"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("key"))
    rows = left_by_key(rows, spans, "key").select("row", "text", "spans")
    rest = "n_bytes long, n_removed long, removed array<struct<start: bigint, stop: bigint>>, kept binary, kept_sha256 string, kept_text string"
    return rows.mapInArrow(_cut(words), fields(rows.schema["row"], rest))

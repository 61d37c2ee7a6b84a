"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find.

Documents with equal shingle sets are one node. A node's signature holds, per place, the
least rank that any of its shingles has there; a shingle ranks the places by a permutation
of its own, drawn step by step, and the draw stops as soon as no place can improve. Bands
of the signature put nodes into buckets.

Within a bucket not every pair is compared. First every node meets the bucket's smallest
node; nodes that link are united. In the buckets that still hold several components, the
nodes outside the largest one meet the nodes of the other components, in blocks of nodes
that compare their sets in a task and hand on one pair per node and component. So no link
between candidates is lost, while a bucket of copies takes one comparison per copy. Pairs
whose signatures agree too little for the similarity (six standard deviations below it)
are dropped; the others are compared on their full shingle sets.

Shingles are known by 64-bit fingerprints (of their words' xxh3 values), sets by 128-bit ones. With the default bands a pair
at the similarity of 0.8 shares no bucket with a chance of 3 in a million, one at 0.9 with
less than 1e-13.

Defined cases: a null text, or one without words, has an empty set and links with nothing;
a text of fewer words than a shingle has its whole sequence as the one shingle; rows that
repeat an id are documents of their own, and a component's id is the smallest id in it;
null ids come last (null only if all of a component are null); an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.llm.common import U64, batch_of, bounded, fields, mix, slices, stage, word_values
from ledgerlens.llm.graph import components

BANDS, ROWS = 42, 6
PLACES = BANDS * ROWS
CHUNK = 256  # nodes of a bucket in one block


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle fingerprints of each text."""
    word, first = word_values(data, offsets, lower=True)

    def joined(words: np.ndarray, n: int) -> np.ndarray:
        out = mix(words[: len(words) - n + 1] + U64(n))
        for i in range(1, n):
            out = mix(out * U64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i])
        return out

    return [np.unique(joined(word[a:b], min(size, b - a))) if b > a else word[:0] for a, b in zip(first, first[1:])]


def signature(shingles: np.ndarray, places: int = PLACES) -> np.ndarray:
    """SuperMinHash: in step j every shingle draws a rank in [j, j + 1) for the j-th place of its permutation.

    All shingles take a step together. After it, a signature whose places are all taken is
    final, as later ranks are higher.
    """
    least = np.full(places, np.iinfo(np.uint64).max, U64)
    order, rows = None, np.arange(len(shingles))
    for j in range(places if len(shingles) else 0):
        drawn = mix(shingles + U64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        at = j + ((drawn & U64(0xFFFFFFFF)) * U64(places - j) >> U64(32)).astype(np.int64)
        if order is None:
            place = at
        else:
            place = order[rows, at]
        np.minimum.at(least, place, (U64(j) << U64(32)) | (drawn >> U64(32)))
        if least.max() >> U64(32) <= U64(j):
            break
        if order is None:
            order = np.tile(np.arange(places, dtype=np.uint16), (len(shingles), 1))
        order[rows, at] = order[:, j]
    return least


def _sketch(size: int, places: int):
    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "text"):
            sets = shingle_sets(data, offsets, size)
            ids = part.column("doc_id")
            columns = pa.schema([("doc_id", ids.type), ("node", pa.binary()), ("n", pa.int64()), ("signature", pa.binary())])
            # of each rank one byte is kept: equal ranks agree, others do with 1 in 256
            signatures = [(signature(s, places) & U64(255)).astype(np.uint8).tobytes() for s in sets]
            yield batch_of(columns, ids, [_name(s) for s in sets], [len(s) for s in sets], signatures)

    return sketched


def _name(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _named_texts(size: int):
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "text"):
            yield batch_of(pa.schema([("node", pa.binary()), ("text", pa.string())]), [_name(s) for s in shingle_sets(data, offsets, size)], part.column("text").cast(pa.string()))

    return named


def _named_rows(size: int):
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "text"):
            row, ids = part.column("row"), part.column("doc_id")
            columns = pa.schema([("row", row.type), ("doc_id", ids.type), ("node", pa.binary())])
            yield batch_of(columns, row, ids, [_name(s) for s in shingle_sets(data, offsets, size)])

    return named


def _alike(least_equal: int):
    """Pairs whose signatures agree in at least so many places."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
                keep = pa.array((x == y).sum(axis=1) >= least_equal)
                yield batch.select(["a", "b"]).filter(keep)

    return compared


def _verified(size: int, percent: int):
    """Pairs whose full shingle sets have the similarity: 100 * common >= percent * united."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(iter([batch]), "x"):
                _, other, others = next(slices(iter([part]), "y", 1 << 62))
                keep = []
                for s, t in zip(shingle_sets(data, offsets, size), shingle_sets(other, others, size)):
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    keep.append(100 * common >= percent * (len(s) + len(t) - common))
                yield part.select(["a", "b"]).filter(pa.array(keep))

    return verified


class _Matcher:
    """Compares pairs of nodes: sizes, signatures, then full sets."""

    def __init__(self, nodes: DataFrame, texts: DataFrame, size: int, percent: int, places: int):
        self.nodes, self.texts, self.size, self.percent = nodes, texts, size, percent
        s = percent / 100
        self.least_equal = int(places * s - 6 * (places * s * (1 - s)) ** 0.5)

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are linked."""
        ab = StructType(pairs.select("a", "b").schema.fields)
        x = self.nodes.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("signature").alias("x"))
        y = self.nodes.select(F.col("node").alias("b"), F.col("n").alias("k"), F.col("signature").alias("y"))
        sized = pairs.join(x, "a").join(y, "b").filter(F.least("m", "k") * 100 >= F.greatest("m", "k") * self.percent)
        near = stage(sized.select("a", "b", "x", "y").mapInArrow(_alike(self.least_equal), ab), "near")
        x, y = (self.texts.select(F.col("node").alias(k), F.col("text").alias(t)) for k, t in (("a", "x"), ("b", "y")))
        return stage(near.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verified(self.size, self.percent), ab), "links")


def _roots(found: DataFrame, members: DataFrame) -> DataFrame:
    """The members of buckets with the root of their component so far."""
    return members.join(found.withColumnRenamed("key", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))


def linked_components(nodes: DataFrame, texts_of, size: int, percent: int) -> DataFrame:
    """key and root of every node that is linked with another."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.concat(F.unhex(F.lpad(F.hex(i), 4, "0")), F.substring("signature", i * ROWS + 1, F.lit(ROWS))))
    banded = nodes.filter("n > 0").select("node", F.explode(bands).alias("bucket"))
    buckets = stage(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("leader")).filter("size > 1"), "buckets")
    members = stage(banded.join(buckets, "bucket"), "members")
    texts = stage(texts_of(stage(members.select("node").distinct(), "candidates")), "texts")
    matcher = _Matcher(nodes, texts, size, percent, PLACES)
    links = matcher.links(members.filter("node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct())
    found = components(links)
    left = _unmet_links(found, members, texts, matcher)
    if left is None:
        return found
    return components(left.unionByName(found.filter("key != root").select(F.col("key").alias("a"), F.col("root").alias("b"))))


def _unmet_links(found: DataFrame, members: DataFrame, texts: DataFrame, matcher: _Matcher) -> DataFrame | None:
    """Links between components within the buckets that still hold several, or None if no bucket does."""
    rooted = _roots(found, members.filter("size > 2"))  # two nodes have met
    sizes = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    split = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("n"), F.count(F.lit(1)).alias("roots"))
    split = stage(split.filter("roots > 1").select("bucket", "main", F.col("n").alias("main_n")), "split")
    if not split.limit(1).count():
        return None
    rooted = rooted.select("bucket", "node", "root", "size").join(split, "bucket")
    rooted = rooted.withColumn("blocks", F.ceil(F.col("size") / CHUNK)).withColumn("minor_blocks", F.ceil((F.col("size") - F.col("main_n")) / CHUNK))
    rooted = stage(rooted, "rooted")
    sets = texts.mapInArrow(_full_sets(matcher.size), "node binary, shingles binary")

    def gathered(rows: DataFrame, blocks: str, name: str) -> DataFrame:
        """One row per bucket and block, of about CHUNK nodes."""
        block = F.pmod(F.xxhash64("node"), F.col(blocks)).alias("block")
        rows = rows.join(sets, "node").select("bucket", "main", block, F.struct("node", "root", "shingles").alias("member"))
        return rows.groupBy("bucket", "main", "block").agg(F.collect_list("member").alias(name)).drop("block")

    kind = "array<struct<node: binary, root: binary, shingles: binary>>"
    small = gathered(rooted.filter("blocks = 1"), "blocks", "others").select("main", "others", F.lit(None).cast(kind).alias("minors"))
    large = rooted.filter("blocks > 1")
    minors = gathered(large.filter("root != main"), "minor_blocks", "minors").drop("main")
    large = gathered(large, "blocks", "others").join(minors, "bucket").select("main", "others", "minors")
    pairs = small.unionByName(large).mapInArrow(_block_pairs(matcher.percent), "a binary, b binary").distinct()
    return matcher.links(stage(pairs, "pairs"))


def _full_sets(size: int):
    """The shingle sets of nodes, all bits of each shingle."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "text"):
            sets = [s.tobytes() for s in shingle_sets(data, offsets, size)]
            yield batch_of(pa.schema([("node", pa.binary()), ("shingles", pa.binary())]), part.column("node").cast(pa.binary()), sets)

    return full


def _block_pairs(percent: int):
    """Of each minor node and each other component in the block: the most similar pair that has the similarity."""

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[bytes, bytes]] = set()
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                others = row["others"]
                minors = row["minors"] or [m for m in others if m["root"] != row["main"]]
                sets = [np.frombuffer(m["shingles"], U64) for m in others]
                n = np.array([len(s) for s in sets])
                shingles, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), n)
                order = np.argsort(shingles, kind="stable")
                shingles, owner = shingles[order], owner[order]
                roots = np.unique([m["root"] for m in others], return_inverse=True)[1]
                place = {m["root"]: r for m, r in zip(others, roots)}
                for minor in minors:
                    own = np.frombuffer(minor["shingles"], U64)
                    low, high = np.searchsorted(shingles, own, "left"), np.searchsorted(shingles, own, "right")
                    many = high - low
                    at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
                    common = np.bincount(owner[at], minlength=len(sets))
                    alike = np.flatnonzero((100 * common >= percent * (len(own) + n - common)) & (roots != place.get(minor["root"], -1)))
                    best: dict[int, tuple[float, int]] = {}
                    for j in alike:
                        share = common[j] / (len(own) + n[j] - common[j])
                        if roots[j] not in best or share > best[roots[j]][0]:
                            best[roots[j]] = (share, j)
                    found |= {(max(minor["node"], others[j]["node"]), min(minor["node"], others[j]["node"])) for _, j in best.values()}
            yield batch_of(pa.schema([("a", pa.binary()), ("b", pa.binary())]), [a for a, _ in found], [b for _, b in found])

    return paired


def sketches(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """doc_id, node (name of the shingle set), n (its size) and signature of every row."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_sketch(size, PLACES), fields(rows.schema["doc_id"], "node binary, n long, signature binary"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row; node names the row's shingle set, root its component."""
    sketched = stage(sketches(df, id_col, text_col, size), "sketches")
    nodes = stage(sketched.groupBy("node").agg(F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("signature").alias("signature")), "nodes")

    def texts_of(wanted: DataFrame) -> DataFrame:
        rows = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        named = rows.mapInArrow(_named_texts(size), "node binary, text string")
        return named.join(bounded(wanted), "node").groupBy("node").agg(F.first("text").alias("text"))

    found = linked_components(nodes, texts_of, size, percent)
    lows = found.join(nodes.select(F.col("node").alias("key"), "low"), "key").groupBy("root").agg(F.min("low").alias("component_id"))
    grouped = stage(found.join(stage(lows, "lows"), "root").select(F.col("key").alias("node"), "root", "component_id"), "grouped")
    named = nodes.select("node", "low").join(grouped, "node", "left")
    named = named.select("node", F.coalesce("root", "node").alias("root"), F.coalesce("component_id", "low").alias("component_id"))
    result = sketched.select("doc_id", "node", "n").join(stage(named, "named"), "node")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return result.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), "node", "root")


def kept_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component with all its columns: that with the component's id (its smallest set, its first row).

    Rows with an empty set are all kept. Texts stay where they are unless the rows to drop
    are too many to send to every task.
    """
    judged = stage(near_duplicates(df, id_col, text_col, size, percent).filter("n_shingles > 0"), "judged")
    heads = stage(judged.filter("kept").groupBy("root").agg(F.min(F.struct("node", "doc_id")).alias("head")), "heads")
    lost = judged.join(heads, "root").filter((F.col("node") != F.col("head.node")) | ~F.col("doc_id").eqNullSafe(F.col("head.doc_id")))
    lost = bounded(stage(lost.select("node", "doc_id").distinct(), "lost"))
    again = judged.groupBy("node", "doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("node", "doc_id")
    again = stage(again, "again")
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.mapInArrow(_named_rows(size), StructType([*rows.select("row", "doc_id").schema.fields, *StructType.fromDDL("node binary").fields]))

    def same(other: DataFrame):
        return (rows.node == other.node) & rows.doc_id.eqNullSafe(other.doc_id)

    left = rows.join(lost, same(lost), "left_anti")
    if not again.limit(1).count():
        return left.select("row.*")
    again, rows = bounded(again), left
    once = left.join(again, same(again), "left_anti")
    first = left.join(again, same(again), "left_semi").groupBy("node", "doc_id").agg(F.first("row").alias("row"))
    return once.select("row.*").unionByName(first.select("row.*"))

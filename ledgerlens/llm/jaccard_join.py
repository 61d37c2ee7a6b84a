"""N-gram Jaccard join of documents by points of group counts in R-trees.

A document's distinct shingles are hashed into groups; its group counts are a point. Two
sets have at most the sum of the smaller coordinates of their points in common, and a point
and a box of points at most that sum with the box's upper corner. So a tree of boxes tells
which points may reach the similarity; only those pairs are verified on their full sets.

One tree over all points would not prune: unrelated points of one size differ a little in
every coordinate, so the boxes of any leaf overlap all others, and trees of separate tasks
would have to meet pairwise. Points are therefore first dealt to buckets that linked ones must
share. Two linked sets, the smaller with n members, differ in at most t = n * (100 - percent)
/ percent members. The range of hash values is cut into t + 1 + spare slabs (t of the largest
n of a class of sizes), so at least spare + 1 slabs hold the same members in both; equal slabs
are a bucket. A set also goes to the class below if a smaller partner may be there. A slab is
poor if it holds fewer than LIGHT members or stands in more than CROWD sets; both sets know it.
A set with at most `spare` poor slabs needs none of them, as the pair must share a better one;
any other set keeps them all. No bucket is cut and no link can be lost.

Buckets are joined in three steps, each on the pairs the one before left open:

1. every member meets the bucket's smallest one;
2. in buckets that still hold several components, points outside the largest one are looked
   up in R-trees of the bucket's points, in blocks of BLOCK; each hands on its NEAR most
   promising partners in each other component;
3. the same again with all partners that the bounds leave, in buckets still split.

A pair is left to the least bucket both are in, as far as their FIRST least buckets show it.
So a group of copies costs a comparison per copy, and a pair is compared in full only if its
points allow the link. Pairs are verified on sets of 64-bit shingle fingerprints (of words'
xxh3 values); united by union-find and star contraction.

Defined cases: a null text, or one without words, has an empty set and links with nothing; a
text of fewer words than a shingle has its whole sequence as the one shingle; rows that
repeat an id are documents of their own, and a component's id is the smallest id in it; null
ids come last (null only if all of a component are null); pairs exactly at the similarity are
linked; texts of any length are taken whole (the point grows with the set); an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import SLICE_BYTES, U64, batch_of, bounded, fields, mix, stage
from ledgerlens.llm.graph import components

LIGHT = 3  # members below which a slab says little
CROWD = 256  # sets beyond which a slab is poor
BLOCK = 1024  # points of a bucket in one block
LEAF, FAN = 16, 8  # points of a leaf, boxes of a node
NEAR = 4
FIRST = 16  # least open buckets of a set that its points carry, so that a pair is handed on once
GOLDEN = U64(0x9E3779B97F4A7C15)


# --- sets, points and slabs -----------------------------------------------------------


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct fingerprints of the shingles of `size` words; A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, U64)
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))
    n = min(size, len(word))
    out = mix(word[: len(word) - n + 1] + U64(n))
    for i in range(1, n):
        out = mix(out * GOLDEN + word[i : len(word) - n + 1 + i])
    return np.unique(out)


def set_name(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def groups_of(n: int) -> int:
    """Coordinates of the point of a set of n members: a power of two."""
    return max(32, 1 << int(np.ceil(np.log2(max(n, 8) / 8))))


def point_of(members: np.ndarray) -> np.ndarray:
    groups = groups_of(len(members))
    return np.bincount((members & U64(groups - 1)).astype(np.int64), minlength=groups).astype(np.uint16)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """A point in fewer groups: coordinates whose groups fall together are added."""
    return point if len(point) == groups else point.reshape(-1, groups).sum(axis=0, dtype=point.dtype)


def classes(percent: int, largest: int) -> list[tuple[int, int, int]]:
    """First size, slabs and spare slabs of each class of sizes, a class a quarter wider than the one before; up to `largest`."""
    out, first = [], 1
    while first <= largest:
        after = max(first + 1, -(-first * 5 // 4))
        differ = (after - 1) * (100 - percent) // percent
        spare = 1 + differ // 10 if differ else 0
        out.append((first, differ + 1 + spare, spare))
        first = after
    return out


class Slabs:
    """The slabs of a set in each class where it may have partners."""

    def __init__(self, percent: int):
        self.percent, self.table, self.firsts = percent, [], np.zeros(0, np.int64)
        self.cuts: dict[int, np.ndarray] = {}  # of each class: where slabs end in the range of hash values, and their marks

    def of(self, members: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
        """class, spare, number of light slabs, and the key of each slab (light ones first)."""
        n = len(members)
        if not n:
            return []
        if not self.table or self.firsts[-1] * 5 // 4 <= n:
            self.table = classes(self.percent, 4 * n)
            self.firsts = np.array([first for first, *_ in self.table])
        low, high = (int(np.searchsorted(self.firsts, m, "right")) - 1 for m in (-(-n * self.percent // 100), n))
        marks = np.append(U64(0), np.cumsum(mix(members + GOLDEN)))
        out = []
        for number in range(low, high + 1):
            _, slabs, spare = self.table[number]
            if not spare:
                continue  # only equal sets are linked there, and they are one already
            if number not in self.cuts:
                edges = np.array([i * (1 << 64) // slabs for i in range(1, slabs)], U64)
                self.cuts[number] = edges, mix(U64(number << 32) + np.arange(slabs, dtype=U64))
            edges, own = self.cuts[number]
            at = np.concatenate([[0], np.searchsorted(members, edges), [n]])
            held = np.diff(at)
            keys = mix(marks[at[1:]] - marks[at[:-1]] + own + held.astype(U64))
            light = held < LIGHT
            out.append((number, spare, int(light.sum()), np.concatenate([keys[light], keys[~light]]).astype(np.int64)))
        return out


def _texts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Rows with their texts, about SLICE_BYTES at once."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        start = size = 0
        held: list = []
        for text in texts:
            held.append(text.as_py())
            size += len(held[-1] or "")
            if size >= SLICE_BYTES:
                yield batch.slice(start, len(held)), held
                start, size, held = start + len(held), 0, []
        if held:
            yield batch.slice(start, len(held)), held


SLAB = pa.struct([("class", pa.int32()), ("spare", pa.int32()), ("light", pa.int32()), ("keys", pa.list_(pa.int64()))])
SKETCH = "node binary, n long, point binary, slabs array<struct<class: int, spare: int, light: int, keys: array<bigint>>>"


def _sketch(size: int, percent: int):
    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slabs = Slabs(percent)
        for part, texts in _texts(batches, "text"):
            sets = [shingle_set(t, size) for t in texts]
            each = [slabs.of(s) for s in sets]
            flat = [x for own in each for x in own]
            keys = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *(len(x[3]) for x in flat)]), pa.int32()), pa.array(np.concatenate([x[3] for x in flat] or [np.zeros(0, np.int64)])),
            )
            struct = pa.StructArray.from_arrays([*(pa.array([x[i] for x in flat], pa.int32()) for i in range(3)), keys], fields=list(SLAB))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, each)]), pa.int32()), struct)
            ids = part.column("doc_id")
            columns = pa.schema([("doc_id", ids.type), ("node", pa.binary()), ("n", pa.int64()), ("point", pa.binary()), ("slabs", lists.type)])
            yield batch_of(columns, ids, [set_name(s) for s in sets], [len(s) for s in sets], [point_of(s).tobytes() for s in sets], lists)

    return sketched


def _sets(size: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches, "text"):
            sets = [shingle_set(t, size) for t in texts]
            yield batch_of(pa.schema([("node", pa.binary()), ("members", pa.binary())]), [set_name(s) for s in sets], [s.tobytes() for s in sets])

    return found


# --- R-tree -----------------------------------------------------------------------------


def least_common(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with which sets of n and m members are linked."""
    return -(-percent * (n + m) // (100 + percent))


class CountTree:
    """A tree of boxes over points: per box the largest coordinates and the range of set sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent, self.points, self.sizes = percent, points, sizes
        groups = [np.arange(len(sizes))]
        self.parents: list[np.ndarray] = []
        while max(map(len, groups)) > LEAF:
            parents, parts = [], []
            for parent, group in enumerate(groups):
                for part in self._cut(group):
                    parents.append(parent)
                    parts.append(part)
            self.parents.append(np.array(parents))
            groups = parts
        self.leaves = groups
        corner = np.array([points[g].max(axis=0) for g in groups])
        low, high = (np.array([f(sizes[g]) for g in groups]) for f in (np.min, np.max))
        self.levels = [(corner, low, high)]
        for parents in reversed(self.parents):
            starts = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
            self.levels.append((np.maximum.reduceat(self.levels[-1][0], starts), np.minimum.reduceat(self.levels[-1][1], starts), np.maximum.reduceat(self.levels[-1][2], starts)))
        self.levels.reverse()

    def _cut(self, group: np.ndarray) -> list[np.ndarray]:
        """A group in up to FAN parts along the coordinate, or the size, in which it is widest."""
        if len(group) <= LEAF:
            return [group]
        spread = self.points[group].std(axis=0)
        axis = int(spread.argmax())
        along = self.sizes[group] if self.sizes[group].std() > spread[axis] else self.points[group, axis]
        return np.array_split(group[np.argsort(along, kind="stable")], min(FAN, -(-len(group) // LEAF)))

    def _reach(self, point: np.ndarray, n: int, corner: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether boxes may hold a partner, and their bounds."""
        smallest = np.maximum(low, -(-n * self.percent // 100))
        bound = np.minimum(corner, point).sum(axis=1, dtype=np.int64)
        return (bound >= least_common(n, smallest, self.percent)) & (smallest <= high) & (100 * n >= self.percent * low), bound

    def near(self, point: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the points that may be linked, and how much of the union they may share."""
        at = np.arange(len(self.levels[0][0]))
        for level, (corner, low, high) in enumerate(self.levels):
            if level:
                at = np.flatnonzero(np.isin(self.parents[level - 1], at))
            at = at[self._reach(point, n, corner[at], low[at], high[at])[0]]
        if not len(at):
            return at, np.zeros(0)
        places = np.concatenate([self.leaves[i] for i in at])
        keep, bound = self._reach(point, n, self.points[places], self.sizes[places], self.sizes[places])
        places, bound = places[keep], bound[keep]
        return places, bound / (n + self.sizes[places] - bound)


def _tree_pairs(percent: int, most: int | None):
    """Of each minor point: the partners in every other component that the bounds leave, or the `most` most promising."""

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                others = row["others"]
                minors = row["minors"] or [m for m in others if m["root"] != row["main"]]
                points, own = ([np.frombuffer(m["point"], np.uint16) for m in side] for side in (others, minors))
                groups = min(map(len, [*points, *own]))
                tree = CountTree(np.array([folded(p, groups) for p in points]), np.array([m["n"] for m in others]), percent)
                earlier = np.full((len(others), FIRST), row["key"])
                for j, m in enumerate(others):
                    earlier[j, : len(m["first"])] = np.minimum(m["first"], row["key"])
                names = np.unique([m["root"] for m in others], return_inverse=True)
                roots, place = names[1], {r: j for j, r in enumerate(names[0].tolist())}
                found: set[tuple[bytes, bytes]] = set()
                for minor, point in zip(minors, own):
                    at, share = tree.near(folded(point, groups), minor["n"])
                    before = [k for k in minor["first"] if k < row["key"]]  # a pair that shares one of these is met there
                    away = (roots[at] != place.get(minor["root"], -1)) & ~np.isin(earlier[at], before).any(axis=1)
                    at, share = at[away], share[away]
                    if most is not None and len(at) > most:
                        order = np.lexsort((-share, roots[at]))
                        at = at[order]
                        first = np.flatnonzero(np.append(True, np.diff(roots[at]) != 0))
                        at = at[np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at)))) < most]
                    found |= {(max(minor["node"], others[j]["node"]), min(minor["node"], others[j]["node"])) for j in at}
                yield batch_of(PAIR_COLUMNS, [a for a, _ in found], [b for _, b in found])

    return paired


PAIR = "a binary, b binary"
PAIR_COLUMNS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


# --- pairs ------------------------------------------------------------------------------


def _may_link(percent: int):
    """Pairs whose points leave enough in common."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, k = (np.asarray(batch.column(c)) for c in (2, 3))
            keep = []
            for x, y, need in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), least_common(m, k, percent)):
                x, y = np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)
                groups = min(len(x), len(y))
                keep.append(int(np.minimum(folded(x, groups), folded(y, groups)).sum(dtype=np.int64)) >= need)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return compared


def _verified(percent: int):
    """Pairs whose full sets have the similarity: 100 * common >= percent * united."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verified


class _Pairs:
    """Compares pairs of nodes: sizes, points, then full sets; remembers which it has compared."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, percent: int):
        self.nodes, self.sets, self.percent, self.links = nodes, sets, percent, None

    def compare(self, pairs: DataFrame, bounded_already: bool = False) -> None:
        if not bounded_already:
            x, y = (self.nodes.select(F.col("node").alias(k), F.col("n").alias(n), F.col("point").alias(p)) for k, n, p in (("a", "m", "x"), ("b", "k", "y")))
            sized = pairs.join(x, "a").join(y, "b").filter(F.least("m", "k") * 100 >= F.greatest("m", "k") * self.percent)
            pairs = stage(sized.select("a", "b", "m", "k", "x", "y").mapInArrow(_may_link(self.percent), PAIR), "near")
        x, y = (self.sets.select(F.col("node").alias(k), F.col("members").alias(s)) for k, s in (("a", "x"), ("b", "y")))
        links = stage(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verified(self.percent), PAIR), "links")
        self.links = links if self.links is None else self.links.unionByName(links)


def _open_blocks(found: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """Blocks of the buckets that still hold several components: their points, and those outside the largest component. None if there are none."""
    rooted = members.filter("size > 2").join(found.withColumnRenamed("key", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    split = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("main_n"), F.count(F.lit(1)).alias("roots"))
    split = stage(split.filter("roots > 1").select("key", "main", "main_n"), "split")
    if not split.limit(1).count():
        return None
    rooted = rooted.select("key", "node", "root", "size").join(split, "key")
    rooted = rooted.withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("minor_blocks", F.ceil((F.col("size") - F.col("main_n")) / BLOCK))
    first = rooted.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("key")), 1, FIRST).alias("first"))  # one set's slabs
    rooted = stage(rooted.join(nodes.select("node", "n", "point"), "node").join(first, "node"), "rooted")

    def gathered(rows: DataFrame, blocks: str, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("node"), F.col(blocks)).alias("block")
        rows = rows.select("key", "main", block, F.struct("node", "root", "n", "point", "first").alias("member"))
        return rows.groupBy("key", "main", "block").agg(F.collect_list("member").alias(name)).drop("block")

    kind = "array<struct<node: binary, root: binary, n: bigint, point: binary, first: array<bigint>>>"
    small = gathered(rooted.filter("blocks = 1"), "blocks", "others").select("key", "main", "others", F.lit(None).cast(kind).alias("minors"))
    large = rooted.filter("blocks > 1")
    minors = gathered(large.filter("root != main"), "minor_blocks", "minors").drop("main")
    return small.unionByName(gathered(large, "blocks", "others").join(minors, "key").select("key", "main", "others", "minors"))


def bucket_members(nodes: DataFrame) -> DataFrame:
    """key, node, size and leader: the sets of every bucket with at least two (see the module's text)."""
    slab = nodes.select("node", F.explode("slabs").alias("s")).select("node", "s.class", "s.spare", "s.light", F.posexplode("s.keys").alias("i", "key"))
    shared = stage(slab.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1"), "shared")
    slab = slab.withColumn("is_light", F.col("i") < F.col("light")).drop("i")
    slab = stage(slab.join(shared, "key"), "slabs")
    crowded = slab.filter(~F.col("is_light") & (F.col("sets") > CROWD))
    crowds = stage(crowded.groupBy("node", "class").agg(F.count(F.lit(1)).alias("crowded")), "crowds")
    marked = slab.join(bounded(crowds), ["node", "class"], "left")
    poor = F.col("is_light") | (F.col("sets") > CROWD)
    needed = marked.filter(~poor | (F.col("light") + F.coalesce("crowded", F.lit(0)) > F.col("spare"))).select("key", "node")
    needed = stage(needed, "needed")
    buckets = stage(needed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("leader")).filter("size > 1"), "buckets")
    return stage(needed.join(buckets, "key"), "members")


def linked_components(nodes: DataFrame, sets_of, percent: int) -> DataFrame:
    """key and root of every node that is linked with another."""
    members = bucket_members(nodes)
    sets = stage(sets_of(stage(members.select("node").distinct(), "candidates")), "sets")
    pairs = _Pairs(nodes, sets, percent)
    tried = stage(members.filter("node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "star")
    pairs.compare(tried)
    for most in (NEAR, None):
        found = components(pairs.links)
        blocks = _open_blocks(found, members, nodes)
        if blocks is None:
            return found
        fresh = blocks.mapInArrow(_tree_pairs(percent, most), PAIR).distinct()
        fresh = stage(fresh.join(tried, ["a", "b"], "left_anti"), "fresh")
        if most is None and not fresh.limit(1).count():
            return found
        pairs.compare(fresh, bounded_already=True)
        tried = tried.unionByName(fresh)
    return components(pairs.links)


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sketched = stage(rows.mapInArrow(_sketch(size, percent), fields(rows.schema["doc_id"], SKETCH)), "sketches")
    first = [F.first(c).alias(c) for c in ("n", "point", "slabs")]
    nodes = stage(sketched.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("low"), *first), "nodes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        found = rows.select("text").mapInArrow(_sets(size), "node binary, members binary")
        return found.join(bounded(wanted), "node", "left_semi").groupBy("node").agg(F.first("members").alias("members"))

    found = linked_components(nodes, sets_of, percent)
    lows = found.join(nodes.select(F.col("node").alias("key"), "low"), "key").groupBy("root").agg(F.min("low").alias("component_id"))
    linked = found.join(stage(lows, "lows"), "root").select(F.col("key").alias("node"), "component_id")
    named = nodes.select("node", "low").join(linked, "node", "left").select("node", F.coalesce("component_id", "low").alias("component_id"))
    result = sketched.select("doc_id", "node", "n").join(stage(named, "named"), "node", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return result.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))

"""Connected components of links between keys, as Spark jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import stage


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one task: a link from every key to the smallest key it was united with."""
    parent: dict = {}

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    kind = pa.binary()
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(parent.setdefault(a, a)), find(parent.setdefault(b, b))
            parent[max(a, b)] = min(a, b)
    pairs = [(x, find(x)) for x in parent]
    pairs = [(x, r) for x, r in pairs if x != r]
    yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], kind) for i in (0, 1)], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """key and root (the smallest key reachable) for every key in a link (columns a, b).

    Every task first unites its own links. Then large-star and small-star steps alternate:
    each key hands its neighbours to the smallest key it knows, until nothing moves. Keys
    with very many links are aggregated before the shuffle, and the joins have one row per
    key on one side.
    """
    edges = stage(links.select("a", "b").mapInArrow(_forests, links.select("a", "b").schema).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = stage(large, "large")  # a > b in every row
        least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.select(F.col("b").alias("key"), F.col("b").alias("root"))
            return stage(edges.select(F.col("a").alias("key"), F.col("b").alias("root")).unionByName(roots).distinct(), "components")
        before = now

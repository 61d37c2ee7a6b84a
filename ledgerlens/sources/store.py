"""The eight tables and the chunk index: append, scan, keyed lookup, update, delete.

A table is stored in buckets of its key (`sources.bucketed`). Changes are whole frames of
keys and values, applied in one join to the buckets that they touch; several writers may
work at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens import schemas
from ledgerlens.operators.ordering import small_lookup
from ledgerlens.session import cut_lineage
from ledgerlens.sources.bucketed import BUCKETS, BucketedTable, hashed


# --- transformations -----------------------------------------------------------------


def numbered(rows: DataFrame, first: int, name: str) -> DataFrame:
    """Consecutive ids from `first`, without sorting everything in one task.

    The rows are checkpointed with their partition-local order; the per-partition counts
    then give every partition its offset.
    """
    placed = cut_lineage(rows.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    offsets = (
        placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # as many rows as partitions
    return joined.select((F.lit(first) + F.col("_before") + local).cast("long").alias(name), *rows.columns)


def apply_updates(table: DataFrame, changes: DataFrame, key: str, column: str, new: str = "new_value") -> DataFrame:
    """One column changed where a key matches; unknown keys change nothing.

    `changes` has one row per key. The hit flag lets a change to null count as a change.
    """
    marked = changes.select(key, F.struct(F.col(new).alias("v")).alias("_new"))
    joined = table.join(marked, key, "left")
    value = F.when(F.col("_new").isNotNull(), F.col("_new.v")).otherwise(F.col(column))
    return joined.select(*[value.alias(c) if c == column else F.col(c) for c in table.columns])


def apply_deletes(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti").select(*table.columns)


def clear_references(child: DataFrame, deleted: DataFrame, foreign_key: str, key: str) -> DataFrame:
    """Children of deleted parents stay, without the reference."""
    gone = deleted.select(F.col(key).alias(foreign_key)).distinct().withColumn("_gone", F.lit(True))
    joined = child.join(gone, foreign_key, "left")
    value = F.when(F.col("_gone").isNull(), F.col(foreign_key))
    return joined.select(*[value.alias(c) if c == foreign_key else F.col(c) for c in child.columns])


def find(table: DataFrame, key: str, value) -> DataFrame:
    """The row of one key or nothing; the predicate reaches the Parquet scan."""
    return table.filter(F.col(key) == value).limit(1)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def documents_per_session(sessions: DataFrame, documents: DataFrame) -> DataFrame:
    counts = documents.groupBy("session_id").agg(F.count("document_id").alias("document_count"))
    return sessions.join(counts, "session_id", "left").na.fill({"document_count": 0})


def newest_first(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.col("created_at").desc(), F.col("session_id").desc())


def document_details(documents: DataFrame, metrics: DataFrame, flags: DataFrame) -> DataFrame:
    """Documents with their metric rows and red flags nested (those of one document)."""

    def nested(child: DataFrame, name: str, key: str) -> DataFrame:
        columns = [key, *[c for c in child.columns if c not in (key, "document_id")]]
        return child.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    out = documents.join(nested(metrics, "metrics", "metric_id"), "document_id", "left")
    out = out.join(nested(flags, "red_flags", "red_flag_id"), "document_id", "left")
    status = F.when(F.col("metrics").isNotNull(), "ready").otherwise("processing")
    return out.withColumn("status", status)


def session_tree(sessions: DataFrame, documents: DataFrame, companies: DataFrame, metrics: DataFrame) -> DataFrame:
    """Sessions with their documents, companies and metrics; sessions without any stay.

    The documents are the large side of an inner join, so a session with most of them is
    not gathered: a small set of sessions is broadcast, else adaptive execution splits the
    hot keys. Sessions without documents are found from the session ids alone.
    """
    named = sessions.select("session_id", "session_name")
    held = small_lookup(documents, named, ["session_id"])
    tree = held.join(companies.select("company_id", "company_name"), "company_id", "left").join(metrics, "document_id", "left")
    alone = named.join(documents.select("session_id").distinct(), "session_id", "left_anti")
    return tree.unionByName(alone, allowMissingColumns=True)


def comparison_pairs(comparisons: DataFrame, companies: DataFrame) -> DataFrame:
    """Comparison rows with both company names: one dimension joined twice."""

    def side(n: int) -> DataFrame:
        return companies.select(F.col("company_id").alias(f"company{n}_id"), F.col("company_name").alias(f"company{n}_name"))

    return comparisons.join(side(1), "company1_id", "left").join(side(2), "company2_id", "left")


def delete_document_chunks(index: DataFrame, deletes: DataFrame) -> DataFrame:
    """Chunks that remain after removing (session_id, document_id) pairs."""
    return index.join(deletes.select("session_id", "document_id").distinct(), ["session_id", "document_id"], "left_anti").select(*index.columns)


def delete_results(index: DataFrame, deletes: DataFrame) -> DataFrame:
    """Per asked pair: whether any chunk matched."""
    present = index.select("session_id", "document_id").distinct().withColumn("deleted", F.lit(True))
    return deletes.join(present, ["session_id", "document_id"], "left").na.fill({"deleted": False})


# --- storage ------------------------------------------------------------------------


class Table:
    """One of the eight tables below `root`."""

    def __init__(self, spark: SparkSession, root: str, name: str, buckets: int = BUCKETS):
        self.spark, self.name = spark, name
        self.key, self.schema = schemas.TABLES[name]
        self.path = f"{root.rstrip('/')}/{name}"
        self.rows = BucketedTable(spark, self.path, self.schema, [self.key], lambda: hashed(self.key, buckets))

    def read(self) -> DataFrame:
        return self.rows.read()

    def append(self, rows: DataFrame) -> DataFrame:
        """Rows with generated ids and default timestamps are added; returns them.

        The ids are reserved first, so two writers never give one out twice; a writer that
        fails in between leaves a gap.
        """
        stamp = schemas.DEFAULT_TIMESTAMP.get(self.name)
        if stamp and stamp not in rows.columns:
            rows = rows.withColumn(stamp, F.current_timestamp())
        rows = cut_lineage(rows.drop(self.key))
        fresh = numbered(rows, self.rows.reserve(rows.count()), self.key)
        columns = [c.split()[0] for c in self.schema.split(", ")]
        empty = self.spark.createDataFrame([], self.schema)
        fresh = fresh.select(*[F.col(c) if c in fresh.columns else F.lit(None).alias(c) for c in columns]).to(empty.schema)
        self.rows.append(fresh)
        return fresh

    def _typed(self, keys: DataFrame) -> DataFrame:
        """Keys in the type of the table, as the bucket of a number depends on its width."""
        return keys.withColumn(self.key, F.col(self.key).cast("bigint"))

    def get(self, value: int) -> DataFrame:
        """The row of one key or nothing, from its bucket alone."""
        keys = self._typed(self.spark.createDataFrame([(value,)], f"{self.key} bigint"))
        return find(self.rows.read_buckets(keys), self.key, value)

    def update(self, changes: DataFrame) -> None:
        """`new_value` in the table's changeable column, one row per key; the changes are stored before they are applied."""
        stored = cut_lineage(self._typed(changes))
        self.rows.rewrite(stored, lambda rows: apply_updates(rows, stored, self.key, schemas.UPDATABLE[self.name]))

    def delete(self, keys: DataFrame) -> None:
        stored = cut_lineage(self._typed(keys.select(self.key)))
        self.rows.rewrite(stored, lambda rows: apply_deletes(rows, stored, self.key))


class ChunkIndex:
    """Chunks of documents by session: one document lies in one bucket, a session in `parts` of them.

    `schema` names session_id, document_id (both strings) and chunk_index beside the chunk's own columns.
    """

    KEY = ["session_id", "document_id"]

    def __init__(self, spark: SparkSession, path: str, schema: str, sessions: int = BUCKETS, parts: int = 4):
        self.sessions, self.parts, self.schema = sessions, parts, schema
        self.rows = BucketedTable(spark, path, schema, self.KEY, lambda: hashed("session_id", sessions) * parts + hashed("document_id", parts))

    def add(self, chunks: DataFrame, order: str = "pos") -> None:
        """Documents with all their chunks; chunk_index counts from 0 in `order` within each.

        A document that the session already holds is replaced, so that a batch sent again
        changes nothing. The chunks of one document are bounded by its text.
        """
        place = (F.row_number().over(W.partitionBy(*self.KEY).orderBy(order)) - 1).cast("int")
        columns = [c.split()[0] for c in self.schema.split(", ")]
        fresh = cut_lineage(chunks.withColumn("chunk_index", place).select(*columns))
        keys = cut_lineage(fresh.select(*self.KEY).distinct())
        self.rows.rewrite(keys, lambda rows: delete_document_chunks(rows, keys).unionByName(fresh))

    def session(self, session_id: str) -> DataFrame:
        """The chunks of one session, from its buckets alone."""
        first = self.rows.spark.createDataFrame([(session_id,)], "session_id string")
        part = F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1)))
        ours = [str(r.b) for r in first.select((hashed("session_id", self.sessions) * self.parts).alias("a"), part.alias("p")).select((F.col("a") + F.col("p")).alias("b")).collect()]
        return self.rows._load(self.rows.latest()[1], ours).filter(F.col("session_id") == session_id)

    def delete(self, deletes: DataFrame) -> DataFrame:
        """Drops the chunks of (session_id, document_id) pairs; returns per pair whether any were there."""
        stored = cut_lineage(deletes.select(*self.KEY))
        found = cut_lineage(delete_results(self.rows.read_buckets(stored), stored))
        self.rows.rewrite(stored, lambda rows: delete_document_chunks(rows, stored))
        return found

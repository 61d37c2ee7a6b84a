"""Incremental forms: new documents become chunks, new metrics red flags, and documents change their status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.operators.chunking import chunk_sections
from ledgerlens.operators.redflags import exact_dedup, merge, numeric_flags


def read_new_files(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def index_new_documents(documents: DataFrame, keys: list[str], out: str, checkpoint: str, partition: str | None = None) -> StreamingQuery:
    """Chunks of every new document, appended exactly once to the index folder.

    Each document is chunked in its own row, so the stream needs no state.
    """
    writer = chunk_sections(documents, keys).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    if partition:
        writer = writer.partitionBy(partition)
    return writer.trigger(availableNow=True).start()


def flag_new_metrics(changes: DataFrame, keys: list[str], out: str, checkpoint: str, buckets: int = 256) -> StreamingQuery:
    """Red flags of the requests touched by each batch; `current_flags` reads the result.

    The metrics of each batch are kept by bucket of the request, and only the buckets that a
    batch touches are read back. A metric that is sent again for a request replaces what
    earlier batches said of it. A batch that is replayed overwrites its own folders.
    """
    history = f"{out}/metrics"
    near = ["_near", *keys]  # with a number in front rows meet and are sorted by it; one shuffle places them for all steps

    def evaluate(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        # a bucket of any size is split over tasks
        own.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{history}/batch={batch_id}")
        written = spark.read.parquet(f"{history}/batch={batch_id}")
        read = [r.bucket for r in written.select("bucket").distinct().collect()]  # at most `buckets` numbers
        written.select(*keys).distinct().write.mode("overwrite").parquet(f"{out}/requests/batch={batch_id}")
        touched = spark.read.parquet(f"{out}/requests/batch={batch_id}").select(*keys).withColumn("_near", F.xxhash64(*keys))
        stored = spark.read.schema(own.withColumn("batch", F.lit(0)).schema).option("basePath", history).parquet(f"{history}/batch=*")
        stored = stored.filter(F.col("bucket").isin(read) & (F.col("batch") <= batch_id)).withColumn("_near", F.xxhash64(*keys))
        metrics = newest_metrics(stored.join(touched, near, "left_semi").repartition(*near), near)
        merge(exact_dedup(numeric_flags(metrics, near), near), near).drop("_near").write.mode("overwrite").parquet(f"{out}/flags/batch={batch_id}")

    return (
        changes.writeStream.foreachBatch(evaluate).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def newest_metrics(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Of each metric of a request the first row of the newest `batch` that names it; the rules read no other."""
    fields = ["pos", "current_raw", "prior_raw", "is_number"]
    order = F.struct(-F.col("batch"), F.col("pos").isNull(), "pos")
    newest = metrics.groupBy(*keys, "metric").agg(F.min_by(F.struct(*fields), order).alias("m"))
    return newest.select(*keys, "metric", "m.*")


def current_flags(spark: SparkSession, keys: list[str], out: str) -> DataFrame:
    """The flags of each request's newest batch; a request that lost its flags has none."""
    newest = spark.read.option("basePath", f"{out}/requests").parquet(f"{out}/requests/batch=*").groupBy(*keys).agg(F.max("batch").alias("batch"))
    flags = spark.read.option("basePath", f"{out}/flags").parquet(f"{out}/flags/batch=*")
    return flags.join(newest, [*keys, "batch"], "left_semi").drop("batch")


def document_outcomes(documents: DataFrame, facts: DataFrame, key: str, patience: str, late: str, out: str, checkpoint: str) -> StreamingQuery:
    """What became of every document: joined to its facts, or given up after `patience` without any.

    `documents` is a stream of (key, arrived), `facts` one of (key, extracted), where facts
    count that come between the arrival and the end of the patience. Rows may arrive up to
    `late` behind the newest ones of their stream. A document waits in the state of the join
    until the watermark has passed its patience; documents and facts behind it are dropped
    from the state, so that the state holds what is open and not what was ever seen.
    """
    waiting = documents.select(key, "arrived").withWatermark("arrived", late)
    found = facts.select(F.col(key).alias("_key"), "extracted").withWatermark("extracted", late)
    in_time = F.expr(f"`{key}` = _key AND extracted >= arrived AND extracted <= arrived + INTERVAL {patience}")
    outcomes = waiting.join(found, in_time, "left_outer").drop("_key")
    return outcomes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def document_status(documents: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Every document as `ready` since its first facts, `failed`, or still `processing`; one row per document."""
    ends = outcomes.groupBy(key).agg(F.min("extracted").alias("ready_at"))
    status = F.when(F.col("ready_at").isNotNull(), "ready").when(F.col("_ended"), "failed").otherwise("processing")
    seen = documents.groupBy(key).agg(F.min("arrived").alias("arrived"))
    return seen.join(ends.withColumn("_ended", F.lit(True)), key, "left").select(key, "arrived", "ready_at", status.alias("status"))

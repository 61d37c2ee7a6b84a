"""Queries of the stored tables: counts, lookups, changes, deletes and their joins.

Regions stand for sessions, customers for companies, orders for documents, order lines
for metric rows and red flags.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.plans import inputs as I
from ledgerlens.plans.flag_queries import KEYS, _FLAGS, metrics
from ledgerlens.session import scratch_path
from ledgerlens.sources import store as St
from ledgerlens.streaming import incremental as Inc

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table_counts(spark, sf):
    return St.table_counts({n: I.table(spark, sf, n) for n in NAMES})


def _sessions(spark, sf):
    nation = I.table(spark, sf, "nation")
    return nation.select(F.col("n_nationkey").cast("long").alias("session_id"), F.col("n_name").alias("session_name"), F.timestamp_seconds(F.col("n_nationkey") % 7).alias("created_at"))


def _companies(spark, sf):
    return I.table(spark, sf, "customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("company_name"), F.col("c_mktsegment").alias("industry"), F.col("c_nationkey").cast("long").alias("session_id"))


def _documents(spark, sf):
    """Orders as documents; cancelled-looking ones have lost their session."""
    orders = I.table(spark, sf, "orders").join(_companies(spark, sf).select(F.col("company_id").alias("o_custkey"), "session_id"), "o_custkey")
    session = F.when(F.col("o_orderstatus") != "P", F.col("session_id"))
    return orders.select(F.col("o_orderkey").alias("document_id"), session.alias("session_id"), F.col("o_custkey").alias("company_id"), F.col("o_orderpriority").alias("file_name"))


def docs_per_session(spark, sf):
    return St.documents_per_session(_sessions(spark, sf).select("session_id", "session_name"), _documents(spark, sf))


def newest_sessions(spark, sf):
    return St.newest_first(_sessions(spark, sf)).select("session_id", "session_name")


def keyed_lookup(spark, sf):
    return St.find(I.table(spark, sf, "orders"), "o_orderkey", 77).select("o_orderkey", "o_custkey", "o_orderstatus")


def session_tree(spark, sf):
    rows = I.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("metric_id"), F.col("l_extendedprice").alias("revenue"))
    tree = St.session_tree(_sessions(spark, sf), _documents(spark, sf), _companies(spark, sf), rows)
    return tree.groupBy("session_id", "session_name").agg(
        F.count_distinct("document_id").alias("n_documents"), F.count_distinct("company_name").alias("n_companies"), F.sum(F.col("revenue").cast("decimal(12,2)")).cast("double").alias("revenue")
    )


def document_details(spark, sf):
    lines = I.table(spark, sf, "lineitem")
    metric_rows = lines.filter("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("metric_id"), F.col("l_quantity").alias("revenue"), "l_partkey")
    flags = lines.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("red_flag_id"), F.col("l_linestatus").alias("severity"), "l_partkey")
    out = St.document_details(_documents(spark, sf), metric_rows, flags)
    return out.select(
        "document_id", "status", F.array_join(F.transform("metrics", lambda m: F.concat_ws(":", m["metric_id"], m["l_partkey"], m["revenue"].cast("int"))), ",").alias("metrics"),
        F.array_join(F.transform("red_flags", lambda f: F.concat_ws(":", f["red_flag_id"], f["l_partkey"], f["severity"])), ",").alias("red_flags"),
    )


def comparison_pairs(spark, sf):
    """Order lines compare their supplier with the customer of the order."""
    names = _companies(spark, sf).select("company_id", "company_name")
    pairs = I.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("comparison_id"), "l_linenumber", F.col("l_suppkey").alias("company1_id"), (F.col("l_partkey") % 3000).alias("company2_id"))
    return St.comparison_pairs(pairs, names)


def keyed_update(spark, sf):
    """Customers take the priority of their latest order as the new segment."""
    last = I.table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("new_value"))
    changes = last.withColumnRenamed("o_custkey", "c_custkey")
    return St.apply_updates(I.table(spark, sf, "customer"), changes, "c_custkey", "c_mktsegment")


def keyed_delete(spark, sf):
    gone = I.table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return St.apply_deletes(I.table(spark, sf, "customer"), gone, "c_custkey")


def cleared_references(spark, sf):
    """Orders of deleted customers stay, without the customer."""
    gone = I.table(spark, sf, "customer").filter("c_acctbal < 0")
    return St.clear_references(I.table(spark, sf, "orders"), gone, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


def appended_ids(spark, sf):
    """Consecutive ids for new rows: the ids must be 101..100+n, each once."""
    rows = I.table(spark, sf, "orders").select("o_orderkey")
    out = St.numbered(rows, 101, "query_id")
    return out.agg(F.min("query_id").alias("first_id"), F.max("query_id").alias("last_id"), F.count_distinct("query_id").alias("n_ids"), F.count_distinct("o_orderkey").alias("n_rows"))


def _index(spark, sf):
    return I.table(spark, sf, "documents").select(F.col("source").alias("session_id"), F.col("doc_id").alias("document_id"), F.col("n_chars").alias("chunk_index"))


def _deletes(spark, sf):
    labels = I.table(spark, sf, "labels").filter("toxic = 1 OR quality = 0").select(F.col("doc_id").alias("document_id"))
    return labels.join(_index(spark, sf).select("document_id", "session_id"), "document_id").withColumn(
        "session_id", F.when(F.col("document_id") % 4 == 0, "nowhere").otherwise(F.col("session_id"))
    )


def chunk_delete(spark, sf):
    return St.delete_document_chunks(_index(spark, sf), _deletes(spark, sf))


def chunk_delete_results(spark, sf):
    return St.delete_results(_index(spark, sf), _deletes(spark, sf))


def stored_lifecycle(spark, sf):
    """Create, change and delete in a stored table: orders as research queries of two batches."""
    orders = I.table(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderstatus").alias("question"), F.col("o_orderpriority").alias("answer"))
    store = St.Table(spark, scratch_path(spark, "store"), "research_queries")
    store.append(orders.filter("question = 'F'"))
    store.append(orders.filter("question <> 'F'"))
    store.update(store.read().filter("session_id % 2 = 0").select("query_id", F.lit("changed").alias("new_value")))
    store.delete(store.read().filter("question = 'P'").select("query_id"))
    left = store.read()
    return left.groupBy("question", "answer").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("query_id").alias("n_ids"))


INDEX = "session_id string, document_id string, chunk_index int, text string"


def stored_index(spark, sf):
    """Documents as chunks of 400 characters in a stored index: all, one batch again, then the labelled ones deleted."""
    docs = I.texts(spark, sf, "documents").select(F.col("source").alias("session_id"), F.col("doc_id").cast("string").alias("document_id"), F.coalesce("text", F.lit("")).alias("text"))
    starts = F.posexplode(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(400))).alias("pos", "start")
    chunks = docs.select("*", starts).select("session_id", "document_id", "pos", F.substring("text", F.col("start"), F.lit(400)).alias("text"))
    index = St.ChunkIndex(spark, scratch_path(spark, "index"), INDEX)
    index.add(chunks)
    index.add(chunks.filter("CAST(document_id AS bigint) % 3 = 0"))
    index.delete(_deletes(spark, sf).withColumn("document_id", F.col("document_id").cast("string")))
    return index.rows.read().select("session_id", "document_id", "chunk_index", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def stream_red_flags(spark, sf):
    """Red flags of requests whose metrics come in three batches, through a stream."""
    path, out = scratch_path(spark, "metrics"), scratch_path(spark, "flags")
    rows = metrics(spark, sf)
    files = spark.sparkContext.defaultParallelism  # a batch; the metrics of a request fall into all of them
    share = F.pmod(F.xxhash64(*KEYS), F.lit(8 * files))
    rows.repartition(3 * files, "metric", share).write.parquet(path)
    changes = Inc.read_new_files(spark, path, rows.schema, files)
    Inc.flag_new_metrics(changes, KEYS, out, scratch_path(spark, "flags-log"), buckets=8).awaitTermination()
    return Inc.current_flags(spark, KEYS, out).select(*KEYS, "category", "title", "severity", "evidence")


# --- oracle -------------------------------------------------------------------------

_DOCS = """WITH docs AS (SELECT o_orderkey AS document_id, CASE WHEN o_orderstatus <> 'P' THEN CAST(c_nationkey AS BIGINT) END AS session_id, o_custkey AS company_id FROM orders JOIN customer ON c_custkey = o_custkey)"""
_DEL = """WITH ix AS (SELECT source AS session_id, doc_id AS document_id, n_chars AS chunk_index FROM documents),
de AS (SELECT l.doc_id AS document_id, CASE WHEN l.doc_id % 4 = 0 THEN 'nowhere' ELSE session_id END AS session_id FROM labels l JOIN ix ON ix.document_id = l.doc_id WHERE toxic = 1 OR quality = 0)"""

ORACLE = {
    "stored_index": _DEL + """, ch AS (SELECT source AS session_id, doc_id AS document_id, coalesce(text, '') AS text, unnest(range(0, greatest(CAST(ceil(length(coalesce(text, '')) / 400.0) AS BIGINT), 1))) AS i FROM documents)
      SELECT session_id, CAST(document_id AS VARCHAR) AS document_id, CAST(i AS INTEGER) AS chunk_index, md5(substr(text, i * 400 + 1, 400)) AS text_md5 FROM ch ANTI JOIN de USING (session_id, document_id)""",
    "table_counts": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in NAMES),
    "docs_per_session": _DOCS + " SELECT CAST(n_nationkey AS BIGINT) AS session_id, n_name AS session_name, count(document_id) AS document_count FROM nation LEFT JOIN docs ON session_id = n_nationkey GROUP BY 1, 2",
    "newest_sessions": "SELECT CAST(n_nationkey AS BIGINT) AS session_id, n_name AS session_name FROM nation ORDER BY n_nationkey % 7 DESC, n_nationkey DESC",
    "keyed_lookup": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 77",
    "session_tree": _DOCS + """ SELECT CAST(n_nationkey AS BIGINT) AS session_id, n_name AS session_name, count(DISTINCT document_id) AS n_documents, count(DISTINCT c_name) AS n_companies,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue FROM nation LEFT JOIN docs ON session_id = n_nationkey LEFT JOIN customer ON c_custkey = company_id LEFT JOIN lineitem ON l_orderkey = document_id GROUP BY 1, 2""",
    "document_details": _DOCS + """, m AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey || ':' || CAST(l_quantity AS INTEGER), ',' ORDER BY l_linenumber, l_quantity, l_partkey) AS s FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
      f AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey || ':' || l_linestatus, ',' ORDER BY l_linenumber, l_linestatus, l_partkey) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
      SELECT document_id, CASE WHEN m.s IS NULL THEN 'processing' ELSE 'ready' END AS status, m.s AS metrics, f.s AS red_flags FROM docs LEFT JOIN m ON m.l_orderkey = document_id LEFT JOIN f ON f.l_orderkey = document_id""",
    "comparison_pairs": "SELECT l_orderkey AS comparison_id, l_linenumber, l_suppkey AS company1_id, l_partkey % 3000 AS company2_id, a.c_name AS company1_name, b.c_name AS company2_name "
    "FROM lineitem LEFT JOIN customer a ON a.c_custkey = l_suppkey LEFT JOIN customer b ON b.c_custkey = l_partkey % 3000",
    "keyed_update": "WITH l AS (SELECT o_custkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) "
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, coalesce(o_orderpriority, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN l ON o_custkey = c_custkey",
    "keyed_delete": "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "cleared_references": "SELECT o_orderkey, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN o_custkey END AS o_custkey FROM orders",
    "appended_ids": "SELECT CAST(101 AS BIGINT) AS first_id, 100 + count(*) AS last_id, count(*) AS n_ids, count(DISTINCT o_orderkey) AS n_rows FROM orders",
    "chunk_delete": _DEL + " SELECT * FROM ix WHERE NOT EXISTS (SELECT 1 FROM de WHERE de.document_id = ix.document_id AND de.session_id = ix.session_id)",
    "chunk_delete_results": _DEL + " SELECT document_id, session_id, EXISTS (SELECT 1 FROM ix WHERE ix.document_id = de.document_id AND ix.session_id = de.session_id) AS deleted FROM de",
    "stored_lifecycle": "WITH q AS (SELECT o_orderstatus AS question, CASE WHEN o_custkey % 2 = 0 THEN 'changed' ELSE o_orderpriority END AS answer FROM orders WHERE o_orderstatus <> 'P') SELECT question, answer, count(*) AS n_rows, count(*) AS n_ids FROM q GROUP BY 1, 2",
    "stream_red_flags": _FLAGS + " SELECT company, financial_year, category, title, severity, evidence FROM fl",
}

QUERIES = {name: globals()[name] for name in ORACLE}

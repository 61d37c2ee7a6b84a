"""Queries of the readers and the sink, on files that are first written from the tables, and of the status stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.plans import inputs as I
from ledgerlens.plans.research_queries import strip_sql
from ledgerlens.session import scratch_path
from ledgerlens.sources import files as Fi
from ledgerlens.streaming import incremental as Inc

PER_FILE = 100  # rows that are written to one file
TABLE_ROWS = 100_000  # rows of a table that are written to one delimited file, far below the size limit of a file

# fixed values: the files of each table, their delimiter and columns (the same expression in both engines)
DIALECTS = {
    "customer": (",", {"id": "c_custkey", "company": "c_name", "balance": "CAST(c_acctbal AS DECIMAL(12,2))", "segment": "c_mktsegment"}),
    "part": (";", {"id": "p_partkey", "name": "concat(p_name, {br}, p_brand, ', ', p_type)", "says": "concat('a \"', p_brand, '\"')", "size": "p_size", "price": "CAST(p_retailprice AS DECIMAL(12,2))"}),
    "supplier": ("\t", {"id": "s_suppkey", "company": "s_name", "none": "''", "balance": "CAST(s_acctbal AS DECIMAL(12,2))"}),
    "nation": ("|", {"id": "n_nationkey", "name": "concat({br}, ' ', n_name, ' |  of')", "region": "n_regionkey"}),
}


def delimited_files(spark, sf):
    """Four tables written with a delimiter and a header each, read from one folder."""
    root = scratch_path(spark, "delimited")
    for name, (mark, columns) in DIALECTS.items():
        cells = [F.expr(x.replace("{br}", "char(10)")).cast("string").alias(c) for c, x in columns.items()]
        I.table(spark, sf, name).select(*cells).write.option("maxRecordsPerFile", TABLE_ROWS).csv(f"{root}/{name}", sep=mark, header=True, escape='"')
    rows = Fi.read_delimited_files(spark, root)
    named = rows.select(F.element_at(F.split("name", "/"), -2).alias("folder"), "delimiter", (F.col("row_no") == 0).alias("header"), F.array_join("cells", "~").alias("cells"))
    return named.filter("NOT header").unionByName(named.filter("header").distinct())


def metric_files(spark, sf):
    """Customers as company metrics in JSON arrays, some without a required field."""
    root = scratch_path(spark, "metrics")
    fields = F.struct(
        F.col("c_name").alias("company_name"), F.when(F.col("c_nationkey") % 5 != 0, "FY2024").alias("fiscal_year"),
        F.col("c_mktsegment").alias("source_document"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("revenue_cr"),
    )
    files = I.table(spark, sf, "customer").groupBy(F.floor(F.col("c_custkey") / PER_FILE).alias("file")).agg(F.to_json(F.collect_list(fields)).alias("value"))
    files.write.partitionBy("file").text(root)
    return Fi.read_company_metrics(spark, root).select("company_name", "fiscal_year", "source_document", "revenue_cr", "reason")


def text_files(spark, sf):
    """Documents, a hundred in one text file."""
    root = scratch_path(spark, "texts")
    docs = I.texts(spark, sf, "documents").select(F.floor(F.col("doc_id") / PER_FILE).alias("file"), F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")).alias("doc"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("doc")), lambda d: d["text"]), "\n")
    docs.groupBy("file").agg(whole.alias("value")).write.partitionBy("file").text(root)
    rows = Fi.read_text_files(spark, root)
    return rows.select(F.regexp_extract("name", r"file=(\d+)/", 1).cast("long").alias("file"), F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "warning")


def comparison_files(spark, sf):
    """Nested results written as JSON lines; null fields are kept."""
    root = scratch_path(spark, "comparisons")
    focus = F.struct("c_mktsegment", F.when(F.col("c_nationkey") > 9, F.col("c_nationkey")).alias("peer"))
    Fi.write_comparison(I.table(spark, sf, "customer").select("c_name", focus.alias("focus"), F.array("c_custkey", F.lit(None).cast("long")).alias("ids")), root)
    return spark.read.text(root).select(F.col("value").alias("json"))


LATE_DAYS, PATIENCE_DAYS, BATCHES, FILES = 900, 20, 3, 8


def stream_document_status(spark, sf):
    """Orders as documents and order lines as their facts, in three batches by date; every seventh line comes a batch late."""
    root = scratch_path(spark, "arrivals")
    docs = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").cast("timestamp").alias("arrived"))
    facts = I.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_shipdate").cast("timestamp").alias("extracted"), (F.col("l_linenumber") == 7).cast("int").alias("behind")
    )
    first, last = docs.select(F.min(F.unix_timestamp("arrived")), F.max(F.unix_timestamp("arrived"))).first()

    def batch(time, behind=F.lit(0)):
        third = F.floor((F.unix_timestamp(time) - first) * BATCHES / F.lit(last - first + 1))
        return F.least(third + behind, F.lit(BATCHES - 1))

    for name, rows in (("documents", docs.withColumn("n", batch("arrived"))), ("facts", facts.withColumn("n", batch("extracted", F.col("behind"))).drop("behind"))):
        for n in range(BATCHES):  # files are taken up in the order in which they were written
            rows.filter(F.col("n") == n).drop("n").repartition(FILES).write.mode("append").parquet(f"{root}/{name}")
    streams = [Inc.read_new_files(spark, f"{root}/{name}", schema, FILES) for name, schema in (("documents", docs.schema), ("facts", facts.drop("behind").schema))]
    out = scratch_path(spark, "outcomes")
    Inc.document_outcomes(*streams, "document_id", f"{PATIENCE_DAYS} DAYS", f"{LATE_DAYS * 24 + 12} hours", out, scratch_path(spark, "outcomes-log")).awaitTermination()
    return Inc.document_status(docs, spark.read.schema(docs.withColumn("extracted", F.col("arrived")).schema).parquet(out), "document_id")


# --- oracle -------------------------------------------------------------------------


def _cell(x: str) -> str:
    return f"trim(regexp_replace(CAST({x.replace('{br}', 'chr(10)')} AS VARCHAR), '\\s+', ' ', 'g'))"


def _dialect_sql(name: str, mark: str, columns: dict[str, str]) -> str:
    cells = " || '~' || ".join(_cell(x) for x in columns.values())
    sign = "chr(9)" if mark == "\t" else f"'{mark}'"
    return (
        f"SELECT '{name}' AS folder, {sign} AS delimiter, FALSE AS header, {cells} AS cells FROM {name} "
        f"UNION ALL SELECT '{name}', {sign}, TRUE, '{'~'.join(columns)}'"
    )


ORACLE = {
    "delimited_files": " UNION ALL ".join(_dialect_sql(name, *d) for name, d in DIALECTS.items()),
    "metric_files": """WITH c AS (SELECT c_name AS company_name, CASE WHEN c_nationkey % 5 <> 0 THEN 'FY2024' END AS fiscal_year, c_mktsegment AS source_document, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS revenue_cr FROM customer)
      SELECT *, CASE WHEN fiscal_year IS NULL OR revenue_cr IS NULL THEN 'missing: ' || concat_ws(', ', CASE WHEN fiscal_year IS NULL THEN 'fiscal_year' END, CASE WHEN revenue_cr IS NULL THEN 'revenue_cr' END) END AS reason FROM c""",
    "text_files": f"""WITH f AS (SELECT CAST(floor(doc_id / {PER_FILE}.0) AS BIGINT) AS file, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id, coalesce(text, '')) AS t FROM documents GROUP BY 1),
      s AS (SELECT file, {strip_sql('t')} AS t FROM f)
      SELECT file, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS text_md5, CASE WHEN t = '' THEN 'TXT extraction returned no text' END AS warning FROM s""",
    "comparison_files": """SELECT CAST(to_json({'c_name': c_name, 'focus': {'c_mktsegment': c_mktsegment, 'peer': CASE WHEN c_nationkey > 9 THEN c_nationkey END}, 'ids': [c_custkey, NULL]}) AS VARCHAR) AS json FROM customer""",
    # a document ends as failed when the slower stream is past its patience
    "stream_document_status": f"""WITH d AS (SELECT o_orderkey AS document_id, CAST(o_orderdate AS TIMESTAMP) AS arrived FROM orders), f AS (SELECT l_orderkey, CAST(l_shipdate AS TIMESTAMP) AS extracted FROM lineitem),
      w AS (SELECT least((SELECT max(arrived) FROM d), (SELECT max(extracted) FROM f)) - INTERVAL {LATE_DAYS * 24 + 12} HOUR AS mark),
      r AS (SELECT document_id, arrived, min(extracted) AS ready_at FROM d LEFT JOIN f ON l_orderkey = document_id AND extracted >= arrived AND extracted <= arrived + INTERVAL {PATIENCE_DAYS} DAY GROUP BY 1, 2)
      SELECT document_id, arrived, ready_at, CASE WHEN ready_at IS NOT NULL THEN 'ready' WHEN arrived + INTERVAL {PATIENCE_DAYS} DAY < mark THEN 'failed' ELSE 'processing' END AS status FROM r, w""",
}

QUERIES = {name: globals()[name] for name in ORACLE}

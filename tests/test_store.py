"""Stored tables, the chunk index and the written results."""

import json

from pyspark.sql import functions as F

from ledgerlens import schemas, vocab
from ledgerlens.operators import benchmark as B
from ledgerlens.operators import facts as Fa
from ledgerlens.session import scratch_path, shared_folder, spread
from ledgerlens.sources import files as Fi
from ledgerlens.sources import store as St
from ledgerlens.streaming import incremental as Inc

FIELDS = [m[0] for m in vocab.BENCHMARK_METRICS]


def test_create_list_update_delete(spark):
    table = St.Table(spark, scratch_path(spark, "store"), "companies")
    assert table.read().count() == 0
    rows = spark.createDataFrame([("Apple Inc.", "Technology", "2024"), ("Beta", "Retail", "2024")], "company_name string, industry string, fiscal_year string")
    table.append(rows)
    table.append(rows.limit(1))
    assert sorted(r.company_id for r in table.read().collect()) == [1, 2, 3]
    changes = spark.createDataFrame([(2, "Gamma"), (99, "nobody")], "company_id long, new_value string")
    table.update(changes)
    assert {r.company_id: r.company_name for r in table.read().filter("company_id = 2").collect()} == {2: "Gamma"}
    assert table.read().count() == 3 and table.get(99).isEmpty() and table.get(3).count() == 1
    table.delete(spark.createDataFrame([(3,), (77,)], "company_id long"))
    assert sorted(r.company_id for r in table.read().collect()) == [1, 2]


def test_timestamps_and_missing_session(spark):
    table = St.Table(spark, scratch_path(spark, "store"), "research_queries")
    table.append(spark.createDataFrame([("q", "a")], "question string, answer string"))
    row = table.read().first()
    assert row.query_id == 1 and row.session_id is None and row.created_at is not None


def test_update_to_null_counts(spark):
    table = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    changes = spark.createDataFrame([(1, None)], "k int, new_value string")
    assert {r.k: r.v for r in St.apply_updates(table, changes, "k", "v").collect()} == {1: None, 2: "y"}


def test_every_table_has_key_and_update_column():
    for name, (key, ddl) in schemas.TABLES.items():
        columns = [c.split()[0] for c in ddl.split(", ")]
        assert key == columns[0] and schemas.UPDATABLE[name] in columns
        assert all(fk in columns and parent in schemas.TABLES for fk, parent in schemas.FOREIGN_KEYS.get(name, {}).items())


def _index(spark):
    return St.ChunkIndex(spark, scratch_path(spark, "index"), "session_id string, document_id string, chunk_index int, text string", sessions=4, parts=2)


def _chunks(spark, rows):
    return spark.createDataFrame([(s, d, i, f"{d} {i} {note}") for s, d, n, note in rows for i in range(n)], "session_id string, document_id string, pos int, text string")


def test_chunk_index_replaces_a_document_and_counts_from_zero(spark):
    index = _index(spark)
    index.add(_chunks(spark, [("s1", "d1", 3, "a"), ("s1", "d2", 2, "a"), ("s2", "d1", 1, "a")]))
    before = sorted(index.rows.read().collect())
    index.add(_chunks(spark, [("s1", "d1", 3, "a")]))
    assert sorted(index.rows.read().collect()) == before
    index.add(_chunks(spark, [("s1", "d1", 2, "b")]).withColumn("pos", F.col("pos") + 40))
    assert sorted((r.document_id, r.chunk_index, r.text) for r in index.session("s1").collect()) == [
        ("d1", 0, "d1 0 b"), ("d1", 1, "d1 1 b"), ("d2", 0, "d2 0 a"), ("d2", 1, "d2 1 a")]
    gone = spark.createDataFrame([("s1", "d1"), ("s2", "d2")], "session_id string, document_id string")
    assert {(r.session_id, r.deleted) for r in index.delete(gone).collect()} == {("s1", True), ("s2", False)}
    assert {(r.session_id, r.document_id) for r in index.rows.read().collect()} == {("s1", "d2"), ("s2", "d1")}
    assert index.session("nowhere").isEmpty()


def test_a_change_writes_touched_buckets_only(spark):
    table = St.Table(spark, scratch_path(spark, "store"), "companies", buckets=8)
    table.append(spark.range(100).select(F.concat(F.lit("c"), "id").alias("company_name")))
    before = table.rows.latest()[1]["buckets"]
    assert len(before) == 8
    table.update(spark.createDataFrame([(5, "new")], "company_id int, new_value string"))
    after = table.rows.latest()[1]["buckets"]
    assert [b for b in before if before[b] != after[b]] == table.rows.touched(spark.range(5, 6).withColumnRenamed("id", "company_id"))
    opened = {f.split("bucket=")[1].split("/")[0] for f in table.get(5).inputFiles()}
    assert len(opened) == 1 and table.get(5).first().company_name == "new"
    assert table.read().count() == 100 and table.rows.read(version=2).filter("company_name = 'new'").isEmpty()


def test_two_writers_lose_nothing(spark):
    """Both writers compute their change on the same version; the later one commits on top."""
    root = scratch_path(spark, "store")
    one, two = (St.Table(spark, root, "companies", buckets=2) for _ in range(2))
    one.append(spark.range(20).select(F.concat(F.lit("c"), "id").alias("company_name")))
    write, raced = one.rows._write, []

    def interrupted(rows):
        out = write(rows)
        if not raced:
            raced.append(True)
            two.append(spark.createDataFrame([("late",)], "company_name string"))
            two.update(spark.createDataFrame([(3, "two"), (4, "two")], "company_id long, new_value string"))
            two.delete(spark.createDataFrame([(7,)], "company_id long"))
        return out

    one.rows._write = interrupted
    one.update(spark.createDataFrame([(i, "one") for i in (1, 2, 3, 7)], "company_id long, new_value string"))
    got = {r.company_id: r.company_name for r in one.read().collect()}
    assert (got[1], got[2], got[3], got[4], got[21]) == ("one", "one", "one", "two", "late") and 7 not in got and len(got) == 20
    assert one.rows._create(one.rows.latest()[0], {}) is False


def test_appends_at_once_share_no_id(spark):
    from concurrent.futures import ThreadPoolExecutor

    root = scratch_path(spark, "store")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: St.Table(spark, root, "companies").append(spark.range(10).select(F.lit(f"w{i}").alias("company_name"))), range(4)))
    rows = St.Table(spark, root, "companies").read().collect()
    assert sorted(r.company_id for r in rows) == list(range(1, 41)) and {r.company_name for r in rows} == {f"w{i}" for i in range(4)}


def test_compaction_and_old_versions(spark):
    table = St.Table(spark, scratch_path(spark, "store"), "companies", buckets=2)
    for i in range(4):
        table.append(spark.range(6).select(F.lit(f"w{i}").alias("company_name")))
    before = sorted(table.read().collect())
    table.rows.compact(folders=2)
    assert all(len(f) == 1 for f in table.rows.latest()[1]["buckets"].values()) and sorted(table.read().collect()) == before
    assert table.rows.vacuum() >= 8 and len(table.rows.versions()) == 1 and sorted(table.read().collect()) == before


def test_comparison_written_as_json(spark):
    data = [(i, n, "FY2025", *[float(v)] * 10) for i, (n, v) in enumerate([("A", 2), ("B", 1)])]
    df = spark.createDataFrame(data, "pos long, company_name string, fiscal_year string, " + ", ".join(f"{f} double" for f in FIELDS))
    out = B.comparison(df.withColumn("roe_pct", F.lit(None).cast("double")), "A", ["fiscal_year"])
    path = scratch_path(spark, "json")
    Fi.write_comparison(out, path)
    stored = json.loads(spark.read.text(path).first().value)
    assert len(stored["metric_comparisons"]) == 10 and stored["metric_comparisons"][4]["focus_company_value"] is None
    pretty = Fi.pretty_comparison(out).first().json
    assert json.loads(pretty) == stored and "\n  " in pretty
    assert "Insufficient data for metrics: Return on Equity (%)." in stored["narrative_summary"]


def test_extra_company_values_and_currency(spark):
    rows = [(1, "company_name", p, v, c) for p, (v, c) in enumerate([("Acme Limited", 0.5), ("Other Limited Partners", 0.9), ("ACME Limited ", 0.4)])]
    facts = spark.createDataFrame(rows, "doc_id int, field string, pos long, value string, confidence double")
    assert Fa.best_company_values(facts).first().value == "Acme Limited"
    m = spark.createDataFrame([(1, 0, "revenue", "EUR", "5"), (1, 1, "debt", None, "USD 4")], "doc_id int, place int, field string, unit string, value string")
    assert Fa.detect_document_currency(m, m.filter("field = 'debt'")).first().currency == "USD"
    assert Fa.detect_document_currency(m, m.filter("field = 'none'")).first().currency == "EUR"
    docs = spark.createDataFrame([(1, "in GBP"), (2, "paid in GBP, later USD"), (3, "x" * 12_000 + " USD"), (4, None), (5, "")], "doc_id int, text string")
    found = Fa.detect_document_currency(m, m.filter("field = 'none'"), documents=docs).collect()
    assert {r.doc_id: r.currency for r in found} == {1: "EUR", 2: "GBP"}


def test_stream_replaces_the_flags_of_a_request(spark, tmp_path):
    schema = "request_id string, pos int, metric string, current_raw string, prior_raw string, is_number boolean"

    def send(n, rows):
        spark.createDataFrame([(r, 0, "Revenue", now, before, True) for r, now, before in rows], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
        changes = Inc.read_new_files(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], schema).schema)
        Inc.flag_new_metrics(changes, ["request_id"], str(tmp_path / "out"), str(tmp_path / "log"), buckets=2).awaitTermination()
        return {(r.request_id, r.title) for r in Inc.current_flags(spark, ["request_id"], str(tmp_path / "out")).collect()}

    assert send(0, [("a", "50", "100"), ("b", "50", "100")]) == {("a", "Revenue decline"), ("b", "Revenue decline")}
    assert send(1, [("a", "120", "100"), ("c", "120", "100")]) == {("b", "Revenue decline")}
    assert send(2, [("c", "10", "100")]) == {("b", "Revenue decline"), ("c", "Revenue decline")}


def test_newest_metrics_of_a_request(spark):
    """The newest batch that names a metric counts, in it the first place; a row without a place only where there is no other."""
    rows = [("a", "Revenue", 0, 1, "old"), ("a", "Revenue", 1, 7, "late"), ("a", "Revenue", 1, 3, "first"), ("a", "Revenue", 1, None, "no place"), ("a", "EBITDA", 0, None, "alone")]
    schema = "request_id string, metric string, batch int, pos int, current_raw string"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "CAST(NULL AS string) AS prior_raw", "true AS is_number").repartition(4)
    found = Inc.newest_metrics(df, ["request_id"])
    assert {(r.metric, r.pos, r.current_raw) for r in found.collect()} == {("Revenue", 3, "first"), ("EBITDA", None, "alone")}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_shared_folder_and_spread(spark):
    assert shared_folder(spark) == shared_folder(spark)
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(100).repartition(20)
    assert spread(wide) is wide

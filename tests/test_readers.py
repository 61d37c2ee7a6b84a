"""Folders of delimited files and the status of documents in a stream."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerlens.plans import reader_queries as Q
from ledgerlens.session import scratch_path
from ledgerlens.sources import files as Fi
from ledgerlens.streaming import incremental as Inc


def _rows(spark, folder):
    found = Fi.read_delimited_files(spark, str(folder)).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.name, r.row_no)):
        got.setdefault(r.name.rsplit("/", 1)[1], (r.delimiter, []))[1].append(r.cells)
        assert r.row_no == len(got[r.name.rsplit("/", 1)[1]][1]) - 1
    return got


def test_folder_of_files_with_their_own_delimiters_and_headers(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.csv").write_text('﻿name,x\n" a\nb ",1\n,2\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text('k;k;\r\n"1;2";"say ""x""";3\r\n\r\n  \r\n4\r\n5;6;7;8\r\n9;9;9;\r\n')
    (tmp_path / "deep" / "c.tsv").write_text("only\n" + "x" * 200_000 + "\n")
    (tmp_path / "d.psv").write_text('a|b\n5" pipe|"un"quoted\n"open|never\nclosed\n')
    (tmp_path / "e.csv").write_text("\n \n")
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "f.csv").write_text("head,er\n")
    got = _rows(spark, tmp_path)
    assert got["a.csv"] == (",", [["name", "x"], ["a b", "1"], ["", "2"]])
    assert got["b.csv"] == (";", [["k", "k.1", "Unnamed: 2"], ["1;2", 'say "x"', "3"], ["4", "", ""], ["9", "9", "9"]])
    assert got["c.tsv"] == (",", [["only"], ["x" * 200_000]])
    assert got["d.psv"] == ("|", [["a", "b"], ['5" pipe', "unquoted"], ["open|never closed", ""]])
    assert got["e.csv"] == (",", [[]]) and "none.csv" not in got
    summary = {r.name.rsplit("/", 1)[1]: (r.row_count, r.column_count, r.warning) for r in Fi.delimited_summary(Fi.read_delimited_files(spark, str(tmp_path))).collect()}
    assert summary["b.csv"] == (3, 3, None) and summary["e.csv"] == (0, 0, Fi.NO_DATA_ROWS) and summary["f.csv"] == (0, 2, Fi.NO_DATA_ROWS)


def test_files_above_the_limit_stay_closed_and_many_rows_keep_their_place(spark, tmp_path, monkeypatch):
    (tmp_path / "big.csv").write_text("a,b\n" + "1,2\n" * 5_000)
    (tmp_path / "many.csv").write_text("n,m\n" + "".join(f"{i},x\n" for i in range(4_500)))
    assert [c[0] for c in _rows(spark, tmp_path)["many.csv"][1][1:]] == [str(i) for i in range(4_500)]
    monkeypatch.setattr(Fi.vocab, "MAX_FILE_BYTES", 20_005)
    assert list(_rows(spark, tmp_path)) == ["big.csv"]
    monkeypatch.setattr(Fi.vocab, "MAX_FILE_BYTES", 20)
    assert _rows(spark, tmp_path) == {}


def _day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_document_status_over_batches(spark):
    """Ready by facts of a later batch, failed only behind the watermark, facts outside the patience count for nothing."""
    root, out = scratch_path(spark, "arrivals"), scratch_path(spark, "outcomes")
    docs = [[(1, 0), (2, 0), (3, 1), (4, 1)], [(5, 10), (6, 12)], [(7, 40), (1, 0)]]
    facts = [[(1, 1), (2, -1), (99, 3)], [(1, 2), (3, 4), (4, 9), (5, 10)], [(6, 15), (8, 41)]]
    for n in range(3):
        for name, rows, time in (("documents", docs, "arrived"), ("facts", facts, "extracted")):
            frame = spark.createDataFrame([(k, _day(d)) for k, d in rows[n]], f"k long, {time} timestamp")
            frame.coalesce(1).write.mode("append").parquet(f"{root}/{name}")
    streams = [Inc.read_new_files(spark, f"{root}/{name}", f"k long, {time} timestamp", 1) for name, time in (("documents", "arrived"), ("facts", "extracted"))]
    Inc.document_outcomes(*streams, "k", "5 DAYS", "12 DAYS", out, scratch_path(spark, "log")).awaitTermination()
    arrived = spark.read.parquet(f"{root}/documents")
    got = {r.k: (r.status, r.ready_at) for r in Inc.document_status(arrived, spark.read.parquet(out), "k").collect()}
    assert got == {
        1: ("ready", _day(1)), 2: ("failed", None), 3: ("ready", _day(4)), 4: ("failed", None), 5: ("ready", _day(10)), 6: ("ready", _day(15)), 7: ("processing", None),
    }


def test_status_query_has_every_status(spark, sf_dir):
    assert {r.status for r in Q.stream_document_status(spark, sf_dir).select("status").distinct().collect()} == {"ready", "failed", "processing"}


def test_written_comparisons_keep_nulls_and_print_indented(spark):
    row = spark.range(1).select(F.struct(F.lit("x").alias("a"), F.lit(None).cast("int").alias("b")).alias("r"))
    assert '\n  "r" : {\n' in Fi.pretty_comparison(row).first().json and '"b" : null' in Fi.pretty_comparison(row).first().json


def test_tables_that_would_fill_more_than_a_file_of_the_limit_are_read_whole(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(Fi.vocab, "MAX_FILE_BYTES", 4_000)  # the customers of sf0.001 take more
    monkeypatch.setattr(Q, "TABLE_ROWS", 40)
    counts = {r.folder: r["count"] for r in Q.delimited_files(spark, sf_dir).filter("NOT header").groupBy("folder").count().collect()}
    assert counts == {name: Q.I.table(spark, sf_dir, name).count() for name in Q.DIALECTS}


def test_a_stream_of_documents_reads_a_table_that_is_a_folder(spark, sf_dir, tmp_path):
    from ledgerlens.plans import research_queries as R

    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    one, folder = (R.stream_section_chunks(spark, d) for d in (sf_dir, str(tmp_path)))
    assert folder.count() == one.count() > 0 and folder.exceptAll(one).isEmpty()

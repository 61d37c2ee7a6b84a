"""Duplicate lines, tables and the merge of text sources, one document per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.similarity import nfkc, novel_lines
from ledgerlens.functions.text import SPACE, canonical_text, first_per_key, split_lines, squash, strip
from ledgerlens.operators.ordering import first_by


def distinct_lines_exact(c: Column) -> Column:
    """Text with each line once (first place kept), compared by collapsed lower case."""
    lines = F.filter(F.transform(split_lines(c), strip), lambda s: F.length(s) > 0)

    items = F.transform(lines, lambda s: F.struct(F.lower(squash(s)).alias("k"), s.alias("t")))
    return F.array_join(F.transform(first_per_key(items), lambda e: e["t"]), "\n")


def _keyed_lines(text: Column) -> Column:
    """Stripped lines, each with the form it is compared by."""
    return F.transform(F.transform(split_lines(text), strip), lambda line: F.struct(line.alias("line"), F.lower(squash(line)).alias("key")))


def _keys(lines: Column) -> Column:
    return lines["key"]


def _paired(lines: Column) -> Column:
    """Each line after its key, as one string."""
    return F.transform(lines, lambda x: F.concat(x["key"], F.lit("\n"), x["line"]))


def distinct_lines(df: DataFrame, text: str, out: str, percent: int = 98, window: int = 80, least: int = 12) -> DataFrame:
    """`out`: the text without repeated or nearly repeated lines, in order; runs of blank lines become one."""
    kept = novel_lines(percent, window, least)(_paired(_keyed_lines(F.col(text))), F.array().cast("array<string>"))
    return df.withColumn(out, strip(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n")))


def new_scan_lines(df: DataFrame, native: str, scanned: str, out: str, percent: int = 97, window: int = 400, least: int = 12) -> DataFrame:
    """`out`: lines of the scan that the last `window` long lines of the native text do not already hold."""
    long = F.filter(_keyed_lines(F.coalesce(native, F.lit(""))), lambda x: F.char_length(x["line"]) > least)
    known = F.slice(_keys(long), F.greatest(F.size(long) - window + 1, F.lit(1)), F.lit(window))
    lines = F.filter(_keyed_lines(F.col(scanned)), lambda x: x["line"] != "")
    return df.withColumn(out, F.array_join(novel_lines(percent, window, learn=False)(_paired(lines), known), "\n"))


def dedup_lines_long(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Exact dedup of (keys, pos, line) rows: the first row per signature, as an aggregate."""
    signed = lines.withColumn("line", strip(F.col("line"))).filter("line <> ''").withColumn("signature", F.lower(squash(F.col("line"))))
    return first_by(signed, [*keys, "signature"], "pos", ["pos", "line"])


def rows_to_text(rows: Column) -> Column:
    """Table rows as tab-separated lines; rows of empty cells are left out."""
    return F.array_join(
        F.transform(F.filter(rows, lambda r: F.exists(r, lambda cell: cell != "")), lambda r: F.array_join(r, "\t")), "\n"
    )


def table_signature(rows: Column) -> Column:
    return F.lower(F.regexp_replace(F.left(rows_to_text(rows), F.lit(1000)), f"{SPACE}+", " "))


def distinct_tables(tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """First table per document and signature."""
    return first_by(tables.withColumn("signature", table_signature(F.col("rows"))), [key, "signature"], "pos").drop("signature")


def render_tables(tables: Column) -> Column:
    """Labelled text of an array of table structs (page, sheet, location, rows)."""

    def render(t: Column, i: Column) -> Column:
        def part(name: str, value: Column) -> Column:
            return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{name} "), value))

        label = F.concat_ws(
            " ", F.lit("Table"), (i + 1).cast("string"), part("Page", t["page"].cast("string")),
            part("Sheet", t["sheet"]), part("Location", t["location"]),
        )
        body = rows_to_text(t["rows"])
        return F.when(strip(body) != "", F.concat(label, F.lit("\n\n"), body)).otherwise(label)

    return F.array_join(F.transform(tables, render), "\n\n")


def merge_sources(documents: DataFrame, native: str, scanned: str, tables: str) -> DataFrame:
    """One text per document from native text, new lines of the scan and rendered tables."""
    documents = new_scan_lines(documents, native, scanned, "_scan")
    rendered = strip(render_tables(F.col(tables)))
    parts = [
        F.nullif(strip(F.col(native)), F.lit("")),
        F.nullif(strip(F.col("_scan")), F.lit("")),
        F.when(rendered != "", F.concat(F.lit("Extracted Tables\n"), rendered)),
    ]
    return distinct_lines(documents.withColumn("_merged", F.concat_ws("\n\n", *parts)), "_merged", "merged_text").drop("_scan", "_merged")


def normalise_documents(documents: DataFrame, text: str = "text") -> DataFrame:
    """Text in canonical form without repeated lines."""
    steps = documents.withColumn(text, nfkc(F.col(text)))
    steps = steps.withColumn(text, canonical_text(F.col(text)))
    return distinct_lines(steps, text, text)

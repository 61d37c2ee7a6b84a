"""From report texts to a peer comparison: extract, put curated metrics in place, benchmark.

A set of documents is compared together. One document may stand in any number of sets, as
in pairs, so documents are extracted once and their figures joined to the sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.operators import benchmark as B
from ledgerlens.operators.ordering import lookup
from ledgerlens.session import cut_lineage
from ledgerlens.sources.files import curated_override, extract_report_metrics

FIELDS = [field for field, *_ in vocab.BENCHMARK_METRICS]


def document_metrics(reports: DataFrame, curated: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """Company metrics of each report (doc, text, file_name): a matching curated row, else what its text states."""
    # stored as it is read twice by the override, and for the focus, the ranks and the means
    own = cut_lineage(extract_report_metrics(reports).drop("text", "file_name"))
    return own.withColumn("is_curated", F.lit(False)) if curated is None else cut_lineage(curated_override(own, curated, doc))


def compare_documents(members: DataFrame, figures: DataFrame, set_cols: list[str], focus: str | Column | None = None, doc: str = "doc_id") -> DataFrame:
    """One benchmark row per set and metric.

    `members` lists the documents of each set: set columns, `doc`, `pos` (order in the set)
    and, where `focus` is a column, that column. Without a focus, or where no document has
    that name, the first document is the focus. Sets of fewer than two documents give no row.
    """
    rows = lookup(members, figures.select(doc, "company_name", *FIELDS), [doc])
    return B.benchmark(rows, focus, set_cols)


def compare_pairs(pairs: DataFrame, figures: DataFrame, pair: str = "pair_id", doc: str = "doc_id") -> DataFrame:
    """Two documents against each other: rows (pair, first, second, focus) with `focus` a name or null.

    Both documents of a pair may hold the same company; then the focus has no peer and
    its metrics are without data.
    """
    sides = F.array(*[F.struct(F.col(c).alias(doc), F.lit(i).cast("long").alias("pos")) for i, c in enumerate(("first", "second"))])
    members = pairs.select(pair, "focus", F.explode(sides).alias("side")).select(pair, "focus", "side.*")
    return compare_documents(members, figures, [pair], F.col("focus"), doc)

"""Checks and normal forms of metric inputs, sections, requests, facts and pages.

Each check returns the frame with a `reason` column, null for good rows; `accepted`
and `rejected` split it without a second pass over the logic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.functions.text import blank_to_null, round_exact, strip

# Alternative keys of a metric object
METRIC_KEY_ALIASES = {
    "current": ("current_value", "current_period"),
    "current_year": ("current_year_value",),
    "previous": ("previous_value", "previous_period"),
    "prior": ("prior_value", "prior_period"),
    "prior_year": ("last_year", "last_year_value"),
}


def accepted(df: DataFrame) -> DataFrame:
    return df.filter("reason IS NULL").drop("reason")


def rejected(df: DataFrame) -> DataFrame:
    return df.filter("reason IS NOT NULL")


def _reason(*checks: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(bad, F.lit(text)) for bad, text in checks])


def normalise_metrics(inputs: DataFrame) -> DataFrame:
    """Metric objects with aliases folded in; adds current_raw, prior_raw and reason.

    The current value never falls back to a prior one, nor the prior to `value`.
    """
    for target, names in METRIC_KEY_ALIASES.items():
        inputs = inputs.withColumn(target, F.coalesce(target, *names)).drop(*names)
    six = ["value", "current", "previous", "prior", "current_year", "prior_year"]
    return (
        inputs.withColumn("current_raw", F.coalesce("current", "current_year", "value"))
        .withColumn("prior_raw", F.coalesce("previous", "prior", "prior_year"))
        .withColumn(
            "reason",
            _reason(
                (F.col("kind") == "boolean", "metric values must be strings or numbers, not booleans"),
                (F.coalesce(*six).isNull(), "metric must include at least one value"),
            ),
        )
        .withColumn("is_number", F.col("kind") == "number")
    )


def check_requests(requests: DataFrame) -> DataFrame:
    """request_id, company, financial_year, n_metrics -> trimmed, with reason."""
    df = requests.withColumn("company", strip(F.col("company"))).withColumn("financial_year", strip(F.col("financial_year")))

    def blank(c: str) -> Column:
        return F.coalesce(F.length(c), F.lit(0)) == 0

    return df.withColumn(
        "reason",
        _reason(
            (blank("company"), "company must not be empty"),
            (F.length("company") > 240, "company is longer than 240 characters"),
            (blank("financial_year"), "financial_year must not be empty"),
            (F.length("financial_year") > 40, "financial_year is longer than 40 characters"),
            (F.coalesce("n_metrics", F.lit(0)) == 0, "metrics must not be empty"),
        ),
    )


def check_sections(sections: DataFrame) -> DataFrame:
    df = sections.withColumn("section", strip(F.col("section"))).withColumn("content", strip(F.col("content")))
    empty = (F.coalesce(F.length("section"), F.lit(0)) == 0) | (F.coalesce(F.length("content"), F.lit(0)) == 0)
    return df.withColumn(
        "reason",
        _reason(
            (empty, "section fields must not be empty"),
            (F.length("section") > 160, "section is longer than 160 characters"),
        ),
    )


def clamp_unit(c: Column) -> Column:
    """A confidence in [0, 1]; text that is no finite number gives 0."""
    number = c.cast("string").try_cast("double")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def check_facts(facts: DataFrame, required: list[str]) -> DataFrame:
    """Trimmed facts: required texts non-blank, confidence clamped, page digits without zeros."""
    for name in [*required, *[c for c in ("unit", "period", "page_number") if c in facts.columns]]:
        facts = facts.withColumn(name, blank_to_null(F.col(name).cast("string")))
    digits = F.col("page_number").rlike(r"^\d+$")
    page = F.when(digits, F.regexp_replace("page_number", r"^0+(?=\d)", "")).otherwise(F.col("page_number"))
    return (
        facts.withColumn("page_number", page)
        .withColumn("confidence", F.when(F.col("confidence").isNotNull(), clamp_unit(F.col("confidence"))))
        .withColumn("reason", _reason(*[(F.col(c).isNull(), f"required text field is empty: {c}") for c in required]))
    )


def pages_needing_ocr(pages: DataFrame) -> DataFrame:
    """Adds needs_ocr per page of (doc_id, page_number, n_chars, n_images)."""
    low = F.col("n_chars") < vocab.OCR_MIN_CHARS
    sparse = (F.col("n_images") > 0) & (F.col("n_chars") < 2 * vocab.OCR_MIN_CHARS)
    return pages.withColumn("needs_ocr", low | sparse).withColumn(
        "needs_ocr_simple", F.col("n_chars") < vocab.OCR_MIN_CHARS_SIMPLE
    )


def documents_needing_ocr(pages: DataFrame) -> DataFrame:
    """Per document: the flag and the list of pages (bounded by the pages of one file)."""
    hits = F.collect_list(F.when(F.col("needs_ocr"), F.col("page_number")))
    return pages_needing_ocr(pages).groupBy("doc_id").agg(
        F.bool_or("needs_ocr").alias("ocr_required"), F.array_sort(hits).alias("ocr_pages")
    )


def public_messages(messages: Column, markers=vocab.INTERNAL_WARNING_MARKERS) -> Column:
    """An array of messages without those that carry an internal marker."""

    def internal(m: Column) -> Column:
        low = F.lower(m)
        return low.contains(markers[0]) if len(markers) == 1 else F.array_contains(
            F.transform(F.array(*[F.lit(x) for x in markers]), lambda x: low.contains(x)), True
        )

    return F.filter(messages, lambda m: ~internal(m))


def status_code(errors: Column) -> Column:
    """HTTP-like code of an array of error texts; the first rule that matches counts."""
    text = F.lower(F.array_join(errors, " "))
    code = F.lit(500)
    for value, words in reversed(vocab.STATUS_RULES):
        hit = text.contains(words[0])
        for word in words[1:]:
            hit = hit | text.contains(word)
        code = F.when(hit, value).otherwise(code)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 200).otherwise(code)


def public_status(errors: Column, public_errors: Column) -> Column:
    """A failure that only internal messages explain is a success."""
    code = status_code(errors)
    return F.when((F.size(public_errors) == 0) & code.isin(500, 502), 200).otherwise(code)


def batch_status(results: DataFrame, batch: list[str]) -> DataFrame:
    """Roll-up per batch: success when all succeed, else the highest failing code."""
    failing = F.max(F.when(~F.col("success"), F.coalesce("status_code", F.lit(500))))
    return results.groupBy(*batch).agg(
        F.every("success").alias("success"), F.count(F.lit(1)).alias("count"),
        F.coalesce(failing, F.lit(200)).alias("status_code"),
    )


def text_quality(pages: DataFrame) -> DataFrame:
    """Per document of paged text: characters against 1,200 per page, capped at 1."""
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum("n_chars").alias("total_chars")
    ).withColumn(
        "native_quality",
        round_exact(F.least(F.lit(1.0), F.col("total_chars") / F.greatest(F.lit(1), F.col("n_pages") * 1200)), 4),
    )


def processing_summary(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Status row per document from (doc_id, page_number, source) and (doc_id, ...) chunks."""
    by_doc = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"), F.count_if(F.col("source") == "ocr").alias("ocr_page_count"),
        F.count_if(F.col("source") == "empty").alias("empty_page_count"),
    )
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    df = by_doc.join(counts, "doc_id", "left").na.fill({"chunk_count": 0})
    failed = F.col("chunk_count") == 0
    warn_empty = F.when(
        F.col("empty_page_count") > 0,
        F.concat(F.col("empty_page_count").cast("string"), F.lit(" page(s) produced no text even after OCR (likely blank pages or unreadable images).")),
    )
    warn_ocr = F.when(
        F.col("ocr_page_count") > 0,
        F.concat(F.col("ocr_page_count").cast("string"), F.lit(
            " page(s) had no text layer and were processed with OCR instead — double-check those pages for "
            "extraction accuracy, especially numbers in tables.")),
    )
    return df.select(
        "*", F.when(failed, "failed").otherwise("indexed").alias("status"),
        F.when(failed, "No text chunks were produced from this document.").alias("error"),
        F.array_compact(F.array(warn_empty, warn_ocr)).alias("warnings"),
    )

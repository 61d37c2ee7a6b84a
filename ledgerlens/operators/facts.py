"""Metric and company facts from text lines, and their merge per document.

Extraction is a projection of each line plus broadcast lookups in the fixed alias
tables. The merge groups by document; a document is one input row, so its facts are
bounded by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.functions.similarity import first_distinct, support_counts
from ledgerlens.functions.text import (
    NUMBER, any_of, detect_currency, detect_period, detect_unit, legal_name, let, round_exact, squash, starts_with_one_of, strip, tidy_value, word_key,
)
from ledgerlens.operators.chunking import split_at_pages
from ledgerlens.operators.ordering import best_by, first_by, lookup
from ledgerlens.session import cut_lineage

# --- patterns, built from the alias tables ----------------------------------------

_CODES = "|".join(vocab.REWRITTEN_CODES)
_SCALES = "|".join(vocab.SCALE_WORDS)
_VALUE = (
    rf"(?:[$?]\s*)?{NUMBER}\s*(?:%|x|times|{_SCALES}|shares?)?"
    rf"|(?:{'|'.join(vocab.CURRENCY_CODES)})\s+{NUMBER}\s*(?:{_SCALES})?"
)


def _prefix_pattern(aliases, need_digit: bool) -> str:
    value = r".*?\d.*?" if need_digit else ".+?"
    return (
        rf"(?iuU)^\s*({'|'.join(aliases)})(?:\s*(?:[:=\-?]|\s{{2,}}|\t)\s*({value})"
        rf"|\s+((?:{_CODES}|[$?])?\s*\(?[-+]?\d.*?))\s*$"
    )


_METRIC_ORDER = vocab.alias_order(vocab.METRIC_ALIASES)
_COMPANY_ORDER = vocab.alias_order(vocab.COMPANY_ALIASES)
_LONG_FIRST = sorted((a for a, *_ in _METRIC_ORDER), key=len, reverse=True)
METRIC_PREFIXES = [_prefix_pattern(names, True) for names in (_LONG_FIRST, _LONG_FIRST[::-1])]
COMPANY_PREFIX = _prefix_pattern(sorted((a for a, *_ in _COMPANY_ORDER), key=len, reverse=True), False)
NARRATIVE = (
    rf"(?iuU)\b({'|'.join(_LONG_FIRST)})\b\s+(?:was|were|is|are|totaled|totalled|amounted to|of|at)\s+({_VALUE})"
)
# of the aliases that hold another one only that need be looked for
_LEAST = [a for a in _LONG_FIRST if not any(other != a and other in a for other in _LONG_FIRST)]
METRIC_WORD = f"{starts_with_one_of(''.join(a[0] for a in _LEAST))}(?iu){any_of(_LEAST)}"
COMPANY_WORD = rf"(?iu)^\s*{any_of(a for a, *_ in _COMPANY_ORDER)}"


def _order_map(order: list, suffixes: bool = False) -> Column:
    """alias -> its place in the lookup order; with `suffixes`, the best place among the
    aliases that end it ("total current assets" also says "assets")."""
    pairs = []
    for alias, _, place in order:
        ends = [p for a, _, p in order if alias == a or alias.endswith(f" {a}") or alias.endswith(f"-{a}")]
        pairs += [F.lit(alias), F.lit(min(ends) if suffixes else place)]
    return F.create_map(*pairs)


def _field_at(order: list) -> Column:
    return F.array(*[F.lit(field) for _, field, _ in order])


def prefixed(line: Column, pattern: str) -> Column:
    """[alias, value] of a line that is a match of a prefix pattern as a whole, or null; the pattern is searched once."""
    told = F.regexp_replace(line, pattern, "\x01$1\x02$2$3")
    return let(told, lambda t: F.when(t != line, F.split(F.substring(t, 2, 2**31 - 1), "\x02", 2)))


def metric_from_line(line: Column) -> Column:
    """(field, value) of the first alias in lookup order that the line states, or null.

    An alias is stated as a prefix ("Revenue: 5") or in a sentence ("revenue was 5"); for
    one alias the prefix counts first.
    """
    places, ends = _order_map(_METRIC_ORDER), _order_map(_METRIC_ORDER, suffixes=True)
    candidates = [
        let(prefixed(line, pattern), lambda p: F.when(
            p.isNotNull(), F.struct((F.try_element_at(places, F.lower(F.get(p, F.lit(0)))) * 2).alias("o"), F.lit(0).alias("i"), tidy_value(F.get(p, F.lit(1))).alias("value")),
        ))
        for pattern in METRIC_PREFIXES
    ]
    told = F.transform(
        F.regexp_extract_all(line, F.lit(NARRATIVE), F.lit(0)),
        lambda hit, i: F.struct(
            (F.try_element_at(ends, F.lower(F.regexp_extract(hit, NARRATIVE, 1))) * 2 + 1).alias("o"), i.alias("i"),
            tidy_value(F.regexp_extract(hit, NARRATIVE, 2)).alias("value"),
        ),
    )
    best = F.array_min(F.concat(F.array_compact(F.array(*candidates)), told))
    fields = _field_at(_METRIC_ORDER)
    named = let(best, lambda b: F.when(b.isNotNull(), F.struct(F.get(fields, F.floor(b["o"] / 2).cast("int")).alias("field"), b["value"].alias("value"))))
    return F.when(line.rlike(r"\d") & line.rlike(METRIC_WORD), named)


def company_from_line(line: Column) -> Column:
    """(field, value) of a company-info prefix line, or null."""
    places, fields = _order_map(_COMPANY_ORDER), _field_at(_COMPANY_ORDER)

    def fact(p: Column) -> Column:
        field = F.get(fields, F.try_element_at(places, F.lower(F.get(p, F.lit(0)))))
        return let(tidy_value(F.get(p, F.lit(1))), lambda v: F.when(v != "", F.struct(field.alias("field"), v.alias("value"))))

    return F.when(line.rlike(COMPANY_WORD), let(prefixed(line, COMPANY_PREFIX), lambda p: F.when(p.isNotNull(), fact(p))))


# --- lines ------------------------------------------------------------------------


def alias_frame(spark, aliases: dict) -> DataFrame:
    """Fixed lookup table label_key -> field; small by construction."""
    return spark.createDataFrame(vocab.alias_rows(aliases), "label_key string, field string, field_pos int")


def text_lines(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Non-blank lines in order with the page they stand on: keys, pos (part, line), page_number, line."""
    parts = texts.select(*keys, F.posexplode(split_at_pages(F.col(text))).alias("part", "p"))
    rows = parts.select(*keys, "part", F.col("p.page").alias("page_number"), F.posexplode("p.lines").alias("i", "raw"))
    line = F.when(F.col("raw").contains("\t"), strip(F.col("raw"))).otherwise(squash(F.col("raw")))
    pos = F.struct("part", F.col("i").alias("line"))
    return rows.select(*keys, pos.alias("pos"), "page_number", line.alias("line")).filter("line <> ''")


def facts_of_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """All facts of (keys, pos, page_number, line) rows in one pass; `kind` says which.

    A line that is itself a company name gives that fact only. Table rows are looked up by
    their first cell; other lines by the alias they state. A fact's `pos` is the line's
    `pos` and the fact's place in the line, so no two facts share one.
    """
    spark = lines.sparkSession
    cells = F.filter(F.transform(F.split("line", "\t", -1), strip), lambda c: F.length(c) > 0)
    df = lines.withColumn("name", legal_name(F.col("line"))).withColumn("cells", F.when(F.col("line").contains("\t"), cells))
    df = df.withColumn("label_key", F.when(F.size("cells") >= 2, word_key(F.get("cells", F.lit(0)))))
    for aliases, column in ((vocab.METRIC_ALIASES, "metric_field"), (vocab.COMPANY_ALIASES, "company_field")):
        names = alias_frame(spark, aliases).select("label_key", F.col("field").alias(column))
        df = df.join(F.broadcast(names), "label_key", "left")

    def fact(kind: str, field: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), field.alias("field"), value.alias("value"))

    rest = F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0)))
    in_cells = F.transform(F.filter(rest, lambda c: c.rlike(r"\d")), lambda c: fact("metric", F.col("metric_field"), c))
    stated = let(
        metric_from_line(F.col("line")),
        lambda m: F.when(m.isNotNull(), F.array(fact("metric", m["field"], m["value"]))),
    )
    by_cell = let(in_cells, lambda a: F.when(F.col("metric_field").isNotNull() & (F.size(a) > 0), a))
    metrics = F.when(F.col("name").isNull() & F.col("line").rlike(r"\d"), F.coalesce(by_cell, stated))
    cell = F.when(F.col("company_field").isNotNull(), F.struct(F.col("company_field").alias("field"), F.get("cells", F.lit(1)).alias("value")))
    own = F.when(F.col("name").isNotNull(), F.struct(F.lit("company_name").alias("field"), F.col("name").alias("value")))
    company = let(
        F.coalesce(own, cell, company_from_line(F.col("line"))),
        lambda c: F.when(c.isNotNull(), F.array(fact("company", c["field"], c["value"]))),
    )
    none = F.array().cast("array<struct<kind:string,field:string,value:string>>")
    rows = df.select(
        *keys, "pos", "page_number", "line", F.posexplode(F.concat(F.coalesce(metrics, none), F.coalesce(company, none))).alias("i", "f")
    )
    is_metric = F.col("f.kind") == "metric"
    return rows.select(
        *keys, F.struct(F.col("pos").alias("line"), F.col("i").alias("item")).alias("pos"), "f.kind", "f.field", "f.value", "page_number",
        F.when(is_metric, display_name(F.col("f.field"))).alias("metric"), F.when(is_metric, detect_unit(F.col("f.value"))).alias("unit"),
        F.when(is_metric, detect_period(F.col("line"))).alias("period"),
        F.when(is_metric, vocab.LINE_CONFIDENCE).otherwise(vocab.COMPANY_CONFIDENCE).alias("confidence"),
    )


def split_facts(facts: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(metric facts, company facts) of a mixed frame."""
    metrics = facts.filter("kind = 'metric'").select(*keys, "pos", "field", "metric", "value", "unit", "period", "page_number", "confidence")
    return metrics, facts.filter("kind = 'company'").select(*keys, "pos", "field", "value", "page_number", "confidence")


def line_facts(lines: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(metric facts, company facts) of lines; store `facts_of_lines` first to use both."""
    return split_facts(facts_of_lines(lines, keys), keys)


def display_name(field: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in vocab.DISPLAY_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, field), field)


def canonical_labels(facts: DataFrame, label: str = "metric") -> DataFrame:
    """Adds `field` (null when unknown) and `display` for free metric labels."""
    table = alias_frame(facts.sparkSession, vocab.METRIC_ALIASES).select("label_key", "field")
    words = F.transform(
        F.filter(F.split("label_key", " "), lambda w: w != ""),
        lambda w: F.when(w.isin(*vocab.DISPLAY_ACRONYMS), F.upper(w)).otherwise(F.initcap(w)),
    )
    other = F.coalesce(F.nullif(F.array_join(words, " "), F.lit("")), F.lit("Metric"))
    joined = facts.withColumn("label_key", word_key(F.col(label))).join(F.broadcast(table), "label_key", "left")
    return joined.withColumn("display", F.when(F.col("field").isNotNull(), display_name(F.col("field"))).otherwise(other)).drop("label_key")


# --- merge ---------------------------------------------------------------------------


def dedup_facts(facts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """First fact per lower-cased signature of `columns` within `keys`."""
    signature = F.concat_ws("|", *[F.lower(strip(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in columns])
    return first_by(facts.withColumn("signature", signature), [*keys, "signature"], "pos").drop("signature")


def best_metrics(facts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document and field: highest confidence, then most complete, then longest value."""
    complete = sum(F.coalesce(F.col(c).cast("string") != "", F.lit(False)).cast("int") for c in ("value", "unit", "period", "page_number"))
    score = [F.coalesce("confidence", F.lit(0.0)), complete, F.coalesce(F.length("value"), F.lit(-1))]
    return best_by(facts, [doc, "field"], score, "pos", ["metric", "value", "unit", "period", "page_number", "confidence", "pos"])


def best_company_values(facts: DataFrame, doc: str = "doc_id", percent: int = 92) -> DataFrame:
    """Per document and field: the value with most look-alikes, then confidence, then length."""
    listed = facts.groupBy(doc, "field").agg(F.array_sort(F.collect_list(F.struct("pos", "value", "confidence"))).alias("c"))
    listed = listed.withColumn("support", support_counts(percent)(F.transform("c", lambda x: x["value"])))
    scored = F.zip_with(
        "c", "support",
        lambda x, n: F.struct(
            (-n).alias("n"), (-F.coalesce(x["confidence"], F.lit(0.0))).alias("conf"), (-F.coalesce(F.length(strip(x["value"])), F.lit(-1))).alias("len"),
            x["pos"].alias("p"), x["value"].alias("value"),
        ),
    )
    return listed.select(doc, "field", F.array_min(scored)["value"].alias("value"))


def distinct_metrics(facts: DataFrame, doc: str = "doc_id", percent: int = 96, same: list[str] | None = None) -> DataFrame:
    """Metric facts without look-alikes of earlier ones, in canonical order (`place`).

    The original compares whole facts, so that two long amounts that differ in a digit are
    look-alikes. With `same`, only facts that agree in those columns can be.
    """
    exact = F.lower(strip(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("metric", "value", "unit", "period", "page_number")])))
    columns = ["pos", "field", "metric", "value", "unit", "period", "page_number", "confidence"]
    once = first_by(facts.withColumn("signature", exact), [doc, "signature"], "pos", columns)
    listed = once.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(*columns, "signature"))).alias("c"))
    agree = F.lit(None).cast("array<string>") if same is None else F.transform("c", lambda x: F.concat_ws("\n", *[F.coalesce(x[c], F.lit("")) for c in same]))
    listed = listed.withColumn("keep", first_distinct(percent)(F.transform("c", lambda x: x["signature"]), agree))
    rank = F.create_map(*[F.lit(x) for i, f in enumerate(vocab.METRIC_FIELDS) for x in (f, i)])

    def text(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(""))

    kept = F.filter(F.arrays_zip("c", "keep"), lambda z: z["keep"])
    ordered = F.array_sort(
        F.transform(
            kept,
            lambda z: F.struct(
                F.coalesce(F.try_element_at(rank, z["c"]["field"]), F.lit(len(vocab.METRIC_FIELDS))).alias("a"),
                text(z["c"]["period"]).alias("b"), text(z["c"]["page_number"]).alias("d"), text(z["c"]["metric"]).alias("e"),
                z["c"]["pos"].alias("g"), z["c"].alias("fact"),
            ),
        )
    )
    rows = listed.select(doc, F.posexplode(ordered).alias("place", "s"))
    return rows.select(doc, "place", *[F.col("s.fact")[c].alias(c) for c in columns])


def detect_document_currency(
    metrics: DataFrame, chosen: DataFrame, doc: str = "doc_id", documents: DataFrame | None = None, text: str = "text"
) -> DataFrame:
    """Most frequent currency over metric texts, chosen fields counted again; ties by first seen.

    With `documents`, those whose facts name no currency take the first that the head of
    their text names; documents without any have no row.
    """
    fields = F.create_map(*[F.lit(x) for i, f in enumerate(vocab.METRIC_FIELDS) for x in (f, i)])

    def placed(rows: DataFrame, source: int, place: Column) -> DataFrame:
        return rows.select(doc, F.struct(F.lit(source).alias("source"), place.cast("long").alias("place")).alias("p"), "unit", "value")

    # chosen fields come after all metrics, however many places those take
    both = placed(metrics, 0, F.col("place")).unionByName(placed(chosen, 1, F.element_at(fields, F.col("field"))))
    texts = both.select(doc, "p", F.posexplode(F.array("unit", "value")).alias("i", "t"))
    seen = texts.withColumn("code", detect_currency(F.col("t"))).filter("code IS NOT NULL").groupBy(doc, "code").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("p.source", "p.place", "i")).alias("first")
    )
    order = F.struct("n", -F.col("first.source"), -F.col("first.place"), -F.col("first.i"))
    of_facts = seen.groupBy(doc).agg(F.max_by("code", order).alias("currency"))
    if documents is None:
        return of_facts
    told = documents.select(doc, detect_currency(F.left(text, F.lit(vocab.CURRENCY_HEAD_CHARS))).alias("told"))
    both = lookup(told, of_facts, [doc], "left")
    return both.select(doc, F.coalesce("currency", "told").alias("currency")).filter("currency IS NOT NULL")


def wide_facts(best: DataFrame, doc: str = "doc_id", fields=vocab.METRIC_FIELDS) -> DataFrame:
    """One row per document with a value column per field; the list keeps it one job."""
    return best.groupBy(doc).pivot("field", list(fields)).agg(F.first("value"))


def mean_confidence(metrics: DataFrame, companies: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Mean confidence of all facts of a document, to four places."""
    both = metrics.select(doc, F.coalesce("confidence", F.lit(vocab.METRIC_CONFIDENCE)).alias("confidence")).unionByName(
        companies.filter("confidence > 0").select(doc, "confidence")
    )
    exact = F.sum(F.col("confidence").cast("decimal(20,10)")).cast("double") / F.count(F.lit(1))
    return both.groupBy(doc).agg(round_exact(exact, 4).alias("confidence_score"))


def document_confidence(
    documents: DataFrame, metrics: DataFrame, chosen: DataFrame, companies: DataFrame, doc: str = "doc_id"
) -> DataFrame:
    """0-100 score from (doc, model_confidence, text_quality, has_text, n_errors, n_warnings).

    With a column `warnings` (texts) in place of `n_warnings`, those that only tell of the
    plain reading of facts cost nothing; with `ocr_required` and `ocr_confidence`, a scan
    counts as good as its reader says. `companies` holds (doc, field) of every scalar found.
    """
    if "warnings" in documents.columns:
        counted = F.filter("warnings", lambda w: ~F.lower(w).contains(vocab.UNPENALISED_WARNING))
        documents = documents.withColumn("n_warnings", F.coalesce(F.size(counted), F.lit(0)))
    columns = ["metric", "value", "unit", "period"]
    signature = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns]))
    both = metrics.select(doc, *columns, "confidence").unionByName(chosen.select(doc, *columns, "confidence"))
    once = both.groupBy(doc, signature.alias("s")).agg(F.max("confidence").alias("confidence"))
    found = once.groupBy(doc).agg(
        F.count(F.lit(1)).alias("n_facts"),
        # both as whole numbers, so that the quotient is the double nearest to the mean
        (F.sum(F.floor(F.col("confidence").cast("decimal(20,10)") * 10**10)).cast("double") / (F.count("confidence") * F.lit(1e10))).alias("mean_confidence"),
    )
    scalars = companies.groupBy(doc).agg(F.count_distinct("field").alias("n_scalars"))
    df = lookup(lookup(documents, found, [doc], "left"), scalars, [doc], "left").na.fill(0, ["n_facts", "n_scalars"])

    def unit(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))

    c = F.greatest(unit(F.coalesce("model_confidence", F.lit(0.0))), F.coalesce("mean_confidence", F.lit(0.0)))
    t = unit(F.col("text_quality"))
    t = F.when(F.col("has_text") & (F.col("n_errors") == 0), F.greatest(t, F.lit(0.85))).otherwise(t)
    if "ocr_confidence" in documents.columns:
        scanned = F.coalesce("ocr_required", F.lit(False)) & F.col("ocr_confidence").isNotNull()
        t = F.when(scanned, F.greatest(t, unit(F.col("ocr_confidence")))).otherwise(t)
    density = unit((F.col("n_facts") + F.col("n_scalars")) / 18)
    coverage = unit(F.col("n_facts") / 4)
    score = F.greatest(0.52 * c + 0.28 * t + 0.20 * density, 0.82 * c + 0.13 * t + 0.05 * coverage)
    score = score - F.least(F.lit(0.5), F.col("n_errors") * 0.14) - F.least(F.lit(0.25), F.col("n_warnings") * 0.035)
    return df.withColumn("confidence", round_exact(unit(score) * 100, 2)).drop("mean_confidence")


def company_name_of(documents: DataFrame, text: str = "text", title: str | None = None) -> DataFrame:
    """Adds company_name: from the title, else the first legal name in the first 180 lines."""
    lines = F.slice(F.filter(F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1), strip), lambda s: s != ""), 1, 180)

    def name(line: Column) -> Column:
        value = strip(F.regexp_extract(line, r"(?iuU)^\s*(?:company name|company)\s*(?:[:=\-?]|\s{2,}|\t)\s*(.+?)\s*$", 1))
        return legal_name(F.when(value != "", value).otherwise(line))

    likely = F.filter(lines, lambda s: s.rlike(f"(?iuU){vocab.LEGAL_SUFFIX_PATTERN}"))
    first = F.get(F.filter(F.transform(likely, name), lambda n: n.isNotNull()), F.lit(0))
    return documents.withColumn("company_name", F.coalesce(legal_name(F.col(title)), first) if title else first)


def document_records(
    documents: DataFrame, signals: DataFrame, metrics: DataFrame, companies: DataFrame, doc: str = "doc_id", text: str = "text", title: str | None = None,
    same: list[str] | None = None,
) -> DataFrame:
    """One wide row per document: its company fields, a value per metric field, and its score.

    `metrics` and `companies` are the facts found, stored by the caller as they are read
    several times; `signals` is what `document_confidence` needs but the model's confidence,
    which is the mean over the facts. A legal name in the title comes before the facts; the
    text's own legal name and currency stand in where the facts have none. Documents
    without facts have a row of nulls and their score. `same` is that of `distinct_metrics`.
    """
    distinct, chosen = distinct_metrics(metrics, doc, same=same), best_metrics(metrics, doc)
    currency = detect_document_currency(distinct, chosen, doc, documents, text)
    named = company_name_of(documents, text).select(doc, F.col("company_name").alias("value"))

    def values(rows: DataFrame, rank: int, field: Column, value: str = "value") -> DataFrame:
        return rows.select(doc, field.alias("field"), F.col(value).alias("value"), F.lit(rank).alias("rank"))

    own = values(best_company_values(companies, doc), 1, F.col("field"))
    scalars = own.unionByName(values(currency, 2, F.lit("currency"), "currency")).unionByName(values(named, 2, F.lit("company_name")))
    if title:
        titled = documents.select(doc, legal_name(F.col(title)).alias("value"))
        scalars = scalars.unionByName(values(titled, 0, F.lit("company_name")))
    scalars = cut_lineage(scalars.filter("value IS NOT NULL AND value <> ''"))  # for the row and for the score
    fields = scalars.unionByName(values(chosen, 1, F.col("field")))
    wide = fields.groupBy(doc).pivot("field", [*vocab.COMPANY_FIELDS, *vocab.METRIC_FIELDS]).agg(F.min_by("value", "rank"))
    means = mean_confidence(metrics, companies, doc).withColumnRenamed("confidence_score", "model_confidence")
    score = document_confidence(lookup(signals, means, [doc], "left"), distinct, chosen, scalars, doc)
    rows = lookup(documents.select(doc), wide, [doc], "left")
    return lookup(rows, score.select(doc, "n_facts", "n_scalars", "confidence"), [doc], "left").withColumn(
        "confidence_score", round_exact(F.col("confidence") / 100, 4)
    )


def extract_documents(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> dict[str, DataFrame]:
    """The whole chain: text -> chunks -> line facts -> merged facts per document."""
    from ledgerlens.operators.chunking import chunk_paragraphs
    from ledgerlens.operators.dedup import normalise_documents

    chunks = chunk_paragraphs(normalise_documents(documents.select(doc, text), text), [doc], text)
    keys = [doc, "index"]
    # the texts are read once; the facts found are few and stored; a line that a chunk cuts is read where it is whole
    metrics, companies = split_facts(cut_lineage(facts_of_lines(text_lines(chunks, keys, "lines"), keys)), keys)
    metrics = dedup_facts(metrics, keys, ["metric", "value", "period", "page_number"])
    companies = dedup_facts(companies, keys, ["field", "value", "page_number"])
    place = F.struct("index", F.col("pos").alias("fact"))  # chunk order before line order
    metrics, companies = metrics.withColumn("pos", place), companies.withColumn("pos", place)
    distinct, chosen = distinct_metrics(metrics, doc), best_metrics(metrics, doc)
    return {
        "chunks": chunks, "metric_facts": metrics, "company_facts": companies, "metrics": distinct,
        "chosen": chosen, "company": best_company_values(companies, doc),
        "currency": detect_document_currency(distinct, chosen, doc, documents, text),
    }

"""Queries of text forms, duplicates, tables, files and page checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.functions import similarity as S
from ledgerlens.functions import text as X
from ledgerlens.operators import dedup as D
from ledgerlens.operators import requests as Q
from ledgerlens.operators.chunking import is_signal_line
from ledgerlens.operators.redflags import quoted
from ledgerlens.plans import inputs as I
from ledgerlens.plans.research_queries import WS, strip_sql
from ledgerlens.sources import files as Fi

KEY = ["l_orderkey", "l_linenumber"]


def _lines(spark, sf):
    return I.texts(spark, sf, "lineitem").withColumn("amt", F.format_number("l_extendedprice", 2)).withColumn(
        "kind", (F.col("l_partkey") + F.col("l_linenumber")) % 6
    )


def _pick(*choices):
    """The choice at place `kind`."""
    out = None
    for i, c in enumerate(choices):
        out = F.when(F.col("kind") == i, c) if out is None else out.when(F.col("kind") == i, c)
    return out


def _pick_sql(*choices: str) -> str:
    return "CASE kind " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices)) + " END"


def number_parse(spark, sf):
    amt = F.col("amt")
    text = _pick(
        F.concat(F.lit(" ("), amt, F.lit(") ")), F.concat(amt, F.lit(" crore")), F.concat(F.lit("Rs "), amt), F.lit(" N/A "),
        F.concat(F.lit("-"), amt, F.lit("x")), F.lit("--"),
    )
    return _lines(spark, sf).select(*KEY, X.parse_number(text).alias("number"))


def number_canonical(spark, sf):
    amt = F.col("amt")
    text = _pick(
        F.concat(F.lit("("), amt, F.lit(")")), amt, F.concat(F.lit("+"), amt), F.concat(F.lit("-"), amt), F.concat(amt, F.lit(" cr")), F.concat(F.lit("00"), amt)
    )
    return _lines(spark, sf).select(*KEY, X.canonical_number(text).alias("canonical"))


def currency_canonical(spark, sf):
    amt = F.col("amt")
    text = _pick(
        F.concat(F.lit("paid $"), amt, F.lit(" million today")), F.concat(F.lit("EUR"), amt), F.concat(F.lit("₹ ("), amt, F.lit(")crore due")),
        F.concat(F.lit("no currency "), amt), F.concat(F.lit("gbp "), amt, F.lit("by hand, £5")), F.concat(F.lit("¥"), amt, F.lit(" and usd 1,000")),
    )
    return _lines(spark, sf).select(*KEY, X.canonical_currencies(text).alias("canonical"))


def percent_canonical(spark, sf):
    pct = F.format_string("%.2f", F.col("l_discount") * 100)
    text = _pick(
        F.concat(F.lit("off by ("), pct, F.lit(") % now")), F.concat(pct, F.lit("%")), F.concat(F.lit("+"), pct, F.lit(" %")), F.concat(F.lit("x"), pct, F.lit("%")),
        F.concat(F.lit("-"), pct, F.lit("% and 7.50%")), F.lit("none"),
    )
    return _lines(spark, sf).select(*KEY, X.canonical_percents(text).alias("canonical"))


def thousands_canonical(spark, sf):
    """Groups of three only; "1,91,204" keeps its first comma, as its tail matches alone."""
    amt = F.col("amt")
    text = _pick(
        F.concat(F.lit("total "), amt, F.lit(" units")), F.concat(F.lit("("), amt, F.lit(")")), F.concat(F.lit("v"), amt), F.lit("1,91,204 paid"),
        F.concat(amt, F.lit(" "), amt), F.lit("12 and 1234"),
    )
    return _lines(spark, sf).select(*KEY, X.canonical_thousands(text).alias("canonical"))


def date_canonical(spark, sf):
    day = F.col("l_shipdate")
    text = _pick(
        F.concat(F.lit("on "), F.date_format(day, "MMMM d, yyyy"), F.lit(" sent")), F.date_format(day, "d MMM yyyy"), F.date_format(day, "M/d/yyyy"),
        F.date_format(day, "yyyy-M-d"), F.concat(F.lit("13/"), F.date_format(day, "M/yyyy"), F.lit(" day first")), F.lit("no date 99/99/2000"),
    )
    return _lines(spark, sf).select(*KEY, X.canonical_dates(text).alias("canonical"))


def line_canonical(spark, sf):
    """All steps on one line with a date, a currency, a percentage and wide spaces."""
    text = F.concat(
        F.lit("Sold   for $"), F.col("amt"), F.lit(" million\r\n\r\n\r\n\r\n on "), F.date_format("l_shipdate", "MMMM d, yyyy"), F.lit(" \t at  (5.0) % , total "), F.col("amt")
    )
    return _lines(spark, sf).select(*KEY, X.canonical_text(text).alias("canonical"))


def period_detect(spark, sf):
    day = F.col("l_shipdate")
    text = _pick(
        F.concat(F.lit("results FY"), F.year(day)), F.concat(F.lit("in Q"), F.quarter(day), F.lit(" "), F.year(day)),
        F.concat(F.lit("the year ended "), F.date_format(day, "MMMM d, yyyy")), F.concat(F.lit("sum "), F.year(day), F.lit(" total")),
        F.concat(F.lit("x"), F.year(day)), F.lit("no period"),
    )
    return _lines(spark, sf).select(*KEY, X.detect_period(text).alias("period"))


def unit_detect(spark, sf):
    amt = F.col("amt")
    text = _pick(
        F.concat(F.lit("USD "), amt, F.lit(" Million")), F.concat(amt, F.lit("%")), F.concat(amt, F.lit(" shares")), F.concat(F.lit("$"), amt, F.lit(" cr, 5% of share")),
        amt, F.concat(F.lit("inr "), amt, F.lit(" lakhs")),
    )
    return _lines(spark, sf).select(*KEY, X.detect_unit(text).alias("unit"), X.detect_currency(text).alias("currency"))


def evidence_quoting(spark, sf):
    """Texts in quotes, numbers as they came."""
    text = _pick(F.col("amt"), F.concat(F.lit("it's "), F.col("amt")), F.lit('say "x"'), F.lit("both ' and \""), F.col("amt"), F.lit("plain"))
    return _lines(spark, sf).select(*KEY, quoted(text, F.col("kind") == 4).alias("quoted"))


def legal_company_name(spark, sf):
    c = I.table(spark, sf, "customer").withColumn("kind", F.col("c_custkey") % 6)
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    text = _pick(
        F.concat(name, F.lit(" Limited")), F.concat(F.lit("microsoft word - "), seg, F.lit("_HOLDINGS PLC")), F.concat(F.lit("Annual Report - "), name, F.lit(" Inc - Final")),
        F.concat(F.lower(seg), F.lit(" Corporation")), F.concat(F.lit("Board of "), name, F.lit(" LLC")), name,
    )
    return c.select("c_custkey", X.legal_name(text).alias("company_name"))


def page_clean(spark, sf):
    raw = F.concat(F.lit(" \x0c"), F.replace(F.replace("text", F.lit("\n"), F.lit("\n\n\n")), F.lit(" "), F.lit(" \t ")), F.lit("\n "))
    return I.texts(spark, sf, "documents").select("doc_id", F.md5(X.clean_page(raw)).alias("clean_hash"))


def text_keys(spark, sf):
    t = F.col("text")
    return I.texts(spark, sf, "documents").select(
        "doc_id", F.md5(X.word_key(t)).alias("word_key"), F.md5(X.metric_key(t)).alias("metric_key"), F.md5(X.squash(t)).alias("squashed"),
        X.approx_tokens(t).alias("tokens"),
    )


def metadata_date(spark, sf):
    day = F.col("o_orderdate")
    o = I.table(spark, sf, "orders").withColumn("kind", F.col("o_orderkey") % 4)
    text = _pick(F.date_format(day, "'D:'yyyyMMdd'093000Z'"), F.concat(F.lit("created "), F.date_format(day, "d MMMM yyyy")), F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("unknown"))
    return o.select("o_orderkey", X.metadata_date(text).alias("iso_date"))


# --- duplicates and tables ------------------------------------------------------------


def line_dedup_exact(spark, sf):
    return I.texts(spark, sf, "documents").select("doc_id", D.distinct_lines_exact(F.col("text")).alias("text"))


def line_dedup_long(spark, sf):
    """The same on one row per line."""
    lines = I.texts(spark, sf, "documents").select("doc_id", F.posexplode(X.split_lines(F.col("text"))).alias("pos", "line"))
    return D.dedup_lines_long(lines, ["doc_id"]).select("doc_id", "pos", "line")


def fuzzy_line_dedup(spark, sf):
    docs = D.distinct_lines(I.texts(spark, sf, "documents"), "text", "kept")
    return docs.select("doc_id", F.size(X.split_lines(F.col("kept"))).alias("n_lines"), F.md5("kept").alias("text_hash"))


def scan_line_merge(spark, sf):
    """Native text, a scan of it with one letter misread, and no tables, merged per document."""
    docs = I.texts(spark, sf, "documents").select(
        "doc_id", "text", F.replace("text", F.lit("th"), F.lit("tb")).alias("scan"),
        F.array().cast("array<struct<page:int,sheet:string,location:string,rows:array<array<string>>>>").alias("tables"),
    )
    out = D.merge_sources(docs, "text", "scan", "tables")
    return out.select("doc_id", F.length("merged_text").alias("n_chars"), F.md5("merged_text").alias("text_hash"))


def normalised_documents(spark, sf):
    out = D.normalise_documents(I.texts(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_hash"))


def _order_tables(spark, sf):
    """One table per order: its lines as rows of cells (an order has a handful of lines)."""
    cells = F.array("l_returnflag", "l_linestatus", F.when(F.col("l_linenumber") % 2 == 0, F.format_number("l_quantity", 1)).otherwise(""))
    cells = F.when(F.col("l_linenumber") % 5 == 0, F.array(F.lit(""), F.lit(""), F.lit(""))).otherwise(cells)
    rows = I.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", cells.alias("c")))).alias("r"))
    return rows.select("l_orderkey", F.transform("r", lambda r: r["c"]).alias("rows"))


def rendered_tables(spark, sf):
    t = F.array(F.struct(F.lit(3).alias("page"), F.lit(None).cast("string").alias("sheet"), F.lit("body").alias("location"), F.col("rows").alias("rows")))
    return _order_tables(spark, sf).select("l_orderkey", D.render_tables(t).alias("text"))


def distinct_tables(spark, sf):
    """Orders of one customer as the tables of one document; equal tables once."""
    orders = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("doc_id"))
    tables = _order_tables(spark, sf).join(orders, "l_orderkey").withColumnRenamed("l_orderkey", "pos")
    return D.distinct_tables(tables).select("doc_id", "pos", F.size("rows").alias("n_rows"))


def cell_normal_form(spark, sf):
    rows = F.array(F.array(F.concat(F.lit(" "), F.col("p_name"), F.lit("\r\n "), F.col("p_type")), F.lit(None).cast("string")), F.array(F.col("p_brand"), F.lit(" \t")))
    cells = F.flatten(Fi.normalise_cells(rows))
    return I.table(spark, sf, "part").select("p_partkey", F.array_join(cells, "|").alias("cells"), Fi.table_warning(F.slice(rows, 1, (F.col("p_size") % 3).cast("int"))).alias("warning"))


def signal_lines(spark, sf):
    """Lines of all documents that look like figures, per document."""
    lines = I.texts(spark, sf, "documents").select("doc_id", F.explode(F.transform(X.split_lines(F.col("text")), X.strip)).alias("line"))
    return lines.filter(is_signal_line(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


# --- files and pages --------------------------------------------------------------------


def file_manifest(spark, sf):
    """Web pages as uploads with and without suffix, judged by name, first bytes and mime type."""
    p = I.texts(spark, sf, "pages").withColumn("kind", F.col("page_id") % 6)
    name = F.concat(F.lit("f"), F.col("page_id"), _pick(F.lit(".JPEG"), F.lit(""), F.lit(".bin"), F.lit(".html"), F.lit(".dat"), F.lit("")))
    mime = _pick(F.lit(None).cast("string"), F.lit("image/png"), F.lit("application/vnd.ms-excel"), F.lit("x"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    head = F.when(F.col("kind") == 5, F.lit("255044462D31")).when((F.col("kind") == 4) & (F.col("page_id") % 4 == 0), F.lit("0001FF00")).otherwise(F.hex(F.substring(F.encode("html", "UTF-8"), 1, 4096)))
    size = F.when(F.col("page_id") % 17 == 0, 0).when(F.col("page_id") % 19 == 0, vocab.MAX_FILE_BYTES + 1).otherwise(F.length("html"))
    out = Fi.manifest_rows(p.select("page_id", name.alias("name"), size.alias("size"), head.alias("head_hex"), mime.alias("mime")))
    return out.select("page_id", F.col("kind").alias("file_kind"), F.array_join("errors", "; ").alias("errors"))


def delimiter_detect(spark, sf):
    return I.texts(spark, sf, "pages").select("page_id", Fi.detect_delimiter(F.col("html")).alias("delimiter"))


def _site_pages(spark, sf):
    html = F.col("html")
    images = F.size(F.regexp_extract_all(html, F.lit("<li"), F.lit(0)))
    return I.texts(spark, sf, "pages").select(
        F.regexp_extract("url", "//([^/]+)/", 1).alias("doc_id"), F.col("page_id").alias("page_number"), (F.length(html) % 400).alias("n_chars"), images.alias("n_images")
    )


def ocr_pages(spark, sf):
    return Q.pages_needing_ocr(_site_pages(spark, sf))


def ocr_documents(spark, sf):
    out = Q.documents_needing_ocr(_site_pages(spark, sf))
    return out.withColumn("ocr_pages", F.array_join("ocr_pages", ","))


def page_quality(spark, sf):
    return Q.text_quality(_site_pages(spark, sf))


def processing_summary(spark, sf):
    pages = _site_pages(spark, sf).withColumn("source", F.when(F.col("n_chars") < 30, "empty").when(F.col("n_chars") < 120, "ocr").otherwise("text_layer"))
    chunks = pages.filter("source <> 'empty' AND n_chars % 5 <> 0").select("doc_id")
    out = Q.processing_summary(pages, chunks)
    return out.withColumn("warnings", F.array_join("warnings", " | "))


# --- statuses of events -------------------------------------------------------------------

ERROR_TEXTS = {
    "view": "Unsupported file type: .exe", "click": "Memory error during OCR processing", "signup": "Request timed out after Connection reset",
    "error": "Financial extraction chunk 3: Groq LLM unavailable or skipped", "purchase": "Native text extraction failed",
}


def _events(spark, sf):
    e = I.table(spark, sf, "events")
    text = F.element_at(F.create_map(*[F.lit(x) for pair in ERROR_TEXTS.items() for x in pair]), F.col("event_type"))
    errors = F.when(F.col("value") < 3, F.array().cast("array<string>")).otherwise(F.array(text, F.concat(F.lit("value "), F.col("value").cast("string"))))
    return e.withColumn("errors", F.when(F.col("value") > 10, F.slice(errors, 1, 1)).otherwise(errors))


def status_code(spark, sf):
    public = Q.public_messages(F.col("errors"), vocab.INTERNAL_ERROR_MARKERS)
    df = _events(spark, sf).withColumn("public", public)
    return df.select("event_id", F.size("public").alias("n_public"), Q.status_code(F.col("errors")).alias("status_code"), Q.public_status(F.col("errors"), F.col("public")).alias("public_status"))


def batch_rollup(spark, sf):
    df = _events(spark, sf).withColumn("status_code", Q.status_code(F.col("errors"))).withColumn("success", F.col("status_code") < 400)
    return Q.batch_status(df, ["user_id"])


# --- checks -----------------------------------------------------------------------------------


def request_check(spark, sf):
    """Customers as requests; accounts in debt sent no metrics, some names are blank or long."""
    c = I.table(spark, sf, "customer")
    company = F.when(F.col("c_custkey") % 11 == 0, " \t ").when(F.col("c_custkey") % 13 == 0, F.repeat("c_name", 20)).otherwise(F.concat(F.lit(" "), F.col("c_name"), F.lit("\n")))
    year = F.when(F.col("c_custkey") % 7 == 0, "").otherwise("2025 ")
    out = Q.check_requests(c.select("c_custkey", company.alias("company"), year.alias("financial_year"), F.when(F.col("c_acctbal") < 0, 0).otherwise(3).alias("n_metrics")))
    return out.select("c_custkey", F.length("company").alias("n_company"), "financial_year", "reason")


def section_check(spark, sf):
    turns = I.table(spark, sf, "conversations")
    section = F.when(F.col("turn") == 0, " ").when(F.col("turn") == 1, F.repeat("role", 30)).otherwise(F.col("role"))
    out = Q.check_sections(turns.select("conv_id", "turn", section.alias("section"), F.concat(F.lit("\n"), F.col("text")).alias("content")))
    return out.select("conv_id", "turn", F.length("section").alias("n_section"), F.md5("content").alias("content"), "reason")


def fact_check(spark, sf):
    p = I.table(spark, sf, "part")
    conf = F.when(F.col("p_size") % 5 == 0, "abc").when(F.col("p_size") % 5 == 1, "NaN").when(F.col("p_size") % 5 == 2, "1.7").when(F.col("p_size") % 5 == 3, "-0.2").otherwise("0.5")
    page = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("00"), F.col("p_size"))).when(F.col("p_size") % 3 == 1, " iv ").otherwise(" ")
    facts = p.select(
        "p_partkey", F.when(F.col("p_size") % 9 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("p_name"))).alias("metric"), F.col("p_retailprice").cast("string").alias("value"),
        F.lit(" ").alias("unit"), F.col("p_type").alias("period"), page.alias("page_number"), conf.alias("confidence"),
    )
    out = Q.check_facts(facts, ["metric", "value"])
    return out.select("p_partkey", "metric", "unit", "period", "page_number", "confidence", "reason")


# --- oracle -------------------------------------------------------------------------

_LI = "WITH li AS (SELECT *, format('{:,.2f}', l_extendedprice) AS amt, CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS VARCHAR) AS dec, (l_partkey + l_linenumber) % 6 AS kind FROM lineitem), sh AS (SELECT *, regexp_replace(dec, '\\.?0+$', '') AS num FROM li) "
_PCT = "CAST(CAST(round(l_discount * 100, 2) AS DECIMAL(6,2)) AS VARCHAR)"
_SHORT_PCT = f"regexp_replace({_PCT}, '\\.?0+$', '')"
_ISO = "strftime(l_shipdate, '%Y-%m-%d')"
_YEAR20 = "year(l_shipdate) >= 2000"
_KEYS = "SELECT l_orderkey, l_linenumber, "
_BIG = "l_extendedprice >= 1000"


def _hash(expr: str) -> str:
    return f"md5({expr})"


_EV = "WITH ev AS (SELECT *, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ERROR_TEXTS.items()) + " END AS t FROM events) "
_CODE = "CASE WHEN value < 3 THEN 200 ELSE CASE event_type WHEN 'view' THEN 415 WHEN 'click' THEN 507 WHEN 'signup' THEN 504 WHEN 'error' THEN 502 ELSE 500 END END"
_SITE = """WITH sp AS (SELECT regexp_extract(url, '//([^/]+)/', 1) AS doc_id, page_id AS page_number, CAST(length(html) % 400 AS INTEGER) AS n_chars,
   CAST(len(regexp_extract_all(html, '<li')) AS INTEGER) AS n_images FROM pages)"""
_NEED = "(n_chars < 120 OR (n_images > 0 AND n_chars < 240))"
_TABLES = """WITH tb AS (SELECT l_orderkey, count(*) AS n_rows, string_agg(CASE WHEN l_linenumber % 5 <> 0 THEN l_returnflag || chr(9) || l_linestatus || chr(9) ||
     CASE WHEN l_linenumber % 2 = 0 THEN format('{:,.1f}', l_quantity) ELSE '' END END, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_quantity) AS t FROM lineitem GROUP BY 1)"""
_METRIC_WORDS = "(" + "|".join(dict.fromkeys(vocab.label_key(a) for n in vocab.METRIC_ALIASES.values() for a in n)) + ")"
_COMPANY_WORDS = "(" + "|".join(dict.fromkeys(vocab.label_key(a) for n in vocab.COMPANY_ALIASES.values() for a in n)) + ")"
_SUFFIX = f"(?i){vocab.LEGAL_SUFFIX_PATTERN}"

ORACLE = {
    "number_parse": _LI + _KEYS + _pick_sql("-l_extendedprice", "l_extendedprice", "l_extendedprice", "NULL", "-l_extendedprice", "NULL") + " AS number FROM sh",
    "number_canonical": _LI + _KEYS + _pick_sql("'-' || num", "num", "num", "'-' || num", "amt || ' cr'", "num") + " AS canonical FROM sh",
    "currency_canonical": _LI + _KEYS + _pick_sql(
        "'paid USD ' || num || ' million today'", "'EUR ' || num", "'INR -' || num || ' crore due'", "'no currency ' || amt", "'GBP ' || num || ' by hand, GBP 5'",
        "'JPY ' || num || ' and USD 1000'") + " AS canonical FROM sh",
    "percent_canonical": _LI + _KEYS + _pick_sql(
        f"'off by -' || {_SHORT_PCT} || '% now'", f"{_SHORT_PCT} || '%'", f"{_SHORT_PCT} || '%'", f"'x' || {_PCT} || '%'", f"'-' || {_SHORT_PCT} || '% and 7.5%'", "'none'") + " AS canonical FROM sh",
    "thousands_canonical": _LI + _KEYS + _pick_sql(
        f"CASE WHEN {_BIG} THEN 'total ' || num || ' units' ELSE 'total ' || amt || ' units' END", f"CASE WHEN {_BIG} THEN '-' || num ELSE '(' || amt || ')' END",
        "'v' || amt", "'1,91204 paid'", f"CASE WHEN {_BIG} THEN num || ' ' || num ELSE amt || ' ' || amt END", "'12 and 1234'") + " AS canonical FROM sh",
    "date_canonical": _LI + _KEYS + _pick_sql(
        f"'on ' || {_ISO} || ' sent'", _ISO, _ISO, _ISO, "strftime(l_shipdate, '%Y-%m-13') || ' day first'", "'no date 99/99/2000'") + " AS canonical FROM sh",
    "line_canonical": _LI + _KEYS + f"'Sold for USD ' || num || ' million' || chr(10) || chr(10) || 'on ' || {_ISO} || chr(9) || 'at -5% , total ' || CASE WHEN {_BIG} THEN num ELSE amt END AS canonical FROM sh",
    "period_detect": _LI + _KEYS + _pick_sql(
        f"CASE WHEN {_YEAR20} THEN 'FY' || year(l_shipdate) END", f"CASE WHEN {_YEAR20} THEN 'Q' || quarter(l_shipdate) || ' ' || year(l_shipdate) END",
        f"CASE WHEN {_YEAR20} THEN 'year ended ' || strftime(l_shipdate, '%B %-d, %Y') END", f"CASE WHEN {_YEAR20} THEN CAST(year(l_shipdate) AS VARCHAR) END", "NULL", "NULL") + " AS period FROM sh",
    "unit_detect": _LI + _KEYS + _pick_sql("'USD million'", "'percent'", "'shares'", "'USD cr percent shares'", "NULL", "'INR lakhs'") + " AS unit, "
    + _pick_sql("'USD'", "NULL", "NULL", "'USD'", "NULL", "'INR'") + " AS currency FROM sh",
    "evidence_quoting": _LI + _KEYS + _pick_sql("'''' || amt || ''''", "'\"it''s ' || amt || '\"'", "'''say \"x\"'''", "'''both \\'' and \"'''", "amt", "'''plain'''") + " AS quoted FROM sh",
    "legal_company_name": "WITH c AS (SELECT *, c_custkey % 6 AS kind, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS cap FROM customer) SELECT c_custkey, "
    + _pick_sql("c_name || ' Limited'", "cap || ' Holdings PLC'", "c_name || ' Inc'", "NULL", "NULL", "NULL") + " AS company_name FROM c",
    "page_clean": "SELECT doc_id, " + _hash(strip_sql(
        "regexp_replace(regexp_replace(' ' || chr(12) || replace(replace(text, chr(10), chr(10) || chr(10) || chr(10)), ' ', ' ' || chr(9) || ' '), '[ \\t\\f]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")) + " AS clean_hash FROM documents",
    "text_keys": f"SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS word_key, md5(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) AS metric_key, "
    f"md5(trim(regexp_replace(text, '{WS}+', ' ', 'g'))) AS squashed, CAST(ceil(length(text) / 4) AS INTEGER) AS tokens FROM documents",
    "metadata_date": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso_date FROM orders",
    "line_dedup_long": f"WITH ln AS (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c]')) AS raw, generate_subscripts(string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c]'), 1) - 1 AS pos FROM documents), "
    f"st AS (SELECT doc_id, pos, {strip_sql('raw')} AS line FROM ln WHERE {strip_sql('raw')} <> '') SELECT doc_id, CAST(pos AS INTEGER) AS pos, line FROM st "
    f"QUALIFY row_number() OVER (PARTITION BY doc_id, lower(regexp_replace(line, '{WS}+', ' ', 'g')) ORDER BY pos) = 1",
    "rendered_tables": _TABLES + " SELECT l_orderkey, 'Table 1 Page 3 Location body' || CASE WHEN t IS NULL THEN '' ELSE chr(10) || chr(10) || t END AS text FROM tb",
    "distinct_tables": _TABLES + " SELECT o_custkey AS doc_id, l_orderkey AS pos, CAST(n_rows AS INTEGER) AS n_rows FROM tb JOIN orders ON o_orderkey = l_orderkey "
    f"QUALIFY row_number() OVER (PARTITION BY o_custkey, lower(regexp_replace(left(coalesce(t, ''), 1000), '{WS}+', ' ', 'g')) ORDER BY l_orderkey) = 1",
    "cell_normal_form": "SELECT p_partkey, p_name || ' ' || p_type || '||' || p_brand || '|' AS cells, CASE WHEN p_size % 3 <= 1 THEN 'CSV extraction found no data rows' END AS warning FROM part",
    "signal_lines": f"""WITH ln AS (SELECT doc_id, unnest(list_transform(string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c]'), lambda l: {strip_sql('l')})) AS line FROM documents),
      k AS (SELECT *, trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')) AS k, regexp_matches(line, '(?i){"|".join(vocab.CURRENCY_CODES)}|[$?]|[0-9]') AS v FROM ln)
      SELECT doc_id, count(*) AS n_lines FROM k WHERE (contains(line, chr(9)) AND v) OR (v AND regexp_matches(k, '{_METRIC_WORDS}'))
        OR (regexp_matches(line, '[-:=?\\t]') AND regexp_matches(k, '{_COMPANY_WORDS}')) GROUP BY 1""",
    "file_manifest": """WITH p AS (SELECT page_id, page_id % 6 AS kind, CASE WHEN page_id % 17 = 0 THEN 0 WHEN page_id % 19 = 0 THEN 52428801 ELSE length(html) END AS size FROM pages),
      f AS (SELECT page_id, size, CASE kind WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.xls' WHEN 3 THEN '.html' WHEN 4 THEN CASE WHEN page_id % 4 = 0 THEN '.dat' ELSE '.txt' END ELSE '.pdf' END AS file_kind FROM p)
      SELECT page_id, file_kind, concat_ws('; ', CASE WHEN size = 0 THEN 'Empty file or text payload' END, CASE WHEN size > 52428800 THEN 'File exceeds maximum size of 50 MB' END,
        CASE WHEN file_kind = '.dat' THEN 'Unsupported file type: .dat' END) AS errors FROM f""",
    "delimiter_detect": """WITH n AS (SELECT page_id, [length(html) - length(replace(html, ',', '')), length(html) - length(replace(html, ';', '')), length(html) - length(replace(html, chr(9), '')), length(html) - length(replace(html, '|', ''))] AS n FROM pages)
      SELECT page_id, [',', ';', chr(9), '|'][list_position(n, list_max(n))] AS delimiter FROM n""",
    "ocr_pages": f"{_SITE} SELECT *, {_NEED} AS needs_ocr, n_chars < 30 AS needs_ocr_simple FROM sp",
    "ocr_documents": f"{_SITE} SELECT doc_id, bool_or({_NEED}) AS ocr_required, coalesce(string_agg(page_number, ',' ORDER BY page_number) FILTER ({_NEED}), '') AS ocr_pages FROM sp GROUP BY 1",
    "page_quality": f"{_SITE} SELECT doc_id, count(*) AS n_pages, CAST(sum(n_chars) AS BIGINT) AS total_chars, CAST(printf('%.4f', least(1.0, sum(n_chars) / (count(*) * 1200))) AS DOUBLE) AS native_quality FROM sp GROUP BY 1",
    "processing_summary": f"""{_SITE}, s AS (SELECT doc_id, count(*) AS page_count, count(*) FILTER (n_chars >= 30 AND n_chars < 120) AS ocr_page_count, count(*) FILTER (n_chars < 30) AS empty_page_count,
        count(*) FILTER (n_chars >= 30 AND n_chars % 5 <> 0) AS chunk_count FROM sp GROUP BY 1)
      SELECT *, CASE WHEN chunk_count = 0 THEN 'failed' ELSE 'indexed' END AS status, CASE WHEN chunk_count = 0 THEN 'No text chunks were produced from this document.' END AS error,
        concat_ws(' | ', CASE WHEN empty_page_count > 0 THEN empty_page_count || ' page(s) produced no text even after OCR (likely blank pages or unreadable images).' END,
          CASE WHEN ocr_page_count > 0 THEN ocr_page_count || ' page(s) had no text layer and were processed with OCR instead — double-check those pages for extraction accuracy, especially numbers in tables.' END) AS warnings FROM s""",
    "status_code": _EV + f"""SELECT event_id, CAST(CASE WHEN value < 3 THEN 0 ELSE CASE WHEN event_type = 'error' THEN 0 ELSE 1 END + CASE WHEN value > 10 THEN 0 ELSE 1 END END AS INTEGER) AS n_public, {_CODE} AS status_code,
      CASE WHEN value >= 3 AND event_type = 'error' AND value > 10 THEN 200 ELSE {_CODE} END AS public_status FROM ev""",
    "batch_rollup": _EV + f"SELECT user_id, bool_and({_CODE} < 400) AS success, count(*) AS count, coalesce(max({_CODE}) FILTER ({_CODE} >= 400), 200) AS status_code FROM ev GROUP BY 1",
    "request_check": """WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN repeat(c_name, 20) ELSE c_name END AS company,
        CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '2025' END AS financial_year, c_acctbal FROM customer)
      SELECT c_custkey, CAST(length(company) AS INTEGER) AS n_company, financial_year, CASE WHEN company = '' THEN 'company must not be empty' WHEN length(company) > 240 THEN 'company is longer than 240 characters'
        WHEN financial_year = '' THEN 'financial_year must not be empty' WHEN c_acctbal < 0 THEN 'metrics must not be empty' END AS reason FROM r""",
    "section_check": f"""WITH s AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN '' WHEN turn = 1 THEN repeat(role, 30) ELSE role END AS section, {strip_sql('text')} AS content FROM conversations)
      SELECT conv_id, turn, CAST(length(section) AS INTEGER) AS n_section, md5(content) AS content, CASE WHEN section = '' OR content = '' THEN 'section fields must not be empty' WHEN length(section) > 160 THEN 'section is longer than 160 characters' END AS reason FROM s""",
    "fact_check": """SELECT p_partkey, CASE WHEN p_size % 9 <> 0 THEN p_name END AS metric, NULL AS unit, p_type AS period, CASE p_size % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN 'iv' END AS page_number,
      CASE p_size % 5 WHEN 2 THEN 1.0 WHEN 4 THEN 0.5 ELSE 0.0 END AS confidence, CASE WHEN p_size % 9 = 0 THEN 'required text field is empty: metric' END AS reason FROM part""",
}
ORACLE["line_dedup_exact"] = ORACLE["line_dedup_long"].replace(" SELECT doc_id, CAST(pos AS INTEGER) AS pos, line FROM st ", ", dd AS (SELECT doc_id, pos, line FROM st ") + (
    ") SELECT documents.doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos), '') AS text FROM documents LEFT JOIN dd USING (doc_id) GROUP BY 1"
)

ROWS_ONLY = ["fuzzy_line_dedup", "scan_line_merge", "normalised_documents"]
QUERIES = {name: globals()[name] for name in [*ORACLE, *ROWS_ONLY]}

"""Queries of line facts, their merge per document, and metrics read from report text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.functions.text import fixed
from ledgerlens.operators import benchmark as B
from ledgerlens.operators import facts as Fa
from ledgerlens.operators import report_comparison as Rc
from ledgerlens.plans import inputs as I
from ledgerlens.session import by_key, cut_lineage
from ledgerlens.sources import files as Fi

DOC = ["doc_id"]
CODES = ["USD", "EUR", "GBP"]
SAME = ["value"]  # the SQL keeps the net incomes of two years apart, however alike their digits are


def statements(spark, sf):
    """A short statement of every company and year, line by line, from its figures.

    Placed by document, so that the merges below find their groups together.
    """
    fig = I.company_figures(spark, sf)
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), (F.col("fiscal_year") % 3 + 1).cast("int"))
    revenue = F.concat(F.lit("Revenue: "), I.amount(F.col("revenue")), F.lit(" cr FY"), F.col("fiscal_year"))
    lines = [
        F.lit("Page 1"),
        F.concat("company_name", F.lit(" Limited")),
        revenue,
        F.concat(F.lit("Net income\t"), I.amount(F.col("net_profit")), F.lit("\t"), F.coalesce(I.amount(F.col("prior_net_profit")), F.lit("-"))),
        F.concat(F.lit("The total assets was "), code, F.lit(" "), I.amount(F.col("assets")), F.lit(" million.")),
        F.lit("  OCR   page 02"),
        F.concat(F.lit("Ticker: S"), F.col("pos")),
        F.concat(F.lit("EBITDA ("), I.amount(F.col("ebitda")), F.lit(")")),
        F.concat(F.lit("current ratio of "), F.format_string("%.4f", "current_ratio"), F.lit("x for now")),
        F.lit("Industry\tServices\tother"),
        revenue,
        F.lit("see note 7 on debt"),
    ]
    doc_id = F.col("pos") * 10000 + F.col("fiscal_year")
    return by_key(fig.select(doc_id.alias("doc_id"), F.concat_ws("\n", *lines).alias("text")), "doc_id")


def _facts(spark, sf):
    """Metric and company facts of all statements, found in one pass and stored."""
    facts = cut_lineage(Fa.facts_of_lines(Fa.text_lines(statements(spark, sf), DOC), DOC))
    return Fa.split_facts(facts, DOC)


def _once(metrics):
    return Fa.dedup_facts(metrics, DOC, ["metric", "value", "period", "page_number"])


def _metrics(spark, sf):
    return _once(_facts(spark, sf)[0])


def line_facts(spark, sf):
    metrics, _ = _facts(spark, sf)
    return metrics.drop("pos")


def company_facts(spark, sf):
    _, companies = _facts(spark, sf)
    return companies.drop("pos")


def fact_dedup(spark, sf):
    """Facts once per metric, value and period, whatever the page."""
    metrics, _ = _facts(spark, sf)
    return Fa.dedup_facts(metrics, DOC, ["metric", "value", "period"]).select("doc_id", "metric", "value", "period", "page_number")


def fact_best(spark, sf):
    return Fa.best_metrics(_metrics(spark, sf)).select("doc_id", "field", "metric", "value", "unit", "period", "page_number")


def fact_pivot(spark, sf):
    """Every metric field as a column, whether or not a document states it."""
    return Fa.wide_facts(Fa.best_metrics(_metrics(spark, sf)))


def fact_fuzzy_dedup(spark, sf):
    """Facts without look-alikes of earlier ones that state the same value, in canonical order."""
    return Fa.distinct_metrics(_metrics(spark, sf), same=SAME).select("doc_id", "place", "metric", "value", "unit", "period", "page_number")


def company_values(spark, sf):
    """Company facts as sent by three readers, one of whom misreads a letter; the majority wins."""
    _, companies = _facts(spark, sf)
    readers = F.array(
        F.struct(F.lit(0).alias("r"), F.col("value").alias("v"), F.lit(0.82).alias("c")),
        F.struct(F.lit(1).alias("r"), F.concat(F.lit("Unknown "), F.reverse("value")).alias("v"), F.lit(0.99).alias("c")),
        F.struct(F.lit(2).alias("r"), F.concat("value", F.lit(" ")).alias("v"), F.lit(0.5).alias("c")),
    )
    rows = companies.select("doc_id", "field", "pos", F.explode(readers).alias("x")).select(
        "doc_id", "field", F.struct("pos", F.col("x.r").alias("reader")).alias("pos"), F.col("x.v").alias("value"), F.col("x.c").alias("confidence")
    )
    return Fa.best_company_values(rows)


def document_currency(spark, sf):
    metrics = _metrics(spark, sf)
    return Fa.detect_document_currency(Fa.distinct_metrics(metrics), Fa.best_metrics(metrics), documents=statements(spark, sf))


def _doc_signals(spark, sf):
    return statements(spark, sf).select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, 0.95).alias("model_confidence"), F.least(F.lit(1.0), F.length("text") / 8000).alias("text_quality"),
        F.lit(True).alias("has_text"), (F.col("doc_id") % 2).alias("n_errors"), (F.col("doc_id") % 5).alias("n_warnings"),
    )


def doc_confidence(spark, sf):
    metrics, companies = _facts(spark, sf)
    metrics = _once(metrics)
    out = Fa.document_confidence(_doc_signals(spark, sf), Fa.distinct_metrics(metrics, same=SAME), Fa.best_metrics(metrics), companies)
    return out.select("doc_id", "n_facts", "n_scalars", "confidence")


def extraction_records(spark, sf):
    """The whole record of every statement; a third are scans, and some warnings cost nothing."""
    metrics, companies = _facts(spark, sf)
    warnings = F.transform(
        F.sequence(F.lit(0), (F.col("doc_id") % 5).cast("int")),
        lambda i: F.when(i == 0, "Page 1: Deterministic explicit-fact fallback used").otherwise("low contrast"),
    )
    signals = _doc_signals(spark, sf).drop("model_confidence", "n_warnings").select(
        "*", warnings.alias("warnings"), (F.col("doc_id") % 3 == 0).alias("ocr_required"), F.lit(0.91).alias("ocr_confidence")
    )
    return Fa.document_records(statements(spark, sf), signals, _once(metrics), companies, same=SAME)


def mean_confidence(spark, sf):
    metrics, companies = _facts(spark, sf)
    return Fa.mean_confidence(metrics, companies)


def document_company(spark, sf):
    return Fa.company_name_of(statements(spark, sf)).select("doc_id", "company_name")


LABELS = ["Net Sales", "EPS", "total-assets", "Profit after tax", "free cash flow", "Debt to Equity", "Order backlog", "ebit margin", "Non-Current Debt", ""]


def concept_lookup(spark, sf):
    part = I.table(spark, sf, "part")
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("p_size") % len(LABELS) + 1).cast("int"))
    return Fa.canonical_labels(part.select("p_partkey", label.alias("metric"))).select("p_partkey", "field", "display")


def extracted_documents(spark, sf):
    """The whole chain from statement text to merged facts."""
    out = Fa.extract_documents(statements(spark, sf))
    return out["metrics"].select("doc_id", "place", "metric", "value", "unit", "period", "page_number", "confidence")


def all_documents_facts(spark, sf):
    """The chain over every document of the corpus, whole texts, each with one figure at its end."""
    line = F.concat(F.lit("\nRevenue: "), F.col("n_chars").cast("string"), F.lit(" cr FY2001"))
    docs = I.texts(spark, sf, "documents").select("doc_id", F.concat("text", line).alias("text"))
    return Fa.extract_documents(docs)["metrics"].select("doc_id", "place", "metric", "value", "unit", "period", "confidence")


# --- metrics from report text ------------------------------------------------------------


def report_texts(spark, sf):
    """Annual report passages of every company and year."""
    fig = I.benchmark_metrics(I.company_figures(spark, sf))

    def pct(c):
        return fixed(F.abs(c), 2)

    text = F.concat_ws(
        "\n",
        F.when(F.col("fiscal_year") % 2 == 0, F.concat(F.upper(F.regexp_replace("company_name", "[^A-Za-z0-9]", " ")), F.lit(" LIMITED"))).otherwise("a filing"),
        F.when(F.col("fiscal_year") >= 2000, F.concat(F.lit("Report for FY"), "fiscal_year")).otherwise("year ended March 31, 2009"),
        F.when(F.col("pos") % 4 == 0, "no sales this year").otherwise(F.concat(F.lit("Revenue from Operations were Rs "), I.amount(F.col("revenue_cr")))),
        F.concat(F.lit("The operating margin reached "), pct("ebit_margin_pct"), F.lit("%")),
        F.concat(F.lit("PAT margin "), pct("pat_margin_pct"), F.lit("% and ROE "), pct("roe_pct"), F.lit("%")),
        F.concat(F.lit("DSO of "), pct("dso_days"), F.lit(" days")),
        F.concat(F.lit("voluntary attrition fell to "), pct("attrition_rate_pct"), F.lit("%")),
    )
    name = F.concat(F.lit("annual_report_"), F.col("pos"), F.lit(".pdf"))
    return by_key(fig.select((F.col("pos") * 10000 + F.col("fiscal_year")).alias("doc_id"), text.alias("text"), name.alias("file_name")), "doc_id")


def report_metrics(spark, sf):
    return Fi.extract_report_metrics(report_texts(spark, sf)).drop("text", "file_name", "source_page")


def _curated(spark, sf):
    """Curated metrics of suppliers whose account is positive, under a longer name."""
    s = I.table(spark, sf, "supplier").filter("s_acctbal > 5000")
    name = F.concat(F.initcap(F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]", " "))), F.lit(" Limited Holdings"))
    file = F.concat(F.lit("annual_report_"), F.col("s_suppkey"), F.lit(".pdf"))
    return s.select(
        F.col("s_suppkey").alias("pos"), name.alias("company_name"), F.lit("FY1990").alias("fiscal_year"),
        F.when(F.col("s_suppkey") % 2 == 0, file).otherwise("none").alias("source_document"), F.lit("curated").alias("source_page"), F.col("s_acctbal").alias("revenue_cr"),
    )


def curated_override(spark, sf):
    reports = Fi.extract_report_metrics(report_texts(spark, sf)).drop("text", "file_name")
    out = Fi.curated_override(reports, _curated(spark, sf), "doc_id")
    return out.select("doc_id", "company_name", "fiscal_year", "source_document", "source_page", "revenue_cr", "is_curated")


def document_comparison(spark, sf):
    """Reports to comparison: extracted metrics of each year benchmarked against the first company."""
    rows = cut_lineage(Fi.extract_report_metrics(report_texts(spark, sf)).withColumnRenamed("doc_id", "pos"))
    return B.benchmark(rows, None, ["fiscal_year"])


def _figures(spark, sf):
    """Metrics of every report, curated ones in place."""
    return Rc.document_metrics(report_texts(spark, sf), _curated(spark, sf))


def curated_comparison(spark, sf):
    """The reports of each year compared, curated metrics in place, around a named company."""
    figures = _figures(spark, sf)
    year = F.pmod("doc_id", F.lit(10000)).cast("int")
    members = figures.select(year.alias("report_year"), "doc_id", F.col("doc_id").alias("pos"))
    return Rc.compare_documents(members, figures, ["report_year"], FOCUS)


def pairwise_comparison(spark, sf):
    """Every report against that of the same company a year before; every third pair asks for a focus."""
    figures = _figures(spark, sf)
    docs = figures.select("doc_id")
    later = docs.select((F.col("doc_id") + 1).alias("second"), F.col("doc_id").alias("first"))
    named = figures.select(F.col("doc_id").alias("second"), F.when(F.col("doc_id") % 3 == 0, F.col("company_name")).alias("focus"))
    pairs = later.join(named, "second").withColumn("pair_id", F.col("first"))
    return Rc.compare_pairs(pairs, figures)


FOCUS = "Supplier 000000007 Limited Holdings"

# --- oracle -------------------------------------------------------------------------

_CODE = "['USD', 'EUR', 'GBP'][fiscal_year % 3 + 1]"
_STATE = f"""WITH {I.COMPANY_SQL},
st AS (SELECT *, pos * 10000 + fiscal_year AS doc_id, {I.amount_sql('revenue')} AS a_rev, {I.amount_sql('net_profit')} AS a_np, {I.amount_sql('prior_net_profit')} AS a_pnp,
         {I.amount_sql('assets')} AS a_as, {I.amount_sql('ebitda')} AS a_eb, printf('%.4f', current_ratio) AS a_cr, {_CODE} AS code,
         CASE WHEN fiscal_year >= 2000 THEN 'FY' || fiscal_year END AS period FROM fig),
mf AS (
  SELECT doc_id, 3 AS o, 'revenue' AS field, 'Revenue' AS metric, a_rev || ' cr FY' || fiscal_year AS value, 'cr' AS unit, period, '1' AS page_number FROM st
  UNION ALL SELECT doc_id, 4, 'net_income', 'Net Income', a_np, NULL, NULL, '1' FROM st
  UNION ALL SELECT doc_id, 5, 'net_income', 'Net Income', a_pnp, NULL, NULL, '1' FROM st WHERE a_pnp IS NOT NULL
  UNION ALL SELECT doc_id, 6, 'assets', 'Total Assets', code || ' ' || a_as || ' million', code || ' million', NULL, '1' FROM st
  UNION ALL SELECT doc_id, 7, 'ebitda', 'EBITDA', '(' || a_eb || ')', NULL, NULL, '2' FROM st
  UNION ALL SELECT doc_id, 8, 'current_ratio', 'Current Ratio', a_cr || 'x', NULL, NULL, '2' FROM st WHERE a_cr IS NOT NULL
  UNION ALL SELECT doc_id, 9, 'revenue', 'Revenue', a_rev || ' cr FY' || fiscal_year, 'cr', period, '2' FROM st),
cf AS (
  SELECT doc_id, 'company_name' AS field, company_name || ' Limited' AS value, '1' AS page_number FROM st
  UNION ALL SELECT doc_id, 'ticker', 'S' || pos, '2' FROM st
  UNION ALL SELECT doc_id, 'industry', 'Services', '2' FROM st),
bf AS (SELECT * FROM mf QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY
         CASE WHEN unit IS NULL THEN 0 ELSE 1 END + CASE WHEN period IS NULL THEN 0 ELSE 1 END DESC, length(value) DESC, o) = 1)"""
_DISPLAY = {"Net Sales": ("revenue", "Revenue"), "EPS": ("eps", "EPS"), "total-assets": ("assets", "Total Assets"), "Profit after tax": ("net_profit", "Net Profit"),
            "free cash flow": ("free_cash_flow", "Free Cash Flow"), "Debt to Equity": ("debt_to_equity", "Debt to Equity"), "Order backlog": (None, "Order Backlog"),
            "ebit margin": (None, "EBIT Margin"), "Non-Current Debt": ("long_term_debt", "Long-term Debt"), "": (None, "Metric")}


_TEXT_LENGTH = """(SELECT doc_id, length(concat_ws(chr(10), 'Page 1', company_name || ' Limited', 'Revenue: ' || a_rev || ' cr FY' || fiscal_year, 'Net income' || chr(9) || a_np || chr(9) || coalesce(a_pnp, '-'),
              'The total assets was ' || code || ' ' || a_as || ' million.', '  OCR   page 02', 'Ticker: S' || pos, 'EBITDA (' || a_eb || ')', 'current ratio of ' || a_cr || 'x for now', 'Industry' || chr(9) || 'Services' || chr(9) || 'other',
              'Revenue: ' || a_rev || ' cr FY' || fiscal_year, 'see note 7 on debt')) AS tl FROM st)"""
_COMPANY_OF = {"company_name": "company_name || ' Limited'", "ticker": "'S' || pos", "industry": "'Services'", "currency": "code"}


def _records_sql() -> str:
    fields = ", ".join(f"max(value) FILTER (field = '{f}') AS {f}" for f in vocab.METRIC_FIELDS)
    company = ", ".join(f"{_COMPANY_OF.get(f, 'NULL::VARCHAR')} AS {f}" for f in vocab.COMPANY_FIELDS)
    return _STATE + f""", w AS (SELECT doc_id, {fields} FROM bf GROUP BY 1), co AS (SELECT doc_id, {company} FROM st),
      n AS (SELECT doc_id, count(*) AS n, count(DISTINCT concat_ws('|', metric, value, coalesce(unit, ''), coalesce(period, ''))) AS n_facts FROM mf GROUP BY 1),
      c AS (SELECT doc_id, n_facts, 4 AS n_scalars, greatest(CAST(printf('%.4f', (n * 0.88 + 3 * 0.82) / (n + 3)) AS DOUBLE), 0.88::DOUBLE) AS c,
              greatest(CASE WHEN doc_id % 2 = 0 THEN greatest(0.85::DOUBLE, tl / 8000) ELSE tl / 8000 END, CASE WHEN doc_id % 3 = 0 THEN 0.91::DOUBLE ELSE 0 END) AS t
            FROM n JOIN {_TEXT_LENGTH} USING (doc_id)),
      s AS (SELECT *, greatest(0.52::DOUBLE * c + 0.28::DOUBLE * t + 0.20::DOUBLE * least(1.0::DOUBLE, (n_facts + n_scalars) / 18), 0.82::DOUBLE * c + 0.13::DOUBLE * t + 0.05::DOUBLE * least(1.0::DOUBLE, n_facts / 4))
          - least(0.5::DOUBLE, doc_id % 2 * 0.14::DOUBLE) - least(0.25::DOUBLE, doc_id % 5 * 0.035::DOUBLE) AS s FROM c),
      f AS (SELECT doc_id, n_facts, n_scalars, CAST(printf('%.2f', greatest(0, least(1.0::DOUBLE, s)) * 100) AS DOUBLE) AS confidence FROM s)
      SELECT *, CAST(printf('%.4f', confidence / 100) AS DOUBLE) AS confidence_score FROM co JOIN w USING (doc_id) JOIN f USING (doc_id)"""


def _case(i: int) -> str:
    return " ".join(f"WHEN {n} THEN '{_DISPLAY[label][i]}'" for n, label in enumerate(LABELS) if _DISPLAY[label][i])


def _p2(c: str) -> str:
    return f"CAST(printf('%.2f', abs({c})) AS DOUBLE)"


_REPORTS = f"""WITH {I.COMPANY_SQL}{I.METRICS_SQL},
rm AS (SELECT pos * 10000 + fiscal_year AS doc_id, pos AS supp,
  CASE WHEN fiscal_year % 2 = 0 THEN 'Supplier ' || right(company_name, 9) || ' Limited' ELSE 'Annual Report ' || pos END AS company_name,
  CASE WHEN fiscal_year >= 2000 THEN 'FY' || fiscal_year ELSE 'FY2009' END AS fiscal_year, 'annual_report_' || pos || '.pdf' AS source_document,
  CASE WHEN pos % 4 = 0 THEN 100000.0 ELSE floor(revenue_cr * 100 + 0.5) / 100.0::DOUBLE END AS revenue_cr, NULL::DOUBLE AS revenue_growth_cc_pct, {_p2('ebit_margin_pct')} AS ebit_margin_pct,
  {_p2('pat_margin_pct')} AS pat_margin_pct, {_p2('roe_pct')} AS roe_pct, NULL::DOUBLE AS roce_pct, {_p2('dso_days')} AS dso_days, NULL::DOUBLE AS fcf_to_pat_pct,
  NULL::DOUBLE AS revenue_per_employee_lakh, {_p2('attrition_rate_pct')} AS attrition_rate_pct FROM bm)"""


_CURATED = """, cu AS (SELECT s_suppkey, 'Supplier ' || right(s_name, 9) || ' Limited Holdings' AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'annual_report_' || s_suppkey || '.pdf' ELSE 'none' END AS file, s_acctbal FROM supplier WHERE s_acctbal > 5000),
      m AS (SELECT rm.*, cu.* FROM rm LEFT JOIN cu ON contains(lower(name), lower(company_name)) OR contains(lower(company_name), lower(name)) OR file = source_document QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s_suppkey) = 1)"""
# a curated row has a revenue only: every other metric of a document that it replaces stays as extracted
_FIGURES = _REPORTS + _CURATED + """, fg AS (SELECT m.* EXCLUDE (supp, company_name, fiscal_year, source_document, s_suppkey, name, file, s_acctbal, revenue_cr),
      coalesce(name, company_name) AS company_name, coalesce(s_acctbal, revenue_cr) AS revenue_cr FROM m)"""


def _named_comparison_sql() -> str:
    from ledgerlens.plans.benchmark_queries import _FOCUS, _all_focus_sql

    src = _FIGURES + ", rp AS (SELECT *, doc_id AS pos, CAST(doc_id % 10000 AS INTEGER) AS report_year FROM fg)," + _all_focus_sql("report_year", "rp", vocab.BENCHMARK_METRICS)
    return src + _FOCUS.format(keys="report_year", focus=FOCUS, src="rp") + " SELECT res.* FROM res JOIN foc USING (report_year, focus_company)"


def _pairwise_sql() -> str:
    from ledgerlens.plans.benchmark_queries import _all_focus_sql

    sides = "pr AS (SELECT a.doc_id AS pair_id, b.doc_id AS second, CASE WHEN b.doc_id % 3 = 0 THEN b.company_name END AS focus FROM fg a JOIN fg b ON b.doc_id = a.doc_id + 1)"
    rows = "rp AS (SELECT pair_id, focus, 0 AS pos, fg.* FROM pr JOIN fg ON doc_id = pair_id UNION ALL SELECT pair_id, focus, 1, fg.* FROM pr JOIN fg ON doc_id = second)"
    pick = ", foc AS (SELECT pair_id, arg_min(company_name, CASE WHEN company_name = focus THEN 0 ELSE 10 END + pos) AS focus_company FROM rp GROUP BY 1)"
    return f"{_FIGURES}, {sides}, {rows},{_all_focus_sql('pair_id', 'rp', vocab.BENCHMARK_METRICS)}{pick} SELECT res.* FROM res JOIN foc USING (pair_id, focus_company)"


def _comparison_sql() -> str:
    from ledgerlens.plans.benchmark_queries import _FOCUS, _all_focus_sql

    src = _REPORTS + ", rp AS (SELECT *, doc_id AS pos FROM rm)," + _all_focus_sql("fiscal_year", "rp", vocab.BENCHMARK_METRICS)
    return src + _FOCUS.format(keys="fiscal_year", focus="", src="rp") + " SELECT res.* FROM res JOIN foc USING (fiscal_year, focus_company)"


ORACLE = {
    "line_facts": _STATE + " SELECT doc_id, field, metric, value, unit, period, page_number, 0.88 AS confidence FROM mf",
    "company_facts": _STATE + " SELECT *, 0.82 AS confidence FROM cf",
    "fact_dedup": _STATE + " SELECT doc_id, metric, value, period, page_number FROM mf QUALIFY row_number() OVER (PARTITION BY doc_id, metric, value, period ORDER BY o) = 1",
    "fact_best": _STATE + " SELECT doc_id, field, metric, value, unit, period, page_number FROM bf",
    "fact_pivot": _STATE + " SELECT doc_id, " + ", ".join(f"max(value) FILTER (field = '{f}') AS {f}" for f in vocab.METRIC_FIELDS) + " FROM bf GROUP BY 1",
    "company_values": _STATE + " SELECT doc_id, field, value FROM cf",
    "document_currency": _STATE + " SELECT doc_id, code AS currency FROM st",
    "doc_confidence": _STATE + """, n AS (SELECT doc_id, count(DISTINCT concat_ws('|', metric, value, coalesce(unit, ''), coalesce(period, ''))) AS n_facts FROM mf GROUP BY 1),
      c AS (SELECT doc_id, n_facts, 3 AS n_scalars, CASE WHEN doc_id % 3 = 0 THEN 0.95 ELSE 0.88 END AS c, CASE WHEN doc_id % 2 = 0 THEN 0.85 ELSE tl / 8000 END AS t
            FROM n JOIN (SELECT doc_id, length(concat_ws(chr(10), 'Page 1', company_name || ' Limited', 'Revenue: ' || a_rev || ' cr FY' || fiscal_year, 'Net income' || chr(9) || a_np || chr(9) || coalesce(a_pnp, '-'),
              'The total assets was ' || code || ' ' || a_as || ' million.', '  OCR   page 02', 'Ticker: S' || pos, 'EBITDA (' || a_eb || ')', 'current ratio of ' || a_cr || 'x for now', 'Industry' || chr(9) || 'Services' || chr(9) || 'other',
              'Revenue: ' || a_rev || ' cr FY' || fiscal_year, 'see note 7 on debt')) AS tl FROM st) USING (doc_id)),
      s AS (SELECT *, greatest(0.52::DOUBLE * c + 0.28::DOUBLE * t + 0.20::DOUBLE * least(1.0::DOUBLE, (n_facts + n_scalars) / 18), 0.82::DOUBLE * c + 0.13::DOUBLE * t + 0.05::DOUBLE * least(1.0::DOUBLE, n_facts / 4))
          - least(0.5::DOUBLE, doc_id % 2 * 0.14::DOUBLE) - least(0.25::DOUBLE, doc_id % 5 * 0.035::DOUBLE) AS s FROM c)
      SELECT doc_id, n_facts, n_scalars, CAST(printf('%.2f', greatest(0, least(1.0::DOUBLE, s)) * 100) AS DOUBLE) AS confidence FROM s""",
    "mean_confidence": _STATE + ", n AS (SELECT doc_id, count(*) AS n FROM mf GROUP BY 1) SELECT doc_id, CAST(printf('%.4f', (n * 0.88 + 3 * 0.82) / (n + 3)) AS DOUBLE) AS confidence_score FROM n",
    "document_company": _STATE + " SELECT doc_id, company_name || ' Limited' AS company_name FROM st",
    "concept_lookup": f"SELECT p_partkey, CASE p_size % {len(LABELS)} {_case(0)} END AS field, CASE p_size % {len(LABELS)} {_case(1)} END AS display FROM part",
    "report_metrics": _REPORTS + " SELECT * EXCLUDE (supp) FROM rm",
    "curated_override": _REPORTS + _CURATED + """
      SELECT doc_id, coalesce(name, company_name) AS company_name, CASE WHEN name IS NOT NULL THEN 'FY1990' ELSE fiscal_year END AS fiscal_year, source_document,
        CASE WHEN name IS NOT NULL THEN 'curated' ELSE 'Extracted from PDF' END AS source_page, coalesce(s_acctbal, revenue_cr) AS revenue_cr, name IS NOT NULL AS is_curated FROM m""",
    "document_comparison": _comparison_sql(),
    "curated_comparison": _named_comparison_sql(),
    "extraction_records": _records_sql(),
    "pairwise_comparison": _pairwise_sql(),
}

ORACLE["all_documents_facts"] = (
    "SELECT doc_id, 0 AS place, 'Revenue' AS metric, n_chars || ' cr FY2001' AS value, 'cr' AS unit, CASE WHEN n_chars BETWEEN 2000 AND 2099 THEN CAST(n_chars AS VARCHAR) ELSE 'FY2001' END AS period, 0.88 AS confidence FROM documents"
)

# the second revenue line differs in its page only: one character of L, so it is a look-alike
# (100 * (L - 1) / L >= 96) from 25 characters on
ORACLE["fact_fuzzy_dedup"] = _STATE + """, sg AS (SELECT *, length(concat_ws(' ', metric, value, coalesce(unit, ''), coalesce(period, ''), page_number)) AS len,
   CASE field WHEN 'revenue' THEN 0 WHEN 'ebitda' THEN 5 WHEN 'net_income' THEN 6 WHEN 'assets' THEN 10 ELSE 37 END AS place0 FROM mf),
kp AS (SELECT * FROM sg WHERE NOT (field = 'revenue' AND page_number = '2' AND len >= 25)
       QUALIFY row_number() OVER (PARTITION BY doc_id, metric, value, page_number ORDER BY o) = 1)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place0, coalesce(period, ''), page_number, o) - 1 AS INTEGER) AS place, metric, value, unit, period, page_number FROM kp"""

ROWS_ONLY = ["extracted_documents"]
QUERIES = {name: globals()[name] for name in [*ORACLE, *ROWS_ONLY]}

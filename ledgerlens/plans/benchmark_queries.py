"""Queries of the peer benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.operators import benchmark as B
from ledgerlens.operators.ordering import positions
from ledgerlens.plans import inputs as I
from ledgerlens.session import cut_lineage

YEAR = ["fiscal_year"]
FOCUS = "Supplier#000000001"
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]  # columns of the SQL; the query takes them from the table
PIVOT_LIMIT = 1_000  # most regions as columns; more stop the job
SIDE_ROWS = [("revenue", "Revenue"), ("net_profit", "Net Profit"), ("liabilities", "Total Debt"), ("margin", "Profit Margin")]


def companies(spark, sf):
    """Company metrics, stored once: the benchmark reads them in several passes."""
    return cut_lineage(I.benchmark_metrics(I.company_figures(spark, sf)))


def nations(spark, sf):
    return cut_lineage(I.benchmark_metrics(I.nation_figures(spark, sf)))


def company_years(spark, sf):
    return I.company_figures(spark, sf)


def peer_benchmark(spark, sf):
    return B.benchmark(companies(spark, sf), FOCUS, YEAR, unique_names=True)


def peer_benchmark_all(spark, sf):
    return B.benchmark_all(companies(spark, sf), YEAR, unique_names=True)


def peer_benchmark_by_name(spark, sf):
    """Brands as company names that repeat within a set (one row per part size)."""
    return B.benchmark(_brand_rows(spark, sf), "Brand#3", ["set_name"], BRAND_METRICS)


def peer_benchmark_all_by_name(spark, sf):
    return B.benchmark_all(_brand_rows(spark, sf), ["set_name"], BRAND_METRICS)


BRAND_METRICS = [("price", "Price", True), ("size", "Size", False)]


def _brand_rows(spark, sf):
    part = I.table(spark, sf, "part")
    return part.select(
        F.col("p_type").alias("set_name"), F.col("p_partkey").alias("pos"), F.col("p_brand").alias("company_name"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice")).alias("price"), F.col("p_size").cast("double").alias("size"),
    )


def peer_rank(spark, sf):
    """Place of every company by revenue within its year, best first."""
    df = I.company_figures(spark, sf).select("fiscal_year", "company_name", "pos", "revenue", (-F.col("revenue")).alias("signed"))
    return positions(cut_lineage(df), YEAR, "signed", "pos", "rank").select("fiscal_year", "company_name", "revenue", "rank")


def strengths_weaknesses(spark, sf):
    report = peer_benchmark_all(spark, sf)
    out = B.highlights(report, ["fiscal_year", "focus_company"])
    lists = ("key_strengths", "key_weaknesses", "no_data_metrics")
    return out.select("fiscal_year", "focus_company", "n_metrics", *[F.array_join(c, "; ").alias(c) for c in lists])


def peer_values(spark, sf):
    return B.peer_values(companies(spark, sf), FOCUS, YEAR).drop("pos")


def peer_value_maps(spark, sf):
    """Peer values of nations as one text per year and metric, in input order."""
    maps = B.peer_value_maps(nations(spark, sf), "NATION_3", YEAR)
    entries = F.transform(F.map_entries("peer_values"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"])))
    return maps.select("fiscal_year", "focus_company", "metric", F.array_join(entries, ";").alias("peer_values"))


def comparison_narrative(spark, sf):
    out = B.comparison(nations(spark, sf), "NATION_3", YEAR)
    return out.select(
        "fiscal_year", "focus_company", F.array_join("companies_compared", ",").alias("companies_compared"),
        F.size("metric_comparisons").alias("n_comparisons"), "narrative_summary",
    )


def benchmark_report_rows(spark, sf):
    return B.report_rows(peer_benchmark(spark, sf)).drop("metric_pos")


def side_by_side_pivot(spark, sf):
    fig = I.region_figures(spark, sf).withColumn("margin", I.round4(F.try_divide("net_profit", "revenue") * 100))
    rows = F.array(*[F.struct(F.lit(label).alias("metric"), F.format_string("%.4f", F.col(c)).alias("value")) for c, label in SIDE_ROWS])
    long = fig.select("fiscal_year", "company_name", F.explode(rows).alias("m")).select("fiscal_year", "company_name", "m.*")
    names = I.table(spark, sf, "region").select("r_name").distinct().filter("r_name IS NOT NULL")
    n = names.count()
    if n > PIVOT_LIMIT:
        raise ValueError(f"{n} regions are too many columns; use the long form")
    wide = B.side_by_side(long, YEAR, "metric", "company_name", "value", sorted(r[0] for r in names.collect()))
    return wide.toDF(*[c.replace(" ", "_") for c in wide.columns])


def yoy_pairs(spark, sf):
    return I.company_figures(spark, sf).select("company_name", "fiscal_year", "revenue", "prior_revenue", "growth")


def comparison_set_check(spark, sf):
    """Customers per nation and market segment as sets; a set of one is an error."""
    rows = I.table(spark, sf, "customer").select(F.col("c_nationkey").alias("set_id"), F.col("c_mktsegment").alias("segment"))
    return B.set_sizes(rows, ["set_id", "segment"])


# --- oracle -------------------------------------------------------------------------

def _unpivot(metrics, keys: str, src: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, pos, company_name, {i} AS metric_pos, '{label}' AS metric, {str(higher).upper()} AS higher_is_better, "
        f"{field} AS value, {'-' if higher else ''}{field} AS signed FROM {src}"
        for i, (field, label, higher) in enumerate(metrics)
    )


def _all_focus_sql(keys: str, src: str, metrics) -> str:
    """CTEs ending in `res`: every name as focus. Rows, then names, then leave-one-out."""
    return f"""
lm AS ({_unpivot(metrics, keys, src)}),
rk AS (SELECT *, CASE WHEN value IS NOT NULL THEN row_number() OVER (PARTITION BY {keys}, metric_pos, value IS NULL ORDER BY signed, pos) END AS rnk FROM lm),
nm AS (SELECT {keys}, metric_pos, metric, higher_is_better, company_name, arg_min(ROW(value), pos) AS fv,
         arg_max(CAST(value * pow(2, 60) AS HUGEINT), pos) FILTER (value IS NOT NULL) AS lv, min(rnk) AS rnk, count(value) AS n
       FROM rk GROUP BY ALL),
tot AS (SELECT {keys}, metric_pos, sum(lv) AS total, count(lv) AS n_names, sum(n) AS n_ranked FROM nm GROUP BY ALL),
cmp AS (SELECT nm.*, fv[1] AS value, CAST(CAST(total AS HUGEINT) - coalesce(lv, 0) AS DOUBLE) / pow(2, 60) AS peer_sum,
          n_names - CASE WHEN lv IS NULL THEN 0 ELSE 1 END AS n_peers, n_ranked
        FROM nm JOIN tot USING ({keys}, metric_pos)),
mn AS (SELECT *, CASE WHEN value IS NOT NULL AND n_peers > 0 THEN peer_sum / n_peers END AS mean FROM cmp),
pc AS (SELECT *, (value - mean) / nullif(abs(mean), 0) * 100 AS pct FROM mn),
res AS (SELECT {keys}, company_name AS focus_company, metric_pos, metric, higher_is_better, value AS focus_company_value,
    CAST(printf('%.2f', CAST(printf('%.14e', mean) AS DOUBLE)) AS DOUBLE) AS peer_average, CAST(printf('%.1f', CAST(printf('%.14e', pct) AS DOUBLE)) AS DOUBLE) AS focus_vs_peer_avg_pct,
    CAST(CASE WHEN mean IS NOT NULL THEN rnk END AS BIGINT) AS focus_rank,
    CAST(CASE WHEN mean IS NOT NULL THEN n_ranked ELSE 0 END AS BIGINT) AS total_ranked,
    CASE WHEN pct IS NULL THEN 'no_data' WHEN CASE WHEN higher_is_better THEN pct ELSE -pct END >= 5 THEN 'outperform'
         WHEN CASE WHEN higher_is_better THEN pct ELSE -pct END <= -5 THEN 'underperform' ELSE 'inline' END AS flag
  FROM pc)"""


_COMPANY_ALL = f"WITH {I.COMPANY_SQL}{I.METRICS_SQL},{_all_focus_sql('fiscal_year', 'bm', vocab.BENCHMARK_METRICS)}"
_NATION_ALL = f"WITH {I.NATION_SQL}{I.METRICS_SQL},{_all_focus_sql('fiscal_year', 'bm', vocab.BENCHMARK_METRICS)}"
# the focus of a set: the asked name where it exists, else the first company
_FOCUS = """,
foc AS (SELECT {keys}, arg_min(company_name, (CASE WHEN company_name = '{focus}' THEN 0 ELSE 1 END) * 1e15 + pos) AS focus_company
        FROM {src} GROUP BY ALL HAVING count(*) >= 2)"""
_BRAND = "WITH br AS (SELECT p_type AS set_name, p_partkey AS pos, p_brand AS company_name, CASE WHEN p_size % 7 <> 0 THEN p_retailprice END AS price, CAST(p_size AS DOUBLE) AS size FROM part),"
_BRAND_ALL = _BRAND + _all_focus_sql("set_name", "br", BRAND_METRICS)
_ONE = _COMPANY_ALL + _FOCUS.format(keys="fiscal_year", focus=FOCUS, src="bm") + ", one AS (SELECT res.* FROM res JOIN foc USING (fiscal_year, focus_company))"


def _labels(flag: str) -> str:
    return f"coalesce(string_agg(metric, '; ' ORDER BY metric_pos) FILTER (flag = '{flag}'), '')"


def _phrase(flag: str, lead: str) -> str:
    return f"CASE WHEN count(*) FILTER (flag = '{flag}') > 0 THEN ' {lead}' || string_agg(metric, ', ' ORDER BY metric_pos) FILTER (flag = '{flag}') || '.' ELSE '' END"


ORACLE = {
    "company_years": f"WITH {I.COMPANY_SQL} SELECT * FROM fig",
    "peer_benchmark": _ONE + " SELECT * FROM one",
    "peer_benchmark_all": _COMPANY_ALL + " SELECT * FROM res",
    "peer_benchmark_by_name": _BRAND_ALL + _FOCUS.format(keys="set_name", focus="Brand#3", src="br")
    + " SELECT res.* FROM res JOIN foc USING (set_name, focus_company)",
    "peer_benchmark_all_by_name": _BRAND_ALL + " SELECT * FROM res",
    "peer_rank": f"WITH {I.COMPANY_SQL} SELECT fiscal_year, company_name, revenue, row_number() OVER (PARTITION BY fiscal_year ORDER BY revenue DESC, pos) AS rank FROM fig",
    "strengths_weaknesses": _COMPANY_ALL + f" SELECT fiscal_year, focus_company, count(*) AS n_metrics, {_labels('outperform')} AS key_strengths, "
    f"{_labels('underperform')} AS key_weaknesses, {_labels('no_data')} AS no_data_metrics FROM res GROUP BY 1, 2",
    "peer_values": _COMPANY_ALL + _FOCUS.format(keys="fiscal_year", focus=FOCUS, src="bm")
    + " SELECT fiscal_year, focus_company, metric_pos, metric, company_name, value FROM lm JOIN foc USING (fiscal_year) WHERE company_name <> focus_company AND value IS NOT NULL",
    "peer_value_maps": _NATION_ALL + _FOCUS.format(keys="fiscal_year", focus="NATION_3", src="bm")
    + """ SELECT fiscal_year, focus_company, metric, string_agg(company_name || '=' || printf('%.4f', value), ';' ORDER BY pos) AS peer_values
      FROM lm JOIN foc USING (fiscal_year) WHERE company_name <> focus_company AND value IS NOT NULL GROUP BY 1, 2, 3""",
    "comparison_narrative": _NATION_ALL + _FOCUS.format(keys="fiscal_year", focus="NATION_3", src="bm") + f""",
      nms AS (SELECT fiscal_year, string_agg(company_name, ',' ORDER BY pos) AS companies_compared, count(*) AS n_all,
                string_agg(company_name, ', ' ORDER BY pos) FILTER (company_name <> focus_company) AS peers
              FROM bm JOIN foc USING (fiscal_year) GROUP BY 1),
      sen AS (SELECT fiscal_year, focus_company, count(*) AS n, {_phrase('outperform', 'Key areas of outperformance vs peer average include ')}
                || {_phrase('underperform', 'Key areas of underperformance vs peer average include ')}
                || CASE WHEN count(*) FILTER (flag IN ('outperform', 'underperform')) = 0 THEN ' {vocab.IN_LINE}' ELSE '' END
                || {_phrase('no_data', 'Insufficient data for metrics: ')} AS tail
              FROM res JOIN foc USING (fiscal_year, focus_company) GROUP BY 1, 2)
      SELECT fiscal_year, focus_company, companies_compared, CAST(n AS INTEGER) AS n_comparisons,
        focus_company || CASE WHEN n_all = 2 THEN ' was benchmarked directly against peer ' || peers
          ELSE ' was benchmarked against a peer group of ' || (n_all - 1) || ' companies (' || peers || ')' END
          || ' for ' || fiscal_year || ' across ' || n || ' metrics.' || tail AS narrative_summary
      FROM sen JOIN nms USING (fiscal_year)""",
    "benchmark_report_rows": _ONE + """ SELECT fiscal_year, focus_company, metric,
        coalesce(format('{:,.1f}', CAST(printf('%.1f', focus_company_value) AS DOUBLE)), '-') AS focus_text, coalesce(format('{:,.1f}', peer_average), '-') AS peer_text,
        coalesce(printf('%+.1f', focus_vs_peer_avg_pct) || '%', '-') AS variance_text,
        CASE WHEN focus_rank > 0 THEN focus_rank || '/' || total_ranked ELSE '-' END AS rank_text,
        CASE flag WHEN 'outperform' THEN 'Outperforms' WHEN 'underperform' THEN 'Underperforms' WHEN 'inline' THEN 'In line' ELSE 'No Data' END AS assessment
      FROM one""",
    "side_by_side_pivot": f"WITH {I.REGION_SQL}, lng AS (" + " UNION ALL ".join(
        f"SELECT fiscal_year, company_name, '{label}' AS metric, printf('%.4f', {c if c != 'margin' else I._pct('net_profit', 'revenue')}) AS value FROM fig"
        for c, label in SIDE_ROWS
    ) + ") SELECT fiscal_year, metric, " + ", ".join(
        f"coalesce(max(value) FILTER (company_name = '{r}'), '—') AS {r.replace(' ', '_')}" for r in REGIONS
    ) + " FROM lng GROUP BY 1, 2",
    "yoy_pairs": f"WITH {I.COMPANY_SQL} SELECT company_name, fiscal_year, revenue, prior_revenue, growth FROM fig",
    "comparison_set_check": f"SELECT c_nationkey AS set_id, c_mktsegment AS segment, count(*) AS n_companies, CASE WHEN count(*) < 2 THEN '{B.TOO_FEW}' END AS error FROM customer GROUP BY 1, 2",
}

QUERIES = {name: globals()[name] for name in ORACLE}

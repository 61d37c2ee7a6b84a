"""Business tables mapped to what the operators expect, as Spark frames and as SQL.

The mapping is synthetic: a supplier stands for a company, the ship year for its fiscal
year, and sums over its order lines for its figures. Every frame reads whole tables.
`*_SQL` constants hold the same mapping as common table expressions for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.benchmark import with_prior_year
from ledgerlens.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows take much work each, in at least as many tasks as there are cores."""
    return spread(table(spark, sf_dir, name))


def round4(c: Column) -> Column:
    """Four decimals by plain double arithmetic, the same in every engine."""
    return F.floor(c * 10000 + 0.5) / F.lit(10000.0)


def yearly_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact sums of order lines per supplier and ship year (first aggregate of all figures)."""
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    revenue = price * (F.lit(1).cast("decimal(1,0)") - F.col("l_discount").cast("decimal(4,2)"))
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.year("l_shipdate").alias("fiscal_year"), price.alias("gross"), revenue.cast("decimal(18,4)").alias("revenue"),
        (revenue * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(20,6)").alias("tax"), F.col("l_quantity").cast("decimal(10,2)").alias("qty"),
        "l_returnflag", "l_linestatus",
    )

    def part(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("revenue")).otherwise(F.lit(0).cast("decimal(18,4)")))

    return lines.groupBy("l_suppkey", "fiscal_year").agg(
        F.sum("gross").alias("gross"), F.sum("revenue").alias("revenue"), F.sum("tax").alias("tax"), F.sum("qty").alias("qty"),
        part(F.col("l_linestatus") == "F").alias("revenue_f"), part(F.col("l_linestatus") == "O").alias("revenue_o"),
        part(F.col("l_returnflag") == "R").alias("revenue_r"), part(F.col("l_returnflag") == "N").alias("revenue_n"),
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("l_returnflag") == "R").alias("r_lines"),
    )


SUMS = ["gross", "revenue", "tax", "qty", "revenue_f", "revenue_o", "revenue_r", "revenue_n"]

YEARLY_SUMS_SQL = """
li AS (
  SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS fiscal_year, l_returnflag, l_linestatus,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS gross,
         CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS revenue,
         CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * CAST(l_tax AS DECIMAL(4,2)) AS tax,
         CAST(l_quantity AS DECIMAL(10,2)) AS qty
  FROM lineitem),
yearly AS (
  SELECT l_suppkey, fiscal_year, sum(gross) AS gross, sum(revenue) AS revenue, sum(tax) AS tax, sum(qty) AS qty,
         sum(CASE WHEN l_linestatus = 'F' THEN revenue ELSE 0 END) AS revenue_f,
         sum(CASE WHEN l_linestatus = 'O' THEN revenue ELSE 0 END) AS revenue_o,
         sum(CASE WHEN l_returnflag = 'R' THEN revenue ELSE 0 END) AS revenue_r,
         sum(CASE WHEN l_returnflag = 'N' THEN revenue ELSE 0 END) AS revenue_n,
         count(*) AS n_lines, count(*) FILTER (l_returnflag = 'R') AS r_lines
  FROM li GROUP BY 1, 2)"""


def figures(sums: DataFrame) -> DataFrame:
    """Company figures as doubles of four decimals from the exact sums."""
    d = sums.select("pos", "company_name", "fiscal_year", *[F.col(c).cast("double").alias(c) for c in [*SUMS, "n_lines", "r_lines"]])
    interest = F.col("tax") + F.col("gross") - F.col("revenue")
    d = d.select(
        "pos", "company_name", "fiscal_year", round4(F.col("revenue")).alias("revenue"), round4(F.col("gross")).alias("assets"),
        round4(F.col("revenue") - F.col("tax") - 0.5 * F.col("gross")).alias("net_profit"),
        round4(F.col("revenue") - 0.5 * F.col("gross")).alias("ebitda"),
        round4(F.col("revenue_f") - F.col("revenue_r")).alias("ocf"), round4(F.col("revenue_r") * 2.2).alias("liabilities"),
        round4(F.try_divide(F.col("revenue_f"), F.col("revenue_o"))).alias("current_ratio"),
        round4(F.try_divide(F.col("revenue_r") * 1.5, F.col("revenue_n"))).alias("debt_to_equity"),
        round4(interest).alias("interest"),
        round4(F.try_divide(F.col("revenue_f") - F.col("revenue_r"), interest)).alias("interest_coverage"),
        round4(F.try_divide(F.col("revenue") - F.col("tax") - 0.5 * F.col("gross"), F.col("qty"))).alias("eps"),
        round4(F.try_divide(F.col("revenue_o"), F.col("revenue")) * 365).alias("dso"),
        round4(F.try_divide(F.col("revenue"), F.col("n_lines"))).alias("revenue_per_line"),
        round4(F.col("r_lines") / F.col("n_lines") * 100).alias("return_rate"),
    )
    d = with_prior_year(d, "company_name", "fiscal_year", FIGURES)
    growth = round4(F.try_divide(F.col("revenue") - F.col("prior_revenue"), F.abs("prior_revenue")) * 100)
    return d.withColumn("growth", growth)


FIGURES = ["revenue", "assets", "net_profit", "ebitda", "ocf", "liabilities", "eps"]

_R4 = "floor(({}) * 10000 + 0.5) / 10000.0::DOUBLE"


def _figures_sql(source: str) -> str:
    r = _R4.format
    prior = ", ".join(
        f"CASE WHEN lag(fiscal_year) OVER w = fiscal_year - 1 THEN lag({c}) OVER w END AS prior_{c}" for c in FIGURES
    )
    sums = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in [*SUMS, "n_lines", "r_lines"])
    return f"""
dbl AS (SELECT pos, company_name, fiscal_year, {sums} FROM {source}),
fig0 AS (
  SELECT pos, company_name, fiscal_year, {r('revenue')} AS revenue, {r('gross')} AS assets,
    {r('revenue - tax - 0.5::DOUBLE * gross')} AS net_profit, {r('revenue - 0.5::DOUBLE * gross')} AS ebitda,
    {r('revenue_f - revenue_r')} AS ocf, {r('revenue_r * 2.2::DOUBLE')} AS liabilities,
    {r('revenue_f / nullif(revenue_o, 0)')} AS current_ratio, {r('revenue_r * 1.5::DOUBLE / nullif(revenue_n, 0)')} AS debt_to_equity,
    {r('tax + gross - revenue')} AS interest, {r('(revenue_f - revenue_r) / nullif(tax + gross - revenue, 0)')} AS interest_coverage,
    {r('(revenue - tax - 0.5::DOUBLE * gross) / nullif(qty, 0)')} AS eps, {r('revenue_o / nullif(revenue, 0) * 365')} AS dso,
    {r('revenue / nullif(n_lines, 0)')} AS revenue_per_line, {r('r_lines / n_lines * 100')} AS return_rate
  FROM dbl),
fig1 AS (SELECT *, {prior} FROM fig0 WINDOW w AS (PARTITION BY company_name ORDER BY fiscal_year)),
fig AS (SELECT *, {r('(revenue - prior_revenue) / nullif(abs(prior_revenue), 0) * 100')} AS growth FROM fig1)"""


def company_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as companies: the lines are summed before the join with the names."""
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("company_name"))
    sums = yearly_sums(spark, sf_dir).join(names, "l_suppkey").withColumnRenamed("l_suppkey", "pos")
    return figures(sums)


COMPANY_SQL = YEARLY_SUMS_SQL + """,
src AS (SELECT l_suppkey AS pos, s_name AS company_name, yearly.* EXCLUDE (l_suppkey)
        FROM yearly JOIN supplier ON s_suppkey = l_suppkey),""" + _figures_sql("src")


def _rolled_up(spark: SparkSession, sf_dir: str, keys: DataFrame) -> DataFrame:
    sums = yearly_sums(spark, sf_dir).join(keys, "l_suppkey")
    total = [F.sum(c).alias(c) for c in [*SUMS, "n_lines", "r_lines"]]
    return figures(sums.groupBy("pos", "company_name", "fiscal_year").agg(*total))


def nation_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as companies; their number is that of the nation table, whatever the data size."""
    nation = table(spark, sf_dir, "nation")
    keys = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return _rolled_up(spark, sf_dir, keys.select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("company_name")))


def region_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    keys = (
        table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return _rolled_up(spark, sf_dir, keys.select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_regionkey").cast("long").alias("pos"), F.col("r_name").alias("company_name")))


def _rolled_up_sql(key: str, name: str, joins: str) -> str:
    sums = ", ".join(f"sum({c}) AS {c}" for c in [*SUMS, "n_lines", "r_lines"])
    return YEARLY_SUMS_SQL + f""",
src AS (SELECT CAST({key} AS BIGINT) AS pos, {name} AS company_name, fiscal_year, {sums}
        FROM yearly JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey {joins}
        GROUP BY 1, 2, 3),""" + _figures_sql("src")


NATION_SQL = _rolled_up_sql("n_nationkey", "n_name", "")
REGION_SQL = _rolled_up_sql("r_regionkey", "r_name", "JOIN region ON r_regionkey = n_regionkey")


def benchmark_metrics(fig: DataFrame) -> DataFrame:
    """The ten benchmark metrics of a figures frame."""

    def pct(a: str, b: Column) -> Column:
        return round4(F.try_divide(F.col(a), b) * 100)

    return fig.select(
        "pos", "company_name", "fiscal_year", F.col("revenue").alias("revenue_cr"), F.col("growth").alias("revenue_growth_cc_pct"),
        pct("ebitda", F.col("revenue")).alias("ebit_margin_pct"), pct("net_profit", F.col("revenue")).alias("pat_margin_pct"),
        pct("net_profit", F.col("assets") - F.col("liabilities")).alias("roe_pct"), pct("ebitda", F.col("assets")).alias("roce_pct"),
        F.col("dso").alias("dso_days"), pct("ocf", F.col("net_profit")).alias("fcf_to_pat_pct"),
        F.col("revenue_per_line").alias("revenue_per_employee_lakh"), F.col("return_rate").alias("attrition_rate_pct"),
    )


def _pct(a: str, b: str) -> str:
    return _R4.format(f"{a} / nullif({b}, 0) * 100")


METRICS_SQL = f""",
bm AS (
  SELECT pos, company_name, fiscal_year, revenue AS revenue_cr, growth AS revenue_growth_cc_pct,
    {_pct('ebitda', 'revenue')} AS ebit_margin_pct, {_pct('net_profit', 'revenue')} AS pat_margin_pct,
    {_pct('net_profit', '(assets - liabilities)')} AS roe_pct, {_pct('ebitda', 'assets')} AS roce_pct, dso AS dso_days,
    {_pct('ocf', 'net_profit')} AS fcf_to_pat_pct, revenue_per_line AS revenue_per_employee_lakh, return_rate AS attrition_rate_pct
  FROM fig)"""


def amount(c: Column) -> Column:
    """Thousands-separated text of an amount with two decimals."""
    return F.format_number(F.floor(c * 100 + 0.5) / F.lit(100.0), 2)


def amount_sql(c: str) -> str:
    return f"format('{{:,.2f}}', floor(({c}) * 100 + 0.5) / 100.0::DOUBLE)"

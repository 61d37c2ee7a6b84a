"""Peer benchmark of companies on a list of metrics.

Input: one row per company and comparison set, with `pos` (input order), the company
name and one column per metric. A *set* is what is compared together, here usually a
fiscal year. Sums of values hold at any size (`functions.sums`); non-finite values have
no part in a mean. Means, counts and the focus rank are partial aggregates and ranks of all
companies come from value ranges, so one set may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens import vocab
from ledgerlens.functions import sums
from ledgerlens.functions.text import fixed, round_exact
from ledgerlens.operators.ordering import lookup, positions, small_lookup

NESTED_LIMIT = 100_000  # most companies of one set in the nested (array, map, sentence) forms
TOO_FEW = "a comparison needs at least 2 companies (focus and peers)"


def long_metrics(companies: DataFrame, set_cols: list[str], metrics=vocab.BENCHMARK_METRICS) -> DataFrame:
    """One row per company and metric, nulls kept; `signed` is lower for better. No shuffle."""
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("metric_pos"), F.lit(label).alias("metric"), F.lit(higher).alias("higher_is_better"),
                F.col(field).cast("double").alias("value"),
                (-F.col(field) if higher else F.col(field)).cast("double").alias("signed"),
            )
            for i, (field, label, higher) in enumerate(metrics)
        ]
    )
    keep = [*set_cols, "pos", "company_name"]
    return companies.select(*keep, F.explode(rows).alias("m")).select(*keep, "m.*")


def set_sizes(companies: DataFrame, set_cols: list[str]) -> DataFrame:
    """Company count per set, with an error for sets too small to compare."""
    sizes = companies.groupBy(*set_cols).agg(F.count(F.lit(1)).alias("n_companies"))
    return sizes.withColumn("error", F.when(F.col("n_companies") < 2, F.lit(TOO_FEW)))


def pick_focus(companies: DataFrame, set_cols: list[str], focus: str | Column | None) -> DataFrame:
    """The focus name per set: `focus` (a name, or a column that names it) where the set has it, else its first company."""
    wanted = focus if isinstance(focus, Column) else F.lit(focus)
    order = F.struct((~F.col("company_name").eqNullSafe(wanted)).alias("miss"), F.col("pos"))
    picked = companies.groupBy(*set_cols).agg(
        F.min_by("company_name", order).alias("focus_company"), F.count(F.lit(1)).alias("n_companies")
    )
    return picked.filter("n_companies >= 2")


def _assess(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, variance, rank and flag from value, peer_sum, n_peers, n_ranked and rank."""
    has = F.col("value").isNotNull() & (F.col("n_peers") > 0)
    mean = F.when(has, F.try_divide(F.col("peer_sum"), F.col("n_peers").cast("double")))
    df = df.withColumn("_mean", mean)
    pct = F.try_divide(F.col("value") - F.col("_mean"), F.abs("_mean")) * 100
    df = df.withColumn("_pct", pct)
    signed = F.when(F.col("higher_is_better"), F.col("_pct")).otherwise(-F.col("_pct"))
    flag = (
        F.when(F.col("_pct").isNull(), "no_data")
        .when(signed >= vocab.BENCHMARK_BAND_PCT, "outperform")
        .when(signed <= -vocab.BENCHMARK_BAND_PCT, "underperform")
        .otherwise("inline")
    )
    return df.select(
        *keys, "metric_pos", "metric", "higher_is_better", F.col("value").alias("focus_company_value"),
        round_exact(sums.steady(F.col("_mean")), 2).alias("peer_average"), round_exact(sums.steady(F.col("_pct")), 1).alias("focus_vs_peer_avg_pct"),
        F.when(has, F.col("rank")).cast("long").alias("focus_rank"),
        F.when(has, F.col("n_ranked")).otherwise(0).cast("long").alias("total_ranked"), flag.alias("flag"),
    )


def benchmark(
    companies: DataFrame, focus: str | Column | None, set_cols: list[str], metrics=vocab.BENCHMARK_METRICS,
    unique_names: bool = False,
) -> DataFrame:
    """One focus company per set against its peers; one row per set and metric.

    The rank is counted, not sorted: one more than the rows that come before the focus.
    `unique_names` says that no set holds a name twice, which saves one aggregate; otherwise
    rows that share the focus name are no peers, and a peer name counts once, with its
    last non-null value.
    """
    cell = [*set_cols, "metric_pos"]
    rows = long_metrics(companies, set_cols, metrics)
    chosen = pick_focus(companies, set_cols, focus).drop("n_companies")
    mine = small_lookup(rows, chosen, set_cols).filter("company_name = focus_company").groupBy(*cell, "focus_company").agg(
        F.min_by("value", "pos").alias("value"),
        F.min(F.when(F.col("value").isNotNull(), F.struct("signed", "pos"))).alias("best"),
    )
    rows = small_lookup(rows, mine.withColumnRenamed("value", "focus_value"), cell)
    peer = (F.col("company_name") != F.col("focus_company")) & F.col("value").isNotNull()
    same = ["metric", "higher_is_better", "focus_company", "focus_value"]
    before = F.col("value").isNotNull() & (F.struct("signed", "pos") < F.col("best"))
    ranks = {"n_ranked": F.col("value").isNotNull(), "n_before": F.coalesce(before, F.lit(False))}
    if unique_names:
        peer_value = F.when(peer, F.col("value"))
        totals = sums.grouped(rows, [*cell, *same], peer_value, "parts", {**ranks, "n_peers": sums.split(peer_value).isNotNull()})
    else:
        totals = rows.groupBy(*cell, *same).agg(*[F.sum(c.cast("long")).alias(n) for n, c in ranks.items()])
        names = rows.filter(peer).groupBy(*cell, "company_name").agg(F.max_by("value", "pos").alias("v"))
        peers = sums.grouped(names, cell, F.col("v"), "parts", {"n_peers": sums.split(F.col("v")).isNotNull()})
        totals = totals.join(peers, cell, "left").na.fill({"n_peers": 0})
    totals = totals.withColumn("rank", F.col("n_before") + 1).withColumn("peer_sum", sums.total(F.col("parts")))
    return _assess(totals.withColumnRenamed("focus_value", "value"), [*set_cols, "focus_company"])


def benchmark_all(
    companies: DataFrame, set_cols: list[str], metrics=vocab.BENCHMARK_METRICS, unique_names: bool = False
) -> DataFrame:
    """Every company of a set as the focus, in one pass (leave-one-out sums)."""
    cell = [*set_cols, "metric_pos"]
    keys = [*cell, "metric", "higher_is_better", "company_name"]
    rows = long_metrics(companies, set_cols, metrics)
    ranked = positions(rows.filter("value IS NOT NULL"), cell, "signed", "pos", "rank")
    ranked = ranked.select(*keys, "pos", "value", "rank")
    missing = rows.filter("value IS NULL").select(*keys, "pos", "value", F.lit(None).cast("long").alias("rank"))
    names = ranked.unionByName(missing)
    if unique_names:
        names = names.select(*keys, "value", F.col("value").alias("last_value"), "rank", F.col("value").isNotNull().cast("int").alias("n"))
    else:
        names = names.groupBy(*keys).agg(
            F.min_by("value", "pos").alias("value"),
            F.max_by("value", F.when(F.col("value").isNotNull(), F.col("pos"))).alias("last_value"),
            F.min("rank").alias("rank"), F.count("value").alias("n"),
        )
    counted = sums.split(F.col("last_value")).isNotNull()
    totals = sums.grouped(names, cell, F.col("last_value"), "parts", {"n_names": counted, "n_ranked": F.col("n")})
    own = counted.cast("int")
    joined = (
        small_lookup(names, totals, cell)
        .withColumn("peer_sum", sums.total(F.col("parts"), F.col("last_value")))
        .withColumn("n_peers", F.col("n_names") - own)
        .withColumnRenamed("company_name", "focus_company")
    )
    return _assess(joined, [*set_cols, "focus_company"])


def highlights(report: DataFrame, keys: list[str]) -> DataFrame:
    """Labels of strengths, weaknesses and missing metrics per focus, in metric order."""

    def labels(flag: str) -> Column:
        hit = F.when(F.col("flag") == flag, F.struct("metric_pos", "metric"))
        return F.transform(F.array_sort(F.collect_list(hit)), lambda s: s["metric"])

    return report.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_metrics"), labels("outperform").alias("key_strengths"),
        labels("underperform").alias("key_weaknesses"), labels("no_data").alias("no_data_metrics"),
    )


def _bounded(companies: DataFrame, set_cols: list[str]) -> DataFrame:
    """Rows of sets small enough to nest; a larger set stops the job instead of being cut."""
    sizes = set_sizes(companies, set_cols).select(*set_cols, "n_companies")
    small = F.col("n_companies") <= NESTED_LIMIT
    return (
        lookup(companies, sizes, set_cols)
        .filter(F.when(small, F.lit(True)).otherwise(F.raise_error(F.lit("set too large to nest; use the long form"))))
        .drop("n_companies")
    )


def peer_values(companies: DataFrame, focus: str | None, set_cols: list[str], metrics=vocab.BENCHMARK_METRICS) -> DataFrame:
    """Long form of the peers' values: one row per set, metric and peer name."""
    rows = small_lookup(
        long_metrics(companies, set_cols, metrics), pick_focus(companies, set_cols, focus).drop("n_companies"), set_cols
    )
    return (
        rows.filter("company_name <> focus_company AND value IS NOT NULL")
        .groupBy(*set_cols, "focus_company", "metric_pos", "metric", "company_name")
        .agg(F.max_by("value", "pos").alias("value"), F.min("pos").alias("pos"))
    )


def peer_value_maps(companies: DataFrame, focus: str | None, set_cols: list[str], metrics=vocab.BENCHMARK_METRICS) -> DataFrame:
    """`peer_values` as one map per set and metric, in input order; for sets within NESTED_LIMIT."""
    return _value_maps(_bounded(companies, set_cols), focus, set_cols, metrics)


def _value_maps(companies: DataFrame, focus: str | None, set_cols: list[str], metrics) -> DataFrame:
    values = peer_values(companies, focus, set_cols, metrics)
    entries = F.array_sort(F.collect_list(F.struct("pos", "company_name", "value")))
    return values.groupBy(*set_cols, "focus_company", "metric_pos", "metric").agg(
        F.map_from_entries(F.transform(entries, lambda e: F.struct(e["company_name"], e["value"]))).alias("peer_values")
    )


def comparison(companies: DataFrame, focus: str | None, set_cols: list[str], metrics=vocab.BENCHMARK_METRICS) -> DataFrame:
    """The nested comparison result: one row per set, for sets within NESTED_LIMIT."""
    companies = _bounded(companies, set_cols)
    report = benchmark(companies, focus, set_cols, metrics)
    maps = _value_maps(companies, focus, set_cols, metrics).drop("metric", "focus_company")
    entry = F.struct(
        "metric_pos", "metric", F.lit("").alias("unit"), "higher_is_better", "focus_company_value", "peer_values",
        "peer_average", "focus_vs_peer_avg_pct", "focus_rank", "total_ranked", "flag",
    )
    keys = [*set_cols, "focus_company"]
    by_pos = F.array_sort("entries", lambda a, b: a["metric_pos"] - b["metric_pos"])
    nested = (
        report.join(maps, [*set_cols, "metric_pos"], "left")
        .groupBy(*keys).agg(F.collect_list(entry).alias("entries"))
        .select(*keys, F.transform(by_pos, lambda e: e.dropFields("metric_pos")).alias("metric_comparisons"))
    )
    names = companies.groupBy(*set_cols).agg(F.array_sort(F.collect_list(F.struct("pos", "company_name"))).alias("c"))
    names = names.select(*set_cols, F.transform("c", lambda e: e["company_name"]).alias("companies_compared"))
    out = highlights(report, keys).join(nested, keys).join(names, set_cols)
    year = F.col(set_cols[0])
    return out.withColumn("narrative_summary", narrative(year)).drop("n_metrics", "no_data_metrics")


def narrative(year: Column) -> Column:
    """The templated summary from focus_company, companies_compared and the label lists."""
    peers = F.filter("companies_compared", lambda c: c != F.col("focus_company"))
    listed = F.array_join(peers, ", ")
    tail = F.concat(F.lit(" for "), year.cast("string"), F.lit(" across "), F.col("n_metrics").cast("string"), F.lit(" metrics."))
    opening = F.when(
        F.size(peers) == 1,
        F.concat(F.col("focus_company"), F.lit(" was benchmarked directly against peer "), listed, tail),
    ).otherwise(
        F.concat(
            F.col("focus_company"), F.lit(" was benchmarked against a peer group of "), F.size(peers).cast("string"),
            F.lit(" companies ("), listed, F.lit(")"), tail,
        )
    )

    def sentence(lead: str, labels: str) -> Column:
        return F.when(F.size(labels) > 0, F.concat(F.lit(lead), F.array_join(labels, ", "), F.lit(".")))

    neutral = F.when((F.size("key_strengths") == 0) & (F.size("key_weaknesses") == 0), F.lit(vocab.IN_LINE))
    return F.concat_ws(
        " ", opening,
        sentence("Key areas of outperformance vs peer average include ", "key_strengths"),
        sentence("Key areas of underperformance vs peer average include ", "key_weaknesses"),
        neutral, sentence("Insufficient data for metrics: ", "no_data_metrics"),
    )


def report_rows(report: DataFrame) -> DataFrame:
    """Presentation strings of benchmark rows."""
    labels = F.create_map(*[F.lit(x) for pair in vocab.BENCHMARK_FLAG_LABELS.items() for x in pair])

    def number(c: str) -> Column:
        return F.coalesce(F.format_number(round_exact(F.col(c), 1), 1), F.lit("-"))

    rank = F.when(
        F.col("focus_rank") > 0, F.concat_ws("/", F.col("focus_rank").cast("string"), F.col("total_ranked").cast("string"))
    ).otherwise("-")
    variance = F.concat(fixed(F.col("focus_vs_peer_avg_pct"), 1), F.lit("%"))
    variance = F.when(variance.startswith("-"), variance).otherwise(F.concat(F.lit("+"), variance))
    keep = [c for c in report.columns if c in ("fiscal_year", "focus_company", "metric_pos", "metric")]
    return report.select(
        *keep, number("focus_company_value").alias("focus_text"), number("peer_average").alias("peer_text"),
        F.when(F.col("focus_vs_peer_avg_pct").isNull(), "-").otherwise(variance).alias("variance_text"),
        rank.alias("rank_text"), F.element_at(labels, F.col("flag")).alias("assessment"),
    )


def side_by_side(long_values: DataFrame, keys: list[str], row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Metric rows by company columns; "—" where a company has no value."""
    wide = long_values.groupBy(*keys, row).pivot(column, columns).agg(F.first(value, ignorenulls=True))
    return wide.select(*keys, row, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("—")).alias(c) for c in columns])


def with_prior_year(df: DataFrame, company: str, year: str, columns: list[str]) -> DataFrame:
    """Adds `prior_<column>` from the year before, null when that year is missing.

    The window runs over the few years of one company.
    """
    by_year = W.partitionBy(company).orderBy(year)
    adjacent = F.lag(year).over(by_year) == F.col(year) - 1
    return df.select("*", *[F.when(adjacent, F.lag(c).over(by_year)).alias(f"prior_{c}") for c in columns])

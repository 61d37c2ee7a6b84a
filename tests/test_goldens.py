"""Known results of small fixtures: the benchmark tables and the red-flag requests."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.operators import benchmark as B
from ledgerlens.operators import redflags as R
from ledgerlens.operators import requests as Q

FIELDS = [m[0] for m in vocab.BENCHMARK_METRICS]
COMPANIES = [
    ("NexaCore Technologies", 98450, 5.1, 19.8, 14.5, 23.9, 27.9, 71.2, 63.7, 51.5, 17.4),
    ("Infoedge Systems", 142840, 6.8, 22.8, 17.2, 28.4, 32.4, 62.4, 89.6, 58.4, 13.8),
    ("Zenith Global", 84240, 7.4, 21.2, 15.8, 25.8, 30.4, 64.8, 83.5, 54.8, 14.2),
    ("Apex Digital", 62480, 5.4, 18.8, 14.0, 22.4, 27.4, 68.4, 81.4, 48.4, 15.4),
    ("Globalink IT", 48240, 9.2, 17.2, 13.2, 19.8, 24.8, 58.4, 94.2, 44.8, 16.2),
]


def companies(spark, rows):
    data = [(i, r[0], "FY2025", *[None if v is None else float(v) for v in r[1:]]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "pos long, company_name string, fiscal_year string, " + ", ".join(f"{f} double" for f in FIELDS))


def padded(name, **values):
    return (name, *[values.get(f) for f in FIELDS])


def report(spark, rows, focus):
    return B.benchmark(companies(spark, rows), focus, ["fiscal_year"]).orderBy("metric_pos").collect()


def test_two_companies(spark):
    rows = report(spark, COMPANIES[:2], "NexaCore Technologies")
    assert [r.focus_vs_peer_avg_pct for r in rows] == [-31.1, -25.0, -13.2, -15.7, -15.8, -13.9, 14.1, -28.9, -11.8, 26.1]
    assert {r.flag for r in rows} == {"underperform"} and {(r.focus_rank, r.total_ranked) for r in rows} == {(2, 2)}


def test_five_companies(spark):
    rows = report(spark, COMPANIES, "NexaCore Technologies")
    assert [r.peer_average for r in rows] == [84450.0, 7.2, 20.0, 15.05, 24.1, 28.75, 63.5, 87.17, 51.6, 14.9]
    assert [r.focus_vs_peer_avg_pct for r in rows] == [16.6, -29.2, -1.0, -3.7, -0.8, -3.0, 12.1, -26.9, -0.2, 16.8]
    assert [r.focus_rank for r in rows] == [2, 5, 3, 3, 3, 3, 5, 5, 3, 5]
    under, same = "underperform", "inline"
    assert [r.flag for r in rows] == ["outperform", under, same, same, same, same, under, under, same, under]


@pytest.mark.parametrize("unique", [True, False])
def test_all_focus_equals_single_focus(spark, unique):
    df = companies(spark, COMPANIES)
    every = B.benchmark_all(df, ["fiscal_year"], unique_names=unique)
    for name, *_ in COMPANIES:
        one = B.benchmark(df, name, ["fiscal_year"], unique_names=unique)
        own = every.filter(F.col("focus_company") == name)
        assert own.exceptAll(one.select(own.columns)).isEmpty() and own.count() == 10


def test_ranks_flags_and_missing_values(spark):
    rows = [padded("A", revenue_cr=200, dso_days=90), padded("B", revenue_cr=90, dso_days=60), padded("C", revenue_cr=80, dso_days=55)]
    got = {r.metric: r for r in report(spark, rows, "A")}
    assert (got["Revenue (Rs cr)"].flag, got["Revenue (Rs cr)"].focus_rank) == ("outperform", 1)
    assert (got["Days Sales Outstanding (days)"].flag, got["Days Sales Outstanding (days)"].focus_rank) == ("underperform", 3)
    assert (got["EBIT Margin (%)"].flag, got["EBIT Margin (%)"].total_ranked) == ("no_data", 0)


def test_single_company_is_an_error(spark):
    one = companies(spark, COMPANIES[:1])
    assert B.benchmark(one, "NexaCore Technologies", ["fiscal_year"]).isEmpty()
    assert B.set_sizes(one, ["fiscal_year"]).first().error == B.TOO_FEW


def test_unknown_focus_takes_first_company_and_narrative(spark):
    out = B.comparison(companies(spark, COMPANIES[:2]), "nobody", ["fiscal_year"]).first()
    assert out.focus_company == "NexaCore Technologies" and len(out.metric_comparisons) == 10
    assert out.narrative_summary.startswith(
        "NexaCore Technologies was benchmarked directly against peer Infoedge Systems for FY2025 across 10 metrics."
    )
    assert out.key_strengths == [] and len(out.key_weaknesses) == 10
    assert out.metric_comparisons[0].peer_values == {"Infoedge Systems": 142840.0}


def test_zero_peer_mean_keeps_rank(spark):
    rows = report(spark, [padded("A", revenue_cr=5), padded("B", revenue_cr=0)], "A")
    assert (rows[0].flag, rows[0].focus_rank, rows[0].total_ranked, rows[0].peer_average) == ("no_data", 1, 2, 0.0)


# --- red-flag requests ----------------------------------------------------------------

REQUESTS = {
    "risky": (
        dict(revenue=(900, 1000), revenue_growth=(2, 12), net_profit=(60, 100), ebitda=(120, 180), current_ratio=0.75, debt_to_equity=2.6,
             interest_coverage="1.0", interest_expense=120, operating_cash_flow=20, total_assets=(1000, 1100), total_liabilities=(900, 700)),
        [("Auditor Report", "The auditor included a material uncertainty related to going concern."),
         ("Notes", "Management disclosed pending litigation and a covenant breach under the loan agreement.")],
    ),
    "clean": (
        dict(revenue=(1250, 1100), revenue_growth=(13.6, 9.8), net_profit=(160, 130), ebitda=(290, 245), current_ratio=1.9, debt_to_equity=0.35,
             interest_coverage=8.2, operating_cash_flow=190, total_assets=(1800, 1640), total_liabilities=(620, 600)),
        [("Auditor Report", "The auditor did not issue a qualified opinion and did not identify going concern uncertainty.")],
    ),
    "governance": (
        dict(revenue=(760, 780), net_profit=(42, 55), current_ratio=1.15, debt_to_equity=1.7, operating_cash_flow=18, total_assets=(990, 1010),
             total_liabilities=(790, 690)),
        [("Risk Factors", "The company disclosed a regulatory investigation, pending litigation, and contingent liabilities."),
         ("Notes", "Management reported an asset impairment and an event of default under borrowing arrangements.")],
    ),
}


@pytest.fixture(scope="module")
def frames(spark):
    names = ["value", "current", "previous", "prior", "current_year", "prior_year", *[a for v in Q.METRIC_KEY_ALIASES.values() for a in v]]
    rows, sections = [], []
    for request, (metrics, texts) in REQUESTS.items():
        for pos, (metric, value) in enumerate(metrics.items()):
            cells = dict.fromkeys(names)
            if isinstance(value, tuple):
                cells["current"], cells["previous"] = map(str, value)
            else:
                cells["value"] = str(value)
            rows.append((request, "Example", "2025", pos, metric, *cells.values(), None, None, "number"))
        sections += [(request, i, s, t) for i, (s, t) in enumerate(texts)]
    head = "request_id string, company string, financial_year string, pos int, metric string, "
    metrics = spark.createDataFrame(rows, head + ", ".join(f"{n} string" for n in names) + ", unit string, source string, kind string")
    sections = spark.createDataFrame(sections, "request_id string, pos int, section string, content string")
    metrics = Q.accepted(Q.normalise_metrics(metrics))
    return metrics.select("request_id", "company", "financial_year").distinct(), metrics, sections


@pytest.fixture(scope="module")
def result(frames):
    flags, summary = R.analyse(*frames)
    by_request = {}
    for f in flags.collect():
        by_request.setdefault(f.request_id, {})[f.title] = f
    return by_request, {s.request_id: s for s in summary.collect()}


def test_risky_request(result):
    flags, summary = result[0]["risky"], result[1]["risky"]
    high = {
        "Revenue decline", "Revenue slowdown", "Net profit decline", "EBITDA decline", "Low current ratio", "High debt-to-equity ratio",
        "Weak interest coverage", "Rising liabilities", "High liabilities relative to assets", "Going concern warning", "Debt covenant breach disclosed",
    }
    medium = {"Margin compression", "Weak operating cash conversion", "High interest burden", "Falling assets", "Litigation disclosed"}
    assert {t for t, f in flags.items() if f.severity == "High"} == high
    assert {t for t, f in flags.items() if f.severity == "Medium"} == medium
    assert summary.summary == "Identified 16 red flag(s): 5 medium, 11 high." and summary.overall_risk == "Critical"
    assert flags["Revenue decline"].evidence == "Revenue: current=900, prior=1000, change=-10.00%."
    assert flags["Revenue slowdown"].evidence == "Revenue growth: current=2, prior=12, change=-10.00pp."
    assert flags["High liabilities relative to assets"].evidence == (
        "total_assets=1000.0, total_liabilities=900.0, equity=100.0. Liabilities/assets=90.00%."
    )
    assert flags["High interest burden"].evidence == (
        "Interest expense: current=120.0. Revenue: current=900.0. Interest burden=13.33%."
    )
    assert flags["Margin compression"].evidence == (
        "EBITDA margin: current=13.33%, prior=18.00%. Revenue: current=900, prior=1000. EBITDA: current=120, prior=180."
    )


def test_clean_request(result):
    assert "clean" not in result[0]
    assert (result[1]["clean"].overall_risk, result[1]["clean"].summary) == ("Low", vocab.NO_FLAGS)


def test_governance_request(result):
    got = {t: f.severity for t, f in result[0]["governance"].items()}
    assert got == {
        "Debt default disclosed": "Critical", "Net profit decline": "High", "Regulatory investigation": "High", "Weak operating cash conversion": "Medium",
        "Elevated debt-to-equity ratio": "Medium", "Rising liabilities": "Medium", "Litigation disclosed": "Medium",
        "Contingent liabilities disclosed": "Medium", "Asset impairment disclosed": "Medium", "Revenue decline": "Low", "Weak liquidity cushion": "Low",
        "Falling assets": "Low",
    }
    assert result[1]["governance"].overall_risk == "Critical"


def test_other_sources_are_grounded_and_merged(spark, frames):
    others = spark.createDataFrame(
        [("risky", 0, "governance risk", "litigation disclosed", "severe", "d",
          "Management disclosed pending litigation and a covenant breach under the loan agreement", "r"),
         ("risky", 1, "weather", "Storm damage", "low", "d", "hurricane destroyed warehouses worth 99999", "r"),
         ("clean", 0, "audit", "Audit delay", "unheard of", "d", "qualified opinion", "r")],
        "request_id string, pos long, category string, title string, severity string, description string, evidence string, recommendation string",
    )
    flags, summary = R.analyse(*frames, others)
    got = {(f.request_id, f.title): f for f in flags.collect()}
    assert got[("risky", "litigation disclosed")].severity == "High"
    assert ("risky", "Storm damage") not in got and ("clean", "Audit delay") not in got
    assert {s.request_id: s.n_flags for s in summary.collect()} == {"risky": 16, "clean": 0, "governance": 12}


def test_first_metric_wins_whatever_the_partitions(frames):
    _, metrics, _ = frames
    extra = metrics.filter("metric = 'revenue'").withColumn("pos", F.col("pos") + 50).withColumn("metric", F.lit("Sales")).withColumn("current_raw", F.lit("1"))
    both = metrics.unionByName(extra)
    expected = sorted(map(str, R.numeric_flags(metrics, ["request_id"]).collect()))
    for n in (1, 7):
        assert sorted(map(str, R.numeric_flags(both.repartition(n, "current_raw"), ["request_id"]).collect())) == expected


def test_quoted_strings_in_evidence(spark):
    row = spark.createDataFrame([("r", 0, "Sales", "1,200 crore", "(50)", False)], "request_id string, pos int, metric string, current_raw string, prior_raw string, is_number boolean")
    picked = R.pick_concepts(row, ["request_id"]).select("revenue.*").first()
    assert (picked.cur, picked.prior) == (1200.0, -50.0)
    raw = row.select(R.quoted(F.col("current_raw"), F.col("is_number")).alias("q")).first().q
    assert raw == "'1,200 crore'"


def test_flags_serialise(frames):
    flags, _ = R.analyse(*frames)
    assert json.loads(flags.toJSON().first())["title"]

"""Sums of doubles of any size, and the peer means made of them."""

import math
import random

from pyspark.sql import functions as F

from ledgerlens.functions import sums
from ledgerlens.operators import benchmark as B

SIZE = [("value", "Size", True)]


def summed(spark, groups):
    rows = [(k, v) for k, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    out = sums.grouped(df, ["k"], F.col("v"), "parts", {"n": F.col("v").isNotNull()})
    return {r.k: (r.t, r.n) for r in out.select("k", "n", sums.total(F.col("parts")).alias("t")).collect()}


def test_totals_match_exact_sums(spark):
    rnd = random.Random(7)
    groups = {
        "money": [round(rnd.uniform(-1e6, 1e6), 2) for _ in range(500)],
        "wide": [rnd.uniform(-1, 1) * 10.0 ** rnd.randint(-30, 30) for _ in range(500)],
        "cancel": [1e23, 1.0, -1e23, 2.5e-7],
        "ends": [5e-324, 1e-320, 2.2250738585072014e-308, 1.7e308],
        "zero": [0.0, -0.0, None],
        "none": [None],
    }
    got = summed(spark, groups)
    for k, values in groups.items():
        want = math.fsum(v for v in values if v is not None)
        assert math.isclose(got[k][0], want, rel_tol=4e-16, abs_tol=0.0) or got[k][0] == want, (k, got[k], want)
        assert got[k][1] == sum(v is not None for v in values)


def test_values_that_are_not_finite_have_no_part(spark):
    assert summed(spark, {"a": [1.5, float("nan"), float("inf"), float("-inf"), 2.0]})["a"] == (3.5, 5)


def peers(spark, values):
    rows = [("FY", i, f"c{i}", v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "fiscal_year string, pos long, company_name string, value double")


def test_small_and_large_values_keep_their_means(spark):
    for unique in (True, False):
        small = B.benchmark(peers(spark, [4e-7, 3e-7, 2e-7]), None, ["fiscal_year"], SIZE, unique).first()
        assert (small.focus_vs_peer_avg_pct, small.flag) == (60.0, "outperform")
        every = B.benchmark_all(peers(spark, [1e23, 3e-7, 2e-7, 4e23]), ["fiscal_year"], SIZE, unique)
        got = {r.focus_company: r for r in every.collect()}
        assert got["c0"].peer_average == 4e23 / 3
        assert got["c1"].peer_average == 5e23 / 3
        big = B.benchmark(peers(spark, [1e23, 3e-7, 2e-7]), None, ["fiscal_year"], SIZE, unique).first()
        assert (big.focus_rank, big.total_ranked, big.flag) == (1, 3, "outperform")


def test_fifteen_digits_are_rounded_on_the_true_value_of_a_double(spark):
    pairs = [(928.8, 960.0), (447.6, 480.0), (856.05, 780.0), (851.17, 940.0), (167.49, 180.0), (921.8, 880.0), (926.2, 880.0), (1.0, 3.0), (5.0, 5.0)]
    numbers = [(v - m) / abs(m) * 100 for v, m in pairs] + [0.0, 1e11 + 0.5, 999.9999999999995, 1e-9 / 3]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", sums.steady(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in rows} == {x: float(f"{x:.14e}") for x in numbers}

"""Facts whose figures look alike, beside the SQL of the queries over them."""

import datetime

import pytest

from ledgerlens.operators import facts as Fa
from ledgerlens.plans import fact_queries as Q
from tests import oracle

FACTS = "doc_id long, pos int, field string, metric string, value string, unit string, period string, page_number string, confidence double"
PAIR = ("1,989,387.34", "1,989,737.34")  # two years' net incomes, found among random pairs of sf0.1


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A supplier of two years whose net incomes (half the gross) are the pair."""
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [
        (7, datetime.datetime(year, 5, 1), price, 0.0, 0.0, 1.0, "A", status)
        for year, gross in ((1995, 3978774.68), (1996, 3979474.68)) for status, price in (("F", 1000000.0), ("O", gross - 1000000.0))
    ]
    kinds = "l_suppkey long, l_shipdate timestamp, l_extendedprice double, l_discount double, l_tax double, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(7, "Supplier#000000007")], "s_suppkey long, s_name string").coalesce(1).write.parquet(f"{path}/supplier.parquet")
    return path


@pytest.mark.parametrize("name", ["fact_fuzzy_dedup", "doc_confidence", "extraction_records"])
def test_net_incomes_that_differ_in_a_digit(spark, tables, name):
    import duckdb

    con = duckdb.connect()
    for table in ("lineitem", "supplier"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet/*.parquet'")
    assert oracle.compare(Q.QUERIES[name](spark, tables), con, Q.ORACLE[name]) == ""


def test_same_value_is_asked_for_only_when_named(spark):
    rows = [(1, i, "net_income", "Net Income", v, None, None, "1", 0.88) for i, v in enumerate(PAIR)]
    facts = spark.createDataFrame(rows, FACTS)
    assert [r.value for r in Fa.distinct_metrics(facts).collect()] == [PAIR[0]]
    assert sorted(r.value for r in Fa.distinct_metrics(facts, same=["value"]).collect()) == sorted(PAIR)


def test_mean_of_equal_confidences_is_that_confidence(spark):
    """4.4 / 5 as doubles is above 0.88, which lifted a score that lies on a tie."""
    facts = spark.createDataFrame([(1, i, "eps", "EPS", str(i), None, None, "1", 0.88) for i in range(5)], FACTS)
    signals = "doc_id long, model_confidence double, text_quality double, has_text boolean, n_errors int, n_warnings int"
    docs = spark.createDataFrame([(1, None, 280 / 8000, True, 1, 1)], signals)
    scalars = spark.createDataFrame([(1, f) for f in "abc"], "doc_id long, field string")
    assert Fa.document_confidence(docs, facts, facts, scalars).first().confidence == 60.11

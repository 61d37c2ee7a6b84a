"""Curated metrics in place of extracted ones, and comparisons of documents."""

import random

from pyspark.sql import functions as F

from ledgerlens.operators import facts as Fa
from ledgerlens.operators import report_comparison as Rc
from ledgerlens.sources import files as Fi


def _names(rng, n):
    return ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 7))) for _ in range(n)]


def test_containment_of_names_beside_every_pair(spark):
    rng = random.Random(5)
    short, long = {s for s in _names(rng, 60) if s}, {s for s in _names(rng, 90) if s}
    assert {len(s) for s in short} >= {1, 2, 3}
    got = Fi.contained_names(
        spark.createDataFrame([(s,) for s in short], "short string"), spark.createDataFrame([(s,) for s in long], "long string")
    ).collect()
    assert len(got) == len(set(got))
    assert {(r.short, r.long) for r in got} == {(a, b) for a in short for b in long if a in b}


def test_rows_grow_with_the_length_of_a_name(spark):
    name = "".join(chr(97 + i % 26) for i in range(250))
    grams = spark.range(1).select(*[F.size(Fi._grams(F.lit(name), n)).alias(f"g{n}") for n in (1, 2, 3)]).first()
    assert sum(grams) <= 3 * len(name)
    assert spark.range(1).select(Fi._grams(F.lit("ab"), 3).alias("g")).first().g == []


def test_override_beside_a_loop(spark):
    rng = random.Random(9)
    reports = [(i, name or None if i % 11 else None, f"f{i % 40}") for i, name in enumerate(_names(rng, 120))]
    curated = [(i, name if i != 4 else None, f"f{i * 7}" if i % 3 else None, float(i)) for i, name in enumerate(n for n in _names(rng, 25) if len(n) > 1)]
    for extra in ([], [(99, "", None, 99.0)]):
        rows = curated + extra
        out = Fi.curated_override(
            spark.createDataFrame([(*r, -1.0) for r in reports], "doc_id int, company_name string, source_document string, revenue_cr double"),
            spark.createDataFrame(rows, "pos int, company_name string, source_document string, revenue_cr double"), "doc_id",
        )
        got = {r.doc_id: (r.company_name, r.source_document, r.revenue_cr, r.is_curated) for r in out.collect()}
        for doc, name, file in reports:
            hits = [c for c in rows if c[2] == file or name is not None and c[1] is not None and (name in c[1] or c[1] in name)]
            want = (hits[0][1], file, hits[0][3], True) if hits else (name, file, -1.0, False)
            assert got[doc] == want, (doc, name)


def test_pairs_take_their_focus_and_documents_of_one_company_have_no_peer(spark):
    texts = [(i, f"{n} LIMITED\nReport for FY2024\noperating margin {m}%", f"{i}.pdf") for i, (n, m) in enumerate([("ALPHA", 10), ("BETAX", 20), ("ALPHA", 5)])]
    figures = Rc.document_metrics(spark.createDataFrame(texts, "doc_id long, text string, file_name string"))
    pairs = spark.createDataFrame([(1, 0, 1, None), (2, 0, 1, "Betax Limited"), (3, 0, 1, "nobody"), (4, 0, 2, None)], "pair_id int, first long, second long, focus string")
    rows = Rc.compare_pairs(pairs, figures).filter("metric_pos = 2").collect()
    got = {r.pair_id: (r.focus_company, r.focus_company_value, r.peer_average, r.focus_rank, r.flag) for r in rows}
    assert got == {
        1: ("Alpha Limited", 10.0, 20.0, 2, "underperform"), 2: ("Betax Limited", 20.0, 10.0, 1, "outperform"),
        3: ("Alpha Limited", 10.0, 20.0, 2, "underperform"), 4: ("Alpha Limited", 10.0, None, None, "no_data"),
    }


def test_record_takes_names_and_currency_of_the_text_and_keeps_documents_without_facts(spark):
    docs = spark.createDataFrame([(1, "Acme Holdings Limited\nRevenue: 5 cr\npaid in GBP", None), (2, "nothing here", None), (3, "Ticker: ABC", "Zeta Foods Limited")], "doc_id long, text string, title string")
    facts = Fa.facts_of_lines(Fa.text_lines(docs, ["doc_id"]), ["doc_id"]).checkpoint()
    found, companies = Fa.split_facts(facts, ["doc_id"])
    warned = [(1, ["Deterministic explicit-fact fallback used", "x"], True, 0.99), (2, [], False, 0.99), (3, None, True, None)]
    signals = spark.createDataFrame([(d, 0.5, True, 1, w, o, c) for d, w, o, c in warned], "doc_id long, text_quality double, has_text boolean, n_errors int, warnings array<string>, ocr_required boolean, ocr_confidence double")
    got = {r.doc_id: r for r in Fa.document_records(docs, signals, found, companies, title="title").collect()}
    assert (got[1].company_name, got[1].currency, got[1].revenue, got[1].n_scalars) == ("Acme Holdings Limited", "GBP", "5 cr", 2)
    assert (got[3].company_name, got[3].ticker, got[2].company_name, got[2].n_facts) == ("Zeta Foods Limited", "ABC", None, 0)
    # by hand: one warning counts, the scan's 0.99 stands for the text's quality; without facts nothing but that quality
    c, t = 0.88, 0.99
    assert got[1].confidence == round(100 * (max(0.52 * c + 0.28 * t + 0.2 * 3 / 18, 0.82 * c + 0.13 * t + 0.05 / 4) - 0.14 - 0.035), 2)
    assert got[2].confidence == round(100 * (max(0.28 * 0.5, 0.13 * 0.5) - 0.14), 2) and got[2].confidence_score == 0.0


def test_reports_are_extracted_once(spark):
    """The override reads what was extracted several times; the texts are gone through once."""
    read = spark.sparkContext.accumulator(0)

    def passed(text):
        read.add(1)
        return text

    texts = [(i, f"ACME{i} LIMITED\nRevenue from Operations were Rs {i}00\nFY2024", f"annual_report_{i}.pdf") for i in range(6)]
    reports = spark.createDataFrame(texts, "doc_id long, raw string, file_name string").select("doc_id", F.udf(passed, "string")("raw").alias("text"), "file_name")
    curated = spark.createDataFrame([(1, "Acme3 Limited Holdings", "FY1990", None, "curated", 7.0)], "pos long, company_name string, fiscal_year string, source_document string, source_page string, revenue_cr double")
    found = {r.doc_id: r.revenue_cr for r in Rc.document_metrics(reports, curated).collect()}
    assert found == {i: 7.0 if i == 3 else (i * 100.0 or 100000.0) for i in range(6)}
    assert read.value == len(texts)

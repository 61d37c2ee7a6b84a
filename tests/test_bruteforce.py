"""Operators beside plain loops on small and deliberately skewed inputs."""

import itertools
import os
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.functions import similarity as S
from ledgerlens.functions import text as X
from ledgerlens.operators import chunking as C
from ledgerlens.operators import dedup as D
from ledgerlens.operators import facts as Fa
from ledgerlens.operators import ordering as O
from ledgerlens.operators import redflags as R
from ledgerlens.operators import requests as Q
from ledgerlens.operators import retrieval as Re
from ledgerlens.sources import files as Fi
from ledgerlens.sources import store as St


def values(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


# --- similarity ---------------------------------------------------------------------


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@given(st.text("abcd é", max_size=40), st.text("abcd é", max_size=40), st.sampled_from([92, 96, 97, 98]))
@settings(max_examples=300, deadline=None)
def test_similarity_matches_table(a, b, percent):
    assert S.common_length(a, b) == lcs(a, b)
    total = len(a) + len(b)
    assert S.at_least(a, b, percent) == (total == 0 or 200 * lcs(a, b) >= percent * total)


def test_fuzzy_marks_match_plain_scan():
    rng = random.Random(3)
    base = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    keys = [k if rng.random() < 0.5 else k[:20] + rng.choice("abx") + k[21:] for k in base * 3]
    for percent in (92, 96):
        kept, expected = [], []
        for key in keys:
            fresh = bool(key) and not any(200 * lcs(key, o) >= percent * (len(key) + len(o)) for o in kept)
            expected.append(fresh)
            kept += [key] * fresh
        assert S._first_distinct(keys, percent) == expected


def test_distinct_lines_keeps_order_and_blank_runs(spark):
    text = "Alpha line number one\n\n\n\nalpha   LINE number one\nAlpha line number onf\nshort\nshorx\n\nend"
    long = "x" * 99
    many = "\n".join([f"{long}a", *[f"{i:03d} filler {i * 7919:09d} {i}" for i in range(80)], f"{long}b"])
    df = spark.createDataFrame(list(enumerate([text, f"{long}a\n{long}b\nz", many, None, "", " \n\n "])), "i int, t string")
    got = [r.v for r in D.distinct_lines(df, "t", "v").orderBy("i").collect()]
    # the near copy is one letter off in 21 (95 %), below the threshold; short lines are never compared
    assert got[0] == "Alpha line number one\n\nAlpha line number onf\nshort\nshorx\n\nend"
    assert got[1] == f"{long}a\nz"
    assert got[2].endswith("b")  # the near copy is beyond the last 80 kept lines
    assert got[3:] == [None, "", ""]


def test_scan_lines_compare_with_all_recent_native_lines(spark):
    native = "Revenue for the year was high\nshort"
    scans = ["revenue for the  year was high\nRevenue for the year was low\nshort", None]
    df = spark.createDataFrame([(i, native, s) for i, s in enumerate(scans)], "i int, native string, t string")
    got = [r.v for r in D.new_scan_lines(df, "native", "t", "v").orderBy("i").collect()]
    assert got == ["Revenue for the year was low\nshort", None]


@given(st.text("ab. \n", max_size=300), st.integers(5, 40))
@settings(max_examples=200, deadline=None)
def test_pieces_fit_and_cover(text, size):
    pieces = S._pieces(text, size, size // 5, vocab.SPLIT_SEPARATORS)
    assert all(len(p) <= size for p in pieces)
    joined = "".join(pieces)
    assert set(re.sub(r"\s", "", text)) == set(re.sub(r"\s", "", joined))
    assert len(re.sub(r"\s", "", joined)) >= len(re.sub(r"\s", "", text))


# --- text ---------------------------------------------------------------------------


def test_number_forms(spark):
    texts = ["(50)", "1,200 crore", "n/a", "--", "", "  ", "(1,234.50) loss", "up 3e2", "-.5", "none", "Rs.5", "abc"]
    assert values(spark, texts, X.parse_number) == [-50.0, 1200.0, None, None, None, None, -1234.5, 300.0, -0.5, None, 0.5, None]
    tokens = ["(1,234.50)", "1,91,204", "+5", "-0.0", "007.100", "5 cr", "100", "1.50"]
    assert values(spark, tokens, X.canonical_number) == ["-1234.5", "191204", "5", "-0", "7.1", "5 cr", "100", "1.5"]
    assert values(spark, ["1,91,204", "v1,234", "1,234 and (5,000.10)"], X.canonical_thousands) == ["1,91204", "v1,234", "1234 and -5000.1"]


def test_rounding_matches_exact_binary_value(spark):
    rng = random.Random(5)
    numbers = [2.675, 0.125, 0.375, -2.5, 1.005, -0.001, 0.0, -0.0, 12345678.905, 87.175]
    numbers += [rng.randint(-10**7, 10**7) / 1000 for _ in range(3000)] + [rng.uniform(-1e6, 1e6) for _ in range(1000)]
    df = spark.createDataFrame(list(enumerate(numbers)), "i int, x double")
    for digits in (1, 2, 4):
        rows = df.select("i", "x", X.fixed(F.col("x"), digits).alias("t"), X.round_exact(F.col("x"), digits).alias("r")).collect()
        assert [(r.t, r.r) for r in sorted(rows)] == [(f"{x:.{digits}f}", round(x, digits)) for x in numbers]


def test_plain_double_matches_repr(spark):
    numbers = [900.0, 0.5, 12345678.25, 1e-4, -3.0, 0.1 + 0.2, 99999999999.5]
    df = spark.createDataFrame(list(enumerate(numbers)), "i int, x double")
    assert [r.t for r in df.select("i", X.plain_double(F.col("x")).alias("t")).orderBy("i").collect()] == [repr(x) for x in numbers]




def test_snippets(spark):
    texts = [
        "The board reported fraud in two units.", "There was no fraud.", "Without fraud so far. " + "x" * 100 + "  misconduct\n  was found", "all is well", "",
        "y" * 100 + " fraud " + "z" * 200,
    ]
    pattern = r"\bfraud\b|\bmisconduct\b"
    assert values(spark, texts, lambda c: X.first_supported_snippet(c, pattern)) == [
        '"The board reported fraud in two units."', None, '"' + "x" * 78 + ' misconduct was found"', None, None, '"' + "y" * 79 + " fraud " + "z" * 119 + '"',
    ]


def test_keyword_guard_loses_nothing(spark):
    texts = ["LITIGATION", "Legal  proceedings", "litıgation", "Contingent Liability", "asset writedown", "default under loan", "resignation of CFO", "quiet"]
    sections = spark.createDataFrame([(i, 0, "s", t) for i, t in enumerate(texts)], "i int, pos int, section string, content string")
    got = {(r.i, r.title) for r in R.keyword_flags(sections, ["i"]).collect()}
    expected = {(i, title) for i, t in enumerate(texts) for _, title, _, p, _ in vocab.KEYWORD_RULES if re.search(p, t, re.I)}
    assert got == expected and len(got) >= 5


def test_company_names(spark):
    texts = {
        "NexaCore Technologies Limited": "NexaCore Technologies Limited", "ACME HOLDINGS PLC": "Acme Holdings PLC",
        "Microsoft Word - Annual Report - Beta Corp": "Beta Corp", "annual report | Gamma_Works LLP": "Gamma Works LLP",
        "Board of Delta Limited": None, "delta Limited": None, "Plain Name": None, "Epsilon, Inc": None, "X" * 150 + " Limited": None,
    }
    assert values(spark, list(texts), X.legal_name) == list(texts.values())


def test_dates_and_metadata(spark):
    texts = ["March 5, 2024", "5 mar 2024", "2024-3-5", "3/5/2024", "13/2/2024", "99/99/2024", "1/2/24", "Maybe 5, 2024"]
    assert values(spark, texts, X.canonical_dates) == [
        "2024-03-05", "2024-03-05", "2024-03-05", "2024-03-05", "2024-02-13", "99/99/2024", "2024-01-02", "Maybe 5, 2024",
    ]
    assert values(spark, ["D:20240305093000", "2024-03-05T10:00", "on 5 March 2024", "x", None], X.metadata_date) == ["2024-03-05"] * 3 + [None] * 2


# --- chunks --------------------------------------------------------------------------


def test_paragraph_packing(spark):
    """Nothing is lost, order is kept, no piece is longer than a paragraph and the overlap before it."""
    rng = random.Random(7)
    texts = ["", " \n\n "] + [
        "\n\n".join("".join(rng.choice("abcdefgh ") for _ in range(rng.choice([3, 20, 60, 130]))) for _ in range(rng.randint(1, 12))) for _ in range(200)
    ]
    for text, pieces in zip(texts, values(spark, texts, lambda c: C.pack_paragraphs(c, 50, 12))):
        at = 0
        for paragraph in filter(None, (p.strip() for p in text.split("\n\n"))):
            held = [i for i, piece in enumerate(pieces) if paragraph[:50] in piece and i >= at]
            assert held
            at = held[0]
        assert all(0 < len(piece) <= 50 + 2 + 12 for piece in pieces)
    assert values(spark, ["aa\n\nbb\n\n" + "c" * 60 + "\n\ndd"], lambda c: C.pack_paragraphs(c, 50, 12)) == [["aa\n\nbb", "c" * 50, "c" * 22, "dd"]]
    assert values(spark, ["a" * 30 + "\n\n" + "b" * 30], lambda c: C.pack_paragraphs(c, 50, 12)) == [["a" * 30, "a" * 12 + "\n\n" + "b" * 30]]


def test_section_chunks(spark):
    cases = {
        "": [],
        "SECTION 9: only": [("SECTION 9: only", "SECTION 9: only")],
        "One. Two. Three. Four.": [("UNSPECIFIED", "One. Two. Three."), ("UNSPECIFIED", "Four.")],
        "no stop\n\nSECTION 1: HEAD\nText. More.\n\nA.  B.\tC.": [("UNSPECIFIED", "no stop"), ("SECTION 1: HEAD", "SECTION 1: HEAD\nText. More."), ("SECTION 1: HEAD", "A. B. C.")],
        "x\nSECTION 3: not first\n\n  \n\nSECTION 22: B\n\nend": [("UNSPECIFIED", "x\nSECTION 3: not first"), ("SECTION 22: B", "SECTION 22: B"), ("SECTION 22: B", "end")],
    }
    got = values(spark, list(cases), C.section_chunks)
    assert [[tuple(c) for c in g] for g in got] == list(cases.values())


def test_budget_keeps_order_and_limits(spark):
    texts = ["Revenue: 5\nfiller words only", "x" * 300, "Page 3\nnoise\nNet income was 7 million\nnoise\nEBITDA 5" + "\nmore noise" * 30, "short", "left over"]
    df = spark.createDataFrame([(texts,)], "chunks array<string>")
    got = df.select(C.budget_chunks(F.col("chunks"), 100, 250, 3).alias("b")).first().b
    assert [b.chosen for b in got] == [True, True, True, False, False]
    assert (got[0].text, got[0].truncated) == (texts[0], False)
    assert (len(got[1].text), got[1].truncated) == (100, True)
    assert got[2].text == "Page 3\nNet income was 7 million\nEBITDA 5" and got[2].truncated
    assert got[3].reason == "LLM chunk budget reached (3 chunks per extraction)" and got[4].text == "left over"


# --- facts ---------------------------------------------------------------------------


def test_line_facts(spark):
    cases = {
        "Revenue: 5": ("revenue", "5"), "debt-to-equity: 2": ("debt", "to-equity: 2"), "total current assets was 5": ("assets", "5"),
        "Basic EPS 5": ("eps", "5"), "assets": None, "net cash flow was 7 and revenue was 3": ("revenue", "3"), "EBITDA - 1,234.50 million": ("ebitda", "1,234.50 million"),
        "The gross profit of 12%": ("gross_profit", "12%"), "inventory see note": None, "Dividends paid totalled (7)": ("dividend", "(7)"), "Cash flow = x": None,
    }
    got = values(spark, list(cases), Fa.metric_from_line)
    assert {line: g and (g.field, g.value) for line, g in zip(cases, got)} == cases


def test_display_names():
    assert vocab.DISPLAY_NAMES["diluted_eps"] == "Diluted EPS" and vocab.DISPLAY_NAMES["assets"] == "Total Assets"
    assert list(vocab.DISPLAY_NAMES) == vocab.METRIC_FIELDS and len(vocab.METRIC_FIELDS) == 43


def test_extraction_chain(spark):
    text = "Page 1\nNexaCore Technologies Limited\nRevenue: 98,450 cr FY2025\nNet Income\t100\t90\nPage 7\nGross revenue was 5 million\nRevenue: 98,450 cr FY2025\nTicker: NXC"
    out = Fa.extract_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    chosen = {r.field: (r.value, r.unit, r.period, r.page_number) for r in out["chosen"].collect()}
    assert chosen == {"revenue": ("98450 cr FY2025", "cr", "FY2025", "1"), "net_income": ("100", None, None, "1")}
    assert {r.field: r.value for r in out["company"].collect()} == {"company_name": "NexaCore Technologies Limited", "ticker": "NXC"}
    assert [r.metric for r in out["metrics"].orderBy("place").collect()] == ["Revenue", "Revenue", "Net Income", "Net Income"]


# --- order, merge, lookups under skew -----------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_positions_with_hot_group_and_hot_value(spark, seed):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), 1.0 if rng.random() < 0.5 else float(rng.randint(0, 50)), i) for i in range(4000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double, pos long").repartition(5)
    got = {(r.g, r.pos): r.position for r in O.positions(df, ["g"], "v", "pos", ranges=16).collect()}
    for g in {r[0] for r in rows}:
        for place, (_, _, pos) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 1):
            assert got[(g, pos)] == place


def test_merge_of_flags(spark):
    """A higher severity replaces a flag, otherwise the longer evidence is taken over; titles are compared by their words."""
    flags = [
        ("A", "One two", "Low", "d0", "eee"), ("A", "ONE-TWO", "Low", "d1", "eeeee"), ("A", "One two", "High", "d2", "e"), ("A", "One two", "Medium", "d3", "eeee"),
        ("A", "Other", "Low", "d4", "e"), ("B", "One two", "Medium", "d5", "ee"), ("B", "one two", "Medium", "d6", "ff"),
    ]
    rows = [(1, pos, *f, "r") for pos, f in enumerate(flags)]
    df = spark.createDataFrame(rows, "k int, pos long, category string, title string, severity string, description string, evidence string, recommendation string")
    got = {(r.category, r.title, r.severity, r.description, r.evidence) for r in R.merge(df.repartition(6), ["k"]).collect()}
    assert got == {("A", "One two", "High", "d2", "eeee"), ("A", "Other", "Low", "d4", "e"), ("B", "One two", "Medium", "d5", "ee")}


@pytest.mark.parametrize("severities", [("Low", "Medium", "High", "Critical", "none"), ("Low", "High")])
def test_merge_of_flags_as_a_fold(spark, severities):
    """Merged as an ordered fold leaves them; `standing` is the same without the evidence, and neither joins the flags to themselves."""
    rng = random.Random(len(severities))
    rows = [(rng.choice([None, 1, 2]), pos, rng.choice("AB"), rng.choice(["One two", "one-two", "Other"]), rng.choice(severities), f"d{pos}", "e" * rng.randint(0, 6) or None, "r") for pos in range(120)]
    fold = {}
    rank = {"Low": 1, "Medium": 2, "High": 3, "Critical": 4}
    for k, _, category, title, severity, description, evidence, _ in rows:
        cell = (k, category, title.lower().replace("-", " "))
        old = fold.get(cell)
        if old is None or rank.get(severity, 0) > rank.get(old[1], 0):
            fold[cell] = [title, severity, description, evidence]
        elif evidence is not None and len(evidence) > len(old[3] or ""):
            old[3] = evidence
    df = spark.createDataFrame(rows, "k int, pos long, category string, title string, severity string, description string, evidence string, recommendation string").repartition(6)
    heads = R.standing(df, ["k"])
    assert {(r.k, r.category, r.title, r.severity, r.description) for r in heads.collect()} == {(k, c, *v[:3]) for (k, c, _), v in fold.items()}
    assert "Join" not in heads._jdf.queryExecution().optimizedPlan().toString()
    got = [(r.k, r.category, r.title, r.severity, r.description, r.evidence) for r in R.merge(df, ["k"]).collect()]
    assert sorted(map(str, got)) == sorted(str((k, c, *v)) for (k, c, _), v in fold.items())


def test_split_lookup_keeps_all_rows(spark, monkeypatch):
    monkeypatch.setattr(O, "HOT_SHARE", 4)
    rows = [("hot", i) for i in range(600)] + [(f"k{i % 50}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "term string, i int")
    table = df.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    out = O.split_lookup(df, table, "term", "df", 1000)
    assert out.count() == 1000 and out.filter("term = 'hot' AND df = 600").count() == 600


def test_numbered_is_dense(spark):
    df = spark.range(1000).withColumn("x", F.rand(3)).repartition(7).filter("x > 0.3").select("id")
    ids = sorted(r.n for r in St.numbered(df, 11, "n").collect())
    assert ids == list(range(11, 11 + len(ids))) and len(ids) > 500


# --- retrieval -----------------------------------------------------------------------


def test_vector_search_blocks_and_late_filter(spark, monkeypatch):
    rng = random.Random(19)
    vectors = [(i, rng.choice("ab"), [float(rng.randint(0, 3)) for _ in range(4)]) for i in range(300)]
    asked = [(q, "a" if q % 2 else None, [float(rng.randint(0, 3)) for _ in range(4)]) for q in range(9)]
    chunks = spark.createDataFrame(vectors, "chunk_id long, company string, embedding array<float>").repartition(5)
    queries = spark.createDataFrame(asked, "query_id int, want string, embedding array<double>")
    expected = set()
    for q, want, v in asked:
        near = sorted((sum((a - b) ** 2 for a, b in zip(e, v)), i, c) for i, c, e in vectors)[:6]
        kept = [i for _, i, c in near if want is None or c == want][:2]
        expected |= {(q, rank, i) for rank, i in enumerate(kept, 1)}
    for block in (2000, 4):
        monkeypatch.setattr(Re, "QUERY_BLOCK", block)
        hits = Re.vector_search(chunks, queries, "chunk_id", k=2, overfetch=3, filters={"company": "want"})
        assert {(r.query_id, r.rank, r.chunk_id) for r in hits.collect()} == expected


def test_answers_cite_chunks_and_score(spark):
    text = "SECTION 1: MARGINS\nOperating margin fell to 19.8%. Wages rose.\n\nSECTION 2: FLAGS\nRed flags include litigation of Rs 412 crore. Nothing else."
    chunks = C.chunk_sections(spark.createDataFrame([(1, text)], "doc_id int, text string"), ["doc_id"])
    asked = spark.createDataFrame([(1, "Why did the operating margin fall, and what are the red flags?"), (2, "zebra giraffe antelope")], "query_id int, question string")
    parts = Re.decompose(asked, ["query_id"])
    hits = Re.TermIndex(chunks, ["doc_id", "chunk_no"]).search(parts, ["query_id", "part"], "sub_question", 3).join(chunks, ["doc_id", "chunk_no"])
    out = {r.query_id: r for r in Re.answers(hits, parts, "query_id").collect()}
    assert out[1].citations == ["[C1 | SECTION 1: MARGINS]", "[C2 | SECTION 2: FLAGS]"] and out[1].n_parts == 2
    assert out[2].synthesis == f'- On "zebra giraffe antelope": {vocab.NO_EVIDENCE}' and out[2].citations == []
    rows = [(q, a.part, a.finding) for q, r in out.items() for a in r.sub_answers]
    findings = spark.createDataFrame(rows, "query_id int, part int, finding string")
    scores = {r.query_id: r for r in Re.grounding_scores(findings, chunks, "query_id", []).collect()}
    assert (scores[1].citation_validity_rate, scores[1].numeric_grounding_rate) == (100.0, 100.0)
    assert (scores[2].citation_validity_rate, scores[2].numeric_claims_checked, scores[2].numeric_grounding_rate) == (0.0, 0, 100.0)


def test_term_scores_match_loop(spark, monkeypatch):
    import math

    rng = random.Random(23)
    docs = [" ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(rng.randint(0, 8))) for _ in range(40)]
    questions = ["alpha beta", "gamma", "alpha alpha zeta", "nothing", "delta eps beta"]
    n, df = len(docs), {}
    for d in docs:
        for w in set(d.split()):
            df[w] = df.get(w, 0) + 1

    def vector(text):
        v = {w: text.split().count(w) * (math.log((1 + n) / (1 + df[w])) + 1) for w in set(text.split()) if w in df}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()} if norm else {}

    expected = set()
    for q, text in enumerate(questions):
        v = vector(text)
        scored = [(-round(sum(x * vector(d).get(w, 0) for w, x in v.items()), 12), i) for i, d in enumerate(docs)]
        expected |= {(q, i, round(-s, 6)) for s, i in sorted(scored)[:4] if s < 0}
    chunks = spark.createDataFrame(list(enumerate(docs)), "chunk_no int, text string")
    asked = spark.createDataFrame(list(enumerate(questions)), "q int, question string")
    for block in (2000, 2):
        monkeypatch.setattr(Re, "QUERY_BLOCK", block)
        hits = Re.TermIndex(chunks, ["chunk_no"]).search(asked, ["q"], "question", 4)
        assert {(r.q, r.chunk_no, round(r.score, 6)) for r in hits.collect()} == expected


def test_question_parts(spark):
    q = "What is driving NexaCore's operating margin decline, and what are the biggest financial red flags in the FY2025 annual report?"
    got = values(spark, [q, "a and b", "Brandy sales; AND profit trend"], Re.question_parts)
    assert got == [
        ["What is driving NexaCore's operating margin decline,", "what are the biggest financial red flags in the FY2025 annual report"],
        ["a and b"], ["Brandy sales", "profit trend"],
    ]


# --- sources -------------------------------------------------------------------------


def test_sources_read_back(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"company_name": "A", "fiscal_year": "FY1", "source_document": "d", "revenue_cr": 1}, {"company_name": "B", "fiscal_year": "FY1"}]')
    rows = {r.company_name: r.reason for r in Fi.read_company_metrics(spark, str(tmp_path / "m.json")).collect()}
    assert rows == {"A": None, "B": "missing: source_document, revenue_cr"}
    (tmp_path / "t.csv").write_text('name;x\n"a  b";1\n;2\n')
    found = Fi.read_delimited(spark, str(tmp_path / "t.csv")).orderBy("pos").collect()
    assert [r.cells for r in found] == [["name", "x"], ["a b", "1"], ["", "2"]]
    (tmp_path / "n.txt").write_text("  <b>hi</b>\n")
    assert [r.text for r in Fi.read_text_files(spark, str(tmp_path / "n.txt")).collect()] == ["<b>hi</b>"]
    kinds = {r.name.rsplit("/", 1)[1]: r.kind for r in Fi.read_manifest(spark, str(tmp_path)).collect()}
    assert kinds == {"m.json": ".json", "t.csv": ".csv", "n.txt": ".txt"}


def test_delimited_lines_of_any_length(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,a,,b\n1,2,3,4\nshort\n\n1,2,3,4,5\n5,,,\n6,7,8,9,\n" + "x" * 20_000 + ",2\n")
    (tmp_path / "none.csv").write_text("")
    found = Fi.read_delimited(spark, str(tmp_path / "t.csv")).orderBy("pos").collect()
    assert [r.cells for r in found] == [
        ["a", "a.1", "Unnamed: 2", "b"], ["1", "2", "3", "4"], ["short", "", "", ""], ["5", "", "", ""], ["6", "7", "8", "9"], ["x" * 20_000, "2", "", ""],
    ]
    assert Fi.read_delimited(spark, str(tmp_path / "none.csv")).collect() == []


def test_places_of_facts_never_meet(spark):
    wide = "Revenue\t" + "\t".join(str(i) for i in range(10_000))
    pages = "\n".join(f"Page {i}\nDebt: EUR {i}" for i in range(1, 41))
    docs = spark.createDataFrame([(1, f"{wide}\nRevenue\t7\n{pages}"), (2, ""), (3, None)], "doc_id int, text string")
    facts = Fa.facts_of_lines(Fa.text_lines(docs, ["doc_id"]), ["doc_id"])
    places = facts.orderBy("pos").select("pos", "field", "value").collect()
    assert len({r.pos for r in places}) == len(places) == 10_000 + 1 + 40
    assert [r.value for r in places[9_998:10_002]] == ["9998", "9999", "7", "EUR 1"]
    metrics, _ = Fa.split_facts(facts, ["doc_id"])
    first = Fa.dedup_facts(metrics.filter("field = 'debt'").withColumn("value", F.lit("EUR 5")), ["doc_id"], ["field", "value"]).first()
    assert first.page_number == "1"


def test_control_marks_and_long_matches_stay_in_the_evidence(spark):
    long = "fraud" + "d" * 900
    texts = ["one \x01fraud\x02 here", "no fraud \x01\x02, then fraud", f"see {long} end", "\x01\x02"]
    got = values(spark, texts, lambda c: X.first_supported_snippet(c, r"\bfraud+\b"))
    assert got == ['"one \x01fraud\x02 here"', None, f'"see {long} end"', None]


def test_results_keep_rows_when_input_is_moved(spark):
    """First-wins results do not depend on the partitions of the input."""
    lines = [(d, i, f"line {rng % 7}") for d, i, rng in itertools.product(range(3), range(30), [0])]
    lines = [(d, i, f"line {(i * 5 + d) % 7}") for d, i, _ in lines]
    df = spark.createDataFrame(lines, "doc_id int, pos int, line string")
    expected = sorted(map(tuple, D.dedup_lines_long(df.coalesce(1), ["doc_id"]).collect()))
    assert sorted(map(tuple, D.dedup_lines_long(df.repartition(9, "line"), ["doc_id"]).collect())) == expected and len(expected) == 21


def test_status_order(spark):
    df = spark.createDataFrame([(["Timeout", "Unsupported file type: x"],), ([],), (["odd"],), (["Memory error"],)], "e array<string>")
    assert [r.c for r in df.select(Q.status_code(F.col("e")).alias("c")).collect()] == [415, 200, 500, 507]


def test_side_by_side_has_every_region(spark, sf_dir, tmp_path):
    """A region that no list in the code names has its column and its values."""
    from ledgerlens.plans import benchmark_queries

    for name in os.listdir(sf_dir):
        if name != "region.parquet":
            os.symlink(os.path.join(sf_dir, name), tmp_path / name)
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    region.replace({"ASIA": "NEW LAND"}, subset=["r_name"]).write.parquet(str(tmp_path / "region.parquet"))
    wide = benchmark_queries.side_by_side_pivot(spark, str(tmp_path))
    assert wide.columns == ["fiscal_year", "metric", "AFRICA", "AMERICA", "EUROPE", "MIDDLE_EAST", "NEW_LAND"]
    old = {(r.fiscal_year, r.metric): r.ASIA for r in benchmark_queries.side_by_side_pivot(spark, sf_dir).collect()}
    assert old and {(r.fiscal_year, r.metric): r.NEW_LAND for r in wide.collect()} == old


def test_a_line_that_a_chunk_cuts_is_read_where_it_is_whole(spark):
    from ledgerlens.operators import facts as Fa

    line = "Revenue: 11985 cr FY2001"
    texts = ["x" * n + "\n" + line for n in (11_984, 11_990, 11_996, 11_999, 12_000, 23_575, 23_590)]  # cut at every place of the line
    texts += ["y" * 11_000 + "\n\n" + "gross " + line + "\n" + "z" * 375 + "\n\n" + "w" * 2_000, "y" * 13_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = Fa.extract_documents(docs)
    got = {(r.doc_id, r.place, r.value, r.period) for r in out["metrics"].collect() if r.doc_id < 7}
    assert got == {(i, 0, "11985 cr FY2001", "FY2001") for i in range(7)}
    assert [(r.doc_id, r.metric) for r in out["metrics"].filter("doc_id >= 7").collect()] == [(7, "Gross Revenue")]
    # nothing but cut lines is left out: every line stands whole in the `lines` of some chunk, or no chunk holds it whole
    rng = random.Random(7)
    texts = ["\n".join(rng.choice("ab") * rng.randint(0, 30) for _ in range(rng.randint(1, 12))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = {}
    for r in C.chunk_paragraphs(docs, ["doc_id"], target=50, overlap=12).collect():
        held.setdefault(r.doc_id, []).extend(x.strip() for x in r.lines.split("\n"))
        assert r.lines in r.text
    for i, text in enumerate(texts):
        assert all(x in held[i] for x in text.split("\n") if 0 < len(x) <= 12), text

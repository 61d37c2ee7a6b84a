"""Text steps that run once per row: the same results, and each pattern searched once."""

import re

from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.functions import text as X
from ledgerlens.operators import chunking as C
from ledgerlens.operators import dedup as D
from ledgerlens.operators import facts as Fa

ODD = "\x01a $5 \x03\x05 b\x03\x04 Jan 5, 2020\x01"


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("o")).first().o


def test_matches_are_found_in_one_pass(spark):
    frame = spark.range(1).select(F.col("id").cast("string").alias("t"))
    for column, piece in ((X.canonical_dates, r"\d{1,2}/\d{1,2}/\d{2,4}\b"), (X.canonical_currencies, "[$€£₹¥])"), (X.canonical_percents, r"\s*%")):
        plan = frame.select(column(F.col("t")).alias("o"))._jdf.queryExecution().analyzed().toString()
        assert plan.count(piece) == 1


def test_control_characters_of_the_text_stay(spark):
    assert one(spark, X.canonical_dates, ODD) == "\x01a $5 \x03\x05 b\x03\x04 2020-01-05\x01"
    assert one(spark, X.canonical_currencies, ODD) == "\x01a USD 5 \x03\x05 b\x03\x04 Jan 5, 2020\x01"
    assert one(spark, X.canonical_thousands, "\x01") == "\x01" and one(spark, X.canonical_percents, None) is None


def test_first_letters_without_case(spark):
    assert one(spark, X.canonical_dates, "5 ſep 2020, 5 SEP 2020 or 5 deC 2020") == "5 ſep 2020, 2020-09-05 or 2020-12-05"
    assert one(spark, X.canonical_currencies, "ınr 5, İNR 5, aud 7 and ₹(8)") == "INR 5 İNR 5 AUD 7 and INR -8"


def test_strip_takes_every_space_off_the_ends(spark):
    ends = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    assert one(spark, X.strip, f"{ends}a{ends}b᠎{ends}") == f"a{ends}b᠎"
    assert one(spark, X.strip, ends) == "" and one(spark, X.strip, None) is None


def test_normalised_documents_can_be_planned_again(spark):
    """The chain of rewrites between two Python functions ran only as the first of its kind in a session."""
    docs = spark.createDataFrame([(1, "on Jan 5, 2020 for $ 1,000 at (5) %\nend")], "doc_id long, text string")
    for _ in range(3):
        out = D.normalise_documents(docs).select("doc_id", F.length("text").alias("n"), F.md5("text").alias("h"), "text")
        assert out.first().text == "on 2020-01-05 for USD 1000 at -5%\nend"


def test_chunks_that_fit_or_are_ruled_out_are_not_searched(spark, monkeypatch):
    def searched(c):
        return F.when(c.contains("long"), c).otherwise(F.raise_error(F.lit("looked at")))

    monkeypatch.setattr(C, "signal_text", searched)
    df = spark.createDataFrame([(["fits", "too long " * 3, "ruled out and not to be looked at"],)], "chunks array<string>")
    got = df.select(C.budget_chunks(F.col("chunks"), 20, 100, 2).alias("b")).first().b
    assert [(b.chosen, b.truncated) for b in got] == [(True, False), (True, True), (False, False)]


def test_packing_makes_each_value_once(spark):
    frame = spark.range(1).select(F.col("id").cast("string").alias("t"))
    plan = frame.select(C.packed_chunks(F.col("t")).alias("o"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("rtrim") <= 3  # of a paragraph, of what is handed on, of the end


def test_alias_patterns_without_those_that_hold_another():
    for aliases in (vocab.METRIC_ALIASES, vocab.COMPANY_ALIASES):
        words = [vocab.label_key(a) for names in aliases.values() for a in names]
        pattern = C.holds_one_of(words)
        assert len(pattern) < len(X.any_of(dict.fromkeys(words)))
        for word in words:
            assert re.search(pattern, f"the {word}s") and bool(re.search(pattern, word[1:])) == bool(re.search(X.any_of(words), word[1:]))


def test_single_blanks_are_not_matches(spark):
    assert not re.search(X.LOOSE_SPACE, "words of a line, with é and ~ and !") and "(?=[^!-~])" in str(X.squash(F.col("t")))
    assert one(spark, X.squash, " a  b\tc 　 d e f ") == "a b c d e f"


def test_prefix_patterns_are_searched_once(spark):
    frame = spark.range(1).select(F.col("id").cast("string").alias("t"))
    plan = frame.select(Fa.metric_from_line(F.col("t")).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert all(plan.count(pattern[:400]) == 1 for pattern in Fa.METRIC_PREFIXES)
    for line, want in (("Revenue: 5", ["Revenue", "5"]), ("\x01Revenue\x025", None), ("EBITDA (7) \x02", ["EBITDA", "(7) \x02"]), ("no alias 5", None)):
        assert one(spark, lambda c: Fa.prefixed(c, Fa.METRIC_PREFIXES[0]), line) == want

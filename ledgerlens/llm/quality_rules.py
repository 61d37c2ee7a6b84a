"""Quality rules judged per document and per host, in DataFrame functions only.

Every document is measured inside its row. Rule failures are then counted per host, the
failure rates are shrunk towards all hosts with a beta prior whose mean and strength come
from the hosts themselves, and the verdict on each host is joined back to its documents.

Defined cases: a null or empty text has no words and fails the base rules; a null host is
no host, so only the base rules judge its documents; an empty table gives an empty
result; repeated rows are judged one by one; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import bounded, split_words, stage

SEPARATORS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
RULES = ["few_words", "repeats", "symbols", "dup_lines"]
WEAKEST, STRONGEST = 1.0, 1e6  # bounds of the prior's strength, in documents


@dataclass(frozen=True)
class Prior:
    """Beta prior of one rule's failure rate: mean and strength (in documents)."""

    mean: float
    strength: float


def measures(df: DataFrame, text_col: str = "text", host_col: str = "source", **carried: Column) -> DataFrame:
    """Counts of each text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words; `carried` columns come along."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        *[c.alias(name) for name, c in carried.items()], F.col(host_col).alias("host"),
        split_words(F.col(text_col), SEPARATORS).alias("words"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("lines"),
    )
    n = F.size("words")
    last = n - 2  # number of three-word windows
    windows = F.arrays_zip(
        F.slice("words", 1, last).alias("a"), F.slice("words", 2, last).alias("b"), F.slice("words", 3, last).alias("c"),
        F.sequence(F.lit(0), n - 3).alias("at"),
    )
    rows = rows.select(
        *carried, "host", "n_symbols", n.cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, F.sort_array(windows)).alias("windows"),
    )

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

    repeated = F.filter("windows", lambda w, i: same(w, F.get("windows", i - 1)) | same(w, F.get("windows", i + 1)))
    rows = rows.withColumn("at", F.sort_array(F.transform(repeated, lambda w: w["at"]))).drop("windows")
    steps = F.zip_with(F.slice("at", 1, F.size("at") - 1), F.slice("at", 2, F.size("at") - 1), lambda x, y: F.least(y - x, F.lit(3)))
    covered = F.when(F.size("at") > 0, F.aggregate(steps, F.lit(3), lambda total, step: total + step)).otherwise(0)
    return rows.withColumn("n_repeat_words", covered.cast("long")).drop("at")


def failures(measured: DataFrame) -> DataFrame:
    """A flag for each rule, and base_failed from the two base rules."""
    few, repeats = F.col("n_words") < 50, F.col("n_repeat_words") * 100 > F.col("n_words") * 50
    return measured.withColumns({
        "few_words": few, "repeats": repeats, "symbols": F.col("n_symbols") * 10 > F.col("word_chars"),
        "dup_lines": F.col("n_dup_lines") * 10 > F.col("n_lines") * 3, "base_failed": few | repeats,
    })


def host_failures(flagged: DataFrame) -> DataFrame:
    """Documents and failures per rule of each host; a hot host is summed before the shuffle."""
    sums = [F.sum(F.col(r).cast("long")).alias(r) for r in RULES]
    return flagged.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), *sums)


def fit_priors(hosts: DataFrame) -> dict[str, Prior]:
    """Moments over all hosts, one row of sums: the spread of the rates beyond what chance alone gives."""
    total = F.sum("n")
    row = hosts.agg(
        total.alias("n"), F.count(F.lit(1)).alias("hosts"), *[F.sum(r).alias(f"{r}_k") for r in RULES],
        *[F.sum(F.col(r).cast("double") * F.col(r) / F.col("n")).alias(f"{r}_kk") for r in RULES],
    ).first()
    priors = {}
    for r in RULES:
        if not row["n"]:
            priors[r] = Prior(0.0, STRONGEST)
            continue
        mean = row[f"{r}_k"] / row["n"]
        spread = row[f"{r}_kk"] / row["n"] - mean * mean - mean * (1 - mean) * row["hosts"] / row["n"]
        strength = mean * (1 - mean) / spread - 1 if spread > 0 else STRONGEST
        priors[r] = Prior(mean, min(max(strength, WEAKEST), STRONGEST))
    return priors


def host_verdicts(hosts: DataFrame, priors: dict[str, Prior], max_rate: float = 0.5) -> DataFrame:
    """host, its shrunk failure rate per rule, and host_failed where any of them is above `max_rate`."""
    rates = {f"{r}_rate": (F.col(r) + p.mean * p.strength) / (F.col("n") + p.strength) for r, p in priors.items()}
    failed = F.greatest(*[F.col(c) for c in rates]) > max_rate
    return hosts.withColumns(rates).withColumn("host_failed", failed).select("host", *rates, "host_failed")


def _verdicts(flagged: DataFrame, max_rate: float) -> DataFrame:
    hosts = stage(host_failures(flagged), "hosts")
    return stage(host_verdicts(hosts, fit_priors(hosts), max_rate).select("host", "host_failed"), "verdicts")


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """doc_id, host, the measures, base_failed, host_failed and kept for every row.

    A document is kept if it passes the base rules and its host's shrunk failure rates are
    all at most `max_rate`.
    """
    flagged = stage(failures(measures(df, text_col, host_col, doc_id=F.col(id_col))), "rules")
    host_failed = F.coalesce("host_failed", F.lit(False))
    judged = flagged.join(_verdicts(flagged, max_rate), "host", "left")
    return judged.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed",
        host_failed.alias("host_failed"), (~F.col("base_failed") & ~host_failed).alias("kept"),
    )


def kept_documents(df: DataFrame, text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The rows that `quality_rules` keeps, with all their columns.

    Each text is measured once: rows, hosts and flags are written together, the hosts are
    judged from the narrow columns, and no text is shuffled unless the host table is beyond
    the broadcast bound.
    """
    judged = stage(failures(measures(df, text_col, host_col, row=F.struct(*df.columns))).select("row", "host", "base_failed", *RULES), "judged")
    bad = _verdicts(judged, max_rate).filter("host_failed").select("host", F.lit(True).alias("bad"))
    passed = judged.filter(~F.col("base_failed")).select("row", "host")
    return passed.join(bounded(bad), "host", "left").filter(F.col("bad").isNull()).select("row.*")

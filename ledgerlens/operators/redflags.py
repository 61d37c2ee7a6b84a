"""Red flags: numeric rules on metrics, keyword rules on sections, merge and roll-up.

Metrics arrive long (request_id, pos, metric, current_raw, prior_raw, is_number). One
aggregate per request picks the first metric of each concept; all numeric rules are
then columns of that row. Keyword rules are columns of the section row. No rule joins.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.functions.text import (
    first_supported_snippet, fixed, let, metric_key, parse_number, plain_double, squash, word_key,
)
from ledgerlens.operators.grounding import grounded, proof_tokens, request_pieces, tokens_suffice
from ledgerlens.operators.ordering import key_hash
from ledgerlens.session import cut_lineage

FLAG_FIELDS = ["category", "title", "severity", "description", "evidence", "recommendation"]


def severity_rank(c: Column) -> Column:
    rank = F.lit(0)
    for i, name in enumerate(vocab.SEVERITIES, start=1):
        rank = F.when(c == name, i).otherwise(rank)
    return rank


# --- concepts ------------------------------------------------------------------


def concept_table(spark, concepts=vocab.RISK_CONCEPTS) -> DataFrame:
    """Metric-name key -> concept; a fixed table of a few dozen rows."""
    rows = [("".join(ch for ch in name if ch.isalnum()), concept) for concept, names in concepts.items() for name in names]
    return spark.createDataFrame(rows, "metric_key string, concept string")


def pick_concepts(metrics: DataFrame, keys: list[str], concepts=vocab.RISK_CONCEPTS) -> DataFrame:
    """One row per request with a struct per concept: its first metric in input order."""
    known = metrics.withColumn("metric_key", metric_key(F.col("metric"))).join(
        F.broadcast(concept_table(metrics.sparkSession, concepts)), "metric_key"
    )
    value = F.struct(
        parse_number(F.col("current_raw")).alias("cur"), parse_number(F.col("prior_raw")).alias("prior"),
        "current_raw", "prior_raw", "is_number",
    )
    known = known.withColumn("m", value)
    picks = [F.min_by("m", F.when(F.col("concept") == c, F.col("pos"))).alias(c) for c in concepts]
    return known.groupBy(key_hash(*keys), *keys).agg(*picks).select(*keys, *concepts)


# --- evidence --------------------------------------------------------------------


def quoted(raw: Column, is_number: Column) -> Column:
    """Numbers as they came, strings in quotes."""
    escaped = F.regexp_replace(raw, r"([\\'])", r"\\$1")
    text = F.when(raw.contains("'") & ~raw.contains('"'), F.concat(F.lit('"'), raw, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), escaped, F.lit("'"))
    )
    return F.coalesce(F.when(is_number, raw).otherwise(text), F.lit("None"))


def evidence(label: str | Column, current: Column, prior: Column | None = None, change: Column | None = None, unit="%") -> Column:
    """"Label: current=.., prior=.., change=..%." from texts; `change` comes formatted."""
    head = F.concat(label if isinstance(label, Column) else F.lit(label), F.lit(": current="), current)
    parts = [head]
    if prior is not None:
        parts.append(F.concat(F.lit("prior="), prior))
    if change is not None:
        parts.append(F.concat(F.lit("change="), change, F.lit(unit)))
    return F.concat(F.concat_ws(", ", *parts), F.lit("."))


def _raw(concept: str) -> tuple[Column, Column]:
    c = F.col(concept)
    prior = F.when(c["prior_raw"].isNotNull(), quoted(c["prior_raw"], c["is_number"]))
    return quoted(c["current_raw"], c["is_number"]), prior


def change_pct(concept: str) -> Column:
    c = F.col(concept)
    return F.when(c["prior"] != 0, F.try_divide(c["cur"] - c["prior"], F.abs(c["prior"])) * 100)


# --- numeric rules -----------------------------------------------------------------

SLOTS = 4  # most formatted numbers in one flag


class _Numbers:
    """Numbers of one flag's sentences. Rules write slot marks; the texts are put in once
    per found flag, so that the formatting is not repeated in every rule."""

    def __init__(self):
        self.values: list[Column] = []

    def __call__(self, number: Column) -> Column:
        self.values.append(number.cast("double"))
        return F.lit(f"\x01{len(self.values) - 1}\x02")

    def column(self) -> Column:
        missing = [F.lit(None).cast("double")] * (SLOTS - len(self.values))
        return F.array(*self.values, *missing)


def _fill_slots(name: str) -> Column:
    """Slot marks in a text column replaced by the texts of `numbers`."""
    out = f"`{name}`"
    for i in range(SLOTS):
        out = f"replace({out}, '\x01{i}\x02', coalesce(texts[{i}], ''))"
    return F.expr(out).alias(name)


def _flag(
    when: Column, category: str, title: str, severity: Column | str, description: Column | str, proof: Column,
    numbers: _Numbers | None = None,
) -> Column:
    def text(c):
        return c if isinstance(c, Column) else F.lit(c)

    return F.when(
        when,
        F.struct(
            F.lit(category).alias("category"), F.lit(title).alias("title"), text(severity).alias("severity"),
            text(description).alias("description"), proof.alias("evidence"),
            F.lit(vocab.RULE_ADVICE[title]).alias("recommendation"), (numbers or _Numbers()).column().alias("numbers"),
        ),
    )


def _decline(concept: str, name: str, category: str, title: str, t: dict) -> Column:
    chg = change_pct(concept)
    severity = F.when(chg <= t["decline_high_pct"], "High").when(chg <= t["decline_medium_pct"], "Medium").otherwise("Low")
    n = _Numbers()
    words = F.concat(F.lit(f"{name} declined by "), n(F.abs(chg)), F.lit("% versus the prior period."))
    return _flag(chg < 0, category, title, severity, words, evidence(name, *_raw(concept), n(chg)), n)


def numeric_rules(t: dict = vocab.RULE_THRESHOLDS) -> list[Column]:
    """All numeric rules as nullable flag structs over the concept columns, in report order."""

    def cur(concept):
        return F.col(concept)["cur"]

    def prior(concept):
        return F.col(concept)["prior"]

    rules = [_decline("revenue", "Revenue", vocab.REVENUE, "Revenue decline", t)]

    growth, growth_prior = cur("revenue_growth"), prior("revenue_growth")
    drop = growth_prior - growth
    n = _Numbers()
    rules.append(
        _flag(
            growth < growth_prior - t["revenue_slowdown_pp"], vocab.REVENUE, "Revenue slowdown",
            F.when(drop < 10, "Medium").otherwise("High"),
            F.concat(F.lit("Revenue growth slowed by "), n(drop), F.lit(" percentage points versus the prior period.")),
            evidence("Revenue growth", *_raw("revenue_growth"), n(growth - growth_prior), "pp"), n,
        )
    )
    rules += [
        _decline("net_profit", "Net profit", vocab.PROFITABILITY, "Net profit decline", t),
        _decline("ebitda", "EBITDA", vocab.PROFITABILITY, "EBITDA decline", t),
        _decline("eps", "EPS", vocab.PROFITABILITY, "EPS decline", t),
        _margin_rule(t),
    ]

    ratio = cur("current_ratio")
    ratio_proof = evidence("Current ratio", _raw("current_ratio")[0])
    low = ratio < t["current_ratio_min"]
    rules += [
        _flag(low, vocab.LIQUIDITY, "Low current ratio", F.when(ratio < 0.8, "High").otherwise("Medium"),
              f"Current ratio is below the configured minimum threshold of {t['current_ratio_min']:.2f}.", ratio_proof),
        _flag(~low & (ratio < t["current_ratio_warning"]), vocab.LIQUIDITY, "Weak liquidity cushion", "Low",
              "Current ratio is above the minimum but below the configured warning threshold.", ratio_proof),
    ]
    ocf, profit = cur("operating_cash_flow"), cur("net_profit")
    ocf_proof = evidence("Operating cash flow", _raw("operating_cash_flow")[0])
    conversion = F.try_divide(ocf, profit)
    rules += [
        _flag(ocf < 0, vocab.LIQUIDITY, "Negative operating cash flow", "High",
              "Operating cash flow is negative for the period.", ocf_proof),
        _flag((profit > 0) & (conversion >= 0) & (conversion < t["cash_conversion_warning"]), vocab.LIQUIDITY,
              "Weak operating cash conversion", "Medium",
              "Operating cash flow is materially lower than reported net profit.",
              F.concat_ws(" ", ocf_proof, evidence("Net profit", plain_double(profit)))),
    ]

    leverage = cur("debt_to_equity")
    leverage_proof = evidence("Debt-to-equity ratio", _raw("debt_to_equity")[0])
    high = leverage > t["debt_to_equity_high"]
    cover = cur("interest_coverage")
    interest, revenue = cur("interest_expense"), cur("revenue")
    burden = F.when(revenue > 0, F.try_divide(F.abs(interest), revenue))
    n = _Numbers()
    rules += [
        _flag(high, vocab.DEBT, "High debt-to-equity ratio", F.when(leverage >= 3.0, "Critical").otherwise("High"),
              f"Debt-to-equity ratio exceeds the configured high-risk threshold of {t['debt_to_equity_high']:.2f}.", leverage_proof),
        _flag(~high & (leverage > t["debt_to_equity_warning"]), vocab.DEBT, "Elevated debt-to-equity ratio", "Medium",
              f"Debt-to-equity ratio exceeds the configured warning threshold of {t['debt_to_equity_warning']:.2f}.", leverage_proof),
        _flag(cover < t["interest_coverage_min"], vocab.DEBT, "Weak interest coverage",
              F.when(cover <= 0, "Critical").otherwise("High"),
              f"Interest coverage is below the configured minimum threshold of {t['interest_coverage_min']:.2f}.",
              evidence("Interest coverage", _raw("interest_coverage")[0])),
        _flag(burden > t["interest_burden_warning"], vocab.DEBT, "High interest burden",
              F.when(burden >= 0.2, "High").otherwise("Medium"),
              "Interest or finance cost is high relative to reported revenue.",
              F.concat_ws(" ", evidence("Interest expense", plain_double(interest)), evidence("Revenue", plain_double(revenue)),
                          F.concat(F.lit("Interest burden="), n(burden * 100), F.lit("%."))), n),
    ]

    liab_chg, n = change_pct("total_liabilities"), _Numbers()
    rules += [
        _flag(liab_chg >= t["liability_growth_warning_pct"], vocab.BALANCE_SHEET, "Rising liabilities",
              F.when(liab_chg >= t["liability_growth_high_pct"], "High").otherwise("Medium"),
              F.concat(F.lit("Total liabilities increased by "), n(liab_chg), F.lit("% versus the prior period.")),
              evidence("Total liabilities", *_raw("total_liabilities"), n(liab_chg)), n),
        _decline("total_assets", "Total assets", vocab.BALANCE_SHEET, "Falling assets", t),
    ]

    assets, liabilities = cur("total_assets"), cur("total_liabilities")
    equity = F.coalesce(cur("equity"), assets - liabilities)
    weak = F.coalesce(equity <= 0, F.lit(False))
    n = _Numbers()
    share = F.when(assets > 0, F.try_divide(liabilities, assets))
    sheet = F.concat(
        F.concat_ws(
            ", ",
            *[F.concat(F.lit(f"{name}="), plain_double(v))
              for name, v in (("total_assets", assets), ("total_liabilities", liabilities), ("equity", equity))],
        ),
        F.lit("."),
    )
    rules += [
        _flag(weak, vocab.BALANCE_SHEET, "Weak equity base", "Critical", "Equity is zero or negative based on supplied metrics.", sheet),
        _flag(~weak & (share > t["liabilities_to_assets_warning"]), vocab.BALANCE_SHEET, "High liabilities relative to assets",
              F.when(share >= 0.9, "High").otherwise("Medium"),
              "Liabilities represent a high share of total assets based on the supplied metrics.",
              F.concat(sheet, F.lit(" Liabilities/assets="), n(share * 100), F.lit("%.")), n),
    ]
    return rules


def _margin_rule(t: dict) -> Column:
    """EBITDA margin when the metric is present at all, else the net profit margin."""
    use_ebitda = F.col("ebitda").isNotNull()
    base = F.when(use_ebitda, F.col("ebitda")).otherwise(F.col("net_profit"))
    revenue = F.col("revenue")
    valid = (revenue["cur"] > 0) & (revenue["prior"] > 0)
    now = F.when(valid, F.try_divide(base["cur"], revenue["cur"])) * 100
    before = F.when(valid, F.try_divide(base["prior"], revenue["prior"])) * 100
    lost = before - now
    label, n = F.when(use_ebitda, "EBITDA").otherwise("Net profit"), _Numbers()
    base_prior = F.when(base["prior_raw"].isNotNull(), quoted(base["prior_raw"], base["is_number"]))
    proof = F.concat_ws(
        " ",
        F.concat(label, F.lit(" margin: current="), n(now), F.lit("%, prior="), n(before), F.lit("%.")),
        evidence("Revenue", *_raw("revenue")),
        evidence(label, quoted(base["current_raw"], base["is_number"]), base_prior),
    )
    words = F.concat(label, F.lit(" margin compressed by "), n(lost), F.lit(" percentage points versus the prior period."))
    return _flag(lost >= t["margin_compression_pp"], vocab.PROFITABILITY, "Margin compression",
                 F.when(lost >= 5, "High").otherwise("Medium"), words, proof, n)


def numeric_flags(metrics: DataFrame, keys: list[str], thresholds: dict = vocab.RULE_THRESHOLDS) -> DataFrame:
    """Flags of all numeric rules: keys, pos (report order) and the flag fields."""
    wide = pick_concepts(metrics, keys)
    rules = [F.when(r.isNotNull(), F.struct(F.lit(i).cast("long").alias("pos"), r.alias("f"))) for i, r in enumerate(numeric_rules(thresholds))]
    hits = wide.select(*keys, F.explode(F.array_compact(F.array(*rules))).alias("r"))
    texts = F.transform("numbers", lambda x: fixed(x, 2)).alias("texts")
    found = hits.select(*keys, "r.pos", "r.f.*").select("*", texts)
    return found.select(*keys, "pos", *[_fill_slots(c) if c in ("description", "evidence") else c for c in FLAG_FIELDS])


# --- keyword rules ------------------------------------------------------------------


def literal_starts(pattern: str) -> list[str] | None:
    """Literal beginnings of a pattern's alternatives; null when one has none.

    Text without any of them cannot match, and a plain substring search is much cheaper
    than the pattern.
    """
    parts, depth, current = [], 0, ""
    for ch in pattern:
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += ch
    starts = [re.match(r"[a-z0-9 ]*", part.removeprefix(r"\b"))[0] for part in [*parts, current]]
    return starts if all(starts) else None


def fold_case(c: Column) -> Column:
    """Lower case in which the letters that match s, i and k without case are those letters."""
    for odd, letter in (("ſ", "s"), ("ı", "i"), ("İ", "i"), ("K", "k")):
        c = F.replace(c, F.lit(odd), F.lit(letter))
    return F.lower(c)


def keyword_flags(sections: DataFrame, keys: list[str], rules=vocab.KEYWORD_RULES) -> DataFrame:
    """Flags of (keys, pos, section, content) rows; substring searches guard all patterns.

    Each section is judged within its own row, sections in order and rules in order.
    """

    def possible(low: Column, pattern: str) -> Column:
        starts = literal_starts(pattern)
        return F.lit(True) if starts is None else reduce(or_, [low.contains(s) for s in starts])

    def found(i: int, rule: tuple, low: Column) -> Column:
        category, title, severity, pattern, advice = rule
        words = f"The supplied document section contains language matching {title.lower()}."
        return F.struct(
            F.lit(i).alias("rule_pos"), F.lit(category).alias("category"), F.lit(title).alias("title"),
            F.lit(severity).alias("severity"), F.lit(words).alias("description"),
            F.when(possible(low, pattern), first_supported_snippet(F.col("content"), pattern)).alias("snippet"),
            F.lit(advice).alias("recommendation"),
        )

    # the folded text is named once per row; every rule searches that value
    hits = let(
        fold_case(F.col("content")),
        lambda low: F.filter(F.array(*[found(i, r, low) for i, r in enumerate(rules)]), lambda h: h["snippet"].isNotNull()),
    )
    hits = sections.select(*keys, "pos", "section", F.explode(hits).alias("h"))
    order = F.lit(len(numeric_rules())) + F.col("pos") * len(rules) + F.col("h.rule_pos")
    return hits.select(
        *keys, order.cast("long").alias("pos"), "h.category", "h.title", "h.severity", "h.description",
        F.concat(F.col("section"), F.lit(": "), F.col("h.snippet")).alias("evidence"), "h.recommendation",
    )


# --- canonical forms ------------------------------------------------------------------


def canonical_category(c: Column) -> Column:
    def pick(text: Column) -> Column:
        out = F.lit(vocab.OTHER)
        for name, words in reversed(vocab.CATEGORY_KEYWORDS):
            out = F.when(reduce(or_, [text.contains(w) for w in words]), name).otherwise(out)
        table = F.create_map(*[F.lit(x) for pair in vocab.CATEGORY_VARIANTS.items() for x in pair])
        return F.coalesce(F.try_element_at(table, text), out)

    return let(word_key(c), pick)


def canonical_severity(c: Column) -> Column:
    """The canonical level, or null for an unknown word (the row is then rejected)."""
    table = F.create_map(*[F.lit(x) for pair in vocab.SEVERITY_WORDS.items() for x in pair])
    return F.try_element_at(table, word_key(c))


def check_flags(flags: DataFrame) -> DataFrame:
    """Flags of another source in canonical form, with a reason for unusable ones."""
    df = flags.withColumn("category", canonical_category(F.col("category"))).withColumn(
        "_severity", canonical_severity(F.col("severity"))
    )
    bad_title = ~F.length(F.trim("title")).between(3, 140)
    blank = reduce(or_, [F.coalesce(F.trim(c), F.lit("")) == "" for c in ("description", "evidence", "recommendation")])
    reason = F.when(F.col("_severity").isNull(), "unknown severity").when(F.coalesce(bad_title, F.lit(True)), "title length").when(blank, "empty field")
    df = df.withColumn("reason", reason)
    return df.withColumn("severity", F.coalesce("_severity", "severity")).drop("_severity")


# --- dedup, merge, roll-up --------------------------------------------------------------


def exact_dedup(flags: DataFrame, keys: list[str]) -> DataFrame:
    """One flag per category, title and start of evidence: the first of the highest severity."""
    marks = [F.col("category").alias("_c"), word_key(F.col("title")).alias("_t"), F.left(word_key(F.col("evidence")), F.lit(140)).alias("_e")]
    best = F.min_by(F.struct(*FLAG_FIELDS), F.struct((-severity_rank(F.col("severity"))).alias("s"), "pos"))
    marked = flags.select("*", *marks)
    cell = [*keys, "_c", "_t", "_e"]
    return marked.groupBy(key_hash(*cell), *cell).agg(F.min("pos").alias("pos"), best.alias("f")).select(*keys, "pos", "f.*")


STANDING = [f for f in FLAG_FIELDS if f not in ("category", "evidence")]


def _cells(flags: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Flags with the cell they are merged in: the request, the category and the words of the title."""
    return flags.withColumn("_t", word_key(F.col("title"))), [*keys, "category", "_t"]


def standing(flags: DataFrame, keys: list[str]) -> DataFrame:
    """What `merge` leaves, without the evidence: the first flag of the highest severity per category and title.

    One aggregate; enough for counts and roll-ups.
    """
    marked, cell = _cells(flags, keys)
    first = F.min_by(F.struct(*STANDING), F.struct(-severity_rank(F.col("severity")), "pos"))
    return marked.groupBy(key_hash(*cell), *cell).agg(first.alias("b")).select(*keys, "category", "b.*")


def merge(flags: DataFrame, keys: list[str]) -> DataFrame:
    """One flag per category and title, as folding in input order would leave it.

    The first flag of the highest severity stands; a longer evidence that comes later
    replaces its evidence. One aggregate, no ordered pass over a group, stored once. It
    leaves open only cells whose longest evidence stands before that flag while milder
    flags come after it; `flags` is read again for those, and not where there are none.
    """
    marked, cell = _cells(flags, keys)
    rank = severity_rank(F.col("severity"))
    size = F.coalesce(F.length("evidence"), F.lit(-1))
    milder = range(len(vocab.SEVERITIES))  # every rank but the highest
    found = marked.groupBy(key_hash(*cell), *cell).agg(
        F.min_by(F.struct(F.col("pos").alias("base_pos"), rank.alias("rank"), *STANDING), F.struct(-rank, "pos")).alias("b"),
        F.min_by("evidence", F.struct(-rank, -size, "pos")).alias("own"),  # no flag of the highest severity comes before the first
        F.min_by(F.struct("pos", "evidence"), F.struct(-size, "pos")).alias("longest"),
        *[F.max(F.when(rank == r, F.col("pos"))).alias(f"last_{r}") for r in milder],
    )
    behind = reduce(or_, [F.coalesce((F.col("b.rank") > r) & (F.col(f"last_{r}") >= F.col("b.base_pos")), F.lit(False)) for r in milder])
    whole = F.col("longest.pos") >= F.col("b.base_pos")
    evidence = F.when(whole, F.col("longest.evidence")).otherwise(F.col("own"))
    stored = cut_lineage(found.select(*cell, "b", evidence.alias("evidence"), (~whole & behind).alias("open")))
    merged, unsure = stored.filter(~F.col("open")).drop("open"), stored.filter("open").select(*cell, "b")
    if not unsure.isEmpty():
        same = reduce(and_, [F.col(f"f.{c}").eqNullSafe(F.col(f"u.{c}")) for c in cell])
        later = marked.alias("f").join(unsure.alias("u"), same & (F.col("f.pos") >= F.col("u.b.base_pos"))).select("f.pos", "f.evidence", "u.*")
        longest = F.min_by("evidence", F.struct((-F.coalesce(F.length("evidence"), F.lit(-1))).alias("n"), "pos"))
        merged = merged.unionByName(later.groupBy(*cell, "b").agg(longest.alias("evidence")))
    return merged.select(*keys, "category", *[F.col("b")[f].alias(f) for f in STANDING], "evidence")


def display_order() -> list[Column]:
    """Severity first, then category and title."""
    return [severity_rank(F.col("severity")).desc(), F.col("category"), F.col("title")]


def filter_flags(flags: DataFrame, category: str = "all", severity: str = "all") -> DataFrame:
    if category != "all":
        flags = flags.filter(F.col("category") == category)
    return flags if severity == "all" else flags.filter(F.col("severity") == severity)


def risk_summary(requests: DataFrame, flags: DataFrame, keys: list[str]) -> DataFrame:
    """Overall risk, counts and summary sentence per request, requests without flags included."""
    rank = severity_rank(F.col("severity"))
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in vocab.SEVERITIES]
    by_request = flags.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_flags"), F.max(rank).alias("max_rank"), F.count_if(rank >= 3).alias("n_high_or_critical"),
        *counts, F.array_sort(F.collect_set("category")).alias("categories"),
    )
    names = [f"n_{s.lower()}" for s in vocab.SEVERITIES]
    df = requests.select(*keys).join(by_request, keys, "left").na.fill(0, ["n_flags", "max_rank", "n_high_or_critical", *names])
    overall = (
        F.when((F.col("max_rank") >= 4) | (F.col("n_high_or_critical") >= 3), "Critical")
        .when(F.col("max_rank") == 3, "High").when(F.col("max_rank") == 2, "Medium").otherwise("Low")
    )
    parts = [
        F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(f" {s.lower()}"))) for n, s in zip(names, vocab.SEVERITIES)
    ]
    sentence = F.concat(
        F.lit("Identified "), F.col("n_flags").cast("string"), F.lit(" red flag(s): "), F.concat_ws(", ", *parts), F.lit(".")
    )
    return df.select(
        *keys, "n_flags", *names, "n_high_or_critical",
        F.coalesce("categories", F.array().cast("array<string>")).alias("categories"), overall.alias("overall_risk"),
        F.when(F.col("n_flags") == 0, vocab.NO_FLAGS).otherwise(sentence).alias("summary"),
    )


# --- grounding of other sources -----------------------------------------------------------


def is_grounded(proof: Column, corpus: Column) -> Column:
    """Whether evidence is traceable to one text; both are `word_key` forms. Large requests: `grounding.grounded`."""

    def verdict(tokens: Column) -> Column:
        numbers = F.filter(tokens, lambda w: w.rlike("[0-9]"))
        found = [F.size(F.filter(ws, lambda w: corpus.contains(w))) for ws in (tokens, numbers)]
        return tokens_suffice(F.size(tokens), found[0], F.size(numbers), found[1])

    return F.when(F.coalesce(proof, F.lit("")) == "", False).when(corpus.contains(proof), True).otherwise(let(proof_tokens(proof), verdict))


def analyse(requests: DataFrame, metrics: DataFrame, sections: DataFrame, others: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole chain for many requests: (merged flags, one summary row per request)."""
    keys = ["request_id"]
    rule_flags = exact_dedup(numeric_flags(metrics, keys).unionByName(keyword_flags(sections, keys)), keys)
    rule_flags = cut_lineage(rule_flags)  # read for the corpus and twice for the merge
    flags = rule_flags
    if others is not None:
        usable = grounded(check_flags(others).filter("reason IS NULL").drop("reason"), request_pieces(requests, metrics, sections, rule_flags))
        usable = cut_lineage(usable)

        def placed(df: DataFrame, source: int) -> DataFrame:
            return df.withColumn("pos", F.struct(F.lit(source).alias("source"), F.col("pos").cast("long").alias("pos")))

        # every flag of another source stands after every rule flag
        flags = placed(rule_flags, 0).unionByName(placed(usable, 1), allowMissingColumns=True)
    merged = merge(flags, keys)
    return merged, risk_summary(requests, standing(flags, keys), keys)

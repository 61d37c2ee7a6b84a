"""Text columns: whitespace, keys, canonical numbers, dates, currencies, names.

Every function maps columns to a column, so it stays inside one stage of a scan.
Character classes are spelled out (or flagged Unicode) because the default regex
classes are ASCII only.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens import vocab

SPACE = r"[\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# all runs but a single blank, which may stay; plain characters are told by one range, as the class of spaces is dear
LOOSE_SPACE = f" (?=[^!-~]){SPACE}+|(?=[^ -~]){SPACE}+"
SPACES = "".join(c for c in map(chr, range(0x3001)) if re.match(SPACE, c))
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
NUMBER = r"\(?[-+]?\d[\d,]*(?:\.\d+)?\)?"


def any_of(words) -> str:
    return "(?:" + "|".join(words) + ")"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name a value once and use it many times in `body`, without copying its expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_per_key(items: Column) -> Column:
    """An array of structs (k, t) without those whose k came before, in order.

    Sorted by key and place, so that a long list costs n log n and not n squared.
    """

    def pick(listed: Column) -> Column:
        def firsts(placed: Column) -> Column:
            starts = F.filter(placed, lambda e, j: (j == 0) | (F.get(placed, j - 1)["k"] != e["k"]))
            return F.transform(F.sort_array(F.transform(starts, lambda e: e["i"])), lambda i: F.get(listed, i))

        return let(F.sort_array(F.transform(listed, lambda e, i: F.struct(e["k"].alias("k"), i.alias("i")))), firsts)

    return let(items, pick)


def strip(c: Column) -> Column:
    # two trims: of `btrim` over a Python function Spark loses that function when plans are joined
    return F.rtrim(F.ltrim(c, F.lit(SPACES)), F.lit(SPACES))


def squash(c: Column) -> Column:
    """Runs of whitespace become one space; no leading or trailing space."""
    return F.trim(F.regexp_replace(c, LOOSE_SPACE, " "))


def blank_to_null(c: Column) -> Column:
    return let(strip(c), lambda text: F.when(F.length(text) > 0, text))


def word_key(c: Column) -> Column:
    """Lower case, everything else than a-z and 0-9 as single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def metric_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def split_lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK, -1)


def clean_page(c: Column) -> Column:
    out = F.regexp_replace(c, "\x0c", " ")
    out = F.regexp_replace(out, "[ \t]+", " ")
    return strip(F.regexp_replace(out, "\n{3,}", "\n\n"))


def approx_tokens(c: Column) -> Column:
    return F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4).cast("int")


def rewrite(c: Column, pattern: str, replacement: Callable[[Column], Column], mark: str = "$0") -> Column:
    """Replace each match of `pattern` by an expression of the matched text, or of the groups that `mark` names.

    One pass puts each match between two control characters; the pieces are then told by
    their place. A text that holds such a character itself carries others in its stead meanwhile.
    """

    def weave(marked: Column) -> Column:
        pieces = F.transform(
            F.split(marked, "\x01", -1), lambda piece, i: F.when(i % 2 == 1, F.coalesce(replacement(piece), F.lit(""))).otherwise(piece)
        )
        return F.when(marked.contains("\x01"), F.array_join(pieces, "")).otherwise(marked)

    def swap(text: Column, *pairs: tuple[str, str]) -> Column:
        for old, new in pairs:
            text = F.replace(text, F.lit(old), F.lit(new))
        return text

    # no lambda looks at a variable of one around it: Spark then lost Python functions of the chain
    free = swap(c, ("\x03", "\x03\x04"), ("\x01", "\x03\x05"))
    return swap(let(F.regexp_replace(free, pattern, f"\x01{mark}\x01"), weave), ("\x03\x05", "\x01"), ("\x03\x04", "\x03"))


# --- numbers ---------------------------------------------------------------


def parse_number(c: Column) -> Column:
    """First number of a financial string; "(50)" is negative, scale words are ignored."""

    def parse(text: Column) -> Column:
        bare = F.translate(F.regexp_replace(text, ",", ""), "()", "  ")
        number = F.regexp_extract(bare, r"[-+]?\d*\.?\d+(?:e[-+]?\d+)?", 0).try_cast("double")
        in_brackets = text.startswith("(") & text.contains(")")
        missing = text.isin("", "na", "n/a", "none", "null", "-", "--")
        return F.when(~missing, F.when(in_brackets, -F.abs(number)).otherwise(number))

    return let(F.lower(strip(c)), parse)


def canonical_number(c: Column) -> Column:
    """"(1,234.50)" -> "-1234.5"; text that is no number comes back unchanged."""

    def shorten(raw: Column) -> Column:
        digits = F.regexp_replace(F.translate(raw, "(),", ""), r"^\+", "")
        whole = F.regexp_replace(digits, r"^(-?)0+(?=\d)", "$1")
        short = F.regexp_replace(whole, r"\.0*$|(?<=\.\d{0,60}[1-9])0+$", "")
        negative = raw.startswith("(") & raw.endswith(")") & ~digits.startswith("-")
        return F.when(
            digits.rlike(r"^-?\d+(\.\d+)?$"), F.when(negative, F.concat(F.lit("-"), short)).otherwise(short)
        ).otherwise(raw)

    return let(strip(c), shorten)


def plain_double(c: Column) -> Column:
    """A double in plain digits with at least one decimal ("900.0", never "9.0E2")."""

    def plain(x: Column) -> Column:
        text = x.cast("string")
        digits = F.regexp_replace(text.try_cast("decimal(38,18)").cast("string"), r"(\.\d+?)0+$", "$1")
        size = F.abs(x)
        return F.when((size >= 1e-4) & (size < 1e16) | (x == 0), digits).otherwise(text)

    return let(c, plain)


def _scaled(x: Column, decimals: int) -> Column:
    """|x| * 10^decimals rounded half to even on the exact binary value, as a long.

    The product of a double and a small power of ten is taken with its rounding error
    (split product), so that a decimal tie is judged by the true value of the double.
    """
    scale = F.lit(float(10**decimals))

    def judge(p: Column) -> Column:
        whole = F.floor(p["prod"]).cast("long")
        rest = p["prod"] - whole
        up = (rest > 0.5) | ((rest == 0.5) & ((p["err"] > 0) | ((p["err"] == 0) & (whole % 2 == 1))))
        return whole + up.cast("long")

    def split(a: Column) -> Column:
        high = a * 134217729.0 - (a * 134217729.0 - a)
        prod = a * scale
        return let(F.struct(prod.alias("prod"), ((high * scale - prod) + (a - high) * scale).alias("err")), judge)

    return let(F.abs(x), split)


def fixed(c: Column, decimals: int) -> Column:
    """Text with a fixed number of decimals, rounded on the exact binary value."""

    def text(x: Column) -> Column:
        sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")  # minus zero keeps its sign
        digits = let(
            _scaled(x, decimals),
            lambda q: F.format_string(f"%s%d.%0{decimals}d", sign, F.floor(q / 10**decimals), q % 10**decimals),
        )
        return F.when(F.abs(x) < 1e12, digits).otherwise(F.format_string(f"%.{decimals}f", x))

    return let(c.cast("double"), text)


def round_exact(c: Column, decimals: int) -> Column:
    """Rounding half to even on the exact binary value; keeps the sign of zero."""
    return let(
        c.cast("double"),
        lambda x: F.when(F.abs(x) < 1e12, F.signum(x) * (_scaled(x, decimals) / float(10**decimals))).otherwise(x),
    )


# --- canonical forms inside running text ------------------------------------

def starts_with_one_of(chars: str, others: str = "") -> str:
    """A look at the next character, cheaper than trying every alternative that begins with one of `chars`.

    Upper and lower case, and the letters that match s and i without case.
    """
    both = dict.fromkeys(chars.upper() + chars.lower())
    odd = "ſ" * ("s" in both) + "ıİ" * ("i" in both)
    return f"(?=[{''.join(both)}{odd}{others}])"


CURRENCY_PATTERN = (
    starts_with_one_of("".join(code[0] for code in vocab.REWRITTEN_CODES) + "".join(vocab.CURRENCY_SYMBOLS)) +
    f"(?iu)({'|'.join(vocab.REWRITTEN_CODES)}|[{''.join(vocab.CURRENCY_SYMBOLS)}])"
    f"{SPACE}*({NUMBER})({SPACE}*{any_of(vocab.SCALE_WORDS)})?"
)
# the first character is looked at before what stands before it, which is dearer
PERCENT_PATTERN = rf"(?U)(?=[-+(\d])(?<![\w.])({NUMBER})\s*%"
THOUSANDS_PATTERN = r"(?U)(?=[-+(\d])(?<![\w.])\(?[-+]?\d{1,3}(?:,\d{3})+(?:\.\d+)?\)?(?![\w.])"
DATE_PATTERN = (
    "(?U)" + starts_with_one_of("JFMASOND", r"\d") + rf"(?i:\b{vocab.MONTH_PATTERN}\s+\d{{1,2}},?\s+\d{{4}}\b"
    rf"|\b\d{{1,2}}\s+{vocab.MONTH_PATTERN}\s+\d{{4}}\b"
    r"|\b\d{4}-\d{1,2}-\d{1,2}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b)"
)


def canonical_currencies(c: Column) -> Column:
    symbols = F.create_map(*[F.lit(x) for pair in vocab.CURRENCY_SYMBOLS.items() for x in pair])

    def replacement(hit: Column) -> Column:
        def form(parts: Column) -> Column:
            mark = F.upper(F.get(parts, F.lit(0)))
            number = canonical_number(F.get(parts, F.lit(1)))
            scale = blank_to_null(F.get(parts, F.lit(2)))
            return F.concat_ws(" ", F.coalesce(F.try_element_at(symbols, mark), mark), number, scale)

        return let(F.split(hit, "\x02", -1), form)

    return rewrite(c, CURRENCY_PATTERN, replacement, "$1\x02$2\x02$3")


def canonical_percents(c: Column) -> Column:
    return rewrite(c, PERCENT_PATTERN, lambda number: F.concat(canonical_number(number), F.lit("%")), "$1")


def canonical_thousands(c: Column) -> Column:
    return rewrite(c, THOUSANDS_PATTERN, canonical_number)


def parse_date(c: Column) -> Column:
    """Dates of the four recognised shapes; month first, then day first; else null."""

    def year_of(digits: Column) -> Column:
        # two-digit years fall within fifty years of today
        now = F.year(F.current_date())
        near = digits.try_cast("int") + now - now % 100
        near = F.when(near >= now + 50, near - 100).when(near < now - 50, near + 100).otherwise(near)
        return F.when(F.length(digits) == 2, near).otherwise(digits.try_cast("int"))

    def slashed(parts: Column) -> Column:
        a, b, year = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), year_of(F.get(parts, F.lit(2)))
        return F.coalesce(
            F.try_to_date(F.concat_ws("-", year, a, b), "y-M-d"), F.try_to_date(F.concat_ws("-", year, b, a), "y-M-d")
        )

    def named(text: Column) -> Column:
        month = F.initcap(F.regexp_extract(text, r"(?i)([a-z]{3})[a-z]*", 1))
        day = F.regexp_extract(text, r"(?<!\d)(\d{1,2})(?!\d)", 1)
        return F.try_to_date(F.concat_ws(" ", month, day, F.regexp_extract(text, r"(\d{4})$", 1)), "MMM d yyyy")

    def parse(text: Column) -> Column:
        return (
            F.when(text.rlike(r"^\d{4}-"), F.try_to_date(text, "yyyy-M-d"))
            .when(text.rlike(r"^\d{1,2}/\d{1,2}/(\d{2}|\d{4})$"), slashed(F.split(text, "/")))
            .when(text.rlike(r"(?i)[a-z]{3}"), named(text))
        )

    return let(squash(F.regexp_replace(c, ",", " ")), parse)


def canonical_dates(c: Column) -> Column:
    return rewrite(c, DATE_PATTERN, lambda hit: F.coalesce(parse_date(hit).cast("string"), hit))


def metadata_date(c: Column) -> Column:
    """"D:YYYYMMDD..." stamps or text holding a recognisable date, as an ISO date."""
    stamp = F.regexp_extract(c, r"^D:(\d{8})", 1)
    found = F.regexp_extract(c, DATE_PATTERN, 0)
    iso = F.regexp_extract(c, r"(?<!\d)(\d{4}-\d{1,2}-\d{1,2})T", 1)
    return F.coalesce(
        F.when(iso != "", F.try_to_date(iso, "yyyy-M-d")), F.when(stamp != "", F.try_to_date(stamp, "yyyyMMdd")), F.when(found != "", parse_date(found))
    ).cast("string")


def tidy_lines(c: Column) -> Column:
    """Collapse spaces line by line; the cells of tabbed lines keep their tabs."""

    def tidy(line: Column) -> Column:  # `line` is a lambda variable, free to repeat
        cells = F.transform(F.split(line, "\t", -1), lambda cell: strip(F.regexp_replace(cell, "[ \u00a0]+", " ")))
        return F.when(line.contains("\t"), strip(F.array_join(cells, "\t"))).otherwise(
            strip(F.regexp_replace(line, "[ \t\u00a0]+", " "))
        )

    joined = F.array_join(F.transform(split_lines(c), tidy), "\n")
    return F.regexp_replace(joined, "\n{3,}", "\n\n")


def canonical_text(c: Column) -> Column:
    """Dates, currencies, percents, numbers and spacing in canonical form."""
    out = F.regexp_replace(c, "\r\n?", "\n")
    for step in (canonical_dates, canonical_currencies, canonical_percents, canonical_thousands, tidy_lines):
        out = step(out)
    return out


# --- detection ---------------------------------------------------------------


def detect_currency(c: Column) -> Column:
    chain = F.lit(None).cast("string")
    code = F.upper(F.regexp_extract(c, rf"(?iuU)\b{any_of(vocab.CURRENCY_CODES)}\b", 0))
    chain = F.when(code != "", code)
    for symbol, name in reversed(vocab.CURRENCY_SYMBOLS.items()):
        chain = F.when(c.contains(symbol), F.lit(name)).otherwise(chain)
    return chain


PERIOD_PATTERN = (
    r"(?iuU)\b(?:FY\s*)?20\d{2}\b|\bQ[1-4]\s*20\d{2}\b"
    r"|\b(?:quarter|year)\s+ended\s+[A-Za-z]+\s+\d{1,2},?\s+20\d{2}\b"
)


def detect_period(c: Column) -> Column:
    hit = F.regexp_extract(c, PERIOD_PATTERN, 0)
    return F.when(hit != "", hit)


def detect_unit(c: Column) -> Column:
    """Currency, scale, percent and share words of a value, space-joined."""
    mark = F.upper(F.regexp_extract(c, rf"(?iuU)\b{any_of(vocab.CURRENCY_CODES)}\b|[$?]", 0))
    scale = F.lower(F.regexp_extract(c, rf"(?iuU)\b{any_of(vocab.SCALE_WORDS)}\b", 0))
    parts = F.array_compact(
        F.array(
            F.when(mark == "$", F.lit("USD")).when(mark != "", mark),
            F.when(scale != "", scale),
            F.when(c.contains("%"), F.lit("percent")),
            F.when(c.rlike(r"(?iuU)\bshares?\b"), F.lit("shares")),
        )
    )
    return F.when(F.size(parts) > 0, F.array_join(F.array_distinct(parts), " "))


def tidy_value(c: Column) -> Column:
    return F.regexp_replace(squash(c), r"^[ ;,.?]+|[ ;,.?]+$", "")


def legal_name(c: Column) -> Column:
    """The company name in a title or line, or null when it is no legal-entity name."""
    edges = r"^[ \-?:;,.\t]+|[ \-?:;,.\t]+$"
    suffix = f"{starts_with_one_of('LPIC')}(?iuU){vocab.LEGAL_SUFFIX_PATTERN}"

    def trim_edges(x: Column) -> Column:
        return F.regexp_replace(x, edges, "")

    def pick(text: Column) -> Column:
        out = text
        for mark in (r" \| ", r" \? ", " - "):  # built inside out: " - " is tried first
            parts = F.filter(F.split(text, mark, -1), lambda part: strip(part) != "")
            legal = F.filter(F.transform(parts, trim_edges), lambda part: part.rlike(suffix))
            found = F.try_element_at(legal, F.lit(-1))
            out = F.when(text.rlike(mark), F.coalesce(found, out)).otherwise(out)
        return out

    def check(name: Column) -> Column:
        head = F.substring(name, 1, 1)
        ok = (
            (F.length(name) > 0)
            & (F.length(name) <= 140)
            & ~((F.lower(head) == head) & (F.upper(head) != head))
            & ~name.rlike("[.,]")
            & ~name.rlike(f"(?iuU){vocab.NAME_EXCLUDE_PATTERN}")
            & name.rlike(suffix)
        )
        words = F.transform(
            F.split(name, " "),
            lambda w: F.when(w.isin(*vocab.UPPER_SUFFIXES), w).otherwise(
                F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 200)))
            ),
        )
        return F.when(ok, F.when(F.upper(name) == name, F.array_join(words, " ")).otherwise(name))

    text = F.regexp_replace(c, r"(?iU)^\s*microsoft\s+word\s*[-:]+\s*", "")
    text = let(trim_edges(squash(F.regexp_replace(text, "_+", " "))), pick)
    name = trim_edges(squash(F.regexp_replace(text, f"(?iuU){vocab.NAME_NOISE_PATTERN}", "")))
    return F.when(c.rlike(suffix), let(name, check))


def first_supported_snippet(c: Column, pattern: str) -> Column:
    """Quoted surroundings of the first match that no negation word precedes.

    Every match is marked by its own text between two control characters, unless a
    negation word stands within fifty characters before it; the first mark gives
    the place. Negated matches are consumed unmarked, so later ones keep their place.
    """
    negated = rf"(?<!\b{any_of(vocab.NEGATION_WORDS)}\b[^\n]{{0,50}}\n?)"
    # the pattern is looked for first, so the costly look-behind only runs where it stands
    both = rf"(?iuU)(?={pattern}){negated}({pattern})|(?:{pattern})"
    def cut(pair: Column) -> Column:
        text, marked = pair["text"], pair["marked"]
        at = F.regexp_instr(marked, F.lit("\x01[^\x02]"))
        start = F.length(F.regexp_replace(F.left(marked, at - 1), "\x01[^\x02]*\x02", ""))
        word = F.call_function("locate", F.lit("\x02"), marked, at) - at - 1
        left = F.greatest(F.lit(0), start - 80)
        snippet = F.substring(text, left + 1, start - left + word + 120)
        return F.when(at > 0, F.concat(F.lit('"'), squash(snippet), F.lit('"')))

    masked = F.translate(c, "\x01\x02", "\x03\x03")  # only to find places; the snippet keeps what the text holds
    pair = F.struct(c.alias("text"), F.regexp_replace(masked, both, "\x01$1\x02$0").alias("marked"))
    return F.when(c.rlike(f"(?iuU){pattern}"), let(pair, cut))

"""Chunks of document text. A document is one row; its chunks come from that row alone.

Nothing here shuffles: order, carry-forward and numbering all happen inside the row,
and `posexplode` gives the positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.functions.similarity import split_pieces
from ledgerlens.functions.text import LINE_BREAK, SPACE, any_of, first_per_key, legal_name, let, split_lines, squash, starts_with_one_of, strip, word_key

HEADER = r"SECTION \d+:"
FIRST_LINE = r"[^\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]*"


def blocks(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n\n", -1), strip), lambda b: F.length(b) > 0)


def sentence_groups(block: Column, size: int = 3) -> Column:
    """Sentences of a block in groups of `size`; the rest forms a short group."""
    return let(
        F.split(block, f"(?<=[.]){SPACE}+", -1),
        lambda s: F.transform(
            F.sequence(F.lit(0), F.floor((F.size(s) - 1) / size).cast("int")),
            lambda i: strip(F.array_join(F.slice(s, i * size + 1, size), " ")),
        ),
    )


def section_chunks(c: Column) -> Column:
    """Array of (section, text): sentence groups under the last section header before them."""

    def of_section(part: Column) -> Column:
        header = strip(F.regexp_extract(part, f"^({HEADER}{FIRST_LINE})", 1))
        name = F.when(header != "", header).otherwise("UNSPECIFIED")
        groups = F.flatten(F.transform(blocks(part), lambda b: sentence_groups(b)))
        return let(name, lambda n: F.transform(groups, lambda g: F.struct(n.alias("section"), g.alias("text"))))

    # a header opens a section only where a block starts
    parts = F.split(F.concat(F.lit("\n\n"), c), f"\n\n{SPACE}*(?={HEADER})", -1)
    return F.flatten(F.transform(parts, of_section))


def chunk_sections(documents: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per chunk: keys, chunk_no (1-based), chunk_id "C<n>", section, text."""
    rows = documents.select(*keys, F.posexplode(section_chunks(F.col(text))).alias("i", "c"))
    n = F.col("i") + 1
    return rows.select(*keys, n.alias("chunk_no"), F.concat(F.lit("C"), n.cast("string")).alias("chunk_id"), "c.section", "c.text")


def pack_paragraphs(c: Column, target: int = vocab.PACK_TARGET, overlap: int = vocab.PACK_OVERLAP) -> Column:
    """Array of chunk texts of up to `target` characters that start with the end of the one before.

    A paragraph longer than `target` is cut into overlapping windows and carries nothing on.
    """
    return F.transform(packed_chunks(c, target, overlap, ends=False), lambda x: x["text"])


def packed_chunks(c: Column, target: int = vocab.PACK_TARGET, overlap: int = vocab.PACK_OVERLAP, ends: bool = True) -> Column:
    """The same as array of (text, head, tail): how many characters of the text, at its start and its
    end, are a cut piece of a line that the chunk before or after holds whole. Without `ends` both are 0."""
    step = target - overlap
    chunk = "array<struct<text:string,head:int,tail:int>>"

    def packed(text: Column, head: Column) -> Column:
        return F.struct(text.alias("text"), head.cast("int").alias("head"), F.lit(0).alias("tail"))
    paragraphs = F.filter(F.transform(F.split(c, "\n{2,}", -1), strip), lambda p: F.length(p) > 0)
    start = F.struct(F.array().cast(chunk).alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"), F.lit(0).alias("head"))

    def window(p: Column, i: Column, last: Column) -> Column:
        text = F.substring(p, i * step + 1, F.lit(target))
        return let(text, lambda t: marked(p, i, last, t)) if ends else packed(text, F.lit(0))

    def marked(p: Column, i: Column, last: Column, text: Column) -> Column:
        first = F.instr(text, "\n")  # 0 where there is none
        rest = F.length(F.substring_index(text, "\n", -1))
        # the window before ends with the first `overlap` characters of this one, the one after starts with the last
        begun = (i > 0) & (F.substring(p, i * step, F.lit(1)) != "\n") & first.between(1, overlap + 1)
        before = (i == 1) | F.substring(p, (i - 1) * step + 1, F.lit(step)).contains("\n")
        ended = (i < last) & (F.substring(p, i * step + target + 1, F.lit(1)) != "\n") & (first > 0) & (rest <= overlap)
        after = (i + 1 == last) | F.substring(p, (i + 1) * step + overlap + 1, F.lit(step)).contains("\n")
        return F.struct(
            text.alias("text"), F.when(begun & before, first).otherwise(0).cast("int").alias("head"),
            F.when(ended & after, rest).otherwise(0).cast("int").alias("tail"),
        )

    def windows(p: Column) -> Column:
        last = F.ceil(F.greatest(F.length(p) - target, F.lit(0)) / step).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: window(p, i, last))

    def add(acc: Column, p: Column) -> Column:
        size = F.length(p)
        emit = ((size > target) | (acc["n"] + size + 2 > target)) & (acc["cur"] != "")
        # each value that is looked at more than once is made once
        return let(F.struct(size.alias("size"), F.when(emit, strip(acc["cur"])).alias("body")), lambda e: put(acc, p, e["size"], e["body"]))

    def put(acc: Column, p: Column, size: Column, body: Column) -> Column:
        large, emit, length = size > target, body.isNotNull(), F.length(body)
        done = F.when(emit, F.concat(acc["out"], F.array(packed(body, acc["head"])))).otherwise(acc["out"])
        kept = F.when(emit, F.right(body, F.lit(overlap)) if overlap else F.lit("")).otherwise(acc["cur"])

        def joined(kept: Column) -> Column:
            before = F.when(emit, F.least(length, F.lit(overlap))).otherwise(acc["n"])
            first = F.length(F.substring_index(kept, "\n", 1))
            cut = (length > overlap) & (F.substring(body, length - overlap, F.lit(1)) != "\n")
            head = F.when(emit, F.when(cut & (kept != ""), first).otherwise(0)).otherwise(acc["head"])
            return F.struct(
                done.alias("out"), F.when(kept == "", p).otherwise(F.concat(kept, F.lit("\n\n"), p)).alias("cur"),
                (before + size + 2).alias("n"), head.cast("int").alias("head"),
            )

        alone = F.struct(F.concat(done, windows(p)).alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"), F.lit(0).alias("head"))
        return F.when(large, alone).otherwise(let(kept, joined))

    def finish(acc: Column) -> Column:
        return F.when(acc["cur"] != "", F.concat(acc["out"], F.array(packed(strip(acc["cur"]), acc["head"])))).otherwise(acc["out"])

    return F.aggregate(paragraphs, start, add, finish)


def chunk_paragraphs(documents: DataFrame, keys: list[str], text: str = "text", **sizes) -> DataFrame:
    """One row per packed chunk: keys, index (1-based), total, text, character_count, and `lines`, the text without
    the cut lines at its ends that a neighbour holds whole."""
    def describe(packed: Column) -> Column:
        return F.transform(
            packed,
            lambda x, i: F.struct(
                (i + 1).alias("index"), F.size(packed).alias("total"), x["text"].alias("text"), F.length(x["text"]).alias("character_count"),
                F.substring(x["text"], x["head"] + 1, F.length(x["text"]) - x["head"] - x["tail"]).alias("lines"),
            ),
        )

    rows = documents.select(*keys, F.explode(let(packed_chunks(F.col(text), **sizes), describe)).alias("c"))
    return rows.select(*keys, "c.*")


def chunk_pages(pages: DataFrame, keys: list[str], metadata: list[str], text: str = "text") -> DataFrame:
    """Pages in overlapping pieces; every piece keeps its page's metadata.

    chunk_index runs through the pages of a document, which therefore meet in one sort
    group: the pages of one file.
    """
    from pyspark.sql import Window as W

    pages = pages.filter(F.length(text) > 0)
    pieces = pages.select(*keys, *metadata, F.posexplode(split_pieces()(F.col(text))).alias("piece", "text"))
    order = W.partitionBy(*keys).orderBy("page_number", "piece")
    return pieces.withColumn("chunk_index", F.row_number().over(order) - 1).drop("piece")


# --- budgeted context -------------------------------------------------------------

HAS_VALUE = rf"[$?\d]|{starts_with_one_of(''.join(code[0] for code in vocab.CURRENCY_CODES))}(?iu){any_of(vocab.CURRENCY_CODES)}"
PAGE_MARK = r"(?:page|ocr page)[^\S\n]+(\d+)\b"


def holds_one_of(words) -> str:
    """A pattern for texts that hold one of the (plain) words anywhere: words that hold another are left out, the rest are tried by their first letter."""
    least = [w for w in dict.fromkeys(words) if not any(other != w and other in w for other in words)]
    heads = sorted({w[0] for w in least})
    return f"(?=[{''.join(heads)}])" + any_of(f"{head}{any_of(w[1:] for w in least if w[0] == head)}" for head in heads)


def _keys(aliases: dict) -> str:
    return holds_one_of([vocab.label_key(a) for names in aliases.values() for a in names])


def is_signal_line(line: Column) -> Column:
    """Whether a stripped line looks like a name, a table row, a metric or a company field."""
    key = word_key(line)
    has_value = line.rlike(HAS_VALUE)
    return (
        (line.contains("\t") & has_value)
        | (has_value & key.rlike(_keys(vocab.METRIC_ALIASES)))
        | (line.rlike("[:=\\-?\t]") & key.rlike(_keys(vocab.COMPANY_ALIASES)))
        | legal_name(line).isNotNull()
    )


def split_at_pages(c: Column) -> Column:
    """The text cut before every line with a page mark: array of (page, lines)."""
    def mark(text: Column) -> Column:
        # a text that names no page, as most chunks of prose, is not searched line by line
        return F.when(F.lower(text).contains("page"), F.regexp_replace(text, rf"(?imdU)^(?=[^\n]*?\b{PAGE_MARK})", "\x01$1\x02")).otherwise(text)

    marked = let(F.regexp_replace(F.translate(c, "\x01\x02", ""), LINE_BREAK, "\n"), mark)

    def part(segment: Column) -> Column:
        page = F.regexp_extract(segment, "^(\\d+)\x02", 1)
        return F.struct(
            F.when(page != "", F.regexp_replace(page, r"^0+(?=\d)", "")).alias("page"),
            F.split(F.regexp_replace(segment, "^\\d+\x02", ""), "\n", -1).alias("lines"),
        )

    return F.transform(F.split(marked, "\x01", -1), part)


def signal_text(c: Column) -> Column:
    """Signal lines once each, every page mark before its first one."""

    def entries(part: Column) -> Column:
        has_page = part["page"].isNotNull()
        head = F.when(has_page, strip(F.get(part["lines"], F.lit(0))))
        body = F.when(has_page, F.slice(part["lines"], 2, F.greatest(F.size(part["lines"]) - 1, F.lit(0)))).otherwise(part["lines"])
        lines = F.filter(F.transform(body, strip), lambda s: (F.length(s) > 0) & is_signal_line(s))
        return F.flatten(
            F.transform(
                lines,
                lambda s: F.array(
                    F.struct(F.lower(head).alias("k"), head.alias("t")), F.struct(F.lower(squash(s)).alias("k"), s.alias("t"))
                ),
            )
        )

    listed = F.filter(F.flatten(F.transform(split_at_pages(c), entries)), lambda e: e["t"].isNotNull())

    return strip(F.array_join(F.transform(first_per_key(listed), lambda e: e["t"]), "\n"))


def cut_to_lines(text: Column, limit: Column) -> Column:
    """Whole lines up to `limit` characters; a first line beyond it is cut."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"), F.lit(False).alias("done"), F.lit(0).alias("n"))

    def add(acc: Column, line: Column) -> Column:
        size = F.length(line) + 1
        first = acc["n"] == 0
        fits = ~acc["done"] & (acc["used"] + size <= limit)
        cut = ~acc["done"] & first & (size > limit)
        return F.struct(
            F.when(cut, F.left(line, limit)).when(fits & first, line).when(fits, F.concat(acc["out"], F.lit("\n"), line)).otherwise(acc["out"]).alias("out"),
            F.when(fits, acc["used"] + size).otherwise(acc["used"]).alias("used"),
            (acc["done"] | cut | ~fits).alias("done"), (acc["n"] + 1).alias("n"),
        )

    return strip(F.aggregate(split_lines(text), start, add, lambda acc: acc["out"]))


def budget_chunks(
    chunks: Column, per_chunk: int = vocab.BUDGET_PER_CHUNK, total: int = vocab.BUDGET_TOTAL, most: int = vocab.BUDGET_CHUNKS
) -> Column:
    """For an ordered array of chunk texts: array of (index, text, chosen, truncated, reason)."""
    numbered = F.transform(chunks, lambda t, i: F.struct((i + 1).alias("index"), t.alias("text")))
    result = "array<struct<index:int,text:string,chosen:boolean,truncated:boolean,reason:string>>"
    start = F.struct(F.array().cast(result).alias("out"), F.lit(total).alias("left"), F.lit(0).alias("n"))

    def add(acc: Column, c: Column) -> Column:
        limit = F.least(F.lit(per_chunk), acc["left"])
        whole = F.length(c["text"]) <= limit
        reason = F.when(acc["n"] >= most, f"LLM chunk budget reached ({most} chunks per extraction)").when(
            (acc["left"] <= 0) | F.lit(per_chunk <= 0), f"LLM input character budget reached ({total} chars per extraction)"
        )

        def fit(signal: Column) -> Column:
            short = F.when(F.length(signal) > 0, signal).otherwise(F.left(c["text"], limit))
            return let(short, lambda s: F.when(F.length(s) <= limit, s).otherwise(cut_to_lines(s, limit)))

        # only a chunk that is not ruled out and does not fit as it is has its lines looked at
        fitted = F.when(reason.isNotNull() | whole, c["text"]).otherwise(let(signal_text(c["text"]), fit))

        def place(text: Column) -> Column:
            why = F.coalesce(reason, F.when(F.length(strip(text)) == 0, "Chunk contained no text after LLM budget compaction"))
            take = why.isNull()
            row = F.struct(
                c["index"].alias("index"), F.when(take, text).otherwise(c["text"]).alias("text"), take.alias("chosen"),
                (take & ~whole).alias("truncated"), why.alias("reason"),
            )
            return F.struct(
                F.concat(acc["out"], F.array(row)).alias("out"),
                F.when(take, acc["left"] - F.length(text)).otherwise(acc["left"]).alias("left"),
                (acc["n"] + take.cast("int")).alias("n"),
            )

        return let(fitted, place)

    return F.aggregate(numbered, start, add, lambda acc: acc["out"])

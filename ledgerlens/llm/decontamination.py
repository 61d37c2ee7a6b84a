"""Benchmark decontamination through a positional inverted index, in DataFrame functions only.

The index holds a posting (term, text, position) for every word of the training texts; it
is stored by document, without a shuffle, and read once per question put to it. Test items
are cut into windows. The postings of a window's rarest terms, less their place in the
window, are lists of possible starts; starts that are in all of those lists are candidates,
and those are compared word by word with the text. With `slop` each term may stand up to so
many words off its place, which gives proximity matches.

Defined cases: a null or empty text or item has no words and no hits; an item of fewer
words than a window is one window; equal texts share their postings; items with equal
windows are all reported; a null item id is not listed, but its words are hits; an empty
benchmark leaves every document clean; rows that repeat an id are judged one by one; other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import ascii_lower, bounded, left_by_key, split_words, stage

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
MASK = 63  # lists that one whole number marks
RAREST = 2  # lists that are intersected before a candidate is looked up in its text


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(text), SEPARATORS)


def _key(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def build_index(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The stored postings: key (of the text), position and term of every word."""
    rows = df.select(_key(F.col(text_col)).alias("key"), words_of(F.col(text_col)).alias("words"))
    return stage(rows.select("key", F.posexplode("words").alias("position", "term")), "postings")


def test_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """window (its words, joined), terms and items (ids) of every distinct window, stored."""
    rows = items.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    rows = rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("terms"))
    return stage(rows.groupBy("terms").agg(F.collect_set("item").alias("items")).withColumn("window", F.array_join("terms", " ")), "windows")


def probes(index: DataFrame, windows: DataFrame, rarest: int = RAREST) -> DataFrame:
    """window, place, term and rank of each window's rarest terms; windows with a word that the index lacks have none."""
    terms = windows.select("window", F.posexplode("terms").alias("place", "term"))
    vocabulary = stage(terms.select("term").distinct(), "vocabulary")
    counts = stage(index.join(bounded(vocabulary), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")), "counts")
    counted = terms.join(counts, "term", "left").groupBy("window").agg(
        F.sort_array(F.collect_list(F.struct("n", "place", "term"))).alias("list"), F.count_if(F.col("n").isNull()).alias("lacking"),
    )
    counted = counted.filter("lacking = 0").withColumn("list", F.slice("list", 1, rarest))
    found = counted.select("window", F.size("list").alias("lists"), F.posexplode("list").alias("rank", "probe"))
    return stage(found.select("window", "lists", "rank", "probe.place", "probe.term"), "probes")


def candidates(index: DataFrame, probe: DataFrame, slop: int = 0) -> DataFrame:
    """key, window and start wherever all of the window's lists agree, each list within `slop` words."""
    start = F.col("position") - F.col("place")
    if slop:
        start = F.explode(F.sequence(start - slop, start + slop))
    hits = index.join(bounded(probe), "term").select("key", "window", "lists", "rank", start.alias("start")).filter(F.col("start") >= -slop)
    masks = -(-(probe.agg(F.max("lists")).first()[0] or 1) // MASK)  # 1 unless windows are long
    marks = [F.bit_or(F.expr(f"IF(rank DIV {MASK} = {i}, shiftleft(1L, rank % {MASK}), 0L)")).alias(f"mask{i}") for i in range(masks)]
    agreed = hits.groupBy("key", "window", "start").agg(F.first("lists").alias("lists"), *marks)
    met = F.aggregate(F.array(*[F.bit_count(f"mask{i}") for i in range(masks)]), F.lit(0), lambda a, b: a + b)
    return agreed.filter(met == F.col("lists")).select("key", "window", "start")


def phrase_matches(index: DataFrame, windows: DataFrame) -> DataFrame:
    """key, window, start of the exact matches of whole windows, from the index alone: every term is a list."""
    return candidates(index, probes(index, windows, WINDOW + max(1, windows.agg(F.max(F.size("terms"))).first()[0] or 1)))


def proximity_matches(index: DataFrame, windows: DataFrame, slop: int) -> DataFrame:
    """key, window, start of places where every term of a window stands at most `slop` words off its place."""
    longest = windows.agg(F.max(F.size("terms"))).first()[0] or 1
    return candidates(index, probes(index, windows, longest), slop)


def _judged(df: DataFrame, items: DataFrame, carried: Column, text_col: str, item_col: str, item_text: str, window: int) -> DataFrame:
    """carried, n_words, n_hit and items (sorted as text) of every row."""
    index, windows = build_index(df, text_col), test_windows(items, item_col, item_text, window)
    found = candidates(index, probes(index, windows))
    found = found.join(bounded(windows.select("window", F.size("terms").alias("size"), "items")), "window")
    found = stage(found.groupBy("key").agg(F.collect_set(F.struct("start", "size", "window", "items")).alias("found")), "candidates")
    rows = left_by_key(df.select(carried.alias("row"), F.col(text_col).alias("text"), _key(F.col(text_col)).alias("key")), found, "key")
    rows = rows.select("row", words_of(F.col("text")).alias("words"), F.coalesce("found", F.array().cast(found.schema["found"].dataType)).alias("found"))
    exact = F.filter("found", lambda m: F.array_join(F.slice("words", m["start"] + 1, m["size"]), " ") == m["window"])
    rows = rows.select("row", F.size("words").cast("long").alias("n_words"), F.sort_array(exact).alias("exact"))
    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))

    def grow(seen: Column, match: Column) -> Column:
        end = match["start"] + match["size"]
        return F.struct((seen["hit"] + F.greatest(end - F.greatest(seen["end"], match["start"]), F.lit(0))).alias("hit"), F.greatest(end, seen["end"]).alias("end"))

    named = F.transform(F.array_distinct(F.flatten(F.transform("exact", lambda m: m["items"]))), lambda i: i.cast("string"))
    return rows.select("row", "n_words", F.aggregate("exact", start, grow)["hit"].cast("long").alias("n_hit"), F.array_sort(named).alias("items"))


def decontaminate(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and items of every row."""
    judged = _judged(df, items, F.struct(F.col(id_col).alias("doc_id")), text_col, item_col, item_text, window)
    return judged.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "items",
    )


def clean_documents(df: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows without a hit, with all their columns."""
    judged = _judged(df, items, F.struct(*df.columns), text_col, item_col, item_text, window)
    # not a filter: the optimizer would evaluate the words again for every candidate
    return judged.select(F.explode(F.when(F.col("n_hit") == 0, F.array("row"))).alias("row")).select("row.*")

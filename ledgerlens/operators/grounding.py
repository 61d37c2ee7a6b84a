"""Whether evidence is traceable to what a request holds, for requests of any size.

A request is many pieces of text; they are never put together. A token holds no space, so
it stands in the request's text exactly if one of the request's distinct words holds it:
the few tokens of a usual request are looked for in each of its pieces, those of a request
with many meet its words by their runs of three letters. Only evidence that the tokens leave
open, yet don't rule out, is looked for as a whole, in blocks that overlap by its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.functions.text import word_key
from ledgerlens.operators.ordering import lookup
from ledgerlens.session import cut_lineage
from ledgerlens.sources.files import contained_names

KEY = "request_id"
BLOCK_CHARS = 65_536  # of the text that one block adds
FEW_TOKENS = 64  # distinct tokens of a request up to which they go to its pieces
CELL = 4096  # neighbouring places whose lengths are added up together


def proof_tokens(proof: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in vocab.GROUNDING_STOPWORDS])
    return F.array_distinct(F.filter(F.split(proof, " "), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)))


def tokens_suffice(n: Column, hits: Column, numbers: Column, number_hits: Column) -> Column:
    """The verdict of `n` distinct tokens of which `hits` were found, `numbers` of them with a digit."""
    all_numbers = (numbers > 0) & (numbers == number_hits)
    return (
        F.when(n == 0, False)
        .when(all_numbers, hits >= F.greatest(F.lit(2), F.floor(n * 0.5)))
        .when(n <= 3, hits == n)
        .otherwise((hits >= 3) & (hits / n >= 0.65))
    )


def request_pieces(requests: DataFrame, metrics: DataFrame, sections: DataFrame, flags: DataFrame) -> DataFrame:
    """(request_id, part, pos, t): all texts of a request in `word_key` form and their order; blank ones left out."""
    fields = ["value", "current", "previous", "prior", "current_year", "prior_year", "unit", "source"]
    dumped = F.concat_ws(" ", "metric", *[F.concat_ws(" ", F.lit(f), F.coalesce(f, F.lit("null"))) for f in fields])

    def part(df: DataFrame, n: int, pos: Column, text: Column) -> DataFrame:
        return df.select(KEY, F.lit(n).alias("part"), pos.cast("long").alias("pos"), word_key(text).alias("t"))

    pieces = (
        part(requests, 0, F.lit(0), F.concat_ws("\n", "company", "financial_year"))
        .unionByName(part(metrics, 1, F.col("pos"), dumped))
        .unionByName(part(sections, 2, F.col("pos"), F.concat_ws("\n", "section", "content")))
        .unionByName(part(flags, 3, F.col("pos"), F.concat_ws("\n", "category", "title", "description", "evidence", "recommendation")))
    )
    return pieces.filter("t <> ''")


def found_tokens(tokens: DataFrame, pieces: DataFrame) -> DataFrame:
    """The (request_id, short) of `tokens`, distinct rows, that stand in a piece of their request."""
    sized = tokens.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    few = lookup(tokens, sized.filter(F.col("n") <= FEW_TOKENS), [KEY]).groupBy(KEY).agg(F.collect_list("short").alias("few"))
    hits = F.filter("few", lambda t: F.col("t").contains(t))
    found = lookup(pieces, few, [KEY]).select(KEY, F.explode(hits).alias("short")).distinct()
    many = cut_lineage(sized.filter(F.col("n") > FEW_TOKENS).select(KEY))  # read twice
    if many.isEmpty():
        return found
    words = pieces.join(many, KEY, "left_semi").select(KEY, F.explode(F.split("t", " ")).alias("long")).distinct()
    rest = contained_names(tokens.join(many, KEY, "left_semi"), words, [KEY], shortest=3).select(KEY, "short").distinct()
    return found.unionByName(rest)


def token_counts(proofs: DataFrame, pieces: DataFrame) -> DataFrame:
    """(request_id, proof) with the number of its tokens, of those found, and the same of those with a digit."""
    tokens = proofs.select(KEY, "proof", F.explode(proof_tokens(F.col("proof"))).alias("short"))
    found = found_tokens(tokens.select(KEY, "short").distinct(), pieces)
    marked = tokens.join(found.withColumn("hit", F.lit(True)), [KEY, "short"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    number = F.col("short").rlike("[0-9]")
    counts = {"n": F.count(F.lit(1)), "hits": F.count_if("hit"), "numbers": F.count_if(number), "number_hits": F.count_if(number & F.col("hit"))}
    counted = marked.groupBy(KEY, "proof").agg(*[c.alias(name) for name, c in counts.items()])
    return proofs.join(counted, [KEY, "proof"], "left").fillna(0, list(counts))


def text_offsets(pieces: DataFrame) -> DataFrame:
    """The place `start` at which each piece would begin if a request's pieces were joined by single spaces.

    Lengths are added up per cell of neighbouring places first, so that only one row per
    cell of a request is put in order together.
    """
    sized = pieces.withColumn("cell", F.floor(F.col("pos") / CELL)).withColumn("n", F.length("t").cast("long") + 1)
    cell = [KEY, "part", "cell"]
    earlier = W.partitionBy(KEY).orderBy("part", "cell").rowsBetween(W.unboundedPreceding, -1)
    before = sized.groupBy(*cell).agg(F.sum("n").alias("n")).select(*cell, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = W.partitionBy(*cell).orderBy("pos", "t").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("within", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return placed.join(before, cell).select(KEY, "t", (F.col("before") + F.col("within")).alias("start"))


def whole_proofs(proofs: DataFrame, pieces: DataFrame) -> DataFrame:
    """The (request_id, proof) that stand in the request's text as a whole, over the borders of pieces too."""
    reach = proofs.groupBy(KEY).agg(F.max(F.length("proof")).cast("long").alias("reach"))
    placed = text_offsets(pieces.join(reach.select(KEY), KEY, "left_semi")).join(reach, KEY)
    size = F.greatest(F.lit(BLOCK_CHARS).cast("long"), F.col("reach"))
    first, last = F.greatest(F.lit(0), F.floor((F.col("start") - F.col("reach")) / size)), F.floor((F.col("start") + F.length("t")) / size)
    dealt = placed.withColumn("size", size).withColumn("block", F.explode(F.sequence(first, last)))
    start = F.greatest("start", F.col("block") * F.col("size"))
    end = F.least(F.col("start") + F.length("t") + 1, (F.col("block") + 1) * F.col("size") + F.col("reach"))
    cut = F.substring(F.concat("t", F.lit(" ")), (start - F.col("start") + 1).cast("int"), (end - start).cast("int"))
    parts = dealt.select(KEY, "block", F.struct(start.alias("start"), cut.alias("t")).alias("p"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "")
    blocks = parts.groupBy(KEY, "block").agg(text.alias("text"))  # a bounded text each
    return blocks.join(proofs, KEY).filter(F.col("text").contains(F.col("proof"))).select(KEY, "proof").distinct()


def grounded(flags: DataFrame, pieces: DataFrame) -> DataFrame:
    """Flags of another source whose evidence the request supports."""
    marked = flags.withColumn("_proof", word_key(F.col("evidence")))
    proofs = marked.select(KEY, F.col("_proof").alias("proof")).filter("proof <> ''").distinct()
    asked = pieces.join(proofs.select(KEY).distinct(), KEY, "left_semi")
    one_token = ~F.col("proof").contains(" ") & (F.col("n") == 1)  # such evidence is its own token
    enough = tokens_suffice(*[F.col(c) for c in ("n", "hits", "numbers", "number_hits")]) | (one_token & (F.col("hits") == 1))
    counted = cut_lineage(token_counts(proofs, asked).withColumn("enough", enough))  # one row per evidence, read twice
    # text that stands there as a whole has all its tokens there
    still_open = counted.filter(~F.col("enough") & ~one_token & (F.col("hits") == F.col("n"))).select(KEY, "proof")
    supported = counted.filter("enough").select(KEY, "proof").unionByName(whole_proofs(still_open, asked))
    return marked.join(supported.withColumnRenamed("proof", "_proof"), [KEY, "_proof"], "left_semi").drop("_proof")

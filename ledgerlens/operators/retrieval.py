"""Ranked passages for questions: term weights, vectors and keywords, with citations.

Term index: inverted lists in shards of chunks, cut into blocks that carry their largest
weight. Questions come to the shards, which skip blocks that cannot reach their k best, so
what is shuffled is k rows per question and shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerlens import vocab
from ledgerlens.functions import postings, vectors
from ledgerlens.functions.text import SPACE, let, round_exact, squash, strip
from ledgerlens.operators.ordering import BROADCAST_ROWS, measured, small_lookup, top_k
from ledgerlens.session import by_key, scratch_path

QUERY_TERMS = 50_000  # question terms that come to a shard at a time
QUERY_BLOCK = 2_000  # question vectors that come to a block at a time
BROADCAST_NUMBERS = 4_000_000  # most entries of question vectors that are sent to every task
GROUP_SHARDS = 4  # shards, each of some MB, that are read at once
PIVOTS = 8  # stored vectors whose distances bound those between others


# --- questions ------------------------------------------------------------------


def question_parts(c: Column) -> Column:
    """Parts of a question between "and", "?" and ";", or the question itself."""
    parts = F.filter(F.transform(F.split(c, r"(?iuU)\band\b|\?|;", -1), strip), lambda p: F.length(p) > 8)
    return let(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(c)))


def decompose(questions: DataFrame, keys: list[str], text: str = "question") -> DataFrame:
    parts = questions.select(*keys, F.posexplode(question_parts(F.col(text))).alias("part", "sub_question"))
    return parts.withColumn("part", F.col("part") + 1)


# --- term weights -----------------------------------------------------------------


def tokens(c: Column, stop_words=vocab.STOP_WORDS) -> Column:
    """Lower-cased words of two or more characters without stop words."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*stop_words))


def term_counts(texts: DataFrame, keys: list[str], text: str = "text", stop_words=vocab.STOP_WORDS) -> DataFrame:
    """keys, term, tf. The tokens of one text sit in one partition, so counting them is
    mostly done before the shuffle."""
    return texts.select(*keys, F.explode(tokens(F.col(text), stop_words)).alias("term")).groupBy(*keys, "term").agg(
        F.count(F.lit(1)).alias("tf")
    )


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log((F.lit(1) + n) / (F.lit(1) + df)) + 1


def _written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The rows stored once in the shared folder and read back.

    `rows` that hold long lists go to a row group; a reader decodes up to 4096 rows of a group at once.
    """
    path = scratch_path(df.sparkSession, name)
    (df.write.option("parquet.block.row.count.limit", rows) if rows else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deal_by_scope(rows: DataFrame, scope: list[str], size: int) -> DataFrame:
    """Stored rows (with an `_id`) placed and sorted by scope; a scope of more than `size` rows is dealt to as many places as it fills."""
    sizes = rows.groupBy(*scope).agg(F.ceil(F.count(F.lit(1)) / size).alias("_parts"))
    dealt = small_lookup(rows, sizes.filter("_parts > 1"), scope, "left")
    part = F.pmod(F.xxhash64("_id"), F.coalesce("_parts", F.lit(1)))
    return by_key(dealt.withColumn("_part", part), *scope, "_part").sortWithinPartitions(*scope).select(*rows.columns)


class TermIndex:
    """Unit-length weights of chunk terms, in stored shards of posting blocks; `vocabulary` (scope, term, df, idf).

    With `scope` columns every scope (a session, a document) is an index of its own: its own
    frequencies, and questions see only its chunks. A shard holds the postings of up to SHARD
    chunks of one scope, so frequent terms and large scopes are split over many. Chunks
    without a single term still count in n, as rows of an all-zero matrix would.

    Postings are never joined by term: the shards' terms, one row each, meet the vocabulary,
    and the idf goes back to the shard, sorted, so that a task holds the numbers of one shard.
    """

    def __init__(self, chunks: DataFrame, keys: list[str], text: str = "text", stop_words=vocab.STOP_WORDS, scope: list[str] | None = None):
        self.keys, self.scope, self.stop_words, self._spark, self._blocks = keys, scope or [], stop_words, chunks.sparkSession, None
        words = F.array_join(tokens(F.col(text), stop_words), " ").alias("_words")
        rows = chunks.select(*self.scope, F.struct(*keys).alias("_id"), words)
        if self.scope:
            rows = deal_by_scope(self._stored("words", rows), self.scope, 4 * postings.SHARD)
        schema = T.StructType([*[rows.schema[c] for c in self.scope], T.StructField("ids", T.ArrayType(rows.schema["_id"].dataType)), *T.StructType.fromDDL(postings.LISTS).fields])
        built = postings.shards(len(self.scope), keys, to_arrow_schema(schema))
        self._shards = self._stored("shards", rows.mapInArrow(built, schema).withColumn("shard", F.monotonically_increasing_id()), GROUP_SHARDS)
        self.vocabulary = self._stored("vocabulary", self._frequencies())

    def _stored(self, name: str, df: DataFrame, rows: int | None = None) -> DataFrame:
        return _written(df, f"index-{name}", rows)

    def _frequencies(self) -> DataFrame:
        own = self.scope
        schema = T.StructType([*[self._shards.schema[c] for c in own], *T.StructType.fromDDL("term string, n long").fields])
        counted = postings.frequencies(len(own), to_arrow_schema(schema))
        df = self._shards.select(*own, "terms", "starts").mapInArrow(counted, schema).groupBy(*own, "term").agg(F.sum("n").alias("df"))
        if not own:
            n = self._shards.agg(F.sum(F.size("ids"))).first()[0] or 0
            return df.withColumn("idf", idf(F.lit(n), F.col("df")))
        sizes = self._shards.groupBy(*own).agg(F.sum(F.size("ids")).alias("_n"))
        return small_lookup(df, sizes, own).withColumn("idf", idf(F.col("_n"), F.col("df"))).drop("_n")

    @property
    def blocks(self) -> DataFrame:
        """The shards with weights and the largest weight of every block; built and stored at the first search."""
        if self._blocks is None:
            listed = self._shards.select(*self.scope, "shard", F.posexplode("terms").alias("i", "term"))
            words = self.vocabulary.drop("df")  # stored, so it is only counted
            words = F.broadcast(words) if words.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else words
            known = by_key(listed.join(words, [*self.scope, "term"]).select("shard", "i", "idf"), "shard").sortWithinPartitions("shard", "i")
            known = known.select("shard", "idf").mapInArrow(postings.gathered, "shard long, idf array<double>")
            rows = by_key(self._shards, "shard").join(known, "shard").select(*self.scope, "ids", "terms", "starts", "places", "counts", "idf")
            schema = T.StructType([*rows.schema.fields[: len(self.scope) + 1], *T.StructType.fromDDL(postings.WEIGHED).fields])
            self._blocks = self._stored("blocks", rows.mapInArrow(postings.weighed(len(self.scope) + 1, to_arrow_schema(schema)), schema), GROUP_SHARDS)
        return self._blocks

    def question_weights(self, questions: DataFrame, qkeys: list[str], text: str) -> DataFrame:
        """Unit-length weights of question terms that occur in the index (in the question's scope)."""
        own = [*self.scope, *[q for q in qkeys if q not in self.scope]]
        counts = term_counts(questions, own, text, self.stop_words)
        w = small_lookup(self.vocabulary.drop("df"), counts, [*self.scope, "term"]).withColumn("qw", F.col("tf") * F.col("idf")).select(*own, "term", "qw")
        length = F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(W.partitionBy(*own)))
        return w.withColumn("qw", F.col("qw") / length)

    def search(self, questions: DataFrame, qkeys: list[str], text: str, k: int = vocab.TFIDF_K) -> DataFrame:
        """Top k chunks per question by cosine, one pass over the blocks for all questions.

        The questions of a scope come to its shards, QUERY_TERMS terms at a time; every shard
        hands on its k best per question and skips blocks that cannot reach them. Ties go to
        the lower chunk keys; scores of zero are no hits.
        """
        own = [*self.scope, *[q for q in qkeys if q not in self.scope]]
        numbered = self._stored("questions", questions.select(*own, F.col(text).alias("_text")).withColumn("_q", F.monotonically_increasing_id()))
        asked = self._stored("asked", self.question_weights(numbered, [*self.scope, "_q"], "_text"))
        total = asked.count()
        part = F.pmod(F.xxhash64("_q"), F.lit(-(-total // QUERY_TERMS) or 1)).alias("_part")
        place = F.coalesce(*[F.col(c) for c in self.scope]) if len(self.scope) == 1 else F.struct(*self.scope) if self.scope else F.lit(0)
        packed = asked.withColumn("_scope", place).groupBy("_scope", part).agg(F.collect_list(F.struct("_q", "term", "qw")).alias("asked")).drop("_part")
        shards = self.blocks.withColumn("_scope", place).join(F.broadcast(packed) if total <= BROADCAST_ROWS else packed, "_scope").drop("_scope", *self.scope)
        chunk = self.blocks.schema["ids"].dataType.elementType
        schema = T.StructType([T.StructField("_q", T.LongType()), T.StructField("_id", chunk), T.StructField("score", T.DoubleType())])
        hits = shards.mapInArrow(postings.searched(k, to_arrow_schema(schema)), schema).select("_q", "_id.*", "score")
        best = top_k(hits, ["_q"], [F.col("score").desc(), *[F.col(c) for c in self.keys]], k)
        return best.join(numbered.drop("_text"), "_q").select(*qkeys, *self.keys, "score", "rank")


# --- answers ----------------------------------------------------------------------


def answers(hits: DataFrame, parts: DataFrame, key: str = "query_id") -> DataFrame:
    """Findings, synthesis and citations per question.

    hits: key, part, rank, chunk_id, section, text, score. Nested lists hold at most k
    hits per part and the parts of one question.
    """
    by_part = hits.groupBy(key, "part").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "section", "text", "score"))).alias("retrieved")
    )
    df = parts.join(by_part, [key, "part"], "left")
    cited = F.array_join(F.transform("retrieved", lambda h: F.concat(h["text"], F.lit(" ["), h["chunk_id"], F.lit("]"))), " ")
    finding = F.coalesce(cited, F.lit(vocab.NO_EVIDENCE))
    tags = F.transform("retrieved", lambda h: F.concat(F.lit("["), h["chunk_id"], F.lit(" | "), h["section"], F.lit("]")))
    rows = df.select(key, F.struct("part", "sub_question", finding.alias("finding"), F.coalesce(tags, F.array().cast("array<string>")).alias("tags")).alias("a"))
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list("a")).alias("parts"))
    lines = F.transform("parts", lambda a: F.concat(F.lit('- On "'), a["sub_question"], F.lit('": '), a["finding"]))
    return grouped.select(
        key, F.size("parts").alias("n_parts"), F.array_join(lines, "\n").alias("synthesis"),
        F.array_distinct(F.flatten(F.transform("parts", lambda a: a["tags"]))).alias("citations"),
        F.transform("parts", lambda a: F.struct(a["part"].alias("part"), a["sub_question"].alias("sub_question"), a["finding"].alias("finding"))).alias("sub_answers"),
    )


def cited_ids(finding: Column) -> Column:
    return F.regexp_extract_all(finding, F.lit(r"\[(C\d+)\]"), F.lit(1))


def numeric_claims(finding: Column) -> Column:
    """Number-like claims of at least two characters, reduced to what must be found."""
    raw = F.transform(F.regexp_extract_all(finding, F.lit(rf"\d+[\d,\.]*{SPACE}?(?:%|bps|cr|crore|x)?"), F.lit(0)), strip)
    long = F.filter(raw, lambda n: F.length(n) >= 2)
    return F.transform(long, lambda n: F.regexp_replace(F.get(F.split(n, f"{SPACE}+"), F.lit(0)), "[,.]+$", ""))


def _named_chunks(chunks: DataFrame, cited: DataFrame, keys: list[str]) -> DataFrame:
    """The chunks that are cited at all; few ids are sent to the chunks, not chunks to the ids."""
    ids, small = measured(cited.select(*keys).filter("chunk_id IS NOT NULL").distinct())
    return chunks.join(F.broadcast(ids) if small else ids, keys, "left_semi")


def check_citations(findings: DataFrame, chunks: DataFrame, keys: list[str], chunk_scope: list[str]) -> DataFrame:
    """Per finding: whether it cites at least one chunk and every cited chunk exists."""
    cited = findings.select(*keys, *[c for c in chunk_scope if c not in keys], F.explode_outer(cited_ids(F.col("finding"))).alias("chunk_id"))
    known = _named_chunks(chunks.select(*chunk_scope, "chunk_id"), cited, [*chunk_scope, "chunk_id"]).withColumn("found", F.lit(True))
    joined = cited.join(known, [*chunk_scope, "chunk_id"], "left")
    return joined.groupBy(*keys).agg(
        F.count("chunk_id").alias("n_cited"),
        F.every(F.coalesce("found", F.lit(False))).alias("citations_valid"),
    )


def grounding_scores(findings: DataFrame, chunks: DataFrame, key: str, chunk_scope: list[str]) -> DataFrame:
    """Citation validity and numeric grounding per answer, in percent.

    findings: key, part, scope columns, finding. The cited texts of a finding are the few
    chunks it names, in citation order.
    """
    keys = [key, "part"]
    scope = [c for c in chunk_scope if c not in keys]
    cited = findings.select(*keys, *scope, F.posexplode_outer(cited_ids(F.col("finding"))).alias("i", "chunk_id"))
    texts = chunks.select(*chunk_scope, "chunk_id", F.col("text").alias("cited_text"))
    texts = _named_chunks(texts, cited, [*chunk_scope, "chunk_id"])
    by_part = cited.join(texts, [*chunk_scope, "chunk_id"], "left").groupBy(*keys).agg(
        F.every(F.col("cited_text").isNotNull()).alias("valid"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("cited_text").isNotNull(), F.struct("i", "cited_text")))), lambda s: s["cited_text"]), " ").alias("cited"),
    )
    df = findings.select(*keys, numeric_claims(F.col("finding")).alias("claims")).join(by_part, keys)
    checked = df.select(
        key, "valid", F.size("claims").alias("checked"),
        F.size(F.filter("claims", lambda n: F.col("cited").contains(n))).alias("grounded"),
    )
    out = checked.groupBy(key).agg(
        F.count(F.lit(1)).alias("sub_questions_answered"), F.count_if("valid").alias("sub_answers_with_valid_citations"),
        F.sum("checked").alias("numeric_claims_checked"), F.sum("grounded").alias("numeric_claims_grounded_in_cited_chunk"),
    )

    def rate(part: str, whole: str, empty: float) -> Column:
        return round_exact(F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(empty)) * 100, 1)

    return out.select(
        "*", rate("sub_answers_with_valid_citations", "sub_questions_answered", 0.0).alias("citation_validity_rate"),
        rate("numeric_claims_grounded_in_cited_chunk", "numeric_claims_checked", 1.0).alias("numeric_grounding_rate"),
    )


# --- vectors ----------------------------------------------------------------------


def vector_search(
    chunks: DataFrame, queries: DataFrame, chunk_id: str, k: int = vocab.VECTOR_K, overfetch: int = vocab.VECTOR_OVERFETCH,
    scope: str | None = None, filters: dict[str, str] | None = None, columns: list[str] | None = None,
) -> DataFrame:
    """k nearest chunks per query by squared distance, exact: query_id, rank, the chunk's id, score and further `columns` of it.

    queries: query_id, embedding, and the scope column; `filters` maps chunk columns to
    query columns. As an index does, overfetch * k neighbours are taken first and the
    filters apply to those, so fewer than k may remain. Chunks and queries without a vector
    are left out.

    Chunks are stored in blocks of one scope, of vectors at like distances from a few pivots; a
    large scope is dealt to many places. The queries of a scope come to its blocks, QUERY_BLOCK
    at a time, in one pass. Every task skips blocks that the triangle inequality puts beyond a
    query's nearest few so far, so the shuffle carries little more than overfetch * k rows per
    query and task. Other columns are looked up for the fetched chunks only.
    """
    filters, limit, own = filters or {}, k * overfetch, [scope] if scope else []
    spark = chunks.sparkSession
    rows = chunks.select(*own, F.col(chunk_id).alias("_id"), F.col("embedding").cast("array<double>").alias("v")).filter("v IS NOT NULL")
    asked = queries.select(*own, "query_id", F.col("embedding").cast("array<double>").alias("v")).filter("v IS NOT NULL")
    asked = _written(asked.withColumn("_q", F.monotonically_increasing_id()), "queries")
    hit = T.StructType([T.StructField("_q", T.LongType()), T.StructField("_id", chunks.schema[chunk_id].dataType), T.StructField("score", T.DoubleType())])
    pivots = [r["v"] for r in rows.select("v", F.xxhash64("_id").alias("h")).orderBy("h").limit(PIVOTS).collect()]
    if not pivots:
        found = spark.createDataFrame([], hit)
    else:
        pivots = np.array(pivots)
        if scope:
            rows = deal_by_scope(_written(rows, "vectors"), own, vectors.RUN * vectors.BLOCK)
        doubles = T.StructType.fromDDL("vectors array<double>, low array<double>, high array<double>")
        schema = T.StructType([*[rows.schema[c] for c in own], T.StructField("ids", T.ArrayType(hit["_id"].dataType)), *doubles.fields])
        blocks = _written(rows.mapInArrow(vectors.built(to_arrow_schema(schema), len(own), pivots), schema), "blocks")
        n = asked.count()
        part = F.pmod(F.xxhash64("_q"), F.lit(-(-n // QUERY_BLOCK) or 1)).alias("_part")
        place = F.col(scope) if scope else F.lit(0)
        packed = asked.groupBy(place.alias("_scope"), part).agg(F.collect_list(F.struct("_q", "v")).alias("asked")).drop("_part")
        met = blocks.withColumn("_scope", place).join(F.broadcast(packed) if n * pivots.shape[1] <= BROADCAST_NUMBERS else packed, "_scope")
        found = met.mapInArrow(vectors.searched(to_arrow_schema(hit), pivots, limit), hit)
    fetched = _written(top_k(found, ["_q"], [F.col("score"), F.col("_id")], limit, "fetch_rank"), "fetched")
    kept = fetched.join(asked.select("_q", "query_id"), "_q").drop("_q").withColumnRenamed("_id", chunk_id)
    carried = list(dict.fromkeys([*filters, *(columns or [])]))
    if carried:
        wanted = kept.select(chunk_id).distinct()
        known = chunks.select(chunk_id, *[c for c in carried if c != chunk_id])
        kept = kept.join(small_lookup(known, wanted, [chunk_id]), chunk_id)
    wants = queries.select("query_id", *[F.col(c).alias(f"_want_{c}") for c in filters.values()])
    kept = kept.join(wants, "query_id") if filters else kept
    for column, want in filters.items():
        kept = kept.filter(F.col(f"_want_{want}").isNull() | (F.col(f"_want_{want}") == F.col(column)))
    return top_k(kept.drop(*[f"_want_{c}" for c in filters.values()]), ["query_id"], [F.col("fetch_rank")], k)


# --- keywords and history ------------------------------------------------------------


def keyword_match(content: Column, query: Column) -> Column:
    """Whether any word of the lower-cased query occurs in the lower-cased content."""
    words = F.filter(F.split(squash(F.lower(query)), " "), lambda w: w != "")
    return let(F.lower(content), lambda text: F.exists(words, lambda w: text.contains(w)))


def keyword_search(records: DataFrame, query: str, content: str = "content") -> DataFrame:
    """Records holding any word of one query; a filter, pushed to the scan's stage."""
    words = [w for w in query.lower().split()]
    if not words:
        return records.filter(F.lit(False))
    text = F.lower(content)
    hit = text.contains(words[0])
    for word in words[1:]:
        hit = hit | text.contains(word)
    return records.filter(hit)


def chat_history(queries: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages per session in time order: the question, then the answer."""
    turns = F.array(
        F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role"), F.col("question").alias("content")),
        F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("content")),
    )
    rows = queries.join(sessions.select("session_id", "session_name"), "session_id").select(
        "session_id", "session_name", "query_id", "created_at", F.explode(turns).alias("t")
    )
    tags = F.array_distinct(F.regexp_extract_all(F.col("t.content"), F.lit(r"\[C\d+\]"), F.lit(0)))
    return rows.filter("t.content IS NOT NULL").select(
        "session_id", "session_name", "query_id", "created_at", "t.turn", "t.role", "t.content",
        F.when(F.col("t.role") == "assistant", tags).otherwise(F.array().cast("array<string>")).alias("citations"),
    ).orderBy("session_id", "created_at", "query_id", "turn")

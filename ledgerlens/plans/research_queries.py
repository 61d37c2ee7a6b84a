"""Queries of chunking, retrieval, answers and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens import vocab
from ledgerlens.operators import chunking as C
from ledgerlens.operators import retrieval as R
from ledgerlens.operators.ordering import small_lookup
from ledgerlens.session import cut_lineage
from ledgerlens.plans import inputs as I

def reports(spark, sf):
    """Documents with section headers; the whole text is kept."""
    docs = I.texts(spark, sf, "documents")
    text = F.concat(
        F.lit("SECTION 1: "), F.upper("source"), F.lit("\n"), F.col("text"), F.lit("\n\nSECTION 2: LANGUAGE\nWritten in "),
        F.col("lang"), F.lit(". Length "), F.col("n_chars").cast("string"), F.lit(" characters."),
    )
    return docs.select("doc_id", text.alias("text"))


def chunks(spark, sf):
    """Chunks with ids that are unique over all documents: the document, the chunk number and, in two digits, how long that number is."""
    out = C.chunk_sections(reports(spark, sf), ["doc_id"])
    number = F.col("chunk_no").cast("string")
    return out.withColumn("chunk_id", F.concat(F.lit("C"), "doc_id", number, F.lpad(F.length(number).cast("string"), 2, "0")))


def section_chunks(spark, sf):
    return chunks(spark, sf)


def paragraph_chunks(spark, sf):
    out = C.chunk_paragraphs(I.texts(spark, sf, "documents"), ["doc_id"])
    return out.select("doc_id", "index", "total", "character_count", F.md5("text").alias("text_hash"))


def small_paragraph_chunks(spark, sf):
    """The same packer with a small target, so that windows and overlaps are common."""
    out = C.chunk_paragraphs(reports(spark, sf), ["doc_id"], target=400, overlap=50)
    return out.select("doc_id", "index", "total", "character_count", F.md5("text").alias("text_hash"))


def page_pieces(spark, sf):
    """Web pages as documents of one page, in overlapping pieces."""
    pages = I.texts(spark, sf, "pages").select(
        F.col("page_id").alias("document_id"), F.lit(1).alias("page_number"), F.col("html").alias("text"), F.lit("text_layer").alias("source")
    )
    out = C.chunk_pages(pages, ["document_id"], ["page_number", "source"])
    return out.select("document_id", "page_number", "source", "chunk_index", F.length("text").alias("n_chars"), F.md5("text").alias("text_hash"))


def context_budget(spark, sf):
    """Which packed chunks of a document fit the context budget."""
    docs = reports(spark, sf).select("doc_id", F.explode(C.budget_chunks(C.pack_paragraphs(F.col("text"), 4000, 400))).alias("b"))
    return docs.select("doc_id", "b.index", F.length("b.text").alias("n_chars"), "b.chosen", "b.truncated", "b.reason")


def questions(spark, sf):
    return I.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"))


def question_parts(spark, sf):
    return R.decompose(I.table(spark, sf, "conversations"), ["conv_id", "turn"], "text")


def _index(spark, sf):
    return R.TermIndex(chunks(spark, sf), ["doc_id", "chunk_no"])


def tfidf_stats(spark, sf):
    index = R.TermIndex(I.texts(spark, sf, "documents"), ["doc_id"])
    return index.vocabulary.select("term", "df", F.round("idf", 9).alias("idf"))


def tfidf_topk(spark, sf):
    hits = _index(spark, sf).search(questions(spark, sf), ["item_id"], "question", vocab.TFIDF_K)
    return hits.select("item_id", "rank", "doc_id", "chunk_no", F.round("score", 3).alias("score"))


def tfidf_topk_by_session(spark, sf):
    """The same within one session: the sources are the sessions, and each asks the items that fall to it."""
    sources = I.table(spark, sf, "documents").select("doc_id", F.col("source").alias("session_id"))
    index = R.TermIndex(small_lookup(chunks(spark, sf), sources, ["doc_id"]), ["doc_id", "chunk_no"], scope=["session_id"])
    asked = questions(spark, sf).withColumn("session_id", F.concat(F.lit("src"), F.col("item_id") % 20))
    hits = index.search(asked, ["item_id"], "question", vocab.TFIDF_K)
    return hits.select("item_id", "rank", "doc_id", "chunk_no", F.round("score", 3).alias("score"))


def _answers(spark, sf):
    text = chunks(spark, sf)
    parts = R.decompose(questions(spark, sf), ["item_id"])
    hits = R.TermIndex(text, ["doc_id", "chunk_no"]).search(parts, ["item_id", "part"], "sub_question", vocab.ANSWER_K)
    hits = small_lookup(text, hits, ["doc_id", "chunk_no"]).withColumn("score", F.round("score", 3))
    return cut_lineage(R.answers(hits, parts, "item_id")), text


def research_answers(spark, sf):
    out, _ = _answers(spark, sf)
    return out.select("item_id", "n_parts", "synthesis", F.array_join("citations", " ").alias("citations"))


def _findings(spark, sf):
    out, text = _answers(spark, sf)
    return out.select("item_id", F.explode("sub_answers").alias("a")).select("item_id", "a.part", "a.finding"), text


def citation_check(spark, sf):
    findings, text = _findings(spark, sf)
    return R.check_citations(findings, text, ["item_id", "part"], [])


def grounding_score(spark, sf):
    findings, text = _findings(spark, sf)
    return R.grounding_scores(findings, text, "item_id", [])


KEYWORDS = "Operating MARGIN outlook hand"


def keyword_retrieval(spark, sf):
    docs = I.texts(spark, sf, "documents").select("doc_id", "source", F.col("text").alias("content"))
    return R.keyword_search(docs, KEYWORDS).select("doc_id", "source")


def keyword_match(spark, sf):
    """Whether the turn before shares any word with each turn of a conversation."""
    turns = I.table(spark, sf, "conversations")
    asked = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("query"))
    both = turns.join(asked, ["conv_id", "turn"])
    return both.select("conv_id", "turn", R.keyword_match(F.col("text"), F.col("query")).alias("matched"))


HIT = ["text", "file_name", "page_number", "chunk_index", "source"]


def _vectors(spark, sf):
    """Stored vectors as chunks of documents, ten to a page."""
    v = I.table(spark, sf, "embeddings")
    return v.select(
        "vec_id", "label", "embedding", F.concat(F.lit("piece "), "vec_id").alias("text"), F.concat(F.lit("file"), "label", F.lit(".pdf")).alias("file_name"),
        F.floor(F.col("vec_id") / 10).alias("page_number"), (F.col("vec_id") % 10).alias("chunk_index"), F.lit("text_layer").alias("source"),
    )


def _asked_vectors(spark, sf):
    """Every fiftieth vector asks for its neighbours."""
    v = I.table(spark, sf, "embeddings").filter("vec_id % 50 = 0")
    return v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want"), F.col("label").alias("session_id"), "embedding")


def vector_topk(spark, sf):
    hits = R.vector_search(_vectors(spark, sf), _asked_vectors(spark, sf), "vec_id", columns=HIT)
    return hits.select("query_id", "rank", "vec_id", F.round("score", 9).alias("score"), *HIT)


def vector_topk_filtered(spark, sf):
    """Company filter after the over-fetch, so fewer than k may remain."""
    hits = R.vector_search(_vectors(spark, sf), _asked_vectors(spark, sf), "vec_id", filters={"label": "want"}, columns=HIT)
    return hits.select("query_id", "rank", "vec_id", "label", F.round("score", 9).alias("score"), *HIT)


def vector_topk_by_session(spark, sf):
    """Search within a session: the label is the session of chunk and query."""
    chunks_of = _vectors(spark, sf).withColumn("session_id", F.col("label"))
    hits = R.vector_search(chunks_of, _asked_vectors(spark, sf), "vec_id", scope="session_id", columns=HIT)
    return hits.select("query_id", "rank", "vec_id", F.round("score", 9).alias("score"), *HIT)


def chat_history(spark, sf):
    turns = I.table(spark, sf, "conversations")
    answer = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    asked = turns.filter("role = 'user'").join(answer, ["conv_id", "turn"], "left").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("query_id"), F.col("text").alias("question"), "answer",
        F.timestamp_seconds("turn").alias("created_at"),
    )
    sessions = turns.groupBy(F.col("conv_id").alias("session_id")).agg(F.concat(F.lit("Session "), F.first("conv_id").cast("string")).alias("session_name"))
    out = R.chat_history(asked, sessions)
    return out.select("session_id", "session_name", "query_id", "turn", "role", "content", F.size("citations").alias("n_citations"))


def stream_section_chunks(spark, sf):
    """The same chunks through a stream over the documents folder."""
    from ledgerlens.session import scratch_path
    from ledgerlens.streaming.incremental import index_new_documents, read_new_files

    schema = I.table(spark, sf, "documents").schema
    # the table is one file or a folder of them; a stream takes a single file only by a pattern
    docs = read_new_files(spark, f"{sf}/documents.parque[t]", schema)
    out = scratch_path(spark, "chunks")
    index_new_documents(docs.select("doc_id", "text"), ["doc_id"], out, scratch_path(spark, "chunks-log")).awaitTermination()
    return spark.read.parquet(out).select("doc_id", "chunk_no", "section", "text")


# --- oracle -------------------------------------------------------------------------

WS = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


REPORT_SQL = (
    "rep AS (SELECT doc_id, 'SECTION 1: ' || upper(source) || chr(10) || text || chr(10) || chr(10) || 'SECTION 2: LANGUAGE' || chr(10) || "
    "'Written in ' || lang || '. Length ' || n_chars || ' characters.' AS text FROM documents)"
)


def chunk_sql(source: str) -> str:
    return f"""
bl0 AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS b, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS o FROM {source}),
bl AS (SELECT doc_id, o, {strip_sql('b')} AS b FROM bl0 WHERE {strip_sql('b')} <> ''),
hd AS (SELECT *, nullif({strip_sql("regexp_extract(b, '^(SECTION [0-9]+:[^' || chr(10) || chr(13) || ']*)', 1)")}, '') AS h FROM bl),
cf AS (SELECT *, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY o), 'UNSPECIFIED') AS section FROM hd),
se AS (SELECT *, string_split(regexp_replace(b, '[.]{WS}+', '.' || chr(1), 'g'), chr(1)) AS s FROM cf),
gr AS (SELECT doc_id, o, section, s, unnest(range(0, (len(s) + 2) // 3)) AS i FROM se),
ch AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o, i) AS INTEGER) AS chunk_no, section, {strip_sql("array_to_string(s[i * 3 + 1 : i * 3 + 3], ' ')")} AS text FROM gr),
cc AS (SELECT doc_id, chunk_no, 'C' || doc_id || chunk_no || lpad(CAST(length(CAST(chunk_no AS VARCHAR)) AS VARCHAR), 2, '0') AS chunk_id, section, text FROM ch)"""


_STOP = "(" + ", ".join(f"'{w}'" for w in vocab.STOP_WORDS) + ")"
_CHUNKS = f"WITH {REPORT_SQL},{chunk_sql('rep')}"


def index_sql(source: str, keys: str) -> str:
    return f""",
tk AS (SELECT {keys}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM {source}),
tf AS (SELECT {keys}, term, count(*) AS tf FROM tk WHERE term NOT IN {_STOP} GROUP BY ALL),
nn AS (SELECT count(*) AS n FROM {source}),
voc AS (SELECT term, count(*) AS df, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM tf, nn GROUP BY term, n)"""


def search_sql(source: str, qkeys: str, k: int) -> str:
    """Questions in `source` (qkeys, qtext) against tf/voc; ends in `top`."""
    return f""",
we AS (SELECT doc_id, chunk_no, term, tf * idf AS w FROM tf JOIN voc USING (term)),
le AS (SELECT doc_id, chunk_no, sqrt(sum(w * w)) AS len FROM we GROUP BY ALL),
qt AS (SELECT {qkeys}, unnest(regexp_extract_all(lower(qtext), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM {source}),
qw AS (SELECT {qkeys}, term, count(*) * any_value(idf) AS q FROM qt JOIN voc USING (term) GROUP BY {qkeys}, term),
ql AS (SELECT {qkeys}, sqrt(sum(q * q)) AS qlen FROM qw GROUP BY ALL),
sc AS (SELECT {qkeys}, doc_id, chunk_no, round(sum(q / qlen * w) / any_value(len), 12) AS score
       FROM qw JOIN ql USING ({qkeys}) JOIN we USING (term) JOIN le USING (doc_id, chunk_no) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY {qkeys} ORDER BY score DESC, doc_id, chunk_no) AS rank FROM sc
        QUALIFY row_number() OVER (PARTITION BY {qkeys} ORDER BY score DESC, doc_id, chunk_no) <= {k})"""


def parts_sql(source: str, keys: str, text: str) -> str:
    """Two passes of the word mark, because neighbours share a border character."""
    mark = "regexp_replace({}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])and([^\\p{{L}}\\p{{N}}_]|$)', '\\1' || chr(1) || '\\2', 'g')"
    marked = mark.format(mark.format(text))
    parts = f"list_filter(list_transform(string_split_regex({marked}, '[?;\\x01]'), lambda x: {strip_sql('x')}), lambda x: length(x) > 8)"
    return f"""
pl AS (SELECT {keys}, {text} AS whole, {parts} AS p FROM {source}),
pt AS (SELECT {keys}, unnest(range(1, greatest(len(p), 1) + 1)) AS i, p, whole FROM pl),
parts AS (SELECT {keys}, CAST(i AS INTEGER) AS part, CASE WHEN len(p) = 0 THEN whole ELSE p[i] END AS sub_question FROM pt)"""


_ANSWERS = (
    f"{_CHUNKS},{parts_sql('benchmark', 'item_id', 'text')}, asked AS (SELECT item_id, part, sub_question AS qtext FROM parts)"
    f"{index_sql('cc', 'doc_id, chunk_no')}{search_sql('asked', 'item_id, part', vocab.ANSWER_K)}" + """,
hit AS (SELECT top.*, chunk_id, section, text FROM top JOIN cc USING (doc_id, chunk_no)),
fi AS (SELECT p.item_id, p.part, p.sub_question,
         coalesce(string_agg(text || ' [' || chunk_id || ']', ' ' ORDER BY rank), '""" + vocab.NO_EVIDENCE + """') AS finding,
         list(chunk_id ORDER BY rank) FILTER (chunk_id IS NOT NULL) AS ids, string_agg(text, ' ' ORDER BY rank) AS cited
       FROM parts p LEFT JOIN hit USING (item_id, part) GROUP BY 1, 2, 3)"""
)

_NEAREST = """ch AS (SELECT *, 'piece ' || vec_id AS text, 'file' || label || '.pdf' AS file_name, vec_id // 10 AS page_number, vec_id % 10 AS chunk_index, 'text_layer' AS source FROM embeddings),
qv AS (SELECT vec_id AS query_id, label AS want, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
ds AS (SELECT query_id, want, ch.*, list_sum(list_transform(range(1, len(q) + 1), lambda j: (CAST(embedding[j] AS DOUBLE) - CAST(q[j] AS DOUBLE)) ** 2)) AS score FROM ch, qv{where}),
fe AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS fr FROM ds QUALIFY fr <= 15)"""
_HIT = "round(score, 9) AS score, text, file_name, page_number, chunk_index, source"

ORACLE = {
    "section_chunks": _CHUNKS + " SELECT * FROM cc",
    "question_parts": f"WITH {parts_sql('conversations', 'conv_id, turn', 'text')} SELECT * FROM parts",
    "tfidf_stats": f"WITH docs AS (SELECT doc_id, text FROM documents){index_sql('docs', 'doc_id')} SELECT term, df, round(idf, 9) AS idf FROM voc",
    "tfidf_topk": f"{_CHUNKS}, asked AS (SELECT item_id, text AS qtext FROM benchmark){index_sql('cc', 'doc_id, chunk_no')}{search_sql('asked', 'item_id', vocab.TFIDF_K)}"
    " SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, chunk_no, round(score, 3) AS score FROM top",
    "tfidf_topk_by_session": f"""{_CHUNKS}, ss AS (SELECT cc.*, source AS session_id FROM cc JOIN documents USING (doc_id) WHERE source IS NOT NULL),
tk AS (SELECT session_id, doc_id, chunk_no, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM ss),
tf AS (SELECT session_id, doc_id, chunk_no, term, count(*) AS tf FROM tk WHERE term NOT IN {_STOP} GROUP BY ALL),
nn AS (SELECT session_id, count(*) AS n FROM ss GROUP BY 1),
voc AS (SELECT session_id, term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM tf JOIN nn USING (session_id) GROUP BY 1, 2),
we AS (SELECT session_id, doc_id, chunk_no, term, tf * idf AS w FROM tf JOIN voc USING (session_id, term)),
le AS (SELECT session_id, doc_id, chunk_no, sqrt(sum(w * w)) AS len FROM we GROUP BY ALL),
qt AS (SELECT item_id, 'src' || item_id % 20 AS session_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM benchmark),
qw AS (SELECT session_id, item_id, term, count(*) * any_value(idf) AS q FROM qt JOIN voc USING (session_id, term) GROUP BY ALL),
ql AS (SELECT item_id, sqrt(sum(q * q)) AS qlen FROM qw GROUP BY ALL),
sc AS (SELECT item_id, doc_id, chunk_no, round(sum(q / qlen * w) / any_value(len), 12) AS score
       FROM qw JOIN ql USING (item_id) JOIN we USING (session_id, term) JOIN le USING (session_id, doc_id, chunk_no) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, chunk_no) AS INTEGER) AS rank, doc_id, chunk_no, round(score, 3) AS score
FROM sc QUALIFY rank <= {vocab.TFIDF_K}""",
    "research_answers": _ANSWERS + """, tg AS (SELECT item_id, '[' || chunk_id || ' | ' || section || ']' AS tag, min(part * 10 + rank) AS o FROM hit GROUP BY 1, 2),
      ci AS (SELECT item_id, string_agg(tag, ' ' ORDER BY o) AS citations FROM tg GROUP BY 1)
      SELECT item_id, CAST(count(*) AS INTEGER) AS n_parts, string_agg('- On "' || sub_question || '": ' || finding, chr(10) ORDER BY part) AS synthesis,
        coalesce(any_value(citations), '') AS citations FROM fi LEFT JOIN ci USING (item_id) GROUP BY 1""",
    "citation_check": _ANSWERS + " SELECT item_id, part, coalesce(len(ids), 0) AS n_cited, coalesce(len(ids), 0) > 0 AS citations_valid FROM fi",
    "grounding_score": _ANSWERS + """, cl AS (SELECT item_id, part, ids, cited,
          list_transform(list_filter(list_transform(regexp_extract_all(finding, '[0-9]+[0-9,.]*""" + WS + """?(?:%|bps|cr|crore|x)?'), lambda n: """ + strip_sql("n") + """), lambda n: length(n) >= 2),
            lambda n: regexp_replace(string_split_regex(n, '""" + WS + """+')[1], '[,.]+$', '')) AS claims FROM fi),
      ck AS (SELECT item_id, ids, len(claims) AS checked, len(list_filter(claims, lambda n: contains(coalesce(cited, ''), n))) AS grounded FROM cl)
      SELECT item_id, count(*) AS sub_questions_answered, count(*) FILTER (len(ids) > 0) AS sub_answers_with_valid_citations,
        CAST(sum(checked) AS BIGINT) AS numeric_claims_checked, CAST(sum(grounded) AS BIGINT) AS numeric_claims_grounded_in_cited_chunk,
        CAST(printf('%.1f', count(*) FILTER (len(ids) > 0) / count(*) * 100) AS DOUBLE) AS citation_validity_rate,
        CAST(printf('%.1f', coalesce(sum(grounded) / nullif(sum(checked), 0), 1.0) * 100) AS DOUBLE) AS numeric_grounding_rate
      FROM ck GROUP BY 1""",
    "keyword_retrieval": "SELECT doc_id, source FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{w}')" for w in KEYWORDS.lower().split()),
    "keyword_match": f"SELECT a.conv_id, a.turn, len(list_filter(string_split(trim(regexp_replace(lower(b.text), '{WS}+', ' ', 'g')), ' '), lambda w: w <> '' AND contains(lower(a.text), w))) > 0 AS matched "
    "FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1",
    "vector_topk": f"WITH {_NEAREST.format(where='')} SELECT query_id, CAST(fr AS INTEGER) AS rank, vec_id, {_HIT} FROM fe WHERE fr <= 5",
    "vector_topk_filtered": f"WITH {_NEAREST.format(where='')}, kp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fr) AS r FROM fe WHERE label = want) "
    f"SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, label, {_HIT} FROM kp WHERE r <= 5",
    "vector_topk_by_session": f"WITH {_NEAREST.format(where=' WHERE label = want')} SELECT query_id, CAST(fr AS INTEGER) AS rank, vec_id, {_HIT} FROM fe WHERE fr <= 5",
    "chat_history": """WITH q AS (SELECT u.conv_id AS session_id, u.turn AS query_id, u.text AS question, a.text AS answer FROM conversations u
        LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
      m AS (SELECT session_id, query_id, 0 AS turn, 'user' AS role, question AS content FROM q UNION ALL SELECT session_id, query_id, 1, 'assistant', answer FROM q WHERE answer IS NOT NULL)
      SELECT session_id, 'Session ' || session_id AS session_name, query_id, turn, role, content,
        CASE WHEN role = 'assistant' THEN CAST(len(list_distinct(regexp_extract_all(content, '\\[C[0-9]+\\]'))) AS INTEGER) ELSE 0 END AS n_citations FROM m""",
    "stream_section_chunks": f"WITH{chunk_sql('documents')} SELECT doc_id, chunk_no, section, text FROM cc",
}

ROWS_ONLY = ["paragraph_chunks", "small_paragraph_chunks", "page_pieces", "context_budget"]
QUERIES = {name: globals()[name] for name in [*ORACLE, *ROWS_ONLY]}

"""The registered queries of this subpackage, each over its whole table, and the SQL where one can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontamination, jaccard_join, language_id, mixing, near_duplicates, quality_classifier, quality_rules, ranked_search, repeats, toxicity, url_filters, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), size=2).drop("node", "root")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(warc.records(table(spark, sf_dir, "pages")))
    index = warc.capture_index(warc.read_captures(spark, path))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), carried=["doc_id"])
    return mixed.select("row.doc_id", "tokens", "source_group", "lang_group", "topic_group", "weight", "probability", "selected")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_filters(table(spark, sf_dir, "pages"), url_filters.rule_table(spark))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents"), carried=["doc_id"])
    return cut.select("row.doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_language_id, op3_quality_classifier, op4_quality_rules, op5_warc, op6_toxicity, op7_mixing, op8_decontamination, op9_url_filters, op10_repeats, op11_ranked_search, op12_jaccard_join, op13_whitening)}

_PRIOR = """
  SELECT sum({r}) / sum(n)::DOUBLE AS m,
         sum({r}::DOUBLE * {r} / n) / sum(n) - m * m - m * (1 - m) * count(*) / sum(n) AS spread,
         least(greatest(CASE WHEN spread > 0 THEN m * (1 - m) / spread - 1 ELSE 1e6 END, 1), 1e6) AS s FROM hosts"""

ORACLE = {
    "op1_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS k, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
each AS (SELECT k, unnest(ws) AS x, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM w),
two AS (SELECT k, n, x || ' ' || lead(x) OVER (PARTITION BY k ORDER BY i) AS g, x FROM each),
sh AS (SELECT DISTINCT k, coalesce(g, x) AS g FROM two WHERE g IS NOT NULL OR n = 1),
size AS (SELECT k, count(*) AS n FROM sh GROUP BY k),
pairs AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.k < b.k GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN size x ON x.k = a JOIN size y ON y.k = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(k, r) AS (SELECT k, k FROM w UNION SELECT reach.k, b FROM reach JOIN edges ON r = a),
comp AS (SELECT reach.k, min(doc_id) AS component_id FROM reach JOIN w ON w.k = r GROUP BY reach.k)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM w JOIN comp USING (k) LEFT JOIN size USING (k)""",
    "op4_quality_rules": r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         row_number() OVER () AS k
  FROM documents),
each AS (SELECT k, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
win AS (
  SELECT k, i, g FROM (
    SELECT k, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS g FROM each WINDOW o AS (PARTITION BY k ORDER BY i)) WHERE g IS NOT NULL),
rep AS (SELECT k, g FROM win GROUP BY k, g HAVING count(*) > 1),
hit AS (SELECT DISTINCT k, unnest([i, i + 1, i + 2]) AS i FROM win JOIN rep USING (k, g)),
n_hit AS (SELECT k, count(*) AS n FROM hit GROUP BY k),
m AS (
  SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN n_hit USING (k)),
f AS (
  SELECT *, n_words < 50 AS few_words, 100 * n_repeat_words > 50 * n_words AS repeats, n_symbols * 10 > word_chars AS symbols,
         n_dup_lines * 10 > n_lines * 3 AS dup_lines FROM m),
hosts AS (
  SELECT source, count(*) AS n, sum(few_words::INT) AS few_words, sum(repeats::INT) AS repeats, sum(symbols::INT) AS symbols, sum(dup_lines::INT) AS dup_lines
  FROM f WHERE source IS NOT NULL GROUP BY source),
a AS (""" + _PRIOR.format(r="few_words") + "), b AS (" + _PRIOR.format(r="repeats") + "), c AS (" + _PRIOR.format(r="symbols") + "), d AS (" + _PRIOR.format(r="dup_lines") + r"""),
v AS (
  SELECT source, greatest((few_words + a.m * a.s) / (n + a.s), (repeats + b.m * b.s) / (n + b.s),
                          (symbols + c.m * c.s) / (n + c.s), (dup_lines + d.m * d.s) / (n + d.s)) > 0.5 AS host_failed
  FROM hosts, a, b, c, d)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words OR repeats AS base_failed,
       NOT (few_words OR repeats) AND NOT coalesce(host_failed, false) AS kept
FROM f LEFT JOIN v USING (source)""",
    "op5_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
first AS (SELECT x, min(page_id) AS lead FROM p GROUP BY x),
q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, x, lead, lead IS NOT NULL AND page_id IS DISTINCT FROM lead AS again FROM p JOIN first USING (x))
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(x, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> ((3 - i % 4) * 5)::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN lead END AS refers_to
FROM q""",
    "op8_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + 9], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
word AS (SELECT k, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM d),
gram AS (
  SELECT k, i, n, array_to_string(xs[1 : n], ' ') AS g
  FROM (SELECT k, i, list(x) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS xs FROM word), (SELECT DISTINCT n FROM win) WHERE len(xs) >= n),
found AS (SELECT k, i, n, item_id FROM gram JOIN win USING (n, g)),
hit AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM found) GROUP BY k),
item AS (SELECT k, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM found WHERE item_id IS NOT NULL GROUP BY k)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN item USING (k)""",
    "op9_url_filters": r"""
WITH rules(h, p, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (
  SELECT page_id, row_number() OVER () AS k,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (
  SELECT page_id, k, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
best AS (
  SELECT k, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM s LEFT JOIN best USING (k)""",
    "op11_ranked_search": r"""
WITH t AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
d AS (SELECT k, doc_id, len(ts)::BIGINT AS n, ts FROM t WHERE len(ts) > 0),
size AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS tokens FROM d),
m AS (SELECT k, doc_id, 25 + ((75 * n * docs) // tokens) AS m FROM d, size),
i AS (
  SELECT row_number() OVER () AS q, item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM benchmark),
asked AS (SELECT q, x, count(*)::BIGINT AS times FROM (SELECT q, unnest(ts) AS x FROM i) GROUP BY 1, 2),
post AS (SELECT k, x, count(*)::BIGINT AS tf FROM (SELECT k, unnest(ts) AS x FROM d) WHERE x IN (SELECT x FROM asked) GROUP BY 1, 2),
w AS (SELECT x, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM post, size GROUP BY x, docs),
s AS (
  SELECT q, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN w USING (x) JOIN post USING (x) JOIN m USING (k) GROUP BY q, k, doc_id),
r AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r JOIN i USING (q) WHERE rank <= 10""",
    "op12_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS k, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
sh AS (
  SELECT DISTINCT k, array_to_string(ws[i : i + 2], ' ') AS g
  FROM (SELECT k, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
size AS (SELECT k, count(*) AS n FROM sh GROUP BY k),
pairs AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.k < b.k GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN size x ON x.k = a JOIN size y ON y.k = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(k, r) AS (SELECT k, k FROM w UNION SELECT reach.k, b FROM reach JOIN edges ON r = a),
comp AS (SELECT reach.k, min(doc_id) AS component_id FROM reach JOIN w ON w.k = r GROUP BY reach.k)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM w JOIN comp USING (k) LEFT JOIN size USING (k)""",
}

"""URL rules matched as a safe-browsing list is, in DataFrame functions only.

A rule is a host and a path. Every distinct URL is expanded into its host suffixes, each
with its path prefixes up to a slash; an expression is known by the first 8 hex digits of
its SHA-256. Rules stand under the expression of their host and of their path up to its
last slash, so an equi-join on the short prefixes finds the candidates. Each candidate is
then confirmed by the full digest of host and whole rule path, and the longest rule wins
(of equally long ones that with the longer host, then a block).

Defined cases: a null URL or one without `://` has an empty host and path and no rule;
rules with a null or empty host are left out, a null rule path counts as empty; a host or
path longer than any rule's is only expanded as far as the longest rule reaches, which no
match can exceed; repeated URLs are judged once and every row gets the verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import ascii_lower, stage

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, action string")


def host_of(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def _rest(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + F.lit(3), F.char_length(url))


def _to_slash(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _keyed_rules(rules: DataFrame) -> DataFrame:
    path = F.coalesce("path", F.lit(""))
    return rules.filter(F.char_length("host") > 0).select(
        F.substring(_digest(F.col("host"), _to_slash(path)), 1, 8).alias("key"), _digest(F.col("host"), path).alias("full"),
        F.char_length(path).alias("rule_path"), F.concat("host", path).alias("rule"), F.char_length("host").alias("rule_host"), "action",
    )


def expressions(urls: DataFrame, max_host: int, max_path: int) -> DataFrame:
    """url, path, suffix, key: one row per host suffix and path prefix, no longer than the given lengths."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    pieces = F.slice(F.split(F.substring("path", 1, max_path), "/"), 1, max_path + 1)
    # the last piece has no slash after it, unless the path was cut there
    prefixes = F.transform(F.sequence(F.lit(0), F.size("pieces") - 1), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice("pieces", 1, i), "/"), F.lit("/"))))
    rows = urls.filter("host != ''").withColumn("labels", labels).withColumn("pieces", pieces)
    # suffixes of hosts with more labels than any rule has characters are cut to the last ones
    rows = rows.withColumn("labels", F.slice("labels", F.greatest(F.size("labels") - max_host, F.lit(1)), F.size("labels")))
    rows = rows.select("url", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).filter(F.char_length("suffix") <= max_host)
    rows = rows.select("url", "path", "suffix", F.explode("prefixes").alias("prefix"))
    return rows.select("url", "path", "suffix", F.substring(_digest(F.col("suffix"), F.col("prefix")), 1, 8).alias("key"))


def url_filters(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row; without a rule the verdict is `default`."""
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    keyed = _keyed_rules(rules)
    reach = rules.agg(F.max(F.char_length("host")).alias("h"), F.max(F.char_length("path")).alias("p")).first()
    urls = pages.select("url", "host", "path").distinct()
    found = expressions(urls, reach["h"] or 0, reach["p"] or 0).join(keyed, "key")
    found = found.filter(_digest(F.col("suffix"), F.expr("substring(path, 1, rule_path)")) == F.col("full"))
    order = F.struct(F.char_length("rule"), "rule_host", F.col("action") == "block")
    best = found.groupBy("url").agg(F.max_by(F.struct("rule", "action"), order).alias("best"))
    judged = pages.join(stage(best, "url-rules"), "url", "left")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))

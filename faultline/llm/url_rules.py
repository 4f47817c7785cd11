"""URL filter rules, indexed by the rarest literal token of their pattern.

A rule is a host and a path prefix; its pattern is a regular expression over host and path.  Every rule is filed under the one of its literal
tokens (host labels and path segments) that the fewest rules and URLs hold.  A URL's own tokens fetch the rules filed under them, and only
those run their regular expression.  Rules come as a table, so tens of millions are joined like any table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_SCHEMA = "rule string, host string, path string, verdict string, pattern string, tokens array<string>"
SCOPE_PATTERN = r"(?s)://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, SCOPE_PATTERN, 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, SCOPE_PATTERN, 2), F.lit(""))


def _tokens(host: str, path: str) -> list[str]:
    """``h:label`` of every host label and ``p:segment`` of every closed path segment: any URL that fits holds them all."""
    closed = path.split("/")[1:-1] if path.startswith("/") else []
    return sorted({f"h:{x}" for x in host.split(".")} | {f"p:{x}" for x in closed})


def rules_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules from ``(verdict, host, path)``; the host also stands for its subdomains, an empty host fits only an empty host."""
    rows = []
    for verdict, host, path in rules:
        pattern = r"(?s)\A" + (r"(?:[^/]*\.)?" if host else "") + re.escape(host) + (re.escape(path) if path else r"(?=/|\z)")
        rows.append((host + path, host, path, verdict, pattern, _tokens(host, path)))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL, as in the index; every part of the path counts, closed or not."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, parts))


def rule_index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Every rule under its rarest token: the one that the fewest of ``urls`` hold, then the fewest rules, then the first by name."""
    spread = rules.withColumn("token", F.explode("tokens"))
    in_rules = spread.groupBy("token").agg(F.count("*").alias("_rules"))
    in_urls = urls.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token")).join(in_rules.select("token"), "token", "left_semi").groupBy("token").agg(F.count("*").alias("_urls"))
    weighed = spread.join(in_rules, "token").join(in_urls, "token", "left")
    order = F.struct(F.coalesce("_urls", F.lit(0)), F.col("_rules"), F.col("token"))
    return weighed.groupBy("rule", "host", "path", "verdict", "pattern").agg(F.min_by("token", order).alias("token"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per page: ``id_col``, ``host``, ``path``, ``rule`` (null if none fits), ``verdict``.

    Of the rules that fit, the longest wins; of equally long ones, the first in the order (rule, verdict).  A null URL or one without
    ``://`` has an empty host and path.  Pages may repeat; other columns are ignored.  Equal URLs are judged once.
    """
    split = pages.select(F.col(id_col).alias("_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    urls = split.groupBy("host", "path").agg(F.count("*").alias("_pages"))
    index = rule_index(rules, urls)
    asked = urls.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    fits = asked.join(index, "token").where(F.expr("concat(_host, _path) rlike pattern"))
    order = F.struct(-F.length("rule"), F.col("rule"), F.col("verdict"))
    best = fits.groupBy("_host", "_path").agg(F.min_by(F.struct("rule", "verdict"), order).alias("_best"))
    same = F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path"))
    found = split.join(best, same, "left")
    return found.select(F.col("_id").alias(id_col), "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))

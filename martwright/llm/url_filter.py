"""URL rules of host and path, found by short hash prefixes.

Every rule is one expression, host and path joined. A URL is expanded into those of its host
suffixes and path prefixes whose shape (labels, path length) some rule has. Expressions meet rules
on the first 32 bits of their SHA-256, the whole digest confirms, and the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the digest on which expressions and rules are joined.
PREFIX_DIGITS = 8

RULE_SCHEMA = T.StructType([
    T.StructField("host", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("verdict", T.StringType()),
])


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def url_host(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """From after the host to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # a line feed between them: host "a", path "b" differs from host "ab" without a path
    return F.sha2(F.concat_ws("\n", host, path), 256)


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules with digest, text and rank. Of rules with one host and path, block wins over allow.

    Rules whose host, path or verdict is null are left out: they say nothing.
    """
    known = rules.select("host", "path", "verdict").dropna()
    once = known.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    digest = _digest(F.col("host"), F.col("path"))
    return once.select(
        digest.alias("digest"),
        F.substring(digest, 1, PREFIX_DIGITS).alias("prefix"),
        F.concat("host", "path").alias("rule"),
        F.col("verdict"),
        F.size(F.split("host", r"\.")).alias("labels"),
        F.length("path").alias("path_length"),
        F.length("host").alias("host_length"),
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame | Sequence[tuple[str, str, str]],
    id_column: str = "page_id",
    url_column: str = "url",
    default: str = "allow",
) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    rules: host, path, verdict (allow or block). A rule fits its host and all subdomains if the
    path starts with the rule's. The longest host and path together wins, then the longer host,
    then the smaller text; without a rule the verdict is the default and rule is null. A null URL or
    one without :// has an empty host and path, which only a rule with an empty host fits. Repeated
    pages are judged alike, each row is returned. No pages: no rows. No rules: the default.

    Each distinct host and path is judged once, so a URL that a third of the pages share is one
    row. Only (labels, path length) shapes of rules come to the driver: at most 127 labels times the
    longest rule path, whatever the number of rules.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), RULE_SCHEMA)
    table = rule_table(rules)
    shapes = [tuple(r) for r in table.select("labels", "path_length").distinct().collect()]
    judged = pages.select(
        F.col(id_column).alias("page_id"),
        url_host(F.col(url_column)).alias("host"),
        url_path(F.col(url_column)).alias("path"),
    )
    if not shapes:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    urls = judged.select("host", "path").distinct()
    shape_table = F.array(*[
        F.struct(F.lit(a).alias("labels"), F.lit(b).alias("length")) for a, b in sorted(shapes)
    ])
    fitting = F.filter(
        shape_table,
        lambda s: (s.labels <= F.size(F.split("host", r"\."))) & (s.length <= F.length("path")),
    )
    expressions = urls.select("host", "path", F.explode(fitting).alias("shape")).select(
        "host",
        "path",
        _digest(
            F.expr("substring_index(host, '.', -shape.labels)"),
            F.expr("substring(path, 1, shape.length)"),
        ).alias("digest"),
    )
    expressions = expressions.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    candidates = expressions.join(
        table.withColumnRenamed("digest", "rule_digest"), "prefix"
    )
    confirmed = candidates.where(F.col("digest") == F.col("rule_digest"))
    order = F.struct(
        F.length("rule").alias("length"), F.col("host_length"), F.col("rule"), F.col("verdict")
    )
    best = confirmed.groupBy("host", "path").agg(F.max(order).alias("best"))
    return judged.join(best, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )

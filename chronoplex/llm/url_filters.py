"""URL filters: many host and path rules against many urls.

Each rule is filed under one of its literal tokens, the one that occurs in the fewest urls. The tokens of a url fetch the
rules filed under them, and only those rules run their regular expression on the url.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import ascii_lower

RULE_SCHEMA = "verdict string, host string, path string"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    """What stands between the host and ``?``, ``#`` or the end; else empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rules_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """Rules written as (verdict, ``host/path``); the path reaches from the first slash to the end."""
    return spark.createDataFrame([(v, r.partition("/")[0], "/" + r.partition("/")[2]) for v, r in rules], RULE_SCHEMA)


def _literal(c: Column) -> Column:
    """A pattern for the text itself; a star in a rule stands for any run of characters."""
    quoted = F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.replace(quoted, F.lit("*"), F.lit("\\E(?s:.*)\\Q"))


def _host_tokens(host: Column) -> Column:
    return F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))


def _path_tokens(path: Column) -> Column:
    """Path segments that end with a slash: only those are whole in a rule's prefix."""
    parts = F.split(path, "/")
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: F.concat(F.lit("p:"), x))


def _all_path_tokens(path: Column) -> Column:
    return F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """``key, url, host, path, rule, verdict, candidates``: one row per row of ``pages``.

    ``rules`` has ``verdict, host, path``. A rule fits its host and all subdomains if the url's path starts with the
    rule's; a star in a rule's path stands for any characters. The longest rule wins, among equals the first by
    text and verdict. Without a rule the verdict is ``default``. A null url, or one without ``://``, has
    empty host and path. Repeated rows and null keys stay as they are; other columns of ``pages`` are not read. Rules with
    null parts are left out.
    """
    wanted = pages.select(F.col(key), F.col(url)).toDF("_key", "_url")
    parts = wanted.select("_url").filter(F.col("_url").isNotNull()).select("_url", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    tokens = parts.select("_url", F.concat("host", "path").alias("target"), F.explode(F.array_distinct(F.concat(
        F.array(F.lit("")), _host_tokens(F.col("host")), _all_path_tokens(F.col("path"))))).alias("token"))

    listed = rules.dropna(subset=["verdict", "host", "path"]).distinct().select(
        "verdict", F.concat("host", "path").alias("rule"),
        F.concat(F.lit(r"^(?:[^/]*\.)?"), _literal(F.col("host")), _literal(F.col("path"))).alias("pattern"),
        F.filter(F.array_distinct(F.concat(F.array(F.lit("")), _host_tokens(F.col("host")), _path_tokens(F.col("path")))),
                 lambda t: ~F.contains(t, F.lit("*"))).alias("tokens"))
    # a rule without any whole token is filed under the empty one, which every url has
    filed = listed.withColumn("token", F.explode("tokens")).drop("tokens")
    known = filed.select("token").distinct()
    frequency = tokens.select("token").join(known, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = (
        filed.join(frequency, "token", "left")
        .groupBy("verdict", "rule", "pattern").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), F.length("token") == 0, "token")).alias("token"))
    )
    fits = tokens.join(index, "token").groupBy("_url").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.min(F.when(F.regexp_like("target", F.col("pattern")), F.struct((-F.length("rule")).alias("rank"), "rule", "verdict"))).alias("best"))
    hit = wanted.join(fits, "_url", "left")
    return hit.select(
        F.col("_key").alias(key), F.col("_url").alias(url),
        F.coalesce(host_of(F.col("_url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("_url")), F.lit("")).alias("path"),
        F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.coalesce("candidates", F.lit(0).cast("long")).alias("candidates"))

"""URL rules by hash-prefix lookup.

A URL is expanded into expressions: every host suffix at a label boundary joined with
every path prefix whose length some rule has.  Expressions and rules are hashed; an
equi-join on the first 32 bits finds candidates, the full SHA-256 confirms them, and the
longest rule wins.

Defined results: a null URL or one without ``://`` has an empty host and path and meets
no rule; a URL that meets no rule gets ``otherwise``; of rules equally long the one that
sorts first wins, and of equal rules with both verdicts, block; repeated pages are each
judged; rules with a null part are void; page columns beyond those asked for are kept by
``with_verdicts`` unless they are named like an output, which replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (after ``://``, A-Z lower-cased) and the path up to a query or fragment; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\u0000"), path), 256)


def rule_table(rules: DataFrame) -> DataFrame:
    """(digest, prefix, rule, verdict, width) from rules (host, path, verdict), one row a rule."""
    return (
        rules.dropna(subset=["host", "path", "verdict"])
        .groupBy(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"))
        .agg(F.max("verdict").alias("rule_verdict"))  # "block" sorts last
        .select(
            _digest(F.col("rule_host"), F.col("rule_path")).alias("rule_digest"),
            F.concat("rule_host", "rule_path").alias("rule_text"),
            "rule_verdict",
            F.length("rule_path").alias("rule_path_length"),
        )
        .withColumn("rule_prefix", F.substring("rule_digest", 1, 8))
    )


def _expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    labels = F.split(host, "\\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.filter(F.array(*(F.lit(n) for n in lengths)).cast("array<int>"), lambda n: n <= F.length(path))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(cuts, lambda n: _digest(h, F.substr(path, F.lit(1), n)))))


def judge_urls(urls: DataFrame, rules: DataFrame, otherwise: str = ALLOW) -> DataFrame:
    """(url, host, path, rule, verdict) for each distinct url.

    Rules are broadcast while they have at most ``BROADCAST_ROWS`` rows; the lengths of
    their paths, which the expansion needs, are as many as a path has characters at most.
    """
    table = rule_table(rules)
    lengths = sorted(r.rule_path_length for r in table.select("rule_path_length").distinct().collect())
    small = table.count() <= BROADCAST_ROWS
    host, path = host_and_path(F.col("url"))
    distinct = urls.select("url").distinct().withColumns({"host": host, "path": path})
    hashed = distinct.select("url", F.explode(F.array_distinct(_expressions(F.col("host"), F.col("path"), lengths))).alias("digest"))
    met = hashed.join(F.broadcast(table) if small else table, F.substring("digest", 1, 8) == F.col("rule_prefix")).filter("digest = rule_digest")
    order = F.struct(-F.length("rule_text"), "rule_text")
    best = met.groupBy(F.col("url").alias("met_url")).agg(F.min_by(F.struct("rule_text", "rule_verdict"), order).alias("best"))
    return distinct.join(best, F.col("url") == F.col("met_url"), "left").select(
        "url", "host", "path", F.col("best.rule_text").alias("rule"), F.coalesce("best.rule_verdict", F.lit(otherwise)).alias("verdict")
    )


def with_verdicts(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = ALLOW) -> DataFrame:
    """Add host, path, rule and verdict of each row's URL."""
    outputs = ["host", "path", "rule", "verdict"]
    judged = judge_urls(pages.select(F.col(url).alias("url")), rules, otherwise).select(F.col("url").alias("_judged_url"), F.struct(*outputs).alias("_judged"))
    kept = [c for c in pages.columns if c not in outputs]
    joined = pages.select(F.struct(*kept).alias("_row"), F.col(url).alias("_url")).join(judged, F.col("_url").eqNullSafe(F.col("_judged_url")), "left")
    return joined.select(*(F.col("_row").getField(c).alias(c) for c in kept), *(F.col("_judged").getField(c).alias(c) for c in outputs))

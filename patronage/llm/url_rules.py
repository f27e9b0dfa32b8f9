"""URL filter: a sorted sweep over canonical keys against nested prefix rules.

A rule ``(host, path, verdict)`` fits its host and every subdomain when the url's path
starts with the rule's path; the longest rule text wins, then the longer host, then the
larger text.  With the labels of the host reversed and cut to the rule's depth, the key
``com.example<SOH>/en/`` makes every rule an interval of keys, and intervals nest or
are disjoint.  A url has one key for each of its host's endings that has rules.  Keys
and interval ends are sorted together; the stack of rules open at a key is the one
that the last interval end left behind.

Defined results: a NULL url, or one without ``://``, has empty host and path and fits
no rule; repeated urls are judged once and each row gets the verdict; rules that differ
only in verdict count as the smaller verdict; no rules or no pages give default
verdicts or no rows.  Other columns of either input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from patronage.llm.common import ascii_lower, carried, stage
from patronage.operators.skew import salted_join

CUT = "\u0001"
DEFAULT_VERDICT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(reversed_host: Column, path: Column) -> Column:
    """Hexadecimal, so that keys sort as bytes and 'G' is above any continuation."""
    return F.hex(F.concat(reversed_host, F.lit(CUT), path))


def _interval_ends(rules: DataFrame) -> DataFrame:
    """Where the stack of open rules changes: at the start and the end of each rule.

    A rule's stack holds the rules of its host whose paths are prefixes of its own, so
    it is never longer than the path.
    """
    opened = rules.select(
        "home",
        "path",
        F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n"),
    ).select("home", F.col("path").alias("inner"), F.expr("substring(path, 1, n)").alias("path"))
    stacks = (
        opened.join(rules, ["home", "path"])
        .groupBy("home", "inner")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        F.length("rule").alias("length"),
                        F.length("host").alias("host_length"),
                        "rule",
                        "verdict",
                    )
                )
            ).alias("open")
        )
        .withColumn("key", _key(F.col("home"), F.col("inner")))
    )
    return stacks.select(
        F.explode(
            F.array(
                F.struct("key", "open"),
                F.struct(
                    F.concat("key", F.lit("G")).alias("key"),
                    F.expr("slice(open, 1, size(open) - 1)").alias("open"),
                ),
            )
        ).alias("end")
    ).select("end.key", F.lit(0).alias("is_url"), "end.open")


def judge_urls(
    urls: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT
) -> DataFrame:
    """The rows of ``urls`` with ``host``, ``path``, ``rule`` and ``verdict``.

    Columns of ``urls`` with these names are replaced.
    """
    rules = (
        rules.select(
            ascii_lower(F.coalesce("host", F.lit(""))).alias("host"),
            F.coalesce("path", F.lit("")).alias("path"),
            F.coalesce("verdict", F.lit(default)).alias("verdict"),
        )
        .where(F.col("host") != "")
        .groupBy("host", "path")
        .agg(F.min("verdict").alias("verdict"))
        .withColumn("rule", F.concat("host", "path"))
        .withColumn("home", F.array_join(_labels(F.col("host")), "."))
    )
    deepest = rules.agg(F.max(F.size(_labels(F.col("host"))))).first()[0] or 0

    host, path = host_and_path(F.col(url))
    names = ("host", "path", "rule", "verdict")
    rows = urls.withColumn("_h", host).withColumn("_p", path)
    rows = rows.drop(*[c for c in names if c in urls.columns])
    # judged once for each key, however many hosts of a domain share it
    distinct = rows.select("_h", "_p").where(F.col("_h") != "").distinct()
    endings = stage(
        distinct.withColumn("labels", _labels(F.col("_h")))
        .withColumn("n", F.explode(F.expr(f"sequence(1, least(size(labels), {max(deepest, 1)}))")))
        .select("_h", "_p", F.array_join(F.expr("slice(labels, 1, n)"), ".").alias("home"))
        .join(rules.select("home").distinct(), "home", "left_semi")
        .select("_h", "_p", _key(F.col("home"), F.col("_p")).alias("key")),
        "endings",
    )
    keys = endings.select("key", F.lit(1).alias("is_url")).distinct()
    swept = carried(
        keys.unionByName(_interval_ends(rules), allowMissingColumns=True),
        ["key", "is_url"],
        "open",
        F.col("is_url") == 0,
    )
    longest = swept.where("is_url = 1 AND size(open) > 0").select("key", F.element_at("open", -1).alias("best"))
    # keys that very many hosts share, such as front pages, are salted
    fitting = salted_join(endings, longest, ["key"], "inner", by=["_h"])
    best = fitting.groupBy("_h", "_p").agg(F.max("best").alias("best"))
    return (
        rows.join(best, ["_h", "_p"], "left")
        .withColumn("rule", F.col("best.rule"))
        .withColumn("verdict", F.coalesce("best.verdict", F.lit(default)))
        .drop("best")
        .withColumnsRenamed({"_h": "host", "_p": "path"})
    )

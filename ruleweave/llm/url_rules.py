"""Allow and block rules on URLs by a sorted sweep over reversed hosts.

Reversing the labels of a host (``m.example.net`` becomes ``net.example.m.``) turns "this
host and all its subdomains" into an interval of keys, and a path prefix is an interval of
paths. Points (hosts, then paths under a rule's host) and interval borders are sorted
together in ranges; walking up the keys, the last border passed tells which nested rules
are active, as every border carries the stack that holds after it. A range takes the stack
it starts with from the ranges before it, so no task sees more than its range.

DataFrame functions only. Every distinct host and every distinct URL is judged once.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranks import in_ranges
from ..session import materialize


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty for null or without ``://``.

    The host ends at the first of / ? #, with A-Z lower-cased; the path ends at ? or #.
    """
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = F.substr(rest, F.length(host) + 1)
    return (
        F.translate(host, string.ascii_uppercase, string.ascii_lowercase),
        F.regexp_extract(tail, r"^[^?#]*", 0),
    )


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def key_prefixes(key: Column) -> Column:
    """Keys of a host and of all the hosts it is under."""
    labels = F.split(key, r"\.")
    n = F.size(labels) - 1
    return F.transform(
        F.sequence(F.lit(1), n), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit("."))
    )


def sweep(points: DataFrame, borders: DataFrame, order: Sequence[str], carry: str) -> DataFrame:
    """Give each point what the last border at or before it carries.

    ``points`` and ``borders`` share the ``order`` columns; borders add ``kind`` (0 an
    interval ends before this key, 1 one begins with it) and ``carry``.
    """
    marks = points.withColumn("kind", F.lit(2)).unionByName(borders, allowMissingColumns=True)
    placed = in_ranges(marks, *order, "kind")
    known = placed.where("kind < 2").groupBy("range__").agg(
        F.max_by(F.struct(carry), F.struct(*order, "kind")).alias("end")
    )
    every = placed.select("range__").distinct().join(known, "range__", "left")
    # One row per range: as many as there are partitions.
    start = F.last("end", ignorenulls=True).over(
        W.orderBy("range__").rowsBetween(W.unboundedPreceding, -1)
    )
    starts = every.select("range__", start.alias("start"))
    here = F.last(F.when(F.col("kind") < 2, F.struct(carry)), ignorenulls=True).over(
        W.partitionBy("range__").orderBy(*order, "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    passed = placed.withColumn("here", here).where("kind = 2").join(F.broadcast(starts), "range__")
    return passed.select(
        *points.columns, F.coalesce("here", "start")[carry].alias(carry)
    )


def _host_stacks(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, active): keys of the rule hosts each host falls under."""
    keys = rules.select("key").distinct()
    above = keys.select("key", F.explode(key_prefixes(F.col("key"))).alias("up")).join(
        keys.select(F.col("key").alias("up")), "up", "left_semi"
    )
    # The stack of a rule's host: at most one entry per label.
    stacks = above.groupBy("key").agg(F.array_sort(F.collect_set("up")).alias("stack"))
    begins = stacks.select(F.col("key").alias("at"), F.lit(1).alias("kind"), F.col("stack").alias("active"))
    ends = stacks.select(
        F.concat(F.substr("key", F.lit(1), F.length("key") - 1), F.lit("/")).alias("at"),
        F.lit(0).alias("kind"),
        F.filter("stack", lambda k: k != F.col("key")).alias("active"),
    )
    points = hosts.select("host", host_key(F.col("host")).alias("at"))
    found = sweep(points, begins.unionByName(ends), ["at"], "active")
    return found.where(F.size("active") > 0).select("host", "active")


def _path_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, key, best): the longest path rule each URL meets under one rule host."""
    rule = F.struct("rule", "verdict", "rule_path")
    ups = rules.select(
        "key", "rule_path",
        F.explode(
            F.transform(F.sequence(F.lit(0), F.length("rule_path")), lambda i: F.substr("rule_path", F.lit(1), i))
        ).alias("up"),
    ).where("up <> rule_path")
    parents = (
        ups.join(rules.select("key", F.col("rule_path").alias("up"), rule.alias("parent")), ["key", "up"])
        .groupBy("key", "rule_path")
        .agg(F.max_by("parent", F.length("up")).alias("parent"))
    )
    linked = rules.withColumn("own", rule).join(parents, ["key", "rule_path"], "left")
    # Hexadecimal digits keep the order of the bytes, and "g" comes after all of them.
    begins = linked.select("key", F.hex("rule_path").alias("at"), F.lit(1).alias("kind"), F.col("own").alias("best"))
    ends = linked.select(
        "key", F.concat(F.hex("rule_path"), F.lit("g")).alias("at"), F.lit(0).alias("kind"),
        F.col("parent").alias("best"),
    )
    found = sweep(urls.withColumn("at", F.hex("path")), begins.unionByName(ends), ["key", "at"], "best")
    return found.where("startswith(path, best.rule_path)")


def judge_urls(
    pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    ``rules`` has (host, path, verdict); a rule fits its host and all subdomains when the
    path begins with the rule's. Of the rules that fit, the one with the longest host and
    path together decides, then the one with the longer host; of equal rules with different
    verdicts, the smaller verdict (allow before block). Without a rule, ``rule`` is null and
    the verdict is ``default``. Rules with a null or empty host or a null path or verdict
    fit nothing. Null URLs and those without ``://`` have an empty host and path. Repeated
    rows are judged alike, empty tables give no rows, and columns of ``pages`` that bear one
    of the four names are replaced.
    """
    host, path = url_parts(F.col(url_col))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parted = pages.select(*kept, host.alias("host"), path.alias("path"))
    known = materialize(
        rules.where("host is not null and host <> '' and path is not null and verdict is not null")
        .groupBy(
            host_key(F.translate("host", string.ascii_uppercase, string.ascii_lowercase)).alias("key"),
            F.col("path").alias("rule_path"),
        )
        .agg(F.min("verdict").alias("verdict"), F.min(F.concat("host", "path")).alias("rule"))
    )
    urls = materialize(parted.select("host", "path").distinct())
    stacks = materialize(_host_stacks(urls.select("host").distinct(), known))
    under = urls.join(stacks, "host").select("host", "path", F.explode("active").alias("key"))
    fits = _path_rules(under, known)
    best = materialize(
        fits.groupBy("host", "path").agg(
            F.max_by("best", F.struct(F.length("best.rule"), F.length("key"))).alias("best")
        ).select("host", "path", "best.rule", "best.verdict")
    )
    return parted.join(best, ["host", "path"], "left").select(
        *kept, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )

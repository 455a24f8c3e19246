"""Operator 10, URL filters: a broadcast trie over reversed host labels, then path text, longest match first.

A rule is (host, path, verdict). It fits a url whose host is the rule's host or a subdomain of it and whose path
starts with the rule's path. Of the rules that fit, the one with most host labels wins, then the longest path; two
rules with the same host and path are refused when the trie is built. A url that no rule fits gets the default.

Null urls, urls without ``://`` and empty urls have an empty host and an empty path, fit no rule and get the default.
Repeated rows are judged alike; columns of the input whose names clash with the results' are replaced by them.
The trie's size is that of the rule list, which is checked against MAX_RULES before it is broadcast. A longer list is
never broadcast nor brought to the driver: the same walk is then made by joins, each level of the trie a join key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brainweave.llm import common

#: More rules than this are not broadcast: they are joined.
MAX_RULES = 1_000_000
#: The rules of the registered query.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
LOWER = {i: i + 32 for i in range(65, 91)}


def build_trie(rules: list[tuple[str, str, str]]) -> dict:
    """Nodes are dicts by host label, read from the right; the key None holds a node's path rules: a list of
    (segments, rule text, verdict), where the segments are the path split at '/'; the last may be a partial one."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the bound for a broadcast trie is {MAX_RULES}")
    root: dict = {}
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        paths = node.setdefault(None, {})
        for segment in path.split("/")[:-1]:
            paths = paths.setdefault(segment, {})
        ends = paths.setdefault(None, {})  # what the next segment has to start with
        tail = path.rsplit("/", 1)[-1]
        if tail in ends:
            raise ValueError(f"two rules for {host}{path}")
        ends[tail] = (f"{host}{path}", verdict)
    return root


def longest_path(paths: dict, path: str) -> tuple[str, str] | None:
    """The deepest rule in a path trie that the path starts with."""
    best, node = None, paths
    segments = path.split("/")
    for depth, segment in enumerate(segments):
        if ends := node.get(None):
            fits = [tail for tail in ends if segment.startswith(tail)]
            if fits:
                best = ends[max(fits, key=len)]
        node = node.get(segment)
        if node is None or depth == len(segments) - 1:
            break
    return best


def match(root: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest match, or None."""
    best, node = None, root
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        if None in node:
            best = longest_path(node[None], path) or best
    return best


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path, both empty without '://'."""
    if not (found := PARTS.search(url or "")):
        return "", ""
    return found[1].translate(LOWER), found[2]


def judge_urls(
    df: DataFrame,
    rules: list[tuple[str, str, str]] | DataFrame = RULES,
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """df with host, path, rule (null where none fits) and verdict. rules: a list or a table (host, path, verdict), of any length."""
    spark = df.sparkSession
    if isinstance(rules, DataFrame):
        rules = rules.select("host", "path", "verdict")
        few = rules.limit(MAX_RULES + 1).count() <= MAX_RULES
        return _by_trie(df, [tuple(r) for r in rules.collect()], url, default) if few else _by_joins(df, rules, url, default)
    if len(rules) > MAX_RULES:
        return _by_joins(df, spark.createDataFrame(rules, "host string, path string, verdict string"), url, default)
    return _by_trie(df, rules, url, default)


def _by_trie(df: DataFrame, rules: list[tuple[str, str, str]], url: str, default: str) -> DataFrame:
    trie = df.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        root = trie.value
        for urls in batches:
            rows = []
            for u in urls:
                host, path = split_url(u)
                rows.append((host, path, *(match(root, host, path) or (None, default))))
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    kept = [F.col(f"`{c}`") for c in _others(df)]
    return df.select(*kept, judge(F.col(f"`{url}`")).alias("_j")).select(*kept, "_j.host", "_j.path", "_j.rule", "_j.verdict")


def _others(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]


def _by_joins(df: DataFrame, rules: DataFrame, url: str, default: str) -> DataFrame:
    """The longest match by equality alone: a host's suffixes that have rules, then the path's beginnings of lengths that rules of such a suffix have.

    Every pair of host and path is judged once, however many rows have it, and meets at most one rule per suffix and
    length, so no host with many urls or many rules becomes a product of both. The side that may be skewed (urls)
    always meets a side of distinct keys, so adaptive execution can split it.
    """
    if rules.groupBy("host", "path").count().filter("count > 1").limit(1).count():
        raise ValueError("two rules for one host and path")
    part = lambda i: F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), f"(?s){PARTS.pattern}", i)
    rows = df.select(*[F.col(f"`{c}`") for c in _others(df)], common.lower_ascii(part(1)).alias("host"), part(2).alias("path"))
    listed = rules.select(F.col("host").alias("_on"), F.col("path").alias("_start"), "verdict")
    lengths = listed.select("_on", F.length("_start").alias("_n")).distinct()
    urls = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    on = urls.select("host").distinct().select("host", F.explode(ends).alias("_on")).join(listed.select("_on").distinct(), "_on", "left_semi")
    starts = urls.join(on, "host").join(lengths, "_on").filter(F.col("_n") <= F.length("path"))
    hits = starts.withColumn("_start", F.left("path", F.col("_n"))).join(listed, ["_on", "_start"])
    rank = F.struct(F.size(F.split("_on", r"\.", -1)).alias("labels"), "_n", F.concat("_on", "_start").alias("rule"), "verdict")
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("_best"))
    judged = rows.join(best, ["host", "path"], "left")
    return judged.select(
        *[F.col(f"`{c}`") for c in _others(df)], "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict")
    )

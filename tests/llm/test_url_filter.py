import random

import pytest
from pyspark.sql import functions as F

from brainweave.llm import url_filter


def brute(rules, url):
    host, path = url_filter.split_url(url)
    fits = [(h.count(".") + 1, len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


RULES = [*url_filter.RULES, ("example.org", "/a", "block"), ("example.org", "/a/b", "allow"), ("example.org", "/a/bc/", "block"), ("org", "/a/bc/d", "block"), ("x", "", "block")]


def test_random_urls_match_brute_force():
    r = random.Random(1)
    trie = url_filter.build_trie(RULES)
    for _ in range(4000):
        host = ".".join(r.choices(["example", "net", "org", "com", "www", "x", "notexample", ""], k=r.randint(1, 4)))
        path = r.choice(["", "/"]) + "/".join(r.choices(["en", "de", "fr", "a", "b", "bc", "d", "abc", ""], k=r.randint(0, 4)))
        url = r.choice(["http://", "HTTPS://"]) + host + path + r.choice(["", "?q=/en/", "#/x"])
        h, p, *want = brute(RULES, url)
        assert list(url_filter.match(trie, h, p) or (None, "allow")) == want, url


def test_parts_of_urls():
    cases = {None: ("", ""), "": ("", ""), "no scheme/path": ("", ""), "http://EXAMPLE.Net/A?b#c": ("example.net", "/A"), "a://b://c/d": ("b:", "//c/d"), "x://h?q/p": ("h", ""), "x://h#/p": ("h", ""), "x://É.net/": ("É.net", "/")}
    assert {u: url_filter.split_url(u) for u in cases} == cases


def test_clashing_rules_and_too_many_are_refused(monkeypatch):
    with pytest.raises(ValueError):
        url_filter.build_trie([("a", "/", "allow"), ("a", "/", "block")])
    monkeypatch.setattr(url_filter, "MAX_RULES", 1)
    with pytest.raises(ValueError):
        url_filter.build_trie(RULES)


def test_nulls_long_urls_repeated_rows_empty_table_and_clashing_columns(spark):
    rows = [(1, None, "h"), (2, "", "h"), (3, "http://a.net/" + "x/" * 100_000, "h"), (4, "http://example.net/en/", "h"), (4, "http://example.net/en/", "h"), (5, "http://example.net/en", "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted((r.page_id, r.host, r.rule, r.verdict) for r in url_filter.judge_urls(df).collect() if r.rule) + sorted((r.page_id, r.host, r.verdict) for r in url_filter.judge_urls(df).collect() if not r.rule)
    assert got == [(3, "a.net", "net/", "block"), (4, "example.net", "example.net/en/", "allow"), (4, "example.net", "example.net/en/", "allow"), (5, "example.net", "net/", "block"), (1, "", "allow"), (2, "", "allow")]
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_long_lists_are_joined_and_match_brute_force(spark, monkeypatch):
    r = random.Random(5)
    host = lambda: ".".join(r.choices(["example", "net", "org", "com", "www", "x", "EXAMPLE", "é", ""], k=r.randint(1, 4)))
    path = lambda: r.choice(["", "/"]) + "/".join(r.choices(["en", "de", "a", "b", "bc", "a%b", ""], k=r.randint(0, 4)))
    rules = list({(h, p): (h, p, r.choice(["allow", "block"])) for h, p in ((host().lower(), path()) for _ in range(300))}.values())
    urls = [r.choice(["http://", "HTTPS://", "x"]) + host() + path() + r.choice(["", "?q=/en/", "#/x", "\n"]) for _ in range(3000)] + [None, "", "://", "http://x/" + "a/" * 50_000, "http://net/", "http://net/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("verdict", F.lit("clash"))
    want = {i: brute(rules, u) for i, u in enumerate(urls)}
    trie = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.judge_urls(df, rules).collect()}
    monkeypatch.setattr(url_filter, "MAX_RULES", 10)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for given in (rules, table):
        found = url_filter.judge_urls(df, given)
        assert found.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
        assert {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in found.collect()} == want == trie
        assert url_filter.judge_urls(df.limit(0), given).count() == 0
    with pytest.raises(ValueError):
        url_filter.judge_urls(df, table.union(table))


def test_short_tables_of_rules_go_into_the_trie(spark):
    df = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    assert [tuple(x) for x in url_filter.judge_urls(df, rules).collect()] == [(1, "http://a.net/x", "a.net", "/x", "net/", "block")]

import re

import pytest

from pyspark.sql import functions as F

from pagegrain.llm import urlfilter

URLS = [
    "https://www.Example.NET/en/1?x=1", "http://example.com/de/2#a", "https://blog.example.com/de", "https://a.org/fr/9", "https://a.org/en/9", "ftp://net/", "http://net", "http://internet/", "https://notexample.net/en/",
    "no scheme", "", None, "://", "http://?q", "http://h#f", "x://y://z/p", "https://casino-win.example.org/en/1", "https://wiki.example.org/en/1", "http://ÄÖ.org/fr/ü", "http://a.b/" + "x" * 20000, "http://a.net\n/de/",
]


def slow(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in urlfilter.RULES:
        site, _, tail = rule.partition("/")
        if (host == site or host.endswith("." + site)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_hosts_paths_and_rules(spark):
    rows = urlfilter.judge(spark.createDataFrame([(i, u, "own") for i, u in enumerate(URLS)], "page_id int, url string, host string")).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        host, path, best = slow(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == (best[0] if best else "block" if r.score >= 0 else "allow")


def test_training_set_and_kin_are_told_apart(spark):
    given = urlfilter.labelled_urls()
    more = [("https://spam-farm.example.org/en/7", 1), ("http://blog.casino-win.example.org/en/70.html", 1), ("https://cheap-pills.example.org/en/3/", 1), ("https://ads-track.example.org/es/10", 1), ("https://m.recipes.example.org/en/4", 0), ("https://www.library.example.org/en/4", 0)]
    df = spark.createDataFrame([(u, y) for u, y in given + more], "url string, y int")
    rows = urlfilter.judge(df, rules=()).collect()
    right = [(r.score >= 0) == (r.y == 1) for r in rows]
    assert sum(right) >= 0.97 * len(right)
    assert all((r.score >= 0) == (r.y == 1) for r in rows if r.url in dict(more))


def test_dual_training_equals_gradient_descent(spark):
    import math

    given = urlfilter.labelled_urls()[::9]
    rows = spark.createDataFrame(given, "url string, y int").select("url", "y", urlfilter.buckets(urlfilter.host_of(F.col("url")), urlfilter.path_of(F.col("url"))).alias("x")).collect()
    w = [0.0] * (urlfilter.BUCKETS + 1)
    for _ in range(30):
        slope = [0.0] * len(w)
        for r in rows:
            at = [0, *[b + 1 for b in r.x]]
            err = 1 / (1 + math.exp(-sum(w[i] for i in at))) - r.y
            for i in at:
                slope[i] += err / len(rows)
        w = [v * (1 - urlfilter.RATE * urlfilter.DECAY) - urlfilter.RATE * s for v, s in zip(w, slope)]
    got = urlfilter.train(spark, given, steps=30)
    assert got == pytest.approx(w, abs=1e-9)


def test_nothing(spark):
    df = spark.createDataFrame([], "page_id int, url string")
    assert urlfilter.judge(df).count() == 0
    assert urlfilter.judge(spark.createDataFrame([("http://x.y/",)], "url string"), labelled=[]).first().verdict == "block"

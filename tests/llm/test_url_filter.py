"""Verdicts against a plain reading of the rules, and the filter's plan."""

import re

import pytest

from termtrail.llm import url_filter

SCHEMA = "page_id long, url string, host int, verdict string"
URLS = ["http://a.org/es/1", "https://Example.ORG/es/1", "http://www.example.org/en/12?x=1", "http://example.org/en/2#/es/",
        "http://b.com/fr/", "http://b.com/de/x", "http://b.com/de", "b.com/de/x", None, "", "://", "x://", "ftp://ORG/",
        "http://notorg/", "http://bad.net/page/?utm_source=1&b=2&a=1#t", "https://www.bad.net/page?a=1&b=2",
        "http://bad.net/page?a=1", "http://bad.net/page/", "http://ex.net?next=http://bad.net/page", "http://h.net/a\nb?c"]


def plain(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return (host, path, *max(fits)[1:])
    return host, path, None, "block" if url in listed else "allow"


@pytest.mark.parametrize("limit", [url_filter.BROADCAST_BYTES, 0])
def test_verdicts(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", limit)
    pages = spark.createDataFrame([(i, u, 0, "x") for i, u in enumerate(URLS)] + [(3, URLS[3], 0, "x"), (None, URLS[0], 0, None)], SCHEMA)
    listed = spark.createDataFrame([("http://BAD.net/page?b=2&a=1",), ("http://bad.net/page?b=2&a=1#z",), (None,), ("nohost",),
                                    ("https://bad.net/page",)], "url string")
    hits = {URLS[14], URLS[15], URLS[17]}
    got = sorted(map(tuple, url_filter.verdicts(pages, listed).collect()), key=str)
    want = [(i, *plain(u, hits)) for i, u in enumerate(URLS)] + [(3, *plain(URLS[3], hits)), (None, *plain(URLS[0], hits))]
    assert got == sorted(want, key=str)


def test_filter_passes_every_listed_url_and_few_others(spark):
    listed = spark.range(3000).selectExpr("concat('http://h', id % 7, '.net/p/', id) AS url")
    keys = listed.select(url_filter.canonical(listed.url).alias("key"))
    blocks = 3000 * url_filter.BITS_PER_URL // 512
    bloom = url_filter.bloom_filter(keys, blocks)

    def passed(frame):
        key = url_filter.canonical(frame.url)
        probed = frame.select(key.alias("k"), url_filter._block(key, blocks).alias("b")).join(bloom, url_filter.F.col("b") == bloom.block, "left")
        return probed.where(probed.block.isNotNull() & url_filter._may_hold(probed.k)).count()

    assert passed(listed) == 3000
    assert passed(spark.range(3000).selectExpr("concat('http://other.net/', id) AS url")) < 150


def test_empty_tables_and_native_plan(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert url_filter.verdicts(none, none.select("url")).count() == 0
    one = spark.createDataFrame([(1, URLS[0], 0, "")], SCHEMA)
    judged = url_filter.verdicts(one, none.select("url"))
    assert judged.collect()[0].verdict == "allow"
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", judged._jdf.queryExecution().toString())

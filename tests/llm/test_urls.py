"""Operator 8 against a plain reading of the rules, and the filter's exactness."""

import re

from quern.llm import urls

URLS = [
    None,
    "",
    "no scheme",
    "http://A.Example.ORG/es/x?q#f",
    "https://example.org/en/12",
    "http://notexample.org/es/",
    "http://x.org",
    "http://x.org/",
    "http://shop.com/de/a",
    "http://com/fr/b://c",
    "ftp://www.bad.net:80/page//",
    "http://bad.net/page?utm=1",
    "http://bad.net/pager",
    "x://y?z/w",
    "http://bad.net/page",
]


def brute(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for verdict, rule in urls.RULES:
        domain, rest = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best


def test_rules_and_list(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    listed = spark.createDataFrame([("http://bad.net/page/",), (None,), ("junk",)], "url string")
    for limit in (1 << 20, 0):
        got = {r["page_id"]: r for r in urls.judge(pages, listed, broadcast_bytes=limit).collect()}
        assert len(got) == len(URLS)
        for i, u in enumerate(URLS):
            host, path, best = brute(u)
            assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best[1]), u
            assert got[i]["verdict"] == (best[0] if best else "block" if i in (10, 11, 14) else "allow"), u
    assert urls.judge(pages, listed.where("url = 'none'")).where("is_listed").count() == 0
    assert urls.judge(pages.where("page_id < 0"), listed).count() == 0


def test_filter_is_exact(spark):
    many = spark.range(5000).selectExpr("id as page_id", "concat('http://h', id, '.net/p') as url")
    listed = spark.range(0, 5000, 7).selectExpr("concat('https://www.h', id, '.net/p/') as url")
    hit = urls.judge(many, listed).where("is_listed")
    assert hit.count() == 715 and hit.where("page_id % 7 <> 0").count() == 0


def test_the_rules_as_the_contract_writes_them(spark):
    want = {
        "http://example.org/en/1": ("example.org/en/1", "block"),
        "http://example.org/en/1x": ("example.org/en/1", "block"),
        "http://Sub.Example.org/en/12?q": ("example.org/en/1", "block"),
        "http://example.org/en/2": ("org/", "allow"),
        "http://example.org/en/": ("org/", "allow"),
        "http://example.org/es/x": ("example.org/es/", "block"),
        "http://example.org/es": ("org/", "allow"),
        "http://example.org": (None, "allow"),
        "http://other.org/es/x": ("org/", "allow"),
        "http://a.com/fr/x": ("com/fr/", "allow"),
        "http://com/de/x": ("com/de/", "block"),
        "http://a.com/en/x": (None, "allow"),
        "http://acom/de/x": (None, "allow"),
    }
    # columns that the operator uses inside must not clash with those of the pages
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(want)], "page_id long, url string, host string, url_key string")
    nothing = spark.createDataFrame([], "url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(pages, nothing).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())
    again = urls.judge(pages.unionAll(pages), nothing).collect()
    assert len(again) == 2 * len(want)
    long_url = spark.createDataFrame([(1, "http://a.com/de/" + "x" * 300_000)], "page_id long, url string")
    assert urls.judge(long_url, nothing).first()["verdict"] == "block"

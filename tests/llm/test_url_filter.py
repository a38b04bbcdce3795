import re

import pytest

from recollect.llm import url_filter
from recollect.llm.queries import URL_RULES

URLS = [
    None, "", "example.com/en/x", "http://example.com/en/x", "HTTPS://WWW.EXAMPLE.COM/en/x?y#z", "http://www.example.com/EN/x",
    "ftp://a.b.example.net/es/1", "http://example.net/fr", "http://com", "http://com/", "http://.com/", "http://xcom/a", "http://ÉCOM.com/é",
    "http://example.com/en/x", "http://a://b.com/en/", "http:///en/", "http://example.com?/en/", "x://net/es/\n", "://net/fr/",
]


def verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("max_bytes", [8 << 20, 0])
@pytest.mark.parametrize("rules", [URL_RULES, [], [("net", "/", "block"), ("net", "", "allow"), (None, "/", "block"), ("com", "en", "block")]])
def test_verdicts_equal_brute_force(spark, rules, max_bytes):
    pages = spark.createDataFrame([(i % 15, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_filter.judge(pages, frame, max_filter_bytes=max_bytes).select("url", "host", "path", "rule", "verdict").collect()
    known = [r for r in rules if r[0] is not None and (r[1] == "" or r[1].startswith("/"))]
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((u, *verdict(u, known))) for u in URLS)


def test_cascade_is_exact_with_many_keys(spark):
    universe = spark.range(5000).selectExpr("concat('k', id) as key")
    listed = universe.filter("substr(key, -1) = '3'")
    cascade = url_filter.Cascade(listed, universe, listed.count(), 5000, 1)
    assert len(cascade.levels) > 1
    held = universe.filter(cascade.holds(universe["key"]))
    assert sorted(r.key for r in held.collect()) == sorted(r.key for r in listed.collect())


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(pages, url_filter.rules_frame(spark, URL_RULES)).count() == 0

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridextremes.llm import url_filter as U

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
         ("block", "a.b"), ("allow", "a.b/x/y/"), ("allow", "dup/"), ("block", "dup/")]
URLS = [
    "http://example.org/es/x", "http://EXAMPLE.org/es", "https://sub.example.org/en/12?q#f", "https://example.org/en/2", "http://xexample.org/es/1",
    "http://a.com/fr/", "http://a.com/fr", "http://com/de/x", "ftp://q.a.b", "ftp://q.a.b/x/y/z", "http://a.b/x/y", "http://dup/", "http://org", "http://org/",
    None, "", "no scheme", "http://", "http:///path", "a://b://c/d", "http://example.org:80/es/", "HTTP://É.ORG/É", "http://x.org?/a", "http://x.org#/a",
    "http://" + "l." * 5000 + "org/" + "p/" * 5000, "x\ny://org/\n?z", "http://org//es/",
]


def parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", ""
    return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]


def brute(host, path, rules=RULES):
    best = None
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            best = max(best or (0, "", ""), (len(rule), rule, verdict))
    return best[1:] if best else None


def test_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0])], "page_id long, url string").repartition(3)
    rows = U.filter_urls(pages, RULES).select("row.url", "host", "path", "rule", "verdict").collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path = parts(r["url"])
        assert (r["host"], r["path"]) == (host, path)
        assert (r["rule"], r["verdict"]) == (brute(host, path) or (None, "allow"))


LABEL = st.sampled_from(["a", "b", "c", "org"])
HOST = st.lists(LABEL, min_size=1, max_size=4).map(".".join)
PATH = st.one_of(st.just(""), st.text("/ab", max_size=6).map(lambda s: "/" + s))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["allow", "block"]), st.tuples(HOST, PATH).map("".join)), max_size=8), HOST, PATH)
def test_trie(rules, host, path):
    assert U.longest_match(U.build_trie(rules), host, path) == brute(host, path, rules)


def test_limits(spark, monkeypatch):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert U.filter_urls(pages, RULES).count() == 0
    clash = spark.createDataFrame([(1, "http://org/")], "row int, url string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "verdict", "judged")})
    assert U.filter_urls(clash, RULES).select("verdict").first()[0] == "allow"
    assert U.filter_urls(clash, [], otherwise="block").select("verdict").first()[0] == "block"
    monkeypatch.setattr(U, "MAX_RULES", 2)
    with pytest.raises(ValueError):
        U.build_trie(RULES)
    with pytest.raises(ValueError):
        U.build_trie([("perhaps", "org/")])

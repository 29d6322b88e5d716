import re

from factloom.llm import url_rules

SCHEMA = "page_id long, url string, html string, host string, rule string"


def brute(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


URLS = ["http://a.example.net/en/1", "http://example.net/en", "http://example.net", "https://net/", "http://xnet/a", "HTTP://A.B.Example.COM/de/x?q#z", "http://example.com/DE/", "http://w.org/fr/?x", "http://w.org/fr", "nourl", None, "", "x://://a/b", "http://a\nb.net/c\nd", "http://net./", "http://u@example.net:80/en/", "http://ä.net/ö", "http://a.example.net/en/1", "http://q.test/abc/defg", "http://q.test/abc/de", "http://.net/x//y"]


def check(spark, rules):
    pages = spark.createDataFrame([(i % 15, u, None, "x", "y") for i, u in enumerate(URLS)], SCHEMA)
    got = url_rules.judge(pages, spark.createDataFrame(rules, "verdict string, host string, path string"))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i % 15, *brute(u, rules)) for i, u in enumerate(URLS)), key=str)


def test_contract_rules(spark):
    check(spark, url_rules.RULES)


def test_rules_that_end_inside_a_segment_and_empty_ones(spark, monkeypatch):
    rules = [("block", "q.test", "/abc/def"), ("allow", "test", ""), ("block", "q.test", "/abc/"), ("block", "net", "/x//")]
    check(spark, rules)
    monkeypatch.setattr(url_rules, "BROADCAST_BYTES", 0)
    check(spark, rules)


def test_no_rules_and_no_pages(spark):
    empty = spark.createDataFrame([], "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert [tuple(r) for r in url_rules.judge(pages, empty).collect()] == [(1, "a", "/b", None, "allow")]
    assert url_rules.op5(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = url_rules.op5(spark.createDataFrame([(1, "http://a/b", "", "", "")], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

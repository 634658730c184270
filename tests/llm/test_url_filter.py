from __future__ import annotations

from aerolith.llm import url_filter as U

SCHEMA = "page_id long, url string, html string, verdict string"


def verdicts(spark, rows, **kw):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), **kw).collect()}


def test_rules(spark):
    rows = [
        (1, "http://A.Example.NET/de/1", None), (2, "http://x.example.net/en/1?q#f", ""), (3, "https://example.com/de/", "x"), (4, "https://m.example.com/en/de/", "x"), (5, "http://b.org/fr/2", ""), (6, "http://net", ""),
        (7, None, None), (8, "no scheme", ""), (9, "http://notexample.com/de/", ""), (10, "http://planet/", ""), (11, "http://a.net?x=/", ""),
    ]
    got = verdicts(spark, rows)
    assert got[1] == ("a.example.net", "/de/1", "net/", "block") and got[2] == ("x.example.net", "/en/1", "example.net/en/", "allow")
    assert got[3][2:] == ("example.com/de/", "block") and got[4] == ("m.example.com", "/en/de/", None, "allow")
    assert got[5][2:] == ("org/fr/", "allow") and got[6] == ("net", "", None, "allow") and got[7] == ("", "", None, "allow") == got[8]
    assert got[9][3] == got[10][3] == "allow" and got[11] == ("a.net", "", None, "allow")


def test_decisions_reach_aliases_and_allow_goes_first(spark):
    link = '<LINK href="{}" rel=canonical>'.format
    refresh = '<meta http-equiv="refresh" content="0; url={}">'.format
    rows = [
        (1, "http://a.com/x", link("http://b.com/y")), (2, "http://b.com/y/", refresh("http://bad.net/z")), (3, "https://a.com/x#top", None), (4, "http://a.com/x?utm_source=f", None),
        (5, "http://c.com/1", link("http://bad.net/2")), (6, "http://c.com/other", link("/1")), (7, "http://e.org/fr/ok", link("http://c.com/1")), (8, "http://far.com/", None), (8, "http://far.com/", None),
    ]
    got = verdicts(spark, rows, forms=True)
    assert [got[i][3] for i in (1, 2, 3, 4)] == ["block"] * 4
    assert [got[i][3] for i in (5, 6, 7)] == ["allow"] * 3  # an allowed url is in the class
    assert got[8][3] == "allow"
    more = spark.createDataFrame([("http://far.com/", "http://a.com/x")], "source string, target string")
    assert verdicts(spark, rows, redirects=more, forms=True)[8][3] == "block"
    # without forms only links, refreshes and redirects join urls, up to case of host and fragment
    exact = [(1, "HTTP://A.com/x#top", link("http://b.com/y")), (2, "http://b.com/y", refresh("http://bad.net/z")), (3, "https://a.com/x", None), (4, "http://a.com/x?utm_source=f", None), (5, "http://b.com/y/", None), (6, "http://a.com/x", None)]
    got = verdicts(spark, exact)
    assert [got[i][3] for i in range(1, 7)] == ["block", "block", "allow", "allow", "allow", "block"]


def test_long_rule_lists_agree(spark, monkeypatch):
    rows = [(i, u, None) for i, u in enumerate(["http://a.example.net/en/1", "http://example.net/de", "http://x.org/fr/1", "http://example.com/de/9", "http://q.com/", None])]
    inline = verdicts(spark, rows)
    monkeypatch.setattr(U, "INLINE_RULES", 0)
    assert verdicts(spark, rows) == inline
    assert verdicts(spark, rows[:0]) == {}

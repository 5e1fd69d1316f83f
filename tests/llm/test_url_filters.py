from urllib.parse import urlsplit

from pyspark.sql import functions as F

from lodestore.llm import url_filters as uf
from lodestore.llm.components import connected_components
from lodestore.llm.queries import URL_RULES

URLS = [
    "https://a.com/en/1", "http://A.B.com/en/x?q#f", "https://example.com/en/7/x", "https://www.example.com/en/70", "https://notexample.com/de/", "https://x.net/de/1",
    "https://example.net/de/8", "https://m.example.net/de/80", "https://example.net/de/9", "http://x.org/es/", "http://x.org/es", "ftp://com", "com://com/en/", "no scheme com/en/",
    "", None, "https://com/en/", "://h.com/en/", "https://évil.com/en/É?x://y", "https://a.com", "https://a.com?x", "a://b://c.com/en/", "https://free.io/1", "https://free.io/1?utm_source=z",
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return host, path[:end]


def ruled(url):
    host, path = split(url)
    fits = [(len(h + p), v, h + p) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *((max(fits)[2], max(fits)[1]) if fits else (None, None)))


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "own", "own") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, Host string, rule string")


def test_rules_on_odd_urls(spark):
    got = {r["page_id"]: r for r in uf.url_filter(pages(spark, [(u, None) for u in URLS]), URL_RULES).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = ruled(u)
        r = got[i]
        assert (r["host_"], r["path"], r["rule_"], r["verdict"]) == (host, path, rule, verdict or "allow"), u
        assert r["Host"] == "own" and r["rule"] == "own"
    assert uf.url_filter(pages(spark, []), URL_RULES).count() == 0
    assert {r.verdict for r in uf.url_filter(pages(spark, [(u, None) for u in URLS]), []).collect()} == {"allow"}


def test_blocks_reach_aliases_and_allows_win(spark):
    link = lambda u: f'<html><LINK href="{u}" rel="canonical"></html>'
    move = lambda u: f"<meta http-equiv='refresh' content='0; url={u}'>"
    rows = [
        ("https://one.io/a", link("https://bad.com/en/1")),  # alias of a block
        ("https://two.io/b", move("https://one.io/a")),  # at two steps
        ("https://two.io/b?utm_source=x&ref=y#top", None),  # the same page in another form
        ("https://three.io/c", link("https://bad.com/en/2")),
        ("https://three.io/c?ref=1", link("https://x.net/de/ok")),  # an allow among the aliases
        ("https://alone.io/", link("/relative")),
        ("https://x.net/de/2", link("https://bad.com/en/3")),  # its own allow stays
        (None, link("https://bad.com/en/1")),
        ("https://one.io/a", None),  # a repeated url
    ]
    got = {r.page_id: r.verdict for r in uf.url_filter(pages(spark, rows), URL_RULES).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block"}
    more = spark.createDataFrame([("https://alone.io", "https://hop.io"), ("https://hop.io", "https://bad.org/es/")], "src string, dst string")
    assert {r.page_id: r.verdict for r in uf.url_filter(pages(spark, rows), URL_RULES, redirects=more).collect()}[5] == "block"


def test_canonical_form(spark):
    given = ["HTTP://EX.com/A/?utm_source=a&b=1&ref=2#x", "https://ex.com/?q=1&utm_medium=z", "https://ex.com", "mailto:x", "https://ex.com/a?reference=1"]
    df = spark.createDataFrame([(u,) for u in given], "url string")
    want = ["https://ex.com/A/?b=1", "https://ex.com/?q=1", "https://ex.com", "mailto:x", "https://ex.com/a?reference=1"]
    assert [r[0] for r in df.select(uf.canonical_form(df.url)).collect()] == want
    assert urlsplit(want[0]).netloc == "ex.com"


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (5, 4), (7, 7), (None, 1), (9, None), (1, 2)] + [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(600, 640)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {i: 100 for i in range(100, 141)} | {500: 500} | {i: 500 for i in range(600, 640)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_relative_links_resolve_like_urljoin(spark):
    from urllib.parse import urljoin

    bases = ["https://a.com/x/y/z?q=1#f", "http://a.com", "https://b.org/", "https://c.net/p"]
    targets = ["/en/8", "//h.io/x?y", "k", "k/l?m=1", "../k", "./k/", "../../../k", "a/./b/../c", "?only=1", "https://o.com/a", ".", ".."]
    rows = [(b, t) for b in bases for t in targets]
    got = spark.createDataFrame(rows, "b string, t string").select(uf.resolved(F.col("t"), F.col("b")).alias("r")).collect()
    assert [r.r for r in got] == [urljoin(b, t) for b, t in rows]
    none = [("https://a.com/x", "#top"), ("https://a.com/x", ""), ("no scheme", "/x"), ("https://a.com/x", "mailto:me"), (None, "/x"), ("https://a.com", None)]
    assert {r[0] for r in spark.createDataFrame(none, "b string, t string").select(uf.resolved(F.col("t"), F.col("b"))).collect()} == {None}
    block = [("https://one.io/en/a", "<link rel=canonical href='../b'>"), ("https://one.io/b", None), ("https://one.io/b", '<meta http-equiv=refresh content="1;url=//bad.com/en/1">')]
    assert {r.verdict for r in uf.url_filter(pages(spark, block), URL_RULES).collect()} == {"block"}


def test_a_closing_slash_is_another_url(spark):
    rows = [("https://x.org/es/", None), ("https://x.org/es", None), ("https://x.org/es?utm_source=a", None)]
    assert {r.page_id: r.verdict for r in uf.url_filter(pages(spark, rows), URL_RULES).collect()} == {0: "block", 1: "allow", 2: "allow"}

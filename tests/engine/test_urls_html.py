"""Scalar functions: canonical URLs, resolution, domains, extraction."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from weftline.functions import html as H
from weftline.functions import http
from weftline.functions import urls as U
from weftline.operators import routing

NORMAL = [
    ("HTTP://Example.COM", "http://example.com/"),
    ("https://e.com:443/a//b///c", "https://e.com/a/b/c"),
    ("http://e.com:80/", "http://e.com/"),
    ("http://e.com:8080/x#f", "http://e.com:8080/x"),
    ("https://u:p@e.com/?b=2&utm_medium=z&a=1&&", "https://e.com/?a=1&b=2"),
    ("https://e.com/?FBCLID=1", "https://e.com/"),
    ("https://e.com/?ref=x", "https://e.com/?ref=x"),
    ("  https://e.com/a b ", "https://e.com/a b"),
    ("https://[::1]:8080/x", "https://[::1]:8080/x"),
    ("https://bücher.example/x", "https://xn--bcher-kva.example/x"),
    ("https://e.com:99999/", ""),
    ("https://e.com:abc/", ""),
    ("mailto:a@b.c", ""),
    ("javascript:void(0)", ""),
    ("ftp://e.com/", ""),
    ("#x", ""),
    ("/only", ""),
    ("https:///x", ""),
    ("", ""),
    (None, ""),
]
JOINS = ["/x", "y", "../z", "./w/", "../../../q", "?k=1", "#f", "", "//h.test/p", "https://o.test/", "a/../b/./c", "mailto:q", "..", "."]


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_normalize(spark):
    got = values(spark, NORMAL, "u string, e string", U.normalize("u").alias("n"), "e", "u")
    assert [g for g in got if g[0] != g[1]] == []


def test_normalize_is_stable(spark):
    assert all(a == b for a, b in values(spark, NORMAL, "u string, e string", U.normalize("u"), U.normalize(U.normalize("u"))))


def test_options(spark):
    got = values(spark, [("https://e.com/a?x=1#f",)], "u string", U.normalize("u", strip_query=True), U.normalize("u", keep_fragment=True))
    assert got == [("https://e.com/a", "https://e.com/a?x=1#f")]


@pytest.mark.parametrize("base", ["http://a.test/b/c/d?q=1", "http://a.test", "https://a.test/x/"])
def test_join_is_the_librarys(spark, base):
    got = values(spark, [(base, j) for j in JOINS], "b string, l string", "l", U.join("b", "l"))
    assert [(j, r) for j, r in got if r.rstrip("#") != urljoin(base, j)] == []


def test_domains(spark):
    rows = [("www.a.com", "a.com"), ("x.y.co.uk", "y.co.uk"), ("localhost", "localhost"), ("10.0.0.1", "10.0.0.1"), ("a.b.c.info", "c.info"), ("", "")]
    assert all(a == b for a, b in values(spark, rows, "h string, e string", U.registrable_domain("h"), "e"))


def test_binary(spark):
    rows = [("https://e.com/a.PDF", True), ("https://e.com/a.b/c", False), ("https://e.com/x.html", False), ("https://e.com/a.js?v=1", True), ("https://e.com/", False)]
    assert all(a == b for a, b in values(spark, rows, "u string, e boolean", U.has_binary_extension("u"), "e"))


PAGE = """<html><head><title> A &amp; B </title><meta name="Description" content=" about "><link rel="canonical" href="/c"></head>
<body><nav>menu</nav><script>var x = "<a href='/no'>";</script><p>Hello   <b>world</p><a href="/x">1</a><a href='y?utm_source=q'>2</a>
<a rel="nofollow" href="/z">3</a><a href="#top">4</a><a href="javascript:1">5</a><a href="/x">6</a><noscript>hid</noscript></body></html>"""


def test_native_extraction(spark):
    d = spark.createDataFrame([(PAGE, "https://e.com/d/"), (None, "https://e.com/"), ("", "https://e.com/")], "html string, url string")
    rows = d.select(H.title("html"), H.text("html"), H.links("html", "url")).collect()
    assert tuple(rows[0]) == ("A & B", "menu Hello world 1 2 3 4 5 6", ["https://e.com/x", "https://e.com/d/y"])
    assert tuple(rows[1]) == tuple(rows[2]) == ("", "", [])


def test_parser_agrees(spark):
    d = spark.createDataFrame([(PAGE, "https://e.com/d/")], "html string, url string")
    f = d.select(H.page_facts("html", "url").alias("f"), H.title("html").alias("t"), H.text("html").alias("x")).first()
    assert (f.f.title, f.f.text, f.f.description, f.f.canonical) == (f.t, f.x, "about", "https://e.com/c")
    assert H.parse('<base href="/b/"><a href="k">x</a><meta name=robots content="noindex">', "https://e.com/")["hrefs"] == ["https://e.com/b/k"]
    assert H.parse("<a href=", "https://e.com/")["hrefs"] == []


def test_references_in_titles(spark):
    titles = ["a &amp; b &amp", "a&am", "R&D &quot", "x&", "&#39;s &#39", "a&amp;amp; b", "&lt;i&gt", "&ampx; &unknown;"]
    d = spark.createDataFrame([(f"<html><head><title>{t}</title></head><body>{t}</body></html>", "https://e.com/") for t in titles], "html string, url string")
    for r in d.select("html", H.title("html").alias("t"), H.page_facts("html", "url")["title"].alias("f")).collect():
        assert r.f == r.t, r.html
    # all named references are known, and what isn't a title is read as before
    f = H.parse('<title>caf&eacute; &copy</title><body>&lt <a href="/?a=1&amp;b=2">x</a>', "https://e.com/")
    assert (f["title"], f["text"], f["hrefs"]) == ("café &copy", "< x", ["https://e.com/?a=1&b=2"])


def test_text_of_a_long_page_is_whole(spark):
    words = "word " * 30_000
    d = spark.createDataFrame([(f"<html><body><p>{words}end</p></body></html>", "https://e.com/")], "html string, url string")
    got = d.select(H.text("html").alias("x"), H.page_facts("html", "url")["text"].alias("f"), H.text("html", 9).alias("cut")).first()
    assert got.x == got.f == words + "end" and got.cut == "word word"


def test_ratio_of_a_page_that_is_all_text(spark):
    d = spark.createDataFrame([("<body>" + "word " * 130_000 + "</body>",)], "html string").select("html", H.text("html").alias("text"))
    why = routing.content_check(F.col("text"), F.col("html"), F.lit("ok"), F.lit(200), min_text=600, min_ratio=0.2)
    assert d.select(why).first()[0] == "ok"


def test_outcomes(spark):
    rows = [(True, None, "", ""), (False, 503, "", ""), (False, 200, "x", "boom"), (False, None, "", "Timed out"), (False, None, "", "net::ERR_X"), (False, None, "", "?")]
    got = values(spark, rows, "s boolean, c int, h string, m string", http.outcome(F.col("s"), F.col("c"), F.col("h"), F.col("m")))
    assert [g[0] for g in got] == ["ok", "http_error", "ok", "timeout", "network_error", "backend_error"]


def test_headers(spark):
    d = spark.range(1).select(F.create_map(F.lit("A"), F.lit("1"), F.lit("a"), F.lit("2")).alias("h"), F.create_map(F.lit("SEC-PURPOSE"), F.lit("Prefetch")).alias("p"))
    assert tuple(d.select(http.lower_keys(F.col("h")), http.is_prefetch(F.col("p")), http.is_prefetch(F.col("h"))).first()) == ({"a": "1"}, True, False)

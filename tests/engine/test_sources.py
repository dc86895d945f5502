"""Sources, connectors, sinks, services in virtual time, the command line."""

import http.server
import json
import random
import threading
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

import weftline
from weftline import cli
from weftline.functions import html as H
from weftline.functions import urls as U
from weftline.operators import crawl, dedup, frontier, metrics, politeness, routing, service, simulate
from weftline.operators.scope import allows
from weftline.plans.config import Browser, CrawlConfig, Output, Politeness
from weftline.sources import connectors, contract, live, sinks
from weftline.sources.corpus import CorpusSource


def some_url(rng):
    host = rng.choice(["e.com", "E.com", "[::1]", "", "u:p@e.com", "ü.de", "a.b.co.uk", "x@y@e.com"])
    port = rng.choice(["", "", ":80", ":443", ":0080", ":8080", ":", ":99999", ":abc"])
    path = rng.choice(["", "/", "//a///b", "/a b", "/ä", "/a/../b", "/x.PDF", "/:80/@"])
    query = rng.choice(["", "", "?", "?b=2&a=1", "?utm_Source=x&&z", "?q=a?b", "?a=%20&GCLID=1&a"])
    return rng.choice(["", " ", "\t", "\n"]) + rng.choice(["http", "HTTPS", "ftp", "mailto"]) + rng.choice(["://", ":", "://"]) + host + port + path + query + rng.choice(["", "#f", "#", "\x01"])


def test_the_kernel_and_the_expression_agree(spark):
    rng = random.Random(2)
    urls = [some_url(rng) for _ in range(600)] + ["", "#top", "/only", "//e.com/x", "javascript:void(0)", "http://e.com\n/x"]
    d = spark.createDataFrame(list(enumerate(urls)), "i int, u string")
    for r in d.select("i", U.normalize("u").alias("n"), U.normalize("u", True).alias("s")).collect():
        assert (U.canonical(urls[r.i]), U.canonical(urls[r.i], True)) == (r.n, r.s), urls[r.i]
        assert U.canonical(r.n) == r.n
    assert U.canonical(None) == "" and U.resolved("http://e.com/a/b", "../c") == "http://e.com/c" and U.resolved("http://[x", "//[y") == ""


def test_resolution(spark):
    bases = ["http://e.com", "http://e.com/a/b?q#f", "https://u@e.com:1/x/", "http://e.com/a/b/c.html"]
    refs = ["", "x", "/x", "//o.org/y", "?z=1", "#g", "../x", "./", "../../../x", "x/../y?a#b", "http://z.net/", "mailto:a@b", "x?y=../z"]
    d = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    for x in d.select("b", "r", U.join("b", "r").alias("j")).collect():
        assert x.j.split("#")[0] == urljoin(x.b, x.r).split("#")[0], (x.b, x.r)


PAGE = """<!-- <a href="/comment"> --><head><base href="/b/"><META NAME=Description content=' about &amp; more '><link rel=icon href=/i>
<link rel="canonical" href="HTTP://E.com:80/c?utm_source=1"></head><body><script>'<a href="/s">'</script>
<a class=x href='k'>1</a><a href="k#x">2</a><a href=/r?b=2&amp;a=1>3</a><a rel="ugc NoFollow" href="/n">4</a><a href="#f">5</a><a name=q>6</a><a
 href="http://o.org">7</a>"""


def test_what_a_page_says(spark):
    no = PAGE.replace("<base", '<meta name="ROBOTS" content="noindex"><meta name="robots" content="Index, NOFOLLOW"><base')
    d = spark.createDataFrame([(0, PAGE, "https://e.com/x/y"), (1, no, "https://e.com/x/y"), (2, None, None), (3, "<a href=", "https://e.com/")], "i int, html string, url string")
    want = {
        0: ("about & more", False, False, "http://e.com/c", ["https://e.com/b/k", "https://e.com/r?a=1&b=2", "http://o.org/"]),
        1: ("about & more", False, True, "http://e.com/c", []),
        2: ("", False, False, None, []),
        3: ("", False, False, None, []),
    }
    for f in (H.page("html", "url"), H.page_facts("html", "url")):
        assert {r.i: (r.f.description, r.f.noindex, r.f.nofollow, r.f.canonical, r.f.links) for r in d.select("i", f.alias("f")).collect()} == want
    assert [r.l for r in d.orderBy("i").select(H.links("html", "url").alias("l")).collect()] == [w[4] for w in want.values()]


def test_a_bare_host_is_no_prefix_of_the_scheme(spark):
    d = spark.createDataFrame([("https://other.org/x",), ("https://e.com/x",), ("https://e.com.evil.test/",)], "url string").withColumn("depth", F.lit(1))
    got = lambda **k: [r.url for r in d.where(allows(CrawlConfig(seeds=("https://e.com",), scope="path", **k))).collect()]
    assert got() == ["https://e.com/x", "https://e.com.evil.test/"] and got(strict_path=True) == ["https://e.com/x"]


def test_ready_at_refills_and_changes_nothing():
    b = politeness.Bucket.new(politeness.Limits(), 100.0)
    for _ in range(8):
        assert b.on("acquire", 100.0, None, politeness.Limits())
    assert b.ready_at(100.0) == 100.25 and b.ready_at(100.25) == 100.25 and b.tokens == 0.0
    assert not b.on("acquire", 100.1, None, politeness.Limits()) and b.on("acquire", 100.25, None, politeness.Limits())


def test_bloom_counts_what_is_new(spark):
    urls = spark.range(3000).select(F.concat(F.lit("u"), "id").alias("url"))
    b = dedup.Bloom(5000, 1e-6, shard=1000).add(urls.where("length(url) < 4")).add(urls)
    assert b.shards == 5 and b.inserts() == 3000 and b.saturation() == 0.6
    assert b.flagged(urls).where("not maybe_seen").count() == 0
    other = spark.range(3000).select(F.concat(F.lit("v"), "id").alias("url"), F.lit(1).alias("x"))
    assert b.flagged(other).columns == ["url", "x", "maybe_seen"] and b.flagged(other).where("maybe_seen").count() == 0


def web(spark):
    a = "<a href='{}'>x</a>".format
    pages = {
        "http://e.test/": a("/1") + a("/2") + a("/e") + a("/f.pdf") + a("http://x.test/"),
        "http://e.test/1": "<meta name=robots content=nofollow>" + a("/never"),
        "http://e.test/2": "<base href='/d/'>" + a("3") + a("/1"),
        "http://e.test/d/3": a("/"),
        "http://e.test/e": a("/from-error"),
    }
    rows = [(u, f"<title>{u[-1]}</title><body>{h}</body>", 500 if u.endswith("/e") else 200, 1 if u.endswith("/2") else 0) for u, h in pages.items()]
    return spark.createDataFrame(rows, "url string, html string, http_status int, fail_attempts int")


@pytest.mark.parametrize("kind", ["exact", "bloom"])
def test_traversal_heeds_nofollow_base_and_error_pages(spark, kind):
    config = CrawlConfig(seeds=("http://e.test/",), scope="host", max_depth=3, dedup=kind, dedup_capacity=1000, output=Output(include_html=True))
    got = crawl.crawl(spark, config, CorpusSource(web(spark)))
    rows = {r.url[len("http://e.test/") :]: r for r in got.pages.collect()}
    assert {k: (r.depth, r.status, r.http_status) for k, r in rows.items()} == {"": (0, "ok", 200), "1": (1, "ok", 200), "2": (1, "ok", 200), "e": (1, "http_error", 500), "d/3": (2, "ok", 200), "from-error": (2, "http_error", 404)}
    assert rows["e"].error == "HTTP 500" and rows["from-error"].error == "HTTP 404" and rows["d/3"].parent == "http://e.test/2"
    assert rows["1"].links == [] and rows["2"].attempt == 1 and rows["1"].html.startswith("<title>") and all(r.backend == "corpus" and r.fetched_at > 1e9 for r in rows.values())
    assert {k: got.counters[k] for k in ("discovered", "out_of_scope", "duplicates", "enqueued", "fetched", "retried", "rounds")} == {"discovered": 9, "out_of_scope": 2, "duplicates": 2, "enqueued": 6, "fetched": 6, "retried": 1, "rounds": 3}
    out = sinks.page_row(got.pages, include_html=True, include_links=False)
    assert out.columns == [*sinks.ROW, "html"] and out.where("size(links) > 0").count() == 0 and out.where("n_links > 0").count() == 4


def test_links_and_text_of_the_source(spark):
    class Own(CorpusSource):
        def fetch(self, requests):
            return super().fetch(requests).withColumn("links", F.array(F.lit("HTTP://e.test/d/3#x"), F.lit("mailto:a@b"))).withColumn("text", F.lit("own"))

    config = CrawlConfig(seeds=("http://e.test/1",), scope="host", max_depth=1, output=Output(text_source="backend"))
    got = {r.url: r for r in crawl.crawl(spark, config, Own(web(spark))).pages.collect()}
    assert got["http://e.test/1"].links == ["http://e.test/d/3"] and got["http://e.test/1"].text == "own" and len(got) == 2


def test_a_budget_takes_turns(spark):
    f = spark.createDataFrame([(h, f"{h}{i}", i) for h, n in (("a", 50), ("b", 3), ("c", 1)) for i in range(n)], "host string, url string, seq int")
    for k in (1, 3, 4, 7, 20, 54, 100):
        got = [r.url for r in frontier.next_turns(f, k).collect()]
        want = [r.url for r in frontier.pop_batch(f, k).collect()]
        assert sorted(got) == sorted(want) and len(got) == min(k, 54)


def test_one_result_for_each_request(spark):
    twice = web(spark).unionByName(web(spark).withColumn("html", F.concat(F.lit("<b>"), "html")))
    requests = spark.createDataFrame([(1, "http://e.test/1"), (2, "http://e.test/1"), (3, "http://none/")], "rid int, url string")
    assert CorpusSource(twice).fetch(requests).count() == 3
    results = spark.createDataFrame([(1, 5.0, "ok", None, "u"), (1, 2.0, "timeout", "slow", "u"), (9, 1.0, "ok", None, "z")], "rid int, finished_ts double, status string, error string, final_url string")
    got = {r.rid: (r.status, r.error) for r in contract.complete(requests, results, "rid").collect()}
    assert got == {1: ("timeout", "slow"), 2: ("backend_error", "no result"), 3: ("backend_error", "no result")}


# virtual time


def sim(spark, rows, rules, key="k"):
    d = spark.createDataFrame(rows, "k string, ordinal long, host string, arrive_ts double, elapsed double, status string, http_status int, fail_attempts int")
    return {r.ordinal: r for r in simulate.simulated(d, rules, key).collect()}


def test_pacing_by_tokens(spark):
    rules = simulate.Rules(limits=politeness.Limits(base=5.0, burst=1.0), adaptive=False)
    got = sim(spark, [("k", i, "h", 0.0, 0.0, "ok", 200, 0) for i in range(4)], rules)
    assert [round(got[i].started_ts, 3) for i in range(4)] == [0.0, 0.2, 0.4, 0.6]


def test_hosts_at_their_limit(spark):
    rng = random.Random(1)
    rows = [("k", i, rng.choice("ab"), rng.random(), rng.random() * 3, "ok", 200, 0) for i in range(60)]
    got = sim(spark, rows, simulate.Rules(per_host=3, limits=politeness.Limits(1e3, 1e3, 1, 1e3)))
    for host in "ab":
        edges = sorted(e for r in got.values() if r.host == host for e in ((r.started_ts, 1), (r.finished_ts, -1)))
        now = most = 0
        for _, d in sorted(edges):
            now += d
            most = max(most, now)
        assert most == 3


def test_slots_against_a_plain_queue(spark):
    rng = random.Random(4)
    rows, t = [], 0.0
    for i in range(200):
        t += rng.random()
        rows.append(("k", i, f"h{i}", t, rng.random() * 5, "ok", 200, 0))
    got = sim(spark, rows, simulate.Rules(capacity=3, queue_timeout_s=1.0))
    free, lost = [0.0] * 3, set()
    for _, i, _, arrived, took, *_ in rows:
        k = min(range(3), key=lambda j: free[j])
        start = max(arrived, free[k])
        if start - arrived > 1.0:
            lost.add(i)
            continue
        free[k] = start + took
        assert got[i].status == "ok" and abs(got[i].started_ts - start) < 1e-6
    assert lost == {i for i, r in got.items() if r.status == "rejected"} and 0 < len(lost) < 200
    with pytest.raises(service.ServiceBusy):
        service.raise_if_busy(spark.createDataFrame([("rejected",)], "status string"))


def test_retries_timeouts_and_feedback(spark):
    limits = politeness.Limits(base=4.0)
    rules = simulate.Rules(capacity=8, queue_timeout_s=9.0, timeout_s=2.0, max_retries=2, backoff_s=1.0, limits=limits)
    rows = [("k", 0, "a", 0.0, 0.5, "ok", 200, 1), ("k", 1, "b", 0.0, 0.5, "ok", 200, 5), ("k", 2, "c", 0.0, 9.0, "ok", 200, 0), ("k", 3, "d", 0.0, 0.5, "http_error", 503, 0), ("k", 4, "d", 1.0, 0.5, "ok", 200, 0)]
    got = sim(spark, rows, rules)
    assert (got[0].status, got[0].attempts, got[0].finished_ts) == ("ok", 2, 2.0)
    assert (got[1].status, got[1].attempts, got[1].finished_ts) == ("timeout", 3, 0.5 * 3 + 1 + 2)
    assert (got[2].status, got[2].attempts, got[2].finished_ts) == ("timeout", 3, 9.0)
    # a 503 isn't tried again, and pauses its host for two seconds
    assert (got[3].status, got[3].attempts) == ("http_error", 1) and got[4].started_ts >= 2.5
    s = service.stats(spark.createDataFrame([r.asDict() for r in got.values()], simulate.SCHEMA)).first()
    assert (s.submitted, s.completed, s.failed, s.timed_out, s.retried, s.rejected) == (10, 2, 3, 2, 5, 0)


# service, routing, reports


def test_service_answers_in_order(spark):
    config = CrawlConfig(output=Output(include_links=False))
    with service.FetchService(spark, CorpusSource(web(spark)), config) as s:
        got = s.fetch(["http://e.test/e", "mailto:x", "http://e.test/", "http://e.test/e"]).collect()
        assert [(r.ordinal, r.status, r.n_links) for r in got] == [(0, "http_error", 0), (1, "skipped", 0), (2, "ok", 0), (3, "http_error", 0)]
        assert s.fetch_one("http://e.test/2").title == "2"
    with pytest.raises(RuntimeError, match="started"):
        s.fetch(["http://e.test/"])
    assert service.refused(21) == 413 and service.refused(20) is None


def test_a_judge_that_says_yes_or_no(spark):
    plain = spark.createDataFrame([("u", "short", "<p>", "ok", 200), ("v", "long enough", "<p>", "ok", 200)], "url string, text string, html string, status string, http_status int")
    rendered = spark.createDataFrame([("u", "a longer text", "<r>"), ("v", "much longer than that", "<r>")], "url string, text string, html string")
    yes = lambda text, html, status, code: F.length(text) > 6
    got = {r.url: (r.tier, r.html, r.reason) for r in routing.route(plain, rendered, yes, keep_html=True).collect()}
    assert got == {"u": ("rendered", "<r>", "insufficient"), "v": ("plain", "<p>", "ok")}
    known = routing.route(plain, rendered, yes, memory=spark.createDataFrame([("v",)], "url string"))
    assert {r.url: r.reason for r in known.collect()}["v"] == "host-cached"
    plan = routing.route(plain, rendered)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "Union" not in plan


def test_pages_of_one_url_are_routed_apart(spark, tmp_path):
    from weftline import queries as Q

    # two pages of one URL, on a host of even length, so that both are rendered: to a title alone, and to more text
    page = "<html><head><title>{}</title></head><body>{}</body></html>".format
    rows = [(0, "https://m.abc.test/x", page("t", "one two")), (1, "https://m.abc.test/x", page("t", "one two!")), (2, "https://m.ab.test/y", page("t", "z"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, 1, "error", 1.0, "{}")], "event_id long, user_id long, event_type string, value double, props string").selectExpr("*", "timestamp_ntz'2024-02-01 00:00:00' AS ts").write.parquet(f"{tmp_path}/events.parquet")
    d = str(tmp_path)
    got = sorted(tuple(r) for r in Q.q_routing(spark, d).collect())
    assert [r[0] for r in got] == ["https://m.ab.test/y"] + ["https://m.abc.test/x"] * 2
    assert sorted(r[3] for r in got) == ["escalated", "escalation_failed", "rendered_not_better"]
    for q in (Q.q_routing_stats, Q.q_routing_memory, Q.q_routing_snapshot):
        r = q(spark, d).first()
        assert (r.requested, r.escalated) == (3, 3), q.__name__
    assert Q.q_routing_memory(spark, d).first().host_cache_hits == 3
    assert [tuple(r) for r in Q.q_routing_reasons(spark, d).collect()] == [("thin-text", 3)]


def test_links_are_read_once_and_run_by_run(spark, tmp_path):
    from weftline import queries as Q

    anchors = "".join(f'<a href="/{k}">x</a>' for k in range(5))
    rows = [(0, "https://e.com/", anchors), (1, "https://e.com/b", None), (2, "https://e.com/c", ""), (3, "https://o.org/", anchors + " " * 5000), (4, None, '<a href="http://z.net">z</a>')]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    d = str(tmp_path)
    for q in ("q_seen_anti", "q_scope_host", "q_scope_bare_host", "q_links", "q_inlinks", "q_link_frontier"):
        plan = Q.QUERIES[q](spark, d)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") + plan.count("MapInArrow") == 1, q
    assert sorted(tuple(r) for r in Q.q_links(spark, d).collect()) == [(p, f"{u}{k}") for p, u in ((0, "https://e.com/"), (3, "https://o.org/")) for k in range(5)] + [(4, "http://z.net/")]
    assert {tuple(r) for r in Q._links(spark, d, "src", "src_host").select("src", "src_host").collect()} == {("https://e.com/", "e.com"), ("https://o.org/", "o.org"), ("", "")}
    assert Q.q_seen_anti(spark, d).count() == 11
    # the filter's links are stored: pages aren't read again to ask for them
    bloom = Q.q_bloom_inserts(spark, d)
    assert "html" not in bloom._jdf.queryExecution().executedPlan().toString() and tuple(bloom.first()) == (11, 11)
    import pyarrow as pa

    html = pa.array(["aa", None, "", "ü", "x" * 9, "y"])
    assert list(H.spans(html, 4)) == [(0, 4), (4, 1), (5, 1)] and list(H.spans(html, 1)) == [(0, 1), (1, 2), (3, 1), (4, 1), (5, 1)]
    assert list(H.spans(html.slice(4), 99)) == [(0, 2)] and list(H.spans(pa.array([], pa.string()))) == []


def test_a_hosts_events_are_folded_by_columns(monkeypatch):
    import pandas as pd

    # a row as an object of pandas costs more than the fold itself, and short hosts are many
    monkeypatch.delattr(pd.DataFrame, "itertuples")
    rows = pd.DataFrame({"host": ["a"] * 3 + ["b"], "seq": [1, 2, 3, 4], "ts": [1.0, 1.0, 2.0, 9.0], "signal": ["acquire", "throttled", "acquire", "crawl_delay"], "arg": [None, None, None, 2.0]})
    for r in (rows, rows.astype({"arg": object}).where(rows.notna(), None)):
        got = politeness.fold(r, {}, politeness.Limits())
        assert got.columns.tolist() == [c.split()[0] for c in politeness.SCHEMA.split(", ")]
        assert got["granted"].tolist() == [True, None, False, None] and got["rate"].tolist() == [4.0, 2.0, 2.0, 0.5]
        assert got["tokens"].tolist() == [7.0, 0.0, 0.0, 8.0] and got["blocked_until"].tolist() == [0.0, 3.0, 3.0, 0.0] and got["ready_at"].tolist() == [1.0, 3.0, 3.0, 9.0]
    assert len(politeness.fold(rows[:0], {}, politeness.Limits())) == 0


def test_reports_of_little(spark):
    log = spark.createDataFrame([(5.0, 1, True, 3, 0.5, 200, None)], "ts double, seq long, ok boolean, chars long, elapsed double, http_status int, kind string")
    assert metrics.recent_rate(log).first().recent_pps == 1e9 and metrics.recent_rate(log.limit(0)).first().recent_pps == 0.0
    s = metrics.full_summary(log.limit(0)).first()
    assert len(s) == 18 and s.fetched == 0 and s.status_counts == {} and s.pages_per_second == 0.0
    assert metrics.memory_used_pct("MemTotal: 100 kB\nMemFree: 1 kB\nMemAvailable: 25 kB\n") == 75.0
    assert metrics.memory_used_pct("MemTotal: 0 kB\nMemAvailable: 1 kB") is None and metrics.memory_used_pct("") is None


# sources, connectors, sinks


class Site(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        body = {"/": b"<a href='/a'>x</a>", "/a": b"<title>A</title>", "/robots.txt": b"User-agent: *\nDisallow: /private\n"}.get(self.path)
        self.send_response(200 if body else 404)
        self.send_header("Content-Type", "text/html; charset=utf-8")
        self.send_header("Retry-After", "3")
        self.end_headers()
        self.wfile.write(body or b"gone")

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def site():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_live_http(spark, site):
    source = live.HttpSource(Politeness(per_host_rps=50.0, max_rps=50.0), timeout_s=5, max_retries=1, backoff_s=0.01)
    d = spark.createDataFrame([(1, f"{site}/"), (2, f"{site}/none"), (3, "http://127.0.0.1:9/")], "rid int, url string")
    got = {r.rid: r for r in source.fetch(d).collect()}
    assert (got[1].status, got[1].http_status, got[1].html, got[1].retry_after) == ("ok", 200, "<a href='/a'>x</a>", 3.0)
    assert (got[2].status, got[2].error, got[2].html) == ("http_error", "HTTP 404", "gone") and (got[3].status, got[3].attempt, got[3].http_status) == ("network_error", 1, None)
    pages = crawl.crawl(spark, CrawlConfig(seeds=(f"{site}/",), scope="host"), source).pages
    assert {r.url[len(site) :]: r.title for r in pages.collect()} == {"/": "", "/a": "A"}
    r = live.robots_bodies(spark.createDataFrame([(site,)], "origin string"), source).first()
    assert r.http_status == 200 and "Disallow: /private" in r.body


def test_batches_are_paired(spark):
    requests = spark.createDataFrame([(i, 0, u) for i, u in enumerate(["http://a/", "http://b/", "http://b/", "http://c", "http://d/"])], "rid int, batch int, url string")
    raw = [(0, 0, "http://b/", None, True, 200, None, "1"), (0, 1, "x", "http://a/", True, 200, None, "2"), (0, 2, "http://c/", None, False, 200, "thin", "3"), (0, 3, "http://b/", "http://z/", False, None, "net::err", "")]
    got = {r.rid: (r.status, r.error, r.html, r.final_url) for r in connectors.from_batches(requests, spark.createDataFrame(raw, "batch int, pos int, url string, redirected_url string, success boolean, status_code int, error_message string, html string")).collect()}
    assert got == {0: ("ok", None, "2", "http://a/"), 1: ("ok", None, "1", "http://b/"), 2: ("network_error", "net::err", "", "http://z/"), 3: ("ok", "thin", "3", "http://c/"), 4: ("backend_error", "no result returned", "", "http://d/")}


def test_registry(spark):
    @contract.register("corpus")
    class Mine(contract.FetchSource):
        """Takes the builtin's place."""

        name, needs = "corpus", "a browser"
        capabilities = contract.Capabilities(javascript=True, native_links=True, screenshots=True)

        @classmethod
        def available(cls):
            return False, "no browser here"

    try:
        row = contract.list_sources(spark).where("name = 'corpus'").first()
        assert (row.origin, row.available, row.reason, row.capabilities, row.about) == ("runtime", False, "no browser here", "js, links", "Takes the builtin's place.")
        with pytest.raises(RuntimeError, match="install a browser"):
            contract.get_source("corpus").require()
    finally:
        contract._known["runtime"].clear()
    assert contract.get_source("corpus") is CorpusSource
    with pytest.raises(KeyError, match="corpus, http"):
        contract.get_source("nope")


def test_sink_kinds(spark, tmp_path):
    d = spark.createDataFrame([("u", None, "<p>")], "url string, error string, html string")
    with sinks.MemorySink() as m:
        m.write(d)
        m.write(d)
    assert m.pages == [{"url": "u", "error": None, "html": "<p>"}] * 2
    with sinks.make_sink(str(tmp_path / "out"), include_html=True) as s:
        s.write(d)
        s.write(d)
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()] == [{"url": "u", "error": None, "html": "<p>"}] * 2
    sink = sinks.JsonlSink(str(tmp_path / "stream"))
    for k in (0, 1, 1):
        sink.batch(d, k)
    assert spark.read.text(str(tmp_path / "stream")).count() == 2
    sinks.make_sink(None, "none").write(d)


def test_command_line(spark, tmp_path, capsys):
    web(spark).write.parquet(str(tmp_path / "web"))
    out, stats = tmp_path / "out.gz", tmp_path / "s" / "stats.json"
    assert cli.main(["crawl", "http://e.test/", "--corpus", str(tmp_path / "web"), "-o", str(out), "--stats", str(stats), "--scope", "host", "--max-depth", "1", "-q"]) == 0
    rows = [json.loads(r.value) for r in spark.read.text(str(out)).collect()]
    assert len(rows) == 4 and list(rows[0]) == list(sinks.ROW)
    s = json.loads(stats.read_text())
    assert len(s) == 18 and s["fetched"] == 4 and s["status_counts"] == {"200": 3, "500": 1} and s["errors"] == {"http_error": 1}
    assert cli.main(["crawl", "http://none.test/", "--corpus", str(tmp_path / "web"), "-o", str(out), "-q"]) == 1 and cli.main(["crawl"]) == 2
    assert cli.main(["config", "-o", str(tmp_path / "c" / "c.yaml")]) == 0
    assert CrawlConfig.from_file(str(tmp_path / "c" / "c.yaml")) == CrawlConfig(seeds=("https://example.com",))
    assert cli.main(["sources"]) == 0 and "corpus" in capsys.readouterr().out
    assert cli.main(["bench", "http://e.test/", "--sources", "corpus", "--corpus", str(tmp_path / "web"), "-j", "2"]) == 0 and "true" in capsys.readouterr().out


def test_more_settings():
    assert CrawlConfig.of(CrawlConfig(seeds=("a.com",), allow_patterns=("x",)).to_dict()) == CrawlConfig(seeds=("a.com",), allow_patterns=("x",))
    assert CrawlConfig(concurrency=2).politeness.per_host_concurrency == 2
    assert Browser(block_resources=True).flags() == ["--blink-settings=imagesEnabled=false", "--disable-remote-fonts"] and Browser().flags() == [] and Browser(block_resources=True, browser_type="firefox").options()["flags"] == []
    for bad in ({"politeness": {"nope": 1}}, {"dedup": "hash"}, {"dedup_capacity": 1}, {"output": {"text_source": "x"}}, {"browser": {"wait_until": "never"}}):
        with pytest.raises(ValueError):
            CrawlConfig.of(bad)
    assert set(weftline.__all__) <= set(dir(weftline))

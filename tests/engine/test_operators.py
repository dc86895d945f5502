"""Traversal, frontier, dedup, politeness, routing, robots, sinks, settings."""

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline import queries as Q
from weftline.functions import urls as U
from weftline.operators import crawl, dedup, frontier, politeness, robots, routing
from weftline.operators.scope import allows
from weftline.oracles import ORACLES
from weftline.plans.config import CrawlConfig, Politeness
from weftline.sources import corpus, sinks

SF = "/root/testdata/sf0.001"


def test_site_graph(spark):
    got = Q._crawled(spark)
    depths = {}
    for r in got.pages.collect():
        depths[r.depth] = depths.get(r.depth, 0) + 1
    assert depths == {0: 1, 1: 2, 2: 2, 3: 4, 4: 4}
    assert {k: got.counters[k] for k in ("discovered", "out_of_scope", "duplicates", "enqueued", "fetched")} == {"discovered": 32, "out_of_scope": 18, "duplicates": 2, "enqueued": 13, "fetched": 13}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_traversal_of_the_page_table(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '/root/testdata/{sf}/pages.parquet'")
    want = con.execute(ORACLES["q_crawl_depth1"]).fetchall()
    got = Q.QUERIES["q_crawl_depth1"](spark, f"/root/testdata/{sf}")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    # two of the small table's pages have one URL
    pages = len({U.canonical(r[0]) for r in con.execute("SELECT url FROM pages").fetchall()})
    assert got.where("depth = 0").count() == pages and got.where("depth = 1").count() > 0


def test_page_budget_and_faults(spark):
    site = Q._site(spark).withColumn("fail_attempts", F.when(F.col("url").endswith("/1"), 1).when(F.col("url").endswith("/0"), 9).otherwise(0))
    got = crawl.crawl(spark, CrawlConfig(seeds=("http://site.test/",), scope="host", max_depth=4, max_pages=2), corpus.CorpusSource(site))
    assert got.counters["fetched"] == 2
    r = corpus.CorpusSource(site).fetch(site.select("url")).where("url like '%/0' or url like '%/1'").orderBy("url").collect()
    assert [(x.status, x.attempt) for x in r] == [("timeout", 2), ("ok", 1)]
    with pytest.raises(ValueError):
        corpus.seeds(spark, ("mailto:x",))


def test_scope(spark):
    def ok(url, depth=1, **kw):
        d = spark.createDataFrame([(url, depth)], "url string, depth int")
        return d.select(allows(CrawlConfig(seeds=("https://www.e.com/docs/intro",), **kw)).alias("a")).first().a

    assert ok("https://x.e.com/") and not ok("https://x.e.com/", scope="host") and not ok("https://e.org/")
    assert ok("https://www.e.com/docs2/x", scope="path") and not ok("https://www.e.com/docs2/x", scope="path", strict_path=True)
    assert not ok("https://e.com/a", depth=3) and not ok("https://e.com/a.pdf") and ok("https://e.com/a.pdf", skip_binary=False)
    assert ok("https://z.net/", allow_domains=(".z.net",)) and not ok("https://e.com/p", deny_patterns=("/p$",)) and not ok("https://e.com/q", allow_patterns=("/p",))
    assert ok("https://any.where/", scope="any") and not ok("https://a.e.com/", deny_domains=("e.com",))


def test_bloom(spark):
    bits, k = dedup.bloom_size(10_000_000, 0.001)
    assert (bits, k) == (143_775_875, 8)
    seen = spark.range(2000).select(F.concat(F.lit("u"), "id").alias("url"))
    b = dedup.Bloom(2000, 0.01).add(seen)
    assert b.flagged(seen).where("not maybe_seen").count() == 0
    other = spark.range(5000).select(F.concat(F.lit("v"), "id").alias("url"))
    assert b.flagged(other).where("maybe_seen").count() < 250
    with pytest.raises(ValueError):
        dedup.new_urls(seen, seen, "neither")


def test_frontier(spark):
    f = spark.createDataFrame([(h, i) for i, h in enumerate("aaabbc")], "host string, seq long")
    assert [r.host for r in frontier.pop_batch(f, 4).collect()] == ["a", "b", "c", "a"]
    assert frontier.pop_batch(f, 0).count() == 0
    assert frontier.capped(f, 1, 2).count() == 2


def test_bucket():
    lim = politeness.Limits()
    b = politeness.Bucket.new(politeness.Limits(burst=3), 0.0)
    assert [b.on("acquire", 0.0, None, lim) for _ in range(6)].count(True) == 3
    b = politeness.Bucket.new(lim, 0.0)
    b.on("throttled", 1.0, None, lim)
    assert (b.rate, b.blocked_until, b.tokens) == (2.0, 3.0, 0.0) and not b.on("acquire", 2.0, None, lim)
    for _ in range(10):
        b.on("success", 3.0, None, lim)
    assert b.rate == 2.5
    for _ in range(60):
        b.on("throttled", 4.0, 1.0, lim)
    assert b.rate == 0.2
    b.on("crawl_delay", 5.0, 10.0, lim)
    assert (b.rate, b.top) == (0.1, 0.1)
    b.on("throttled", 6.0, 1.0, lim)
    assert b.rate <= 0.1
    assert politeness.Bucket.new(lim, 0.0, 5.0).rate == 0.2


def test_replay_is_the_plain_fold_and_the_stream(spark):
    ev = Q._signals(spark, SF)
    got = {r.seq: (r.granted, r.rate, r.tokens, r.blocked_until) for r in Q.q_limiter(spark, SF).collect()}
    state, want = {}, {}
    for r in sorted(ev.collect(), key=lambda r: (r.ts, r.seq)):
        b = state.setdefault(r.host, politeness.Bucket.new(politeness.Limits(), r.ts))
        g = b.on(r.signal, r.ts, r.arg, politeness.Limits())
        want[r.seq] = (g, round(b.rate, 6), round(b.tokens, 6), round(b.blocked_until, 6))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0] and got[k][1:] == pytest.approx(want[k][1:], abs=1e-5)
    stream = {r.seq: (r.granted, r.rate, r.tokens, r.blocked_until) for r in Q.q_limiter_stream(spark, SF).collect()}
    assert stream == got


def test_host_memory(spark):
    rows = [("a", 1, 0.0, True), ("a", 2, 5.0, False), ("a", 3, 10.0, False), ("b", 4, 0.0, False), ("a", 5, 11.0, True), ("a", 6, 20.9, True), ("a", 7, 21.0, False)]
    d = spark.createDataFrame(rows, "host string, seq bigint, ts double, escalates boolean")
    assert [r.via for r in routing.remembered(d, 10.0).orderBy("seq").collect()] == ["escalated", "memory", "plain", "plain", "escalated", "memory", "plain"]
    assert "memory" not in {r.via for r in routing.remembered(d, 0.0).collect()}


def test_robots(spark):
    body = "User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /*.gif$\nCrawl-delay: 3\n\nUser-agent: weftline\nDisallow: /only\n"
    bodies = spark.createDataFrame([("https://e.com", 200, body), ("https://no.com", 403, ""), ("https://x.com", 500, "")], "origin string, http_status int, body string")
    urls = spark.createDataFrame([(u,) for u in ("https://e.com/a", "https://e.com/a/b/c", "https://e.com/z.gif", "https://e.com/z.gif?x", "https://e.com/only", "https://no.com/", "https://x.com/", "https://un.known/")], "url string")

    def ok(agent):
        return {r.url for r in robots.judged(urls, robots.parsed(bodies, agent)).where("allowed").collect()}

    assert ok("other") == {"https://e.com/a/b/c", "https://e.com/z.gif?x", "https://e.com/only", "https://x.com/", "https://un.known/"}
    assert "https://e.com/only" not in ok("weftline/1") and "https://e.com/a" in ok("weftline/1")


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("u", None, "<p>")], "url string, error string, html string")
    sinks.write(d, str(tmp_path / "x.gz"))
    assert spark.read.text(str(tmp_path / "x.gz")).first().value == '{"url":"u","error":null}'
    sinks.write(d, None, "none")
    with pytest.raises(ValueError):
        sinks.write(d, "p", "xml")


def test_settings():
    c = CrawlConfig.from_env(environ={"WEFTLINE_SEEDS": "a.com, http://b.com", "WEFTLINE_POLITENESS__BURST": "3"})
    assert c.seeds == ("https://a.com", "http://b.com") and c.politeness.burst == 3
    assert CrawlConfig(concurrency=3).politeness.per_host_concurrency == 3
    for bad in ({"nope": 1}, {"scope": "galaxy"}):
        with pytest.raises(ValueError):
            CrawlConfig.of(bad)
    with pytest.raises(ValueError):
        Politeness(min_rps=9, max_rps=1)


def test_registry(spark):
    assert corpus.get_source("corpus") is corpus.CorpusSource
    with pytest.raises(KeyError, match="corpus"):
        corpus.get_source("nothing")
    assert corpus.list_sources(spark).count() >= 1

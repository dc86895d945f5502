"""The queries of the crawl engine over the driver's tables, each by (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import html as H
from .functions import http
from .functions import urls as U
from .operators import crawl as C
from .operators import dedup, frontier, metrics, politeness, resources, robots, routing, service
from .operators.scope import reason
from .operators.simulate import Rules, simulated
from .plans.config import CrawlConfig, Output, Politeness
from .plans.storage import fresh, spread, stored
from .sources import connectors, contract, sinks
from .sources.corpus import CorpusSource
from .streaming import limiter as S

SEEDS = ("https://m.ththth.example.net/en/25", "http://ththre.example.com/fr/825")
SCOPES = {m: CrawlConfig(seeds=SEEDS, scope=m, max_depth=1, deny_patterns=("/the",), allow_domains=("thther.example.org",)) for m in ("site", "host", "path", "any")}
#: More than any table has rows.
UNBOUNDED = 1 << 62
VECTORS = ("HTTP://Example.COM", "https://example.com:443/a//b", "http://example.com:8080/x?b=2&a=1&utm_source=z", "https://e.com/p?&&x=1&GCLID=9#frag", "mailto:x@y.z", "javascript:void(0)", "#top", "", "  https://e.com/a b  ", "ftp://e.com/", "http://user:pw@e.com/", "https://a.b.co.uk/q.PDF?z", "//e.com/x", "/only/path", "https:///nohost")


def _table(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pages(spark, d) -> DataFrame:
    """The page table for work on its HTML."""
    return spread(_table(spark, d, "pages"))


def _log(spark, d) -> DataFrame:
    """The event table as a fetch log; time is seconds since 1970, free of the session's zone."""
    e = _table(spark, d, "events")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return e.select(F.concat(F.lit("h"), F.col("user_id")).alias("host"), F.col("event_id").alias("seq"), (us / 1e6).alias("ts"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("elapsed"), F.length("props").cast("bigint").alias("chars"), F.col("event_type").alias("kind"))


def _code():
    return F.when(F.col("kind") == "error", F.element_at(F.array(*map(F.lit, (404, 429, 500, 503))), (F.col("seq") % 4 + 1).cast("int"))).otherwise(200)


def _links(spark, d, *keep) -> DataFrame:
    """The links of all pages, with what is kept of page_id, src (the page's canonical URL) and src_host."""
    # the page's own URL and host are made once a page, and only where they are kept
    p = _pages(spark, d).withColumn("src", U.normalize("url"))
    return H.linked(p.withColumn("src_host", U.host_of("src")), *keep)


def _known(spark, d) -> DataFrame:
    return _table(spark, d, "pages").select(U.normalize("url").alias("url"))


def q_link_frontier(spark, d):
    """New in-scope links by host: extract, normalise, keep the page's host, drop what is known."""
    found = _links(spark, d, "src_host").withColumn("host", U.host_of("url"))
    mine = found.where(F.col("host") == F.col("src_host")).select("url", "host").distinct()
    return frontier.unseen(mine, _known(spark, d)).groupBy("host").agg(F.count("*").alias("n_new"))


def q_url_normalize(spark, d):
    return _table(spark, d, "pages").select("page_id", U.normalize("url").alias("norm"))


def q_url_parts(spark, d):
    h = U.host_of("url")
    return _table(spark, d, "pages").select("page_id", h.alias("host"), U.registrable_domain(h).alias("domain"), U.path_of("url").alias("path"), U.has_binary_extension("url").alias("is_binary"), U.is_crawlable_scheme("url").alias("crawlable"))


def q_url_vectors(spark, d):
    return spark.createDataFrame([(v,) for v in VECTORS], "raw string").select("raw", U.normalize("raw").alias("norm"), U.normalize("raw", strip_query=True).alias("bare"))


def _scope_query(mode):
    def run(spark, d):
        found = _links(spark, d).select("url", F.lit(1).alias("depth")).distinct()
        return found.select("url", F.coalesce(reason(SCOPES[mode]), F.lit("in")).alias("verdict"))

    return run


def q_scope_reasons(spark, d):
    found = _links(spark, d).select("url", F.lit(1).alias("depth"))
    return found.groupBy(F.coalesce(reason(SCOPES["host"]), F.lit("in")).alias("verdict")).agg(F.count("*").alias("n"))


def q_links(spark, d):
    return _links(spark, d, "page_id")


def q_title(spark, d):
    return _pages(spark, d).select("page_id", H.title("html").alias("title"))


def q_text(spark, d):
    return _pages(spark, d).select("page_id", H.text("html").alias("text"))


def _dressed(spark, d) -> DataFrame:
    """The page table as a web: page n links to pages 8n to 8n + 7 and to a relative address; some pages have a base element, a canonical link, or say nofollow."""
    p = _table(spark, d, "pages").select("page_id", U.normalize("url").alias("url"), "html")
    up = p.select(F.floor(F.col("page_id") / 8).alias("page_id"), F.col("page_id").alias("k"), "url")
    kids = up.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("k", "url"))).alias("kids"))
    anchors = F.array_join(F.transform("kids", lambda x: F.concat(F.lit('<a href="'), x["url"], F.lit('">x</a>'))), "")
    n = F.col("page_id")
    when = lambda test, x: F.when(test, x).otherwise("")
    head = F.concat(
        when(n % 3 == 1, F.lit('<base href="/b/">')),
        when(n % 11 == 5, F.lit('<META name="Robots" content="NOINDEX, NoFollow">')),
        when(n % 4 == 2, F.concat(F.lit('<link rel="canonical" href="HTTP://E.com:80/c/'), n.cast("string"), F.lit('?utm_source=1">'))),
        F.concat(F.lit('<meta name="description" content="  about '), n.cast("string"), F.lit(' ">')),
    )
    foot = F.concat(F.coalesce(anchors, F.lit("")), F.lit('<a href="k'), n.cast("string"), F.lit('">k</a><a rel="nofollow" href="/never">n</a>'))
    return p.join(kids, "page_id", "left").select("page_id", "url", F.concat(F.replace("html", F.lit("</head>"), F.concat(head, F.lit("</head>"))), foot).alias("html"))


def _facts(f, title):
    return ["page_id", title, F.col(f"{f}.description").alias("description"), F.col(f"{f}.noindex").alias("noindex"), F.col(f"{f}.nofollow").alias("nofollow"), F.col(f"{f}.canonical").alias("canonical"), F.size(f"{f}.links").cast("bigint").alias("n_links")]


def q_page_facts(spark, d):
    """Everything that a page says of itself, by built-in expressions, over all pages as a web."""
    f = spread(_dressed(spark, d)).select("page_id", H.title("html").alias("title"), H.page("html", "url").alias("f"))
    return f.select(*_facts("f", "title"))


def q_page_parser(spark, d):
    """The same by the tolerant parser."""
    f = spread(_dressed(spark, d)).select("page_id", H.page_facts("html", "url").alias("f"))
    return f.select(*_facts("f", F.col("f.title").alias("title")))


def q_crawl_pages(spark, d):
    """The traversal over all pages as a web, from the first seven."""
    config = CrawlConfig(scope="any", max_depth=5, max_pages=UNBOUNDED, max_frontier=UNBOUNDED, max_frontier_per_host=UNBOUNDED, output=Output(include_text=False))
    web = _dressed(spark, d)
    start = web.where("page_id between 1 and 7").select(F.col("url").alias("raw"))
    source = CorpusSource(spread(web).select("url", "html", (F.col("page_id") / 1000).alias("elapsed")))
    got = C.crawl(spark, config, source, start=start).pages
    return sinks.page_row(got).drop("links", "text", "fetched_at")


def q_crawl_robots(spark, d):
    """Every page asked for where its robots.txt allows, with the delay that it asks for."""
    config = CrawlConfig(scope="any", max_depth=0, max_pages=UNBOUNDED, max_frontier=UNBOUNDED, max_frontier_per_host=UNBOUNDED, output=Output(include_text=False))
    p = _table(spark, d, "pages")
    got = C.crawl(spark, config, CorpusSource(p.select(U.normalize("url").alias("url"), "html")), _robots(spark, d), p.select(F.col("url").alias("raw")))
    return got.pages.select("url", "status", "crawl_delay")


def q_seeds(spark, d):
    """The page table's URLs as one text of seeds: split, trimmed, given a scheme, normalised, distinct."""
    raw = _table(spark, d, "pages").select(F.concat(F.regexp_replace("url", "^https://", ""), F.lit(" ,\n"), F.col("url"), F.lit(", javascript:void(0)")).alias("text"))
    parts = raw.select(F.explode(F.split("text", "[,\n]")).alias("raw")).select(F.trim("raw").alias("raw")).where("raw <> ''")
    given = parts.select(F.when(F.col("raw").contains("://"), F.col("raw")).otherwise(F.concat(F.lit("https://"), F.col("raw"))).alias("raw"))
    return given.select(U.normalize("raw").alias("url")).where("url <> ''").distinct()


def q_same_site(spark, d):
    return _links(spark, d, "page_id", "src").select("page_id", "url", U.same_site("src", "url").alias("same"))


def _bare_scope(spark, d, **more):
    config = CrawlConfig(seeds=("https://therhe.example.org", SEEDS[0]), scope="path", max_depth=1, **more)
    found = _links(spark, d).select("url", F.lit(1).alias("depth")).distinct()
    return found.select("url", F.coalesce(reason(config), F.lit("in")).alias("verdict"))


def q_scope_bare_host(spark, d):
    """The path scope with a seed that is a host alone, which stands for itself and not for its scheme."""
    return _bare_scope(spark, d)


def q_scope_allow(spark, d):
    return _bare_scope(spark, d, allow_patterns=("/t", "/a[a-m]"), deny_domains=("example.net",))


def q_inlinks(spark, d):
    return _links(spark, d, "src").groupBy("url").agg(F.countDistinct("src").alias("n_pages"))


def q_outlinks_by_host(spark, d):
    return _links(spark, d, "src_host").groupBy(F.col("src_host").alias("host")).agg(F.count("*").alias("n_links"), F.countDistinct("url").alias("n_targets"))


def _site(spark) -> DataFrame:
    """A site of twelve pages, n to 2n and 2n + 1, with a file and a foreign link on each."""
    anchor = "<a href='{}'>x</a>".format
    page = lambda n: f"<html><head><title>Page {n}</title></head><body><p>Body {n}</p>{''.join(anchor(f'/page/{k}') for k in (2 * n, 2 * n + 1) if k < 12)}{anchor('/asset.pdf')}{anchor('https://elsewhere.test/')}</body></html>"
    rows = [("http://site.test/", page(0)), *[(f"http://site.test/page/{n}", page(n)) for n in range(12)]]
    return spark.createDataFrame(rows, "url string, html string")


def _crawled(spark):
    return C.crawl(spark, CrawlConfig(seeds=("http://site.test/",), scope="host", max_depth=4), CorpusSource(_site(spark)))


def q_crawl_graph(spark, d):
    return _crawled(spark).pages.select("url", "depth", "parent", "status", "title", "n_links")


def q_crawl_metrics(spark, d):
    c = _crawled(spark).counters
    return spark.createDataFrame([(k, v) for k, v in c.items()], "counter string, n bigint")


def q_crawl_depth1(spark, d):
    """The traversal over the whole page table: every page is a seed, and every link that no rule turns away is asked for."""
    p = _table(spark, d, "pages")
    config = CrawlConfig(scope="any", max_depth=1, max_pages=UNBOUNDED, max_frontier=UNBOUNDED, max_frontier_per_host=UNBOUNDED, output=Output(max_text_chars=0))
    got = C.crawl(spark, config, CorpusSource(p.select(U.normalize("url").alias("url"), "html")), start=p.select(F.col("url").alias("raw")))
    return got.pages.select("url", "depth", "parent", "status", "http_status", "title", "n_links")


def q_fetch_corpus(spark, d):
    """Every distinct link asked of the page table."""
    got = CorpusSource(_table(spark, d, "pages").select(U.normalize("url").alias("url"), "html")).fetch(_links(spark, d).select("url").distinct())
    return got.groupBy("status", "http_status").agg(F.count("*").alias("n"))


def q_seen_anti(spark, d):
    return dedup.new_urls(_links(spark, d), _known(spark, d))


def q_seen_bloom(spark, d):
    return dedup.new_urls(_links(spark, d), _known(spark, d), "bloom", capacity=100_000)


def q_bloom_inserts(spark, d):
    """A filter that holds every link: how many it counts, and that it knows them all."""
    # stored, as the filter is built of them and then asked for them
    links = stored(_links(spark, d).distinct(), "links")
    b = dedup.Bloom(1_000_000, 1e-9).add(links)
    return b.flagged(links).agg(F.count_if("maybe_seen").alias("known")).select("known", F.lit(b.inserts()).cast("bigint").alias("inserts"))


def _queue(spark, d):
    return _table(spark, d, "pages").select(U.normalize("url").alias("url"), U.host_of("url").alias("host"), F.col("page_id").alias("seq"), (F.col("page_id") % 7 == 0).alias("is_retry"))


def q_frontier_turns(spark, d):
    return frontier.turns(_queue(spark, d), 2).select("url", "host", "rn", "turn")


def q_frontier_caps(spark, d):
    return frontier.capped(_queue(spark, d), 3, 100).select("url", "host")


def q_pop_batch(spark, d):
    """The next 64 rows while the hosts of even length wait."""
    q = _queue(spark, d)
    hosts = q.select("host").distinct().select("host", F.when(F.length("host") % 2 == 0, 10.0).otherwise(0.0).alias("ready_at"))
    return frontier.pop_batch(q, 64, 1, hosts, 5.0).select("url", "host", "turn")


def q_frontier_stats(spark, d):
    q = _queue(spark, d)
    hosts = q.select("host").distinct().select("host", F.when(F.length("host") % 2 == 0, 10.0).otherwise(0.0).alias("ready_at"))
    return frontier.stats(q, hosts, 5.0)


def q_next_ready(spark, d):
    q = _queue(spark, d)
    return frontier.next_ready_time(q, q.select("host", F.length("host").cast("double").alias("ready_at")).distinct(), 22.0)


def q_attempts(spark, d):
    return frontier.attempts(_log(spark, d), ("host", "chars")).select("seq", F.col("attempt").cast("bigint").alias("attempt"))


def q_status_counts(spark, d):
    return metrics.counted(_log(spark, d).withColumn("http_status", _code()), "http_status")


def q_summary(spark, d):
    return metrics.summary(_log(spark, d))


def _flat(c):
    return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",")


def _results(spark, d):
    return _log(spark, d).withColumn("http_status", _code()).withColumn("kind", F.when(~F.col("ok"), F.concat(F.lit("e"), F.col("seq") % 13)))


def q_full_summary(spark, d):
    s = metrics.full_summary(_results(spark, d), {"discovered": 9, "duplicates": 2})
    return s.withColumn("status_counts", _flat("status_counts")).withColumn("errors", _flat("errors"))


def q_snapshot(spark, d):
    log, q = _results(spark, d), _queue(spark, d)
    hosts = q.select("host", F.length("host").cast("double").alias("ready_at")).distinct()
    s = metrics.snapshot(log.withColumn("elapsed", F.col("elapsed") * 3600), q, hosts, 1_704_200_000.0, {"enqueued": 7}, 1 << 40)
    return s.select("fetched", "queued", "hosts", "ready", "deferred", "in_flight", "budget_left", "seen", "recent_pps", "paused_memory")


def q_memory_pauses(spark, d):
    """The log's values as readings of memory, some unknown: paused from 60 on, until they fall below 55."""
    used = _log(spark, d).select(F.col("host").alias("probe"), "ts", (F.when(F.col("seq") % 10 > 0, F.col("elapsed") * 2)).alias("pct"))
    return metrics.paused(used, 60.0).select("probe", "ts", "paused")


def q_bench_rows(spark, d):
    runs = _log(spark, d).groupBy(F.col("kind").alias("backend"), (F.col("seq") % 3).cast("int").alias("concurrency")).agg(F.count("*").alias("pages"), F.round(F.sum("elapsed"), 2).alias("elapsed"))
    return metrics.bench_rows(runs)


def q_error_topk(spark, d):
    return metrics.top_errors(_log(spark, d), "host")


def q_latency_pct(spark, d):
    return metrics.latency_percentiles(_log(spark, d))


def q_host_latency(spark, d):
    return metrics.by_host_percentiles(_log(spark, d))


def q_recent_pps(spark, d):
    return metrics.recent_rate(_log(spark, d))


def q_streaks(spark, d):
    return metrics.streaks(_log(spark, d))


def q_streak_raises(spark, d):
    """How often each host's rate would have been raised: once for every five clean answers in a row."""
    return metrics.streaks(_log(spark, d), 5)


def q_in_flight(spark, d):
    return metrics.in_flight(_log(spark, d).withColumn("elapsed", F.col("elapsed") * 64))


def _outcomes(spark, d):
    texts = F.array(*map(F.lit, ("Navigation timeout of 30 s", "net::ERR_NAME", "Connection refused", "something else", "useragent", "took longer than", "socket hang up", "it was closed", "net::x", "ECONNREFUSED")))
    return _log(spark, d).select("seq", "host", "ts", "ok", _code().alias("code"), F.when(F.col("ok"), None).otherwise(F.element_at(texts, (F.col("seq") % 10 + 1).cast("int"))).alias("message"))


def q_classify_sources(spark, d):
    """What a message means depends on the kind of source."""
    o = _outcomes(spark, d).where("message is not null")
    return o.select("message", *[http.classify_error(F.col("message"), k).alias(k) for k in http.MARKERS]).distinct()


def q_outcome_map(spark, d):
    o = _outcomes(spark, d)
    return o.select("seq", http.outcome(F.col("ok"), F.when(F.col("seq") % 3 > 0, F.col("code")), F.when(F.col("seq") % 2 == 0, "x"), F.col("message")).alias("outcome"), http.http_status(F.col("code")).alias("by_code"), http.http_error(F.col("code")).alias("error"))


def q_classify_error(spark, d):
    return _outcomes(spark, d).where("message is not null").groupBy(http.classify_error(F.col("message")).alias("kind")).agg(F.count("*").alias("n"))


def q_retry_plan(spark, d):
    """Which failures are tried again, after how long, and what they tell the limiter."""
    o = _outcomes(spark, d).withColumn("status", F.when(F.col("ok"), "ok").otherwise(http.classify_error(F.col("message")))).withColumn("attempt", (F.col("seq") % 5).cast("int"))
    again = http.is_retryable(F.col("status")) & (F.col("attempt") < 2)
    return o.select("seq", "status", again.alias("again"), F.when(again, http.backoff(F.col("attempt"))).alias("delay"), http.signal(F.col("status"), F.col("code")).alias("signal"))


def q_retry_after(spark, d):
    raw = F.element_at(F.array(*map(F.lit, ("5", " 2.5 ", "-3", "Wed, 21 Oct 2026 07:28:00 GMT", ""))), (F.col("seq") % 5 + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, ("retry-after", "Retry-After", "RETRY-AFTER"))), (F.col("seq") % 3 + 1).cast("int"))
    h = F.create_map(name, raw)
    return _log(spark, d).select("seq", http.retry_after(h).alias("seconds"), http.retry_after(h, ("retry-after",)).alias("service_seconds"))


def q_headers(spark, d):
    """Header names in lower case, where of two spellings the first counts; links by group as one list; the text a source prefers."""
    x = F.col("kind")
    h = F.create_map(F.lit("X-A"), x, F.lit("x-a"), F.lit("later"), F.upper(x), F.lit("v"))
    return _log(spark, d).select("seq", _flat(http.lower_keys(h)).alias("headers"), F.array_join(http.all_links(F.create_map(F.lit("internal"), F.array(x), F.lit("external"), F.array(F.lit("z"), x))), ",").alias("links"), http.markdown(F.when(F.col("ok"), ""), F.when(F.col("seq") % 2 == 0, x), F.lit("plain")).alias("text"), http.decoded(F.encode(x, "UTF-8")).alias("decoded"))


def _requests(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("document", "image", "script", "font", ""))), (F.col("seq") % 5 + 1).cast("int"))
    head = F.when(F.col("seq") % 6 == 0, F.create_map(F.lit("Sec-Purpose"), F.lit("Prefetch;anonymous"))).otherwise(F.create_map(F.lit("accept"), F.lit("*/*")))
    url = F.concat(F.lit("https://"), F.when(F.col("seq") % 4 == 0, "cdn.ads.test").otherwise("ads.test.org"), F.lit("/"), F.col("seq"))
    return _log(spark, d).select("seq", "host", url.alias("url"), kind.alias("resource_type"), head.alias("headers"), F.when(F.col("seq") % 9 == 0, -1).otherwise(F.col("chars")).alias("size"), F.when(F.col("seq") % 2 == 0, F.col("seq") % 3 == 0).alias("from_cache"))


def q_block_reason(spark, d):
    return _requests(spark, d).select("seq", http.is_prefetch(F.col("headers")).alias("prefetch"), resources.block_reason(F.col("url"), F.col("resource_type"), F.col("headers"), hosts=("ads.test",), types=("image", "font")).alias("reason"))


def q_resource_trace(spark, d):
    return resources.by_type(_requests(spark, d))


def q_cache_rate(spark, d):
    return resources.cache_rate(_requests(spark, d))


def _block():
    return resources.block_reason(F.col("url"), F.col("resource_type"), F.col("headers"), hosts=("ads.test",), types=("image", "font"))


def q_blocked(spark, d):
    return resources.blocked(_requests(spark, d), _block())


def _trace(spark, d):
    """Requests, responses and cache events of pages, from the log: a size may be missing or junk, an event may come twice."""
    r = _requests(spark, d).withColumn("request_id", F.col("seq")).withColumn("page_id", F.col("host"))
    log = _log(spark, d)
    size = F.when(F.length("host") == 2, "junk").when(F.col("kind") != "view", F.col("chars").cast("string"))
    responses = log.where("kind <> 'signup'").select(F.col("seq").alias("request_id"), size.alias("content_length"), (F.col("elapsed") > 20).alias("disk_cache"), (F.col("elapsed") < 1).alias("prefetch_cache"))
    served = log.where("kind = 'click'").select(F.col("seq").alias("request_id"))
    return resources.traced(r.select("request_id", "page_id", "resource_type", "url", "headers"), responses, served.unionByName(served))


def q_trace(spark, d):
    return _trace(spark, d).select("request_id", "size", "from_cache")


def q_trace_totals(spark, d):
    return resources.totals(_trace(spark, d))


def q_trace_report(spark, d):
    return resources.report(_trace(spark, d), _block())


def q_content_check(spark, d):
    p = _pages(spark, d).select("page_id", H.text("html").alias("text"), "html")
    code = F.when(F.col("page_id") % 11 == 0, 403).when(F.col("page_id") % 13 == 0, 404).otherwise(200)
    why = routing.content_check(F.col("text"), F.col("html"), http.http_status(code), code, min_text=600, min_ratio=0.2)
    return p.select("page_id", why.alias("reason"), routing.sufficient(why).alias("sufficient"))


def _routed(spark, d, memory=None):
    """The rendered tier fails on hosts of odd length, and gives a title alone where the page's HTML has odd length. Pages of one URL are requests of their own."""
    p = _pages(spark, d).select("page_id", "url", H.text("html").alias("text"), H.title("html").alias("title"), "html", F.lit("ok").alias("status"), F.lit(200).alias("http_status"))
    more = p.where(F.length(U.host_of("url")) % 2 == 0).select("page_id", F.when(F.length("html") % 2 == 1, F.col("title")).otherwise(F.concat("text", F.lit(" more"))).alias("text"))
    return routing.route(p.drop("title"), more, memory=memory, key="page_id")


def q_routing_memory(spark, d):
    """Hosts whose name begins with m are known to need rendering."""
    known = _table(spark, d, "pages").select("url").where(U.host_of("url").startswith("m."))
    return routing.stats(_routed(spark, d, known))


def q_routing_snapshot(spark, d):
    hosts = _log(spark, d).groupBy("host").agg(F.max(F.when(~F.col("ok"), F.col("ts"))).alias("until"))
    s = routing.snapshot(_routed(spark, d), hosts, 1_706_000_000.0)
    return s.select("requested", "served_plain", "escalated", "host_cache_hits", _flat("escalation_reasons").alias("reasons"), "hosts_needing_render", "browser_started")


def q_routing(spark, d):
    return _routed(spark, d).select("url", "tier", F.length("text").cast("bigint").alias("n_chars"), "outcome")


def q_routing_stats(spark, d):
    return routing.stats(_routed(spark, d))


def q_routing_reasons(spark, d):
    return routing.reasons(_routed(spark, d))


def q_host_memory(spark, d):
    return routing.remembered(_log(spark, d).withColumn("escalates", ~F.col("ok")), 86_400.0).select("host", "seq", "via")


def _signals(spark, d):
    """The log as a limiter's events: asking, results (some with a Retry-After), and crawl delays."""
    n = F.col("seq")
    result = F.coalesce(http.signal(F.when(F.col("ok"), "ok").otherwise("timeout"), _code()), F.lit("error"))
    sig = F.when(n % 2 == 0, "acquire").when(n % 13 == 5, "crawl_delay").otherwise(result)
    arg = F.when(sig == "crawl_delay", 1.0 + n % 4).when((sig == "throttled") & (n % 3 == 0), 0.5 + n % 7)
    return _log(spark, d).select("host", "seq", "ts", sig.alias("signal"), arg.cast("double").alias("arg"))


def _rounded(df):
    return df.select("host", "seq", "signal", "granted", *[F.round(c, 6).alias(c) for c in ("rate", "tokens", "blocked_until", "ready_at")])


def q_limiter(spark, d):
    return _rounded(politeness.replay(_signals(spark, d)))


def q_limiter_stream(spark, d):
    """The same rows from the streaming operator."""
    e = _signals(spark, d)
    path = fresh(spark, "signals")
    e.write.parquet(path)
    out = S.drained(S.limiter(spark.readStream.schema(e.schema).parquet(path)), "limiter")
    return _rounded(out)


def q_limiter_snapshot(spark, d):
    last = politeness.replay(_signals(spark, d)).groupBy("host").agg(F.max_by("rate", F.struct("ts", "seq")).alias("rate"))
    return last.select("host", F.round("rate", 2).alias("rate"))


def q_window_rate(spark, d):
    """Results by hour of the log (an extension: the event-time form of the recent rate)."""
    h = F.floor(F.col("ts") / 3600).cast("bigint")
    return _log(spark, d).groupBy(h.alias("hour")).agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))


def _robots(spark, d):
    body = F.lit("User-agent: *\nDisallow: /en/\nAllow: /en/2\nDisallow: /*9$\nCrawl-delay: 2\n\nUser-agent: other\nDisallow: /\n")
    o = _table(spark, d, "pages").select(U.origin_of(U.normalize("url")).alias("origin")).distinct()
    code = F.when(F.length("origin") % 5 == 0, 403).when(F.length("origin") % 5 == 1, 404).otherwise(200)
    return robots.parsed(o.select("origin", code.alias("http_status"), body.alias("body")))


def q_robots_filter(spark, d):
    urls = _table(spark, d, "pages").select("page_id", U.normalize("url").alias("url"))
    return robots.judged(urls, _robots(spark, d)).select("page_id", "allowed", "crawl_delay")


def q_robots_cache(spark, d):
    """The log as requests of origins, whose rules are kept for a week; those of some can't be had."""
    log = _log(spark, d).withColumnRenamed("host", "origin")
    failed = log.select("origin").where("origin like '%7'")
    return robots.cache_stats(robots.lookups(log, 604_800.0), failed)


def q_robots_fresh(spark, d):
    r = _log(spark, d).groupBy(F.col("host").alias("origin")).agg(F.max("ts").alias("fetched_at"))
    return robots.fresh(r, 1_706_660_000.0, 36_000.0).select("origin")


def q_service(spark, d):
    """Every page's URL asked for, with two unusable ones between; answers keep the order of the questions."""
    p = _table(spark, d, "pages")
    r = p.select(F.col("page_id").alias("ordinal"), F.when(F.col("page_id") % 17 == 3, "mailto:x").otherwise(F.col("url")).alias("url"), (F.col("page_id") % 10).cast("double").alias("elapsed"))
    src = CorpusSource(p.select(U.normalize("url").alias("url"), "html", F.when(F.col("page_id") % 19 == 0, 500).otherwise(200).alias("http_status")))
    return service.ordered(service.respond(r, src, timeout_s=8.5)).select("ordinal", "final_url", "status", "http_status", "error", "title")


def q_response(spark, d):
    """The response's fields with links but without text, robots.txt heeded."""
    p = _table(spark, d, "pages")
    src = CorpusSource(p.select(U.normalize("url").alias("url"), "html", (F.col("page_id") / 7).alias("elapsed")))
    got = service.respond(p.select(F.col("page_id").alias("ordinal"), "url"), src, None, CrawlConfig(), _robots(spark, d))
    return service.projected(got, include_links=True).select("ordinal", "status", "error", "elapsed_s", "text", F.size("links").cast("bigint").alias("n_links"))


def _paced(spark, d):
    log = _log(spark, d)
    return log.select("host", F.col("seq").alias("ordinal"), F.col("ts").alias("arrive_ts"), (F.col("elapsed") * 100).alias("elapsed"))


def q_paced(spark, d):
    """Hosts that serve one request at a time, and start one in 1,000 s at most, in virtual time."""
    got = simulated(_paced(spark, d), Rules(per_host=1, adaptive=False, limits=politeness.Limits(base=0.001, burst=1.0, low=0.0001, high=0.001)), "host")
    return got.select("ordinal", F.round("started_ts", 3).alias("started_ts"), F.round("finished_ts", 3).alias("finished_ts"))


def q_admission(spark, d):
    """Services of one slot, by the kind of event, where a request waits 2,000 s at most."""
    r = _paced(spark, d).join(_log(spark, d).select(F.col("seq").alias("ordinal"), F.col("kind").alias("service")), "ordinal")
    got = simulated(r, Rules(capacity=1, queue_timeout_s=2000.0, per_host=1, adaptive=False, limits=politeness.Limits(1e6, 1e6, 1.0, 1e6)), "service")
    return got.select("ordinal", "status", F.round("started_ts", 3).alias("started_ts"))


def _busy(spark, d):
    """The log as requests at two services of 4 slots, with failures that pass and others that don't."""
    o = _outcomes(spark, d).withColumn("status", F.when(F.col("ok"), "ok").when(F.col("message").isNotNull(), http.classify_error(F.col("message"))))
    o = o.join(_log(spark, d).select("seq", "elapsed", "kind"), "seq")
    return o.select(F.when(F.col("kind") < "m", "a").otherwise("b").alias("service"), F.col("seq").alias("ordinal"), "host", (F.col("ts") / 100).alias("arrive_ts"), "elapsed", "status", F.col("code").alias("http_status"), (F.col("seq") % 4).cast("int").alias("fail_attempts"))


def _served(spark, d):
    return service.admitted(_busy(spark, d), CrawlConfig(concurrency=4, politeness=Politeness(per_host_rps=0.05, min_rps=0.01)), 60.0, 40.0)


def q_service_load(spark, d):
    """Admission, hosts' limits, timeouts and retries together; no SQL: events of one request change the times of others."""
    return _served(spark, d).select("key", "ordinal", "status", "attempts", F.round("started_ts", 3).alias("started_ts"), F.round("finished_ts", 3).alias("finished_ts"))


def q_service_stats(spark, d):
    """The counters of that load; no SQL for the same reason."""
    return service.snapshot(_served(spark, d), CrawlConfig(concurrency=4), "corpus")


def q_crawl_schedule(spark, d):
    """When a polite crawl would have fetched each page of the log, by host; no SQL for the same reason."""
    got = service.schedule(_busy(spark, d).drop("service"), CrawlConfig(politeness=Politeness(per_host_concurrency=2)))
    return got.select("ordinal", "status", "attempts", F.round("started_ts", 3).alias("started_ts"), F.round("finished_ts", 3).alias("finished_ts"))


def _raw(spark, d):
    """Pages asked for in batches of 16, and what a connector returned: some under another spelling, some under a redirect, some not at all."""
    p = _table(spark, d, "pages").select(F.col("page_id").alias("rid"), F.floor(F.col("page_id") / 16).alias("batch"), "url", F.length("url").alias("n"), "html")
    kind = F.col("n") % 5
    raw = p.where(kind != 4).select("batch", F.col("rid").alias("pos"), F.when(kind == 1, F.lit("about:blank")).when(kind == 2, F.concat("url", F.lit("/"))).otherwise(F.col("url")).alias("url"), F.when(kind == 1, F.col("url")).alias("redirected_url"), (kind != 3).alias("success"), F.when(kind == 3, F.when(F.col("rid") % 2 == 0, 500).otherwise(200)).otherwise(200).alias("status_code"), F.when(kind == 3, "blocked by a guess").alias("error_message"), F.lit("<p>x</p>").alias("html"), F.array(F.lit("l")).alias("links"))
    return p.select("rid", "batch", "url"), raw


def q_connector_batches(spark, d):
    got = connectors.from_batches(*_raw(spark, d))
    return got.groupBy("status", F.coalesce("error", F.lit("")).alias("error"), F.col("links").isNotNull().alias("with_links")).agg(F.count("*").alias("n"))


def q_connector_keys(spark, d):
    """Every request of the log by its key; results may come twice, or not."""
    log = _log(spark, d)
    raw = log.where("kind <> 'signup'").select(F.col("seq").alias("key"), F.col("ts").alias("finished_ts"), _code().alias("http_status"), F.lit("x").alias("html"), F.when(F.col("kind") == "click", "Timed out").alias("error_message"))
    late = raw.withColumn("finished_ts", F.col("finished_ts") + 5).withColumn("http_status", F.lit(200))
    got = connectors.from_keyed(log.select(F.col("seq").alias("key"), F.lit("u").alias("url")), raw.unionByName(late))
    return got.select("key", "status", "error")


def q_connector_plain(spark, d):
    o = _outcomes(spark, d).select("seq", F.when(F.col("message").isNull() | (F.col("seq") % 2 == 0), F.col("code")).alias("http_status"), F.lit("").alias("html"), F.when(F.col("seq") % 2 == 1, F.col("message")).alias("error_message"))
    return connectors.from_plain(o).select("seq", "status", "error")


def q_capabilities(spark, d):
    """The sources that come with the package."""
    return contract.list_sources(spark).where("origin = 'builtin'").select("name", "available", "capabilities")


def q_completed(spark, d):
    """Every row of the log is asked for; views have no answer, signups have two, and strays come for what nobody asked."""
    log = _log(spark, d)
    asked = log.select(F.col("seq").alias("rid"))
    came = log.where("kind <> 'view'").select(F.col("seq").alias("rid"), "ts", F.when(F.col("ok"), "ok").otherwise("timeout").alias("status"))
    again = log.where("kind = 'signup'").select(F.col("seq").alias("rid"), F.col("ts") + 1, F.lit("http_error")).toDF("rid", "ts", "status")
    strays = log.select(-F.col("seq") - 1, "ts", F.lit("ok")).toDF("rid", "ts", "status")
    return service.completed(asked, came.unionByName(again).unionByName(strays))


def q_sink_roundtrip(spark, d):
    p = _table(spark, d, "pages").select("page_id", "url", H.title("html").alias("title"), F.lit(None).cast("string").alias("error"), (F.col("page_id") / 7).alias("elapsed"), "html")
    path = fresh(spark, "sink")
    sinks.write(sinks.page_row(p), path, "jsonl.gz")
    return spark.read.schema("page_id bigint, url string, title string, error string, elapsed_s double").json(path)


def q_source_parity(spark, d):
    """Titles on which the native and the parsing extractor disagree: none."""
    p = _table(spark, d, "pages")
    a = p.select("page_id", H.title("html").alias("title"))
    b = p.select("page_id", H.page_facts("html", "url")["title"].alias("title"))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("n"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")} | {f"q_scope_{m}": _scope_query(m) for m in SCOPES}

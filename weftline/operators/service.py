"""Request and response: a table of URLs with an ordinal in, a page for each out, in the same order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..plans.config import CrawlConfig
from ..sources.contract import complete
from . import robots as R
from .politeness import Limits
from .simulate import Rules, simulated


class ServiceBusy(RuntimeError):
    """A request found no free slot in time."""


def respond(requests: DataFrame, source, timeout_s: float | None = None, config: CrawlConfig | None = None, robots: DataFrame | None = None) -> DataFrame:
    """One row for each request, with the columns of a page: an unusable URL gives 'skipped', one that robots.txt denies 'blocked_robots', a slow answer 'timeout'.

    The same URL may be asked for again; each request has its own answer.  Rows come in
    the order of their ordinals (``ordered``).
    """
    config = config or CrawlConfig()
    out = config.output
    r = requests.withColumn("asked", F.col("url")).withColumn("url", U.normalize("url", config.strip_query))
    if robots is not None and config.politeness.respect_robots:
        r = R.judged(r, robots).drop("origin", "crawl_delay")
    else:
        r = r.withColumn("allowed", F.lit(True))
    got = source.fetch(r)
    late = F.col("elapsed") > timeout_s if timeout_s is not None else F.lit(False)
    unfit = F.when(F.col("url") == "", "skipped").when(~F.col("allowed"), "blocked_robots")
    status = F.coalesce(unfit, F.when(late, "timeout").otherwise(F.col("status")))
    answered = unfit.isNull() & ~late
    has = answered & (F.length("html") > 0)
    none = F.array().cast("array<string>")
    links = F.when(has, H.links("html", "final_url", config.strip_query)).otherwise(none) if out.include_links else none
    error = F.when(F.col("url") == "", "not a usable url").when(~F.col("allowed"), "denied by robots.txt").when(late, F.lit(f"no response within {timeout_s} s")).otherwise(F.col("error"))
    empty = lambda c: F.when(has, c).otherwise("")
    return got.withColumn("found", links).select(
        "ordinal",
        F.col("asked").alias("url"),
        F.when(answered, F.col("final_url")).otherwise(F.col("url")).alias("final_url"),
        F.lit(0).alias("depth"),
        F.lit(None).cast("string").alias("parent"),
        F.when(answered, F.col("http_status")).alias("http_status"),
        status.alias("status"),
        empty(H.title("html")).alias("title"),
        (empty(H.text("html", out.max_text_chars)) if out.include_text else F.lit("")).alias("text"),
        F.col("found").alias("links"),
        F.size("found").alias("n_links"),
        error.alias("error"),
        F.when(unfit.isNotNull(), 0.0).when(late, F.lit(float(timeout_s or 0))).otherwise(F.col("elapsed")).alias("elapsed"),
        F.when(unfit.isNull(), F.col("backend")).otherwise("").alias("backend"),
        "fetched_at",
        (F.when(answered, F.col("html")) if out.include_html else F.lit(None).cast("string")).alias("html"),
    )


def ordered(pages: DataFrame) -> DataFrame:
    """The answers in the order of the requests."""
    return pages.orderBy("ordinal")


def projected(pages: DataFrame, include_text: bool = False, include_links: bool = False) -> DataFrame:
    """The response's fields: text and links only where they are asked for, seconds to three places."""
    text = F.col("text") if include_text else F.lit(None).cast("string")
    links = F.col("links") if include_links else F.lit(None).cast("array<string>")
    return pages.select("ordinal", "url", "final_url", "status", "http_status", "title", text.alias("text"), links.alias("links"), "error", F.round("elapsed", 3).alias("elapsed_s"))


def refused(n_urls: int, most: int = 20) -> int | None:
    """The HTTP status of a request with too many URLs."""
    return 413 if n_urls > most else None


def completed(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Results by request id; a request without one is a backend error, the first of several counts, and strays go."""
    first = results.groupBy("rid").agg(F.min(F.struct("ts", "status")).alias("m")).select("rid", "m.status")
    return requests.join(first, "rid", "left").withColumn("status", F.coalesce("status", F.lit("backend_error")))


def rules(config: CrawlConfig, queue_timeout_s: float = 30.0, request_timeout_s: float | None = 60.0) -> Rules:
    p = config.politeness
    return Rules(config.concurrency, queue_timeout_s, p.per_host_concurrency, request_timeout_s, config.max_retries, config.retry_backoff_s, p.adaptive, Limits(p.per_host_rps, p.burst, p.min_rps, p.max_rps))


def admitted(requests: DataFrame, config: CrawlConfig, queue_timeout_s: float = 30.0, request_timeout_s: float | None = 60.0, key: str = "service") -> DataFrame:
    """What becomes of requests (service, ordinal, host, arrive_ts, elapsed, ...) at services with ``config.concurrency`` slots each, in virtual time."""
    return simulated(requests, rules(config, queue_timeout_s, request_timeout_s), key)


def raise_if_busy(outcome: DataFrame) -> DataFrame:
    """A batch of which one request was rejected fails as a whole."""
    n = outcome.where("status = 'rejected'").count()
    if n:
        raise ServiceBusy(f"{n} requests found no free slot")
    return outcome


def schedule(results: DataFrame, config: CrawlConfig) -> DataFrame:
    """When a crawl with these settings would have made the requests (host, ordinal, elapsed, status, ...): each host by itself, by its limits and robots delay, at most ``per_host_concurrency`` at once."""
    p = config.politeness
    own = Rules(None, 0.0, p.per_host_concurrency, None, config.max_retries, config.retry_backoff_s, p.adaptive, Limits(p.per_host_rps, p.burst, p.min_rps, p.max_rps))
    return simulated(results, own, "host")


def stats(outcome: DataFrame, now: float | None = None) -> DataFrame:
    """The service's counters over ``admitted`` rows, one row; ``now``: what is open then."""
    span = F.greatest(F.max("finished_ts") - F.min(F.coalesce("admitted_ts", "finished_ts")), F.lit(1e-9))
    done = F.col("status") == "ok"
    tried = ~F.col("status").isin("rejected", "blocked_robots", "skipped")
    at = F.lit(now).cast("double")
    open_: Column = F.count_if((F.col("started_ts") <= at) & (F.col("finished_ts") > at)) if now is not None else F.lit(0).cast("bigint")
    return outcome.agg(
        F.coalesce(F.sum(F.when(tried, F.col("attempts"))), F.lit(0)).alias("submitted"),
        F.count_if(done).alias("completed"),
        F.count_if(tried & ~done).alias("failed"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.count_if(F.col("status") == "blocked_robots").alias("robots_blocked"),
        F.count_if(F.col("status") == "timeout").alias("timed_out"),
        F.coalesce(F.sum(F.when(tried, F.col("attempts") - 1)), F.lit(0)).alias("retried"),
        open_.alias("in_flight"),
        F.round(F.coalesce(span, F.lit(0.0)), 1).alias("uptime_s"),
        F.round(F.coalesce(F.count_if(done) / span, F.lit(0.0)), 2).alias("completed_per_second"),
    )


def snapshot(outcome: DataFrame, config: CrawlConfig, backend: str, now: float | None = None) -> DataFrame:
    """The counters with the settings and the number of hosts seen."""
    hosts = outcome.where("started_ts is not null").agg(F.countDistinct("host").alias("hosts_tracked")).withColumn("k", F.lit(1))
    return stats(outcome, now).withColumn("k", F.lit(1)).join(hosts, "k").drop("k").select("*", F.lit(backend).alias("backend"), F.lit(config.concurrency).alias("concurrency"))


class FetchService:
    """A source with settings: ``fetch`` URLs, answers in their order. It has to be started, and may be started again."""

    def __init__(self, spark, source, config: CrawlConfig | None = None, request_timeout_s: float | None = 60.0, robots: DataFrame | None = None):
        self.spark, self.source, self.config, self.timeout_s, self.robots = spark, source, config or CrawlConfig(), request_timeout_s, robots
        self.ready = False

    def start(self) -> FetchService:
        if hasattr(self.source, "require"):
            self.source.require()
        self.ready = True
        return self

    def close(self) -> None:
        self.ready = False

    def __enter__(self) -> FetchService:
        return self.start()

    def __exit__(self, *_) -> None:
        self.close()

    def requests(self, urls: list[str]) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(urls)), "ordinal bigint, url string")

    def fetch(self, urls) -> DataFrame:
        """Pages for a list of URLs, or for a table (ordinal, url)."""
        if not self.ready:
            raise RuntimeError("the service isn't started")
        r = urls if isinstance(urls, DataFrame) else self.requests(list(urls))
        return ordered(respond(r, self.source, self.timeout_s, self.config, self.robots))

    def fetch_one(self, url: str):
        return self.fetch([url]).first()


__all__ = ["FetchService", "ServiceBusy", "admitted", "complete", "completed", "ordered", "projected", "raise_if_busy", "refused", "respond", "rules", "schedule", "snapshot", "stats"]

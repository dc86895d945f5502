"""Breadth-first traversal: each round is one declarative plan, and ends in a table of the shared folder.

fetch (join) -> facts and links -> scope -> least parent a URL -> anti join with all seen.  Only
counters come to the driver.  What was seen lies in a table bucketed by URL, to which a
round appends and which no round shuffles again.  A budget cuts a round by turns of its
hosts: whole turns are taken by a filter, so the batch stays spread.
"""

from __future__ import annotations

import time
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..plans.config import CrawlConfig
from ..plans.storage import Scratch, fresh, remove
from ..sources.corpus import seeds
from . import robots as R
from .dedup import Bloom, apart
from .frontier import capped, first_seen, next_turns, unseen
from .scope import reason

PAGE = "url string, final_url string, depth int, parent string, http_status int, status string, title string, text string, links array<string>, n_links int, error string, elapsed double, backend string, fetched_at double, html string, attempt int, retry_after double, n_chars bigint, crawl_delay double"
COUNTERS = "discovered out_of_scope duplicates enqueued dropped robots_blocked fetched retried rounds".split()


class Crawl(NamedTuple):
    pages: DataFrame
    counters: dict[str, int]


class _Seen:
    """URLs that were found, in a table of the shared folder that is bucketed by URL, and with settings that say so a filter in front of it."""

    def __init__(self, spark: SparkSession, config: CrawlConfig):
        self.spark, self.path = spark, fresh(spark, "seen")
        self.bloom = Bloom(config.dedup_capacity, config.dedup_error_rate) if config.dedup == "bloom" else None
        self.name = f"weftline_seen_{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def add(self, rows: DataFrame) -> None:
        part = rows.select("url").repartition(self.buckets, "url")
        part.write.bucketBy(self.buckets, "url").mode("append").format("parquet").option("path", self.path).saveAsTable(self.name)
        if self.bloom is not None:
            self.bloom.add(rows.select("url"))

    def unseen(self, found: DataFrame) -> DataFrame:
        known = self.spark.table(self.name)
        return unseen(found, known) if self.bloom is None else apart(found, known, self.bloom)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)


def page_rows(got: DataFrame, config: CrawlConfig) -> DataFrame:
    """The columns of ``PAGE`` from results of requests; error pages with a body are read as well."""
    has = F.length("html") > 0
    deep = has & (F.col("depth") < config.max_depth) & F.lit(config.follow_links)
    none = F.array().cast("array<string>")
    links = H.links("html", "final_url", config.strip_query)
    if "links" in got.columns:
        # links that the source found itself are followed even on a page that says nofollow
        own = F.array_distinct(F.array_remove(F.transform("links", lambda u: U.normalize(u, config.strip_query)), ""))
        links = F.coalesce(own, links)
    links = F.when(deep, links).otherwise(none)
    text = H.text("html", config.output.max_text_chars)
    if config.output.text_source == "backend" and "text" in got.columns:
        text = F.coalesce(F.nullif("text", F.lit("")), text)
    text = F.when(has, text).otherwise("") if config.output.include_text else F.lit("")
    kept = got.withColumn("found", links)
    return kept.select(
        "url", "final_url", "depth", "parent", "http_status", "status", F.when(has, H.title("html")).otherwise("").alias("title"), text.alias("text"),
        F.col("found").alias("links"), F.size("found").alias("n_links"), "error", "elapsed", "backend", "fetched_at",
        (F.col("html") if config.output.include_html else F.lit(None).cast("string")).alias("html"),
        "attempt", (F.col("retry_after") if "retry_after" in got.columns else F.lit(None).cast("double")).alias("retry_after"), F.coalesce(F.length("html"), F.lit(0)).cast("bigint").alias("n_chars"), "crawl_delay",
    )


def crawl(spark: SparkSession, config: CrawlConfig, source, robots: DataFrame | None = None, start: DataFrame | None = None) -> Crawl:
    """Pages (``PAGE``) and the counters. ``start``: a table (raw) of seeds beside the settings'; ``robots``: rules by origin."""
    began = time.monotonic()
    total = dict.fromkeys(COUNTERS, 0)
    pages_at = fresh(spark, "pages")
    seen = _Seen(spark, config)
    schema = "url string, depth int, parent string"
    kept = Scratch(spark)
    try:
        frontier = kept.stored(seeds(spark, config.seeds, start), "frontier")
        total["enqueued"] = waiting = frontier.count()
        seen.add(frontier)
        while waiting and total["fetched"] < config.max_pages and not (config.time_budget_s and time.monotonic() - began > config.time_budget_s):
            with Scratch(spark) as scratch:
                batch = frontier.withColumn("crawl_delay", F.lit(None).cast("double"))
                if robots is not None and config.politeness.respect_robots:
                    marked = scratch.stored(R.judged(frontier, robots).select("url", "depth", "parent", "allowed", "crawl_delay"), "robots")
                    blocked = marked.where("not allowed").count()
                    total["robots_blocked"] += blocked
                    waiting -= blocked
                    batch = marked.where("allowed").drop("allowed")
                left = config.max_pages - total["fetched"]
                if waiting > left:
                    batch = next_turns(batch.withColumn("host", U.host_of("url")).withColumn("seq", F.col("url")), left).select("url", "depth", "parent", "crawl_delay")
                path = f"{pages_at}/round={total['rounds']}"
                page_rows(source.fetch(batch), config).write.parquet(path)
                done = spark.read.schema(PAGE).parquet(path)
                n = done.agg(F.count("*").alias("n"), F.coalesce(F.sum("attempt"), F.lit(0)).alias("again")).first()
                total["fetched"] += n.n
                total["retried"] += n.again
                total["rounds"] += 1
                if not n.n or not config.follow_links:
                    break
                # children of the address that answered
                found = done.select(F.explode("links").alias("url"), (F.col("depth") + 1).alias("depth"), F.col("final_url").alias("parent"))
                found = scratch.stored(found.withColumn("why", reason(config)), "found")
                new = scratch.stored(seen.unseen(first_seen(found.where("why is null").select("url", "depth", "parent"))), "new")
                counts = found.agg(F.count("*").alias("n"), F.count("why").alias("oos")).first()
                fits = enqueued = new.count()
                following = Scratch(spark)
                if fits > min(config.max_frontier_per_host, config.max_frontier):
                    ranked = new.withColumn("host", U.host_of("url")).withColumn("seq", F.col("url"))
                    new_frontier = following.stored(capped(ranked, config.max_frontier_per_host, config.max_frontier).select("url", "depth", "parent"), "frontier")
                    enqueued = new_frontier.count()
                else:
                    new_frontier = following.stored(new, "frontier")
                seen.add(new)
                for k, v in (("discovered", counts.n), ("out_of_scope", counts.oos), ("duplicates", counts.n - counts.oos - fits), ("enqueued", enqueued), ("dropped", fits - enqueued)):
                    total[k] += v
                kept.__exit__()
                kept, frontier, waiting = following, new_frontier.select(*[f.split()[0] for f in schema.split(", ")]), enqueued
    finally:
        kept.__exit__()
        seen.drop()
    if not total["rounds"]:
        return Crawl(spark.createDataFrame([], PAGE), total)
    return Crawl(spark.read.schema(PAGE + ", round int").parquet(pages_at).drop("round"), total)

"""The command line: crawl, sources, bench, config."""

from __future__ import annotations

import argparse
import dataclasses
import pathlib
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import urls as U
from .operators import metrics
from .operators.crawl import Crawl, crawl
from .plans.config import CrawlConfig
from .sources.contract import get_source, list_sources
from .sources.corpus import CorpusSource
from .sources.live import HttpSource
from .sources.sinks import make_sink, page_row, write_stats


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftline", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("crawl", help="follow links from seeds and write a row for each page")
    c.add_argument("seeds", nargs="*")
    c.add_argument("--config", "-c", help="a YAML or JSON file of settings; of the options only seeds, source and output add to it")
    c.add_argument("--source", "-s", help="a registered source")
    c.add_argument("--corpus", help="a Parquet table (url, html) in the network's place")
    c.add_argument("--output", "-o")
    c.add_argument("--stats", help="a JSON file for the summary")
    c.add_argument("--quiet", "-q", action="store_true")
    for name, kind in (("concurrency", int), ("max-pages", int), ("max-depth", int), ("per-host-rps", float), ("per-host-concurrency", int), ("time-budget", float), ("retries", int), ("timeout-ms", int)):
        c.add_argument(f"--{name}", type=kind)
    c.add_argument("--scope", choices=("site", "host", "path", "any"))
    c.add_argument("--dedup", choices=("exact", "bloom"))
    for name in ("allow", "deny", "allow-domain", "deny-domain"):
        c.add_argument(f"--{name}", action="append")
    for name in ("no-robots", "html", "no-text", "strip-query"):
        c.add_argument(f"--{name}", action="store_true")
    sub.add_parser("sources", help="list the sources and whether they can be used")
    b = sub.add_parser("bench", help="pages a second by source and concurrency")
    b.add_argument("url")
    b.add_argument("--sources", default="http")
    b.add_argument("--corpus")
    b.add_argument("--concurrency", "-j", default="8,16,32")
    b.add_argument("--max-pages", "-n", type=int, default=60)
    b.add_argument("--repeat", type=int, default=1)
    f = sub.add_parser("config", help="print all settings with their defaults")
    f.add_argument("--output", "-o")
    return p


def settings(a: argparse.Namespace) -> CrawlConfig:
    """Options over the settings' file, which keeps all but seeds, source and output."""
    out = {k: v for k, v in (("path", a.output), ("format", "jsonl.gz" if (a.output or "").endswith(".gz") else None)) if v is not None}
    top = {k: v for k, v in (("seeds", a.seeds or None), ("backend", a.source)) if v is not None}
    if a.config:
        base = CrawlConfig.from_file(a.config)
        return dataclasses.replace(base, **top, output=dataclasses.replace(base.output, **out))
    names = {"concurrency": "concurrency", "max_pages": "max_pages", "max_depth": "max_depth", "time_budget": "time_budget_s", "retries": "max_retries", "scope": "scope", "dedup": "dedup", "allow": "allow_patterns", "deny": "deny_patterns", "allow_domain": "allow_domains", "deny_domain": "deny_domains"}
    top |= {to: getattr(a, k) for k, to in names.items() if getattr(a, k) is not None}
    polite = {k: v for k, v in (("per_host_rps", a.per_host_rps), ("per_host_concurrency", a.per_host_concurrency), ("respect_robots", False if a.no_robots else None)) if v is not None}
    out |= {"include_html": a.html, "include_text": not a.no_text}
    browser = {"page_timeout_ms": a.timeout_ms} if a.timeout_ms else {}
    return CrawlConfig.of({**top, "strip_query": a.strip_query, "politeness": polite, "output": out, "browser": browser})


def source_of(spark: SparkSession, config: CrawlConfig, corpus: str | None):
    if corpus:
        pages = spark.read.parquet(corpus)
        return CorpusSource(pages.withColumn("url", U.normalize("url", config.strip_query)), config.max_retries, config.retry_backoff_s)
    make = get_source(config.backend)
    if make is HttpSource:
        return HttpSource(config.politeness, config.browser.page_timeout_ms / 1000, config.max_retries, config.retry_backoff_s, **config.backend_options)
    browser = {"browser": config.browser.options()} if getattr(make, "takes_browser", False) else {}
    return make(**config.backend_options, **browser)


def log_of(pages: DataFrame) -> DataFrame:
    """Result rows as the log that reports read."""
    return pages.select("url", F.col("fetched_at").alias("ts"), F.xxhash64("url").alias("seq"), (F.col("status") == "ok").alias("ok"), F.col("n_chars").alias("chars"), "elapsed", "http_status", F.when(F.col("status") != "ok", F.col("status")).alias("kind"))


def summary_of(done: Crawl) -> DataFrame:
    return metrics.full_summary(log_of(done.pages), done.counters)


def run_crawl(spark: SparkSession, a: argparse.Namespace) -> int:
    config = settings(a)
    if not config.seeds:
        sys.stderr.write("no seeds\n")
        return 2
    began = time.monotonic()
    done = crawl(spark, config, source_of(spark, config, a.corpus))
    out = config.output
    with make_sink(out.path, out.format, out.include_html) as sink:
        sink.write(page_row(done.pages, out.include_html, out.include_links))
    summary = summary_of(done)
    row = summary.first()
    if a.stats:
        write_stats(summary, a.stats)
    if not a.quiet:
        for k, v in row.asDict().items():
            sys.stderr.write(f"{k:>18}  {v}\n")
        sys.stderr.write(f"{'wall_s':>18}  {time.monotonic() - began:.1f}\n")
    return 1 if row.fetched and not row.succeeded else 0


def run_bench(spark: SparkSession, a: argparse.Namespace) -> int:
    runs = []
    for name in a.sources.split(","):
        for level in map(int, a.concurrency.split(",")):
            for _ in range(a.repeat):
                polite = {"respect_robots": False, "per_host_rps": float(level * 4), "max_rps": float(level * 4), "per_host_concurrency": level}
                config = CrawlConfig.of({"seeds": [a.url], "backend": name.strip(), "concurrency": level, "max_pages": a.max_pages, "max_depth": 3, "scope": "host", "politeness": polite, "output": {"format": "none"}})
                began = time.monotonic()
                done = crawl(spark, config, source_of(spark, config, a.corpus))
                s = summary_of(done).first()
                runs.append((name.strip(), level, s.fetched, time.monotonic() - began, float(s.success_rate)))
    rows = metrics.bench_rows(spark.createDataFrame(runs, "backend string, concurrency int, pages bigint, elapsed double, ok double"))
    rows.orderBy("backend", "concurrency").show(len(runs), truncate=False)
    return 0 if any(r[2] for r in runs) else 1


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "config":
        text = CrawlConfig(seeds=("https://example.com",)).to_yaml()
        if a.output:
            pathlib.Path(a.output).parent.mkdir(parents=True, exist_ok=True)
            pathlib.Path(a.output).write_text(text)
        else:
            sys.stdout.write(text)
        return 0
    spark = SparkSession.builder.appName("weftline").getOrCreate()
    if a.command == "sources":
        list_sources(spark).show(100, truncate=False)
        return 0
    return run_crawl(spark, a) if a.command == "crawl" else run_bench(spark, a)

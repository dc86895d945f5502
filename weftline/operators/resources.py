"""Requests of a page: what a block policy turns away, and the trace of types, bytes and cache hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import http
from ..functions.urls import host_of
from .scope import in_domains


def block_reason(url: Column, kind: Column, headers: Column, prefetch: bool = True, hosts=(), types=()) -> Column:
    """prefetch before resource type before host; null where the request goes on."""
    out = F.when(http.is_prefetch(headers) & F.lit(prefetch), "prefetch")
    if types:
        out = out.when(F.lower(kind).isin(*[t.lower() for t in types]), "resource_type")
    return out.when(in_domains(host_of(url), hosts), "host") if hosts else out


def policy_needed(prefetch: bool = True, hosts=(), types=()) -> bool:
    """Whether a policy turns anything away."""
    return bool(prefetch or hosts or types)


def from_settings(browser) -> dict:
    """The arguments of ``block_reason`` from the browser's settings."""
    return {"prefetch": browser.block_prefetch, "hosts": tuple(h.strip().lower().lstrip(".") for h in browser.blocked_hosts if h.strip()), "types": tuple(browser.blocked_resource_types) if browser.block_resources else ()}


def traced(requests: DataFrame, responses: DataFrame, served: DataFrame) -> DataFrame:
    """Events of a page as one table of requests: (request_id, page_id, resource_type), (request_id, content_length, disk_cache, prefetch_cache), (request_id).

    A size that is missing or no number is 0; a request that was served from memory once is a hit, whatever its response says; without a response it is neither.
    """
    r = responses.select("request_id", F.coalesce(F.greatest(F.col("content_length").try_cast("bigint"), F.lit(0)), F.lit(0)).alias("size"), (F.coalesce("disk_cache", F.lit(False)) | F.coalesce("prefetch_cache", F.lit(False))).alias("cached"))
    m = served.select("request_id").distinct().withColumn("memory", F.lit(True))
    joined = requests.join(r, "request_id", "left").join(m, "request_id", "left")
    return joined.select(*requests.columns, F.coalesce("size", F.lit(0)).alias("size"), F.when(F.col("cached").isNotNull(), F.col("cached") | F.coalesce("memory", F.lit(False))).alias("from_cache"))


def by_type(requests: DataFrame) -> DataFrame:
    """Requests and bytes by type; an empty type is 'other', and sizes below 0 don't count."""
    kind = F.coalesce(F.nullif(F.col("resource_type"), F.lit("")), F.lit("other"))
    return requests.groupBy(kind.alias("resource_type")).agg(F.count("*").alias("requests"), F.sum(F.greatest(F.coalesce("size", F.lit(0)), F.lit(0))).alias("bytes"))


def cache_rate(requests: DataFrame) -> DataFrame:
    return requests.agg(F.count("*").alias("requests"), F.round(F.try_divide(F.count_if("from_cache"), F.count("from_cache")), 6).alias("cache_hit_rate"))


def blocked(requests: DataFrame, reason: Column) -> DataFrame:
    """Requests turned away by reason."""
    return requests.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("requests"))


def totals(requests: DataFrame, page: str = "page_id") -> DataFrame:
    """One row: requests, bytes, pages, requests a page, hits, answers from the network and the share of hits, null where none is known."""
    n, pages = F.count("*"), F.countDistinct(page)
    return requests.agg(
        n.alias("requests"),
        F.coalesce(F.sum(F.greatest(F.coalesce("size", F.lit(0)), F.lit(0))), F.lit(0)).alias("bytes"),
        pages.alias("pages"),
        F.round(n / F.greatest(pages, F.lit(1)), 1).alias("per_page"),
        F.count_if(F.col("from_cache")).alias("from_cache"),
        F.count_if(~F.col("from_cache")).alias("from_network"),
        F.round(F.try_divide(F.count_if("from_cache"), F.count("from_cache")), 6).alias("cache_hit_rate"),
    )


def report(requests: DataFrame, reason: Column | None = None, page: str = "page_id") -> DataFrame:
    """The trace's lines (place, line), most frequent types first, then reasons of blocking, then the cache."""
    t = totals(requests, page).withColumn("k", F.lit(1))
    w = Window.partitionBy("kind").orderBy(F.desc("requests"), "name")
    rows = by_type(requests).select(F.lit(1).alias("kind"), F.col("resource_type").alias("name"), "requests", "bytes")
    if reason is not None:
        rows = rows.unionByName(blocked(requests, reason).select(F.lit(2).alias("kind"), F.col("reason").alias("name"), "requests", F.lit(0).cast("bigint").alias("bytes")))
    # a few types and reasons, one row of totals
    rows = rows.withColumn("nth", F.row_number().over(w)).withColumn("k", F.lit(1)).join(t.select("k", F.greatest("pages", F.lit(1)).alias("pages")), "k")
    line = F.when(F.col("kind") == 1, F.format_string("%s: %d requests, %.1f a page, %.2f MB", "name", "requests", F.col("requests") / F.col("pages"), F.col("bytes") / 1e6)).otherwise(F.format_string("blocked by %s: %d requests, %.1f a page", "name", "requests", F.col("requests") / F.col("pages")))
    head = t.select((F.lit(0)).alias("kind"), F.lit(1).alias("nth"), F.format_string("%d requests, %.2f MB, %d pages", "requests", F.col("bytes") / 1e6, "pages").alias("line"))
    tail = t.where("cache_hit_rate is not null").select(F.lit(3).alias("kind"), F.lit(1).alias("nth"), F.format_string("cache: %d hits, %d from the network, %.0f%% hits", "from_cache", "from_network", F.col("cache_hit_rate") * 100).alias("line"))
    lines = head.unionByName(rows.select("kind", "nth", line.alias("line"))).unionByName(tail)
    return lines.select((F.col("kind") * 1000 + F.col("nth")).alias("place"), "line").orderBy("place")

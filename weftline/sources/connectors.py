"""Results of browser connectors as tables: how what they return becomes results of requests.

Connectors drive browsers that aren't here; what they hand over is a table of raw results,
and these functions pair it with the requests and map its outcome.  Three kinds are known:
``batch`` (a batch at a time, by URL, which it may rewrite or drop), ``keyed`` (a key for
each request) and ``plain`` (no browser).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import http
from .contract import complete


def mapped(raw: DataFrame, source: str = "batch") -> DataFrame:
    """raw (success, status_code, error_message, html, url, redirected_url, links) with final_url, status, http_status, error and links.

    A page that the connector failed by its own judgement, though the server answered, is ok, and its message stays as the error; links count only where the connector had success.
    """
    success = F.coalesce(F.col("success"), F.lit(False))
    status = http.outcome(success, F.col("status_code"), F.col("html"), F.col("error_message"), source)
    has_links = "links" in raw.columns
    out = raw.select("*", F.coalesce(F.nullif("redirected_url", F.lit("")), F.nullif("url", F.lit(""))).alias("final_url"), status.alias("status"), F.col("status_code").alias("http_status"), F.nullif("error_message", F.lit("")).alias("error"))
    return out.withColumn("links", F.when(success, F.col("links")) if has_links else F.lit(None).cast("array<string>"))


def _occurrence(df: DataFrame, by: str, order: Column | str) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(order)))


def by_url(requests: DataFrame, raw: DataFrame) -> DataFrame:
    """Pair requests (rid, batch, url) with raw results (batch, pos, url, redirected_url, ...): by the result's URL, else its redirect, the n-th with the n-th, else the first that is left of its batch; null where none is.

    A batch is one call of the connector and of bounded size, so its rest is ranked in one place.
    """
    asked = _occurrence(requests.select("rid", "batch", F.col("url").alias("asked")), "asked", "rid").withColumn("key", F.concat_ws("|", F.col("batch"), "asked", "nth"))
    paired, left_raw, left_req = None, raw.withColumn("raw_id", F.concat_ws("|", F.col("batch"), F.col("pos"))), asked
    for c in ("url", "redirected_url"):
        own = left_raw.where(F.coalesce(F.col(c), F.lit("")) != "").withColumn("who", F.concat_ws("|", F.col("batch"), F.col(c)))
        own = own.withColumn("nth", F.row_number().over(Window.partitionBy("who").orderBy("pos")))
        mine = left_req.withColumn("who", F.concat_ws("|", F.col("batch"), "asked")).withColumn("nth", F.row_number().over(Window.partitionBy("who").orderBy("rid")))
        hit = mine.select("rid", "who", "nth").join(own.select("raw_id", "who", "nth"), ["who", "nth"]).select("rid", "raw_id")
        paired = hit if paired is None else paired.unionByName(hit)
        left_raw, left_req = left_raw.join(hit, "raw_id", "left_anti"), left_req.join(hit, "rid", "left_anti")
    by_batch = lambda df, o: df.withColumn("nth", F.row_number().over(Window.partitionBy("batch").orderBy(o)))
    rest = by_batch(left_req.select("rid", "batch"), "rid").join(by_batch(left_raw.select("raw_id", "batch", "pos"), "pos").drop("pos"), ["batch", "nth"]).select("rid", "raw_id")
    pairs = paired.unionByName(rest)
    named = raw.withColumn("raw_id", F.concat_ws("|", F.col("batch"), F.col("pos"))).drop("batch", "pos")
    return requests.select("rid", F.col("url").alias("asked")).join(pairs, "rid", "left").join(named, "raw_id", "left").drop("raw_id")


def from_batches(requests: DataFrame, raw: DataFrame) -> DataFrame:
    """One result for each request (rid, batch, url); what the connector dropped is a backend error."""
    m = mapped(by_url(requests, raw))
    there = F.col("success").isNotNull()
    return m.select("rid", "asked", F.when(there, F.col("final_url")).otherwise(F.col("asked")).alias("final_url"), F.when(there, F.col("status")).otherwise("backend_error").alias("status"), "http_status", F.when(there, F.col("error")).otherwise("no result returned").alias("error"), F.coalesce("html", F.lit("")).alias("html"), "links")


def from_keyed(requests: DataFrame, raw: DataFrame) -> DataFrame:
    """One result for each request (key, url) from (key, finished_ts, http_status, html, error_message): the first of a key counts, later ones are ignored."""
    failed = F.col("error_message").isNotNull()
    status = F.when(failed, http.classify_error(F.col("error_message"), "browser")).otherwise(http.http_status(F.col("http_status")))
    results = raw.select("key", "finished_ts", "http_status", F.coalesce("html", F.lit("")).alias("html"), status.alias("status"), F.coalesce("error_message", http.http_error(F.col("http_status"))).alias("error"))
    return complete(requests, results, "key")


def from_plain(raw: DataFrame) -> DataFrame:
    """Status and error of plain answers (http_status, html, error_message)."""
    failed = F.col("error_message").isNotNull()
    status = F.when(failed, http.classify_error(F.col("error_message"), "plain")).otherwise(http.http_status(F.col("http_status")))
    return raw.withColumn("status", status).withColumn("error", F.coalesce("error_message", http.http_error(F.col("http_status"))))

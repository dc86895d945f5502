"""Two-tier fetching: judge the plain page, take the rendered one where it is better."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_TEXT, MIN_RATIO = 2500, 0.03


def content_check(text: Column, html: Column, status: Column, code: Column, min_text: int = MIN_TEXT, min_ratio: float = MIN_RATIO, marker: str | None = None) -> Column:
    """The verdict's reason; 'ok', 'not-ok' and 'marker-present' are sufficient."""
    t, n = F.coalesce(text, F.lit("")), F.coalesce(F.length(text), F.lit(0))
    ratio = n / F.length(html)
    out = F.when(status != "ok", F.when(code == 403, "http-403").otherwise("not-ok"))
    if marker is not None:
        return out.when(t.contains(marker), "marker-present").otherwise("marker-missing")
    out = out.when(n < min_text, F.concat(F.lit("thin-text:"), n.cast("string")))
    out = out.when((F.coalesce(F.length(html), F.lit(0)) > 0) & (ratio < min_ratio), F.format_string("low-text-ratio:%.3f", ratio))
    return out.otherwise("ok")


def sufficient(reason: Column) -> Column:
    return reason.isin("ok", "not-ok", "marker-present")


def route(plain: DataFrame, rendered: DataFrame, judge=content_check, memory: DataFrame | None = None, keep_html: bool = False, key: str = "url") -> DataFrame:
    """(url, text, html, status, http_status) of both tiers: url, tier, text, reason, outcome (and html of the page that is served).

    key: the column of both that names a request, for requests of which several may have one URL;
    each gets the rendered page of its own request, and one row.  The rendered tier has one row a key at most.

    One pass over the plain pages and one outer join: whether a row needs the rendered tier
    is part of the join's condition, so sufficient pages match nothing.  A missing rendered
    page or one with less text leaves the plain page; of equal lengths the rendered one is
    served.  memory: URLs that are rendered without being judged, as their host is known to
    need it; where that fails, the plain page is served.
    """
    given = judge(F.col("text"), F.col("html"), F.col("status"), F.col("http_status"))
    base = plain.withColumn("given", given)
    by_rule = F.when(F.col("given"), "ok").otherwise("insufficient") if dict(base.dtypes)["given"] == "boolean" else F.col("given")
    if memory is not None:
        base = base.join(memory.select("url", F.lit(True).alias("known")).distinct(), "url", "left")
        by_rule = F.when(F.col("known"), "host-cached").otherwise(by_rule)
    base = base.select("url", F.col(key).alias("p_key"), "text", *(["html"] if keep_html else []), by_rule.alias("reason"))
    r = rendered.select(F.col(key).alias("r_key"), F.col("text").alias("r_text"), *([F.col("html").alias("r_html")] if keep_html else []), F.lit(True).alias("r_there"))
    j = base.join(r, (F.col("p_key") == F.col("r_key")) & ~sufficient(F.col("reason")), "left")
    n = lambda c: F.coalesce(F.length(c), F.lit(0))
    shorter = (F.col("reason") != "host-cached") & (n("r_text") < n("text"))
    outcome = F.when(sufficient(F.col("reason")), "sufficient").when(F.col("r_there").isNull(), F.when(F.col("reason") == "host-cached", "cached_failed").otherwise("escalation_failed")).when(shorter, "rendered_not_better").otherwise("escalated")
    j = j.withColumn("outcome", outcome)
    took = F.col("outcome") == "escalated"
    pick = lambda a, b: F.when(took, F.col(a)).otherwise(F.col(b)).alias(b)
    return j.select("url", F.when(took, "rendered").otherwise("plain").alias("tier"), pick("r_text", "text"), *([pick("r_html", "html")] if keep_html else []), "reason", "outcome")


def stats(routed: DataFrame) -> DataFrame:
    n = F.count("*")
    of = lambda x: F.count_if(F.col("outcome") == x)
    up = F.count_if(F.col("outcome") != "sufficient")
    return routed.agg(
        n.alias("requested"),
        of("sufficient").alias("served_plain"),
        up.alias("escalated"),
        of("escalation_failed").alias("escalation_failed"),
        of("rendered_not_better").alias("rendered_not_better"),
        F.count_if(F.col("reason") == "host-cached").alias("host_cache_hits"),
        F.round(F.when(n > 0, up / n).otherwise(0.0), 3).alias("escalation_rate"),
    )


def snapshot(routed: DataFrame, hosts: DataFrame, now: float) -> DataFrame:
    """The counters with the reasons as a map, and how many hosts are known to need rendering. hosts: (host, until)."""
    by = reasons(routed).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("escalation_reasons"))
    need = hosts.where(F.col("until") > now).agg(F.countDistinct("host").alias("hosts_needing_render"))
    one = stats(routed).withColumn("k", F.lit(1))
    for part in (by, need):
        one = one.join(part.withColumn("k", F.lit(1)), "k")
    return one.drop("k").withColumn("browser_started", F.col("escalated") > 0)


def reasons(routed: DataFrame) -> DataFrame:
    """Escalations by the kind of reason."""
    return routed.where("outcome <> 'sufficient'").groupBy(F.substring_index("reason", ":", 1).alias("reason")).agg(F.count("*").alias("n"))


def remembered(requests: DataFrame, ttl: float) -> DataFrame:
    """(host, seq, ts, escalates): ``via`` is 'memory' while an earlier escalation of the host is younger than ``ttl``.

    The expiry counts from the escalation that was remembered, not from later hits.
    State is carried over the sorted rows of a partition, so no host has to fit in memory.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, until = None, float("-inf")
        for p in parts:
            via = []
            for h, ts, up in zip(p["host"], p["ts"], p["escalates"], strict=True):
                if h != host:
                    host, until = h, float("-inf")
                if ts < until:
                    via.append("memory")
                elif up:
                    via.append("escalated")
                    until = ts + ttl if ttl > 0 else float("-inf")
                else:
                    via.append("plain")
            yield p.assign(via=via)

    slim = requests.select("host", "seq", "ts", "escalates")
    return slim.repartition("host").sortWithinPartitions("host", "ts", "seq").mapInPandas(run, "host string, seq bigint, ts double, escalates boolean, via string")

"""robots.txt as a dimension table: parsed rules by origin, the longest match decides."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import origin_of

SCHEMA = "origin string, state string, crawl_delay double, rules array<struct<size:int,allow:boolean,pattern:string>>"


def pattern(path: str) -> str:
    """A rule's path as a regular expression: ``*`` any run, a final ``$`` the end."""
    end = path.endswith("$")
    return "^" + ".*".join(re.escape(p) for p in path.rstrip("$" if end else "").split("*")) + ("$" if end else "")


def parse(body: str, agent: str) -> tuple[list[tuple[int, bool, str]], float | None]:
    """Rules and crawl delay of the groups that name the agent, else of those for all."""
    groups: list[tuple[set[str], list, list]] = []
    open_ = False
    for line in body.splitlines():
        key, _, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if not open_:
                groups.append((set(), [], []))
            groups[-1][0].add(value.lower())
            open_ = True
        elif key in ("allow", "disallow", "crawl-delay") and groups:
            open_ = False
            if key == "crawl-delay":
                try:
                    groups[-1][2].append(float(value))
                except ValueError:
                    pass
            elif value:
                groups[-1][1].append((len(value), key == "allow", pattern(value)))
    mine = [g for g in groups if any(a != "*" and a and a in agent.lower() for a in g[0])] or [g for g in groups if "*" in g[0]]
    delays = [d for g in mine for d in g[2]]
    return [r for g in mine for r in g[1]], delays[0] if delays else None


def parsed(bodies: DataFrame, agent: str = "weftline") -> DataFrame:
    """(origin, http_status, body) to rules: 401 and 403 deny all; other errors and blank bodies allow all."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for origin, code, body in zip(p["origin"], p["http_status"], p["body"], strict=True):
                if code in (401, 403):
                    rows.append((origin, "deny_all", None, []))
                elif pd.isna(code) or code >= 400 or not isinstance(body, str) or not body.strip():
                    rows.append((origin, "allow_all", None, []))
                else:
                    rules, delay = parse(body, agent)
                    rows.append((origin, "rules", delay, [dict(zip(("size", "allow", "pattern"), r, strict=True)) for r in rules]))
            yield pd.DataFrame(rows, columns=["origin", "state", "crawl_delay", "rules"]).astype({"crawl_delay": "float64"})

    return bodies.select("origin", "http_status", "body").mapInPandas(run, SCHEMA)


def fresh(robots: DataFrame, now: float, ttl_s: float = 3600.0) -> DataFrame:
    """Rules that aren't older than ``ttl_s``; those of other origins have to be read again. robots: with fetched_at."""
    return robots.where(F.lit(now) - F.col("fetched_at") < ttl_s)


def lookups(requests: DataFrame, ttl_s: float = 3600.0) -> DataFrame:
    """Requests (origin, ts, seq) with ``hit``: the origin's rules were read less than ``ttl_s`` before, at its last miss. State is carried over sorted rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, read = None, 0.0
        for p in parts:
            hit = []
            for origin, ts in zip(p["origin"], p["ts"], strict=True):
                known = origin == own and ts - read < ttl_s
                hit.append(known)
                if not known:
                    own, read = origin, ts
            yield p.assign(hit=hit)

    slim = requests.select("origin", "ts", "seq")
    return slim.repartition("origin").sortWithinPartitions("origin", "ts", "seq").mapInPandas(run, "origin string, ts double, seq bigint, hit boolean")


def cache_stats(looked: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """robots_cached, robots_hits, robots_misses, robots_errors. failed: origins whose rules can't be had."""
    rows = looked if failed is None else looked.join(failed.select("origin", F.lit(True).alias("bad")).distinct(), "origin", "left")
    bad = F.count_if(~F.col("hit") & F.col("bad")) if failed is not None else F.lit(0).cast("bigint")
    return rows.agg(F.countDistinct("origin").alias("robots_cached"), F.count_if("hit").alias("robots_hits"), F.count_if(~F.col("hit")).alias("robots_misses"), bad.alias("robots_errors"))


def judged(requests: DataFrame, robots: DataFrame, url: str = "url") -> DataFrame:
    """``requests`` with ``allowed`` and the origin's crawl delay; origins without a row are allowed.

    The join has no hint: the planner broadcasts the rules where their size permits.
    """
    joined = requests.withColumn("origin", origin_of(url)).join(robots, "origin", "left")
    target = F.regexp_replace(F.col(url), r"^[^:]+://[^/?#]*", "")
    target = F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target))
    hits = F.filter("rules", lambda r: F.regexp(target, r["pattern"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["size"], r["allow"])))
    allowed = F.when(F.col("state") == "deny_all", False).when(F.col("state") == "rules", F.coalesce(best["allow"], F.lit(True))).otherwise(True)
    return joined.withColumn("allowed", allowed).drop("rules", "state")

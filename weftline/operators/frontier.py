"""The frontier as ranked rows: caps, host-fair order, readiness, budget, first discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def capped(frontier: DataFrame, per_host: int, size: int) -> DataFrame:
    """At most ``per_host`` rows a host and ``size`` in all; retries first, then by seq.

    Rows over a host's cap go before the total is applied, and the total is a
    top-k, so no window runs over all rows in one task.
    """
    first = [F.col("is_retry").desc(), F.col("seq")] if "is_retry" in frontier.columns else [F.col("seq")]
    ranked = frontier.withColumn("rn", F.row_number().over(Window.partitionBy("host").orderBy(*first)))
    return ranked.where(F.col("rn") <= per_host).orderBy(*first).limit(size).drop("rn")


def turns(frontier: DataFrame, per_host: int = 1, order=("seq",)) -> DataFrame:
    """``turn``: the round of the host ring in which each row comes, and ``rn``, its place at its host."""
    rn = F.row_number().over(Window.partitionBy("host").orderBy(*order))
    return frontier.withColumn("rn", rn).withColumn("turn", F.ceil(F.col("rn") / per_host).cast("int"))


def pop_batch(frontier: DataFrame, limit: int, per_host: int = 1, hosts: DataFrame | None = None, now: float | None = None) -> DataFrame:
    """The next ``limit`` rows, one turn of each ready host after the other. hosts: (host, ready_at)."""
    if hosts is not None:
        frontier = frontier.join(hosts.where(F.col("ready_at") > now).select("host"), "host", "left_anti")
    if limit <= 0:
        return frontier.limit(0)
    return turns(frontier, per_host).orderBy("turn", "host", "rn").limit(limit)


def next_turns(frontier: DataFrame, limit: int, order=("seq",)) -> DataFrame:
    """The first ``limit`` rows by turns of the hosts, as a filter: only the turn in which the limit falls is cut by a top-k, of at most one row a host."""
    t = turns(frontier, 1, order)
    per_turn = sorted(t.groupBy("turn").count().collect())
    whole, taken = 0, 0
    for turn, n in per_turn:
        if taken + n > limit:
            break
        whole, taken = turn, taken + n
    out = t.where(F.col("turn") <= whole)
    return out.unionByName(t.where(F.col("turn") == whole + 1).orderBy("host", *order).limit(limit - taken)) if taken < limit else out


def next_ready_time(frontier: DataFrame, hosts: DataFrame, now: float) -> DataFrame:
    """next_ready: the least time at which a host with rows that waits is ready; null where none waits."""
    waits = frontier.select("host").distinct().join(hosts, "host").where(F.col("ready_at") > now)
    return waits.agg(F.min("ready_at").alias("next_ready"))


def stats(frontier: DataFrame, hosts: DataFrame, now: float) -> DataFrame:
    """queued, hosts, ready, deferred."""
    f = frontier.join(hosts, "host", "left").select("host", (F.coalesce("ready_at", F.lit(0.0)) <= now).alias("ready"))
    return f.agg(F.count("*").alias("queued"), F.countDistinct("host").alias("hosts"), F.countDistinct(F.when(F.col("ready"), F.col("host"))).alias("ready"), F.countDistinct(F.when(~F.col("ready"), F.col("host"))).alias("deferred"))


def first_seen(found: DataFrame) -> DataFrame:
    """One row a URL: the least depth, then the least parent."""
    return found.groupBy("url").agg(F.min(F.struct("depth", "parent")).alias("m")).select("url", "m.depth", "m.parent")


def unseen(found: DataFrame, seen: DataFrame) -> DataFrame:
    return found.join(seen.select("url"), "url", "left_anti")


def attempts(log: DataFrame, by=("url",)) -> DataFrame:
    """``attempt``: which try of its URL each row of a log (ts, seq) is, from 0."""
    w = Window.partitionBy(*by).orderBy("ts", "seq")
    return log.withColumn("attempt", F.row_number().over(w) - 1)

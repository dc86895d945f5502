"""Crawl reports over a result log: counters, percentiles, recent throughput, host and status groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RECENT = 2000


def _span(log: DataFrame):
    return F.greatest(F.max("ts") - F.min("ts"), F.lit(1e-9))


def summary(log: DataFrame) -> DataFrame:
    """One row over (ts seconds, ok, chars, elapsed): counters, span, pages a second, success rate."""
    n = F.count("*")
    return log.agg(
        n.alias("fetched"),
        F.count_if("ok").alias("succeeded"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("bytes_html"),
        F.round(F.when(n > 0, n / _span(log)).otherwise(0.0), 4).alias("pages_per_second"),
        F.round(F.when(n > 0, F.count_if("ok") / n).otherwise(0.0), 4).alias("success_rate"),
    )


def _map(rows: DataFrame, key: str, name: str, order) -> DataFrame:
    """One row with a map of the groups' counts, in order."""
    pairs = F.array_sort(F.collect_list(F.struct(*order, F.col(key).alias("k"), F.col("n").alias("c"))))
    return rows.agg(F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["k"].alias("key"), x["c"].alias("value")))).alias(name))


def full_summary(log: DataFrame, counters: dict[str, int] | None = None) -> DataFrame:
    """The report's eighteen fields, one row. log: (ts, seq, ok, chars, elapsed, http_status, kind); kind: what failed. counters: what only a traversal knows."""
    known = {k: (counters or {}).get(k, 0) for k in ("retried", "discovered", "enqueued", "duplicates", "out_of_scope", "robots_blocked")}
    n = F.count("*")
    base = log.agg(
        F.round(_span(log), 2).alias("elapsed_s"), n.alias("fetched"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"),
        F.round(F.when(n > 0, n / _span(log)).otherwise(0.0), 2).alias("pages_per_second"), F.round(F.when(n > 0, F.count_if("ok") / n).otherwise(0.0), 4).alias("success_rate"),
        F.round(F.coalesce(F.sum("chars"), F.lit(0)) / 1e6, 2).alias("mb_html"),
    )
    lat = latency_percentiles(log).select(*[F.round(F.col(p), 3).alias(f"latency_{p}_s") for p in ("p50", "p90", "p99")])
    codes = _map(counted(log, "http_status"), "http_status", "status_counts", [F.col("http_status").alias("o")])
    errors = _map(top_errors(log, "kind"), "kind", "errors", [(-F.col("n")).alias("o"), F.col("kind").alias("o2")])
    one = base.select("*", *[F.lit(v).cast("bigint").alias(k) for k, v in known.items()]).withColumn("k", F.lit(1))
    for part in (lat, codes, errors):
        one = one.join(part.withColumn("k", F.lit(1)), "k")  # of one row each
    first = "elapsed_s fetched succeeded failed retried discovered enqueued duplicates out_of_scope robots_blocked pages_per_second success_rate mb_html latency_p50_s latency_p90_s latency_p99_s status_counts errors".split()
    return one.select(*first)


def snapshot(log: DataFrame, frontier: DataFrame, hosts: DataFrame, now: float, counters: dict[str, int] | None = None, max_pages: int = 1000, paused: bool = False) -> DataFrame:
    """The live report: the summary, the frontier's figures, what is open, the budget left, URLs seen, the recent rate, and whether memory makes it wait."""
    from . import frontier as Fr

    open_ = log.where((F.col("ts") <= now) & (F.col("ts") + F.coalesce("elapsed", F.lit(0.0)) > now)).agg(F.count("*").alias("in_flight"))
    one = full_summary(log, counters).withColumn("k", F.lit(1))
    for part in (Fr.stats(frontier, hosts, now), open_, recent_rate(log).select(F.round("recent_pps", 2).alias("recent_pps"))):
        one = one.join(part.withColumn("k", F.lit(1)), "k")
    return one.drop("k").select("*", (F.lit(max_pages) - F.col("fetched")).alias("budget_left"), (F.lit((counters or {}).get("enqueued", 0) + (counters or {}).get("dropped", 0))).cast("bigint").alias("seen"), F.lit(paused).alias("paused_memory"))


def bench_rows(runs: DataFrame) -> DataFrame:
    """Runs (backend, concurrency, pages, elapsed, ok) with pages a second, and which of them is best."""
    rows = runs.withColumn("pps", F.round(F.col("pages") / F.greatest("elapsed", F.lit(1e-9)), 2))
    best = rows.agg(F.max("pps").alias("top")).withColumn("k", F.lit(1))
    return rows.withColumn("k", F.lit(1)).join(best, "k").select(*rows.columns, (F.col("pps") == F.col("top")).alias("best"))


def memory_used_pct(meminfo: str) -> float | None:
    """Percentage of memory in use by the text of a meminfo file, null where it doesn't say."""
    found = dict(line.split(":", 1) for line in meminfo.splitlines() if ":" in line)
    try:
        total = int(found["MemTotal"].split()[0])
        return 100.0 * (1 - int(found["MemAvailable"].split()[0]) / total) if total else None
    except (KeyError, ValueError, IndexError):
        return None


def paused(used: DataFrame, limit: float = 85.0, slack: float = 5.0) -> DataFrame:
    """Rows (probe, ts, pct) with ``paused``: on at the limit, off below the limit less the slack, else as before; what isn't known changes nothing and pauses nothing."""
    w = Window.partitionBy("probe").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    turn = F.when(F.col("pct") >= limit, True).when(F.col("pct") < limit - slack, False)
    state = F.coalesce(F.last(turn, ignorenulls=True).over(w), F.lit(False))
    return used.withColumn("paused", F.col("pct").isNotNull() & state)


def counted(log: DataFrame, key: str) -> DataFrame:
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(key)


def top_errors(log: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k most frequent kinds, ties by name."""
    return log.where(~F.col("ok")).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def recent(log: DataFrame, n: int = RECENT) -> DataFrame:
    """The last n rows by (ts, seq): a distributed top-k, not a sort of everything."""
    return log.orderBy(F.desc("ts"), F.desc("seq")).limit(n)


def latency_percentiles(log: DataFrame, points=(0.5, 0.9, 0.99)) -> DataFrame:
    """Nearest rank min(n - 1, floor(p n)) over the recent positive latencies, 0 where there are none."""
    xs = recent(log.where(F.col("elapsed") > 0)).agg(F.array_sort(F.collect_list("elapsed")).alias("xs"))
    n = F.size("xs")
    at = lambda p: F.when(n == 0, 0.0).otherwise(F.get("xs", F.least(n - 1, F.floor(F.lit(p) * n).cast("int"))))
    return xs.select(*[at(p).alias(f"p{round(100 * p)}") for p in points])


def recent_rate(log: DataFrame) -> DataFrame:
    """Rows a second over the recent window; of less than two rows, the overall rate."""
    span = F.max("ts") - F.min("ts")
    n = F.count("*")
    overall = F.when(n > 0, n / F.greatest(span, F.lit(1e-9))).otherwise(0.0)
    return recent(log).agg(F.round(F.when(n < 2, overall).when(span > 1e-6, n / span).otherwise(0.0), 6).alias("recent_pps"))


def by_host_percentiles(log: DataFrame) -> DataFrame:
    """Nearest-rank percentiles of each host's recent latencies."""
    rn = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("ts"), F.desc("seq")))
    xs = log.where(F.col("elapsed") > 0).withColumn("rn", rn).where(F.col("rn") <= RECENT).groupBy("host").agg(F.array_sort(F.collect_list("elapsed")).alias("xs"))
    n = F.size("xs")
    return xs.select("host", *[F.get("xs", F.least(n - 1, F.floor(F.lit(p) * n).cast("int"))).alias(f"p{round(100 * p)}") for p in (0.5, 0.9, 0.99)])


def streaks(log: DataFrame, reset: int | None = None) -> DataFrame:
    """Runs of clean responses of each host: a failure begins a new island. ``reset``: a run ends as well when it reaches so many, as the limiter's do where its rate may rise."""
    w = Window.partitionBy("host").orderBy("ts", "seq")
    island = F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(w)
    runs = log.withColumn("island", island).groupBy("host", "island").agg(F.count_if("ok").alias("n"))
    best = F.max("n") if reset is None else F.max(F.least("n", F.lit(reset)))
    rises = F.sum(F.floor(F.col("n") / reset)).cast("bigint").alias("raises") if reset else None
    return runs.groupBy("host").agg(best.cast("bigint").alias("best_streak"), *([rises] if reset else []))


def in_flight(log: DataFrame) -> DataFrame:
    """Most requests open at once at each host. log: (host, ts, elapsed)."""
    edges = log.select("host", F.explode(F.array(F.struct(F.col("ts").alias("at"), F.lit(1).alias("d")), F.struct((F.col("ts") + F.col("elapsed")).alias("at"), F.lit(-1).alias("d")))).alias("e")).select("host", "e.*")
    w = Window.partitionBy("host").orderBy("at", "d").rowsBetween(Window.unboundedPreceding, 0)
    return edges.withColumn("open", F.sum("d").over(w)).groupBy("host").agg(F.max("open").alias("most_open"))

"""Admission, pacing and retries of requests in virtual time.

A service (or a host of a crawl) is a fold over its requests in the order of their
arrival: ``capacity`` requests hold a slot at once and others wait at most
``queue_timeout_s`` for one; a host serves ``per_host`` at once and each start takes a
token of the host's bucket, which answers feed; transient failures are tried again after
a backoff that doubles, and hold their slot meanwhile.  Rows are partitioned by the key
and sorted in the shuffle, and a worker carries only what is open: waiting and running requests and the hosts' buckets.

Defined results: a rejected request has no start; an answer later than the timeout is a
timeout, and tells the limiter nothing; equal arrivals go by ordinal; null durations are 0.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import http
from .politeness import Bucket, Limits

SCHEMA = "key string, ordinal bigint, host string, status string, attempts int, admitted_ts double, started_ts double, finished_ts double"


@dataclass(frozen=True)
class Rules:
    capacity: int | None = None
    queue_timeout_s: float = 0.0
    per_host: int = 4
    timeout_s: float | None = None
    max_retries: int = 2
    backoff_s: float = 1.5
    adaptive: bool = True
    limits: Limits = Limits()


@dataclass
class _Request:
    ordinal: int
    host: str
    arrived: float
    elapsed: float
    status: str
    code: float | None
    fails: int
    retry_after: float | None
    crawl_delay: float | None
    attempt: int = 0
    admitted: float | None = None
    started: float | None = None


@dataclass
class _Host:
    bucket: Bucket
    free: int
    queue: deque = field(default_factory=deque)


class Simulation:
    """One key's requests; ``rows`` are those that are settled."""

    def __init__(self, rules: Rules):
        self.rules, self.free = rules, rules.capacity
        self.waiting: deque[_Request] = deque()
        self.hosts: dict[str, _Host] = {}
        self.events: list[tuple] = []
        self.made = 0
        self.rows: list[tuple] = []

    def _at(self, ts: float, what, r: _Request) -> None:
        self.made += 1
        heapq.heappush(self.events, (ts, self.made, what, r))

    def until(self, ts: float) -> None:
        while self.events and self.events[0][0] <= ts:
            at, _, what, r = heapq.heappop(self.events)
            what(r, at)

    def arrive(self, r: _Request) -> None:
        self.until(r.arrived)
        if self.free is None or self.free > 0:
            self._admit(r, r.arrived)
        else:
            self._expire(r.arrived)
            self.waiting.append(r)

    def close(self) -> None:
        self.until(float("inf"))
        self._expire(float("inf"))

    def _expire(self, ts: float) -> None:
        while self.waiting and self.waiting[0].arrived + self.rules.queue_timeout_s < ts:
            r = self.waiting.popleft()
            self.rows.append((r.ordinal, r.host, "rejected", 0, None, None, r.arrived + self.rules.queue_timeout_s))

    def _admit(self, r: _Request, ts: float) -> None:
        if self.free is not None:
            self.free -= 1
        r.admitted = ts
        self._enter(r, ts)

    def _enter(self, r: _Request, ts: float) -> None:
        h = self.hosts.get(r.host)
        if h is None:
            h = self.hosts[r.host] = _Host(Bucket.new(self.rules.limits, ts, r.crawl_delay), self.rules.per_host)
        elif r.crawl_delay:
            h.bucket.on("crawl_delay", ts, r.crawl_delay, self.rules.limits)
        if h.free:
            h.free -= 1
            self._token(r, ts)
        else:
            h.queue.append(r)

    def _token(self, r: _Request, ts: float) -> None:
        """Start, or come again when the bucket says; a host at its limit spends no token."""
        b = self.hosts[r.host].bucket
        if not b.on("acquire", ts, None, self.rules.limits):
            # a step that a double of seconds since 1970 can hold, so that rounding can't stop the clock
            self._at(max(b.ready_at(ts), ts + 1e-6), self._token, r)
            return
        r.started = ts if r.started is None else r.started
        late = self.rules.timeout_s is not None and r.elapsed > self.rules.timeout_s
        self._at(ts + (self.rules.timeout_s if late else r.elapsed), self._end, r)

    def _end(self, r: _Request, ts: float) -> None:
        h, rules = self.hosts[r.host], self.rules
        late = rules.timeout_s is not None and r.elapsed > rules.timeout_s
        status = "timeout" if late or r.attempt < r.fails else r.status
        if not late:
            failed = r.attempt < r.fails
            if not failed and r.code in (429, 503):
                h.bucket.on("throttled", ts, r.retry_after, rules.limits)
            elif status == "ok":
                if rules.adaptive:
                    h.bucket.on("success", ts, None, rules.limits)
            elif status in http.RETRYABLE:
                h.bucket.on("error", ts, None, rules.limits)
        if h.queue:
            self._token(h.queue.popleft(), ts)
        else:
            h.free += 1
        if status in http.RETRYABLE and r.attempt < rules.max_retries:
            self._at(ts + rules.backoff_s * 2.0**r.attempt, self._enter, r)
            r.attempt += 1
            return
        self.rows.append((r.ordinal, r.host, status, r.attempt + 1, r.admitted, r.started, ts))
        if self.free is not None:
            self.free += 1
            self._expire(ts)
            if self.waiting:
                self._admit(self.waiting.popleft(), ts)


def _none(x):
    return None if pd.isna(x) else x


def simulated(requests: DataFrame, rules: Rules, key: str) -> DataFrame:
    """Requests (key, ordinal, host, arrive_ts, elapsed, status, http_status, fail_attempts, retry_after, crawl_delay; but for key, ordinal and host each has a default) with what became of them."""
    have = set(requests.columns)
    col = lambda c, default, kind: (F.coalesce(F.col(c).cast(kind), F.lit(default)) if default is not None else F.col(c).cast(kind)) if c in have else F.lit(default).cast(kind)
    slim = requests.select(
        F.col(key).cast("string").alias("key"), F.col("ordinal").cast("bigint"), F.coalesce("host", F.lit("")).alias("host"), col("arrive_ts", 0.0, "double").alias("arrive_ts"), col("elapsed", 0.0, "double").alias("elapsed"),
        col("status", "ok", "string").alias("status"), col("http_status", None, "double").alias("code"), col("fail_attempts", 0, "int").alias("fails"), col("retry_after", None, "double").alias("retry_after"), col("crawl_delay", None, "double").alias("crawl_delay"),
    )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sim, own = None, None
        columns = [c.split()[0] for c in SCHEMA.split(", ")]

        def taken() -> pd.DataFrame:
            rows, sim.rows = sim.rows, []
            return pd.DataFrame([(own, *r) for r in rows], columns=columns).astype({"ordinal": "int64", "attempts": "int32", "admitted_ts": "float64", "started_ts": "float64", "finished_ts": "float64"})

        for p in parts:
            for r in p.itertuples(index=False):
                if sim is None or r.key != own:
                    if sim is not None:
                        sim.close()
                        yield taken()
                    sim, own = Simulation(rules), r.key
                sim.arrive(_Request(r.ordinal, r.host, r.arrive_ts, r.elapsed, r.status, _none(r.code), r.fails, _none(r.retry_after), _none(r.crawl_delay)))
            if sim is not None and sim.rows:
                yield taken()
        if sim is not None:
            sim.close()
            yield taken()

    return slim.repartition("key").sortWithinPartitions("key", "arrive_ts", "ordinal").mapInPandas(run, SCHEMA)

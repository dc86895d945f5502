"""Per-host token buckets with additive increase and multiplicative decrease, in event time.

``replay`` folds the events of each host in order.  Rows are partitioned by host and
sorted in the shuffle, and a bucket's state is carried from one Arrow batch to the next,
so a hot host never has to fit in memory.  The streaming twin carries the same state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "host string, seq bigint, ts double, signal string, granted boolean, rate double, tokens double, blocked_until double, ready_at double"


@dataclass(frozen=True)
class Limits:
    base: float = 4.0
    burst: float = 8.0
    low: float = 0.2
    high: float = 32.0
    step: float = 0.5
    factor: float = 0.5
    streak: int = 10


@dataclass
class Bucket:
    rate: float
    top: float
    tokens: float
    burst: float
    updated: float
    blocked_until: float = 0.0
    streak: int = 0
    throttled: int = 0

    @classmethod
    def new(cls, limits: Limits, ts: float, crawl_delay: float | None = None) -> Bucket:
        cap = 1.0 / crawl_delay if crawl_delay else limits.high
        rate = min(limits.base, cap)
        room = max(1.0, min(limits.burst, 2 * rate))
        return cls(rate, min(limits.high, cap), room, room, ts)

    def _resize(self, limits: Limits) -> None:
        self.burst = max(1.0, min(limits.burst, 2 * self.rate))

    def filled(self, ts: float) -> float:
        """Tokens at a later time."""
        return min(self.burst, self.tokens + max(0.0, ts - self.updated) * self.rate)

    def ready_at(self, ts: float) -> float:
        """When there is a token next; changes nothing."""
        if ts < self.blocked_until:
            return self.blocked_until
        tokens = self.filled(ts)
        return ts if tokens >= 1 else ts + (1 - tokens) / self.rate

    def on(self, signal: str, ts: float, arg: float | None, limits: Limits) -> bool | None:
        """Apply an event; for an acquire, whether it was granted."""
        if signal == "acquire":
            if ts < self.blocked_until:
                return False
            self.tokens, self.updated = self.filled(ts), max(ts, self.updated)
            if self.tokens < 1:
                return False
            self.tokens -= 1
            return True
        if signal == "success":
            self.streak += 1
            if self.streak >= limits.streak and self.rate < self.top:
                self.rate, self.streak = min(self.top, self.rate + limits.step), 0
                self._resize(limits)
        elif signal == "throttled":
            self.streak, self.throttled, self.tokens = 0, self.throttled + 1, 0.0
            self.rate = max(min(limits.low, self.top), self.rate * limits.factor)
            self._resize(limits)
            pause = arg if arg is not None else min(60.0, 2.0 ** min(self.throttled, 6))
            self.blocked_until = max(self.blocked_until, ts + pause)
        elif signal == "error":
            self.rate, self.streak = max(min(limits.low, self.top), 0.9 * self.rate), 0
        elif signal == "crawl_delay" and arg:
            self.top = min(self.top, 1 / arg)
            self.rate = min(self.rate, self.top)
            self.burst = max(1.0, min(self.burst, 2 / arg))
        return None


def fold(rows: pd.DataFrame, state: dict[str, Bucket], limits: Limits) -> pd.DataFrame:
    """Rows in order; ``state`` is carried on."""
    host, seq, ts, signal, arg = (rows[c].tolist() for c in ("host", "seq", "ts", "signal", "arg"))
    out = []
    for h, t, s, x in zip(host, ts, signal, arg, strict=True):
        b = state.get(h)
        if b is None:
            state.clear()
            b = state[h] = Bucket.new(limits, t)
        # a missing argument is NaN, or None where the column has no number
        got = b.on(s, t, None if x is None or x != x else x, limits)
        out.append((got, b.rate, b.tokens, b.blocked_until, b.ready_at(t)))
    granted, *floats = zip(*out, strict=True) if out else ((),) * 5
    named = zip(("rate", "tokens", "blocked_until", "ready_at"), floats, strict=True)
    return pd.DataFrame({"host": host, "seq": seq, "ts": ts, "signal": signal, "granted": np.array(granted, object)} | {k: np.array(v, float) for k, v in named})


def replay(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Events (host, seq, ts, signal, arg) with the bucket's state after each."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[str, Bucket] = {}
        for p in parts:
            yield fold(p, state, limits)

    return events.select("host", "seq", "ts", "signal", "arg").repartition("host").sortWithinPartitions("host", "ts", "seq").mapInPandas(run, SCHEMA)


def packed(b: Bucket) -> tuple:
    return tuple(asdict(b).values())

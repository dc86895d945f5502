"""A live HTTP source: a host's requests in one task, paced by its bucket, a few at once."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators.politeness import Bucket, Limits
from ..plans.config import Politeness
from .contract import Capabilities, FetchSource, register

#: Larger bodies are cut where ``max_bytes`` says so; by default none is.
_FIELDS = "final_url string, html string, http_status int, status string, error string, elapsed double, attempt int, backend string, fetched_at double, retry_after double, headers map<string,string>"


def get(url: str, agent: str, timeout_s: float, max_bytes: int | None = None) -> dict:
    """One request; an answer of any status is a result, a failure to get one an error."""
    began = time.monotonic()
    out = {"final_url": url, "html": "", "http_status": None, "status": "network_error", "error": None, "headers": {}}
    try:
        try:
            answer = urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout_s)
        except urllib.error.HTTPError as e:
            answer = e
        with answer:
            body = answer.read(max_bytes) if max_bytes else answer.read()
            code = answer.status if hasattr(answer, "status") else answer.code
            charset = answer.headers.get_content_charset() or "utf-8"
            try:
                page = body.decode(charset, "replace")
            except LookupError:
                page = body.decode("utf-8", "replace")
            out |= {"final_url": answer.geturl() or url, "html": page, "http_status": code, "headers": {k.lower(): v for k, v in answer.headers.items()}}
            out |= {"status": "ok"} if code < 400 else {"status": "http_error", "error": f"HTTP {code}"}
    except TimeoutError as e:
        out |= {"status": "timeout", "error": f"{type(e).__name__}: {e}"}
    except Exception as e:  # a source has one result for each request, whatever a server does
        slow = "timed out" in str(e)
        out |= {"status": "timeout" if slow else "network_error", "error": f"{type(e).__name__}: {e}"}
    return out | {"elapsed": time.monotonic() - began, "fetched_at": time.time()}


def _after(headers: dict) -> float | None:
    try:
        return max(0.0, float(headers.get("retry-after", "")))
    except ValueError:
        return None


@register("http", "builtin")
class HttpSource(FetchSource):
    """Plain HTTP without a browser."""

    name = "http"
    capabilities = Capabilities(proxy=True)

    def __init__(self, politeness: Politeness = Politeness(), timeout_s: float = 30.0, max_retries: int = 2, backoff_s: float = 1.5, max_bytes: int | None = None):
        self.politeness, self.timeout_s, self.max_retries, self.backoff_s, self.max_bytes = politeness, timeout_s, max_retries, backoff_s, max_bytes

    def fetch(self, requests: DataFrame) -> DataFrame:
        """Requests are dealt by host, so that one task alone keeps its pace; transient failures are tried again there."""
        p, timeout_s, retries, backoff_s, max_bytes = self.politeness, self.timeout_s, self.max_retries, self.backoff_s, self.max_bytes
        limits = Limits(p.per_host_rps, p.burst, p.min_rps, p.max_rps)
        names = requests.columns
        fields = [f for f in _FIELDS.split(", ") if f.split()[0] not in names]
        schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema], *fields])
        delays = "crawl_delay" in names

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            host, bucket = None, None

            def one(url: str) -> dict:
                for attempt in range(retries + 1):
                    r = get(url, p.user_agent_token, timeout_s, max_bytes) | {"attempt": attempt, "backend": "http"}
                    r["retry_after"] = _after(r["headers"])
                    if r["status"] not in ("timeout", "network_error") or attempt == retries:
                        break
                    time.sleep(backoff_s * 2**attempt)
                return r

            with ThreadPoolExecutor(p.per_host_concurrency) as pool:
                for part in parts:
                    found = [None] * len(part)
                    for own, rows in part.reset_index(drop=True).groupby("__host", sort=False):
                        if own != host:
                            delay = rows["crawl_delay"].dropna().max() if delays else None
                            host, bucket = own, Bucket.new(limits, time.monotonic(), None if pd.isna(delay) else delay)
                        open_ = []

                        def settle(k, job, bucket=bucket, found=found):
                            r = found[k] = job.result()
                            now = time.monotonic()
                            if r["http_status"] in (429, 503):
                                bucket.on("throttled", now, r["retry_after"], limits)
                            elif r["status"] == "ok":
                                if p.adaptive:
                                    bucket.on("success", now, None, limits)
                            elif r["status"] != "http_error":
                                bucket.on("error", now, None, limits)

                        for k, url in zip(rows.index, rows["url"], strict=True):
                            if len(open_) >= p.per_host_concurrency:
                                settle(*open_.pop(0))
                            while not bucket.on("acquire", time.monotonic(), None, limits):
                                time.sleep(min(1.0, max(0.005, bucket.ready_at(time.monotonic()) - time.monotonic())))
                            open_.append((k, pool.submit(one, url)))
                        for x in open_:
                            settle(*x)
                    out = part.drop(columns="__host").reset_index(drop=True)
                    for f in fields:
                        c = f.split()[0]
                        out[c] = [r[c] for r in found]
                    yield out

        dealt = requests.withColumn("__host", urls.host_of("url")).repartition("__host").sortWithinPartitions("__host", "url")
        return dealt.mapInPandas(run, schema)


def robots_bodies(origins: DataFrame, source: FetchSource, max_chars: int = 512 * 1024) -> DataFrame:
    """(origin, http_status, body, fetched_at) of each origin's robots.txt, of which the beginning is read."""
    asked = origins.select("origin", F.concat("origin", F.lit("/robots.txt")).alias("url"))
    return source.fetch(asked).select("origin", "http_status", F.substring("html", 1, max_chars).alias("body"), "fetched_at")

"""Outcomes of a fetch: status classes, error kinds, Retry-After, backoff, header maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATUSES = ("ok", "http_error", "timeout", "blocked_robots", "network_error", "backend_error", "skipped")
RETRYABLE = ("timeout", "network_error", "backend_error")
#: Words in the message of a failure, (timeouts, network errors), by how the source fetches.
MARKERS = {
    # without a browser
    "plain": ("timeout|timed out|useragent|took longer", "dns|connection|ssl|net::err|unreachable|closed"),
    # a browser that is asked one page at a time
    "browser": ("timeout|timed out", "net::err|connection|dns|ssl|econnrefused|unreachable"),
    # a browser that is given batches
    "batch": ("timeout|timed out", "net::err|connection|dns|ssl|econnrefused|unreachable|socket"),
}


def is_success(status: Column) -> Column:
    return status == "ok"


def is_retryable(status: Column) -> Column:
    return status.isin(*RETRYABLE)


def classify_error(message: Column, source: str = "browser") -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    slow, net = MARKERS[source]
    return F.when(m.rlike(slow), "timeout").when(m.rlike(net), "network_error").otherwise("backend_error")


def http_status(code: Column) -> Column:
    return F.when(code.isNull() | (code < 400), "ok").otherwise("http_error")


def http_error(code: Column) -> Column:
    return F.when(code >= 400, F.concat(F.lit("HTTP "), code.cast("string")))


def outcome(success: Column, code: Column, html: Column, message: Column, source: str = "browser") -> Column:
    """Status of a raw result; a page that came with an error message still counts as ok."""
    return F.when(success, "ok").when(code >= 400, "http_error").when(code.isNotNull() & (F.coalesce(F.length(html), F.lit(0)) > 0), "ok").otherwise(classify_error(message, source))


def lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that fall together the first value wins."""
    entries = F.map_entries(headers)
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), F.filter(entries, lambda e: F.lower(e["key"]) == n)[0]["value"].alias("value"))))


def seconds(value: Column) -> Column:
    """Delta seconds, not below 0; dates and junk give null."""
    number = F.trim(value).try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number), F.greatest(F.lit(0.0), number))


def retry_after(headers: Column, spellings: tuple[str, ...] = ("retry-after", "Retry-After")) -> Column:
    """Seconds of the header map's first non-empty entry of these spellings; the service knows only the lower-case one."""
    given = F.coalesce(*[F.nullif(F.try_element_at(headers, F.lit(k)), F.lit("")) for k in spellings])
    return seconds(given)


def all_links(groups: Column) -> Column:
    """Links that a source found itself, by group (internal, external): one list."""
    return F.flatten(F.map_values(groups))


def markdown(fit: Column, raw: Column, plain: Column) -> Column:
    """The text that a source made itself: cleaned, raw, or as it is; the first that isn't empty."""
    return F.coalesce(F.nullif(fit, F.lit("")), F.nullif(raw, F.lit("")), plain)


def decoded(body: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes a replacement sign."""
    return F.make_valid_utf8(body.cast("string"))


def backoff(attempt: Column, base: float = 1.5) -> Column:
    return F.lit(base) * F.pow(F.lit(2.0), attempt)


def signal(status: Column, code: Column, adaptive: bool = True) -> Column:
    """What a result tells its host's limiter: throttled, success, error or nothing."""
    return F.when(code.isin(429, 503), "throttled").when((status == "ok") & F.lit(adaptive), "success").when(is_retryable(status), "error")


def is_prefetch(headers: Column) -> Column:
    return F.coalesce(F.exists(F.map_entries(headers), lambda e: F.lower(e["key"]).isin("purpose", "sec-purpose") & F.lower(e["value"]).contains("prefetch")), F.lit(False))

"""Scope rules compiled into one boolean expression, cheap tests first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import urls as U
from ..plans.config import CrawlConfig


def in_domains(host: Column, domains) -> Column:
    """The host is one of the domains or below one."""
    out = F.lit(False)
    for d in (x.lower().lstrip(".") for x in domains):
        out = out | (host == d) | host.endswith("." + d)
    return out


def _plain(url: str) -> tuple[str, str]:
    """Host and registrable domain of a seed, on the driver."""
    from urllib.parse import urlsplit

    host = (urlsplit(url).hostname or "").lower()
    p = host.split(".")
    if not host or host.replace(".", "").isdigit() or len(p) <= 2:
        return host, host
    deep = p[-2] in ("co", "com", "org", "net", "gov", "edu", "ac") and len(p[-1]) <= 3
    return host, ".".join(p[-3:] if deep else p[-2:])


def path_prefix(seed: str, strict: bool = False) -> str:
    """The seed up to its last slash, which isn't one of the scheme's; a bare host stands for itself."""
    bare = "/" not in seed.split("://", 1)[-1]
    prefix = seed if bare else seed[: seed.rfind("/")]
    return prefix + "/" if strict else prefix


def reason(config: CrawlConfig, url="url", depth="depth") -> Column:
    """The first rule that turns a URL away, null where it is in scope."""
    u, d = F.col(url), F.col(depth)
    host = U.host_of(u)
    seeds = [_plain(s) for s in config.seeds]
    any_of = lambda ps: "|".join(f"(?:{p})" for p in ps)
    allowed = u.rlike(any_of(config.allow_patterns)) if config.allow_patterns else F.lit(True)
    out = F.when(d > config.max_depth, "depth")
    if config.skip_binary:
        out = out.when(U.has_binary_extension(u), "binary")
    out = out.when(host == "", "host")
    if config.deny_domains:
        out = out.when(in_domains(host, config.deny_domains), "deny_domain")
    if config.deny_patterns:
        out = out.when(u.rlike(any_of(config.deny_patterns)), "deny_pattern")
    named = in_domains(host, config.allow_domains) if config.allow_domains else F.lit(False)
    if config.scope == "site":
        mode = U.registrable_domain(host).isin(*{s for _, s in seeds})
    elif config.scope == "host":
        mode = host.isin(*{h for h, _ in seeds})
    elif config.scope == "path":
        mode = F.lit(False)
        for s in config.seeds:
            mode = mode | u.startswith(path_prefix(s, config.strict_path))
    else:
        mode = F.lit(True)
    # an allowed domain is in scope whatever the mode says
    return out.when(~named & ~mode, "mode").when(~allowed, "allow_pattern")


def allows(config: CrawlConfig, url="url", depth="depth") -> Column:
    return reason(config, url, depth).isNull()

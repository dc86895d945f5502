"""Parameters of a crawl: frozen, validated, loadable from a mapping, a file or the environment."""

from __future__ import annotations

import dataclasses
import json
import os
import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Politeness:
    respect_robots: bool = True
    robots_ttl_s: float = 3600.0
    per_host_rps: float = 4.0
    burst: float = 8.0
    min_rps: float = 0.2
    max_rps: float = 32.0
    per_host_concurrency: int = 4
    adaptive: bool = True
    user_agent_token: str = "weftline"

    def __post_init__(self):
        if self.min_rps > self.max_rps:
            raise ValueError("min_rps exceeds max_rps")


@dataclass(frozen=True)
class Browser:
    """What a connector that drives a browser is told; plain sources read ``page_timeout_ms`` alone."""

    headless: bool = True
    browser_type: str = "chromium"
    wait_until: str = "load"
    page_timeout_ms: int = 30_000
    settle_ms: int = 0
    wait_for_selector: str | None = None
    block_resources: bool = False
    blocked_resource_types: tuple[str, ...] = ("image", "media", "font", "stylesheet")
    block_prefetch: bool = True
    blocked_hosts: tuple[str, ...] = ()
    trace_resources: bool = False
    ignore_https_errors: bool = False
    stealth: bool = False

    def __post_init__(self):
        if self.wait_until not in ("domcontentloaded", "load", "networkidle", "commit"):
            raise ValueError(f"unknown wait_until {self.wait_until}")

    def options(self) -> dict:
        """What a connector is given, with the launch flags that stand for blocked resources."""
        return dataclasses.asdict(self) | {"flags": self.flags()}

    def flags(self) -> list[str]:
        """Chromium's flags for images and fonts; other types have none, other browsers neither."""
        known = {"image": "--blink-settings=imagesEnabled=false", "font": "--disable-remote-fonts"}
        use = self.block_resources and self.browser_type == "chromium"
        return [flag for kind, flag in known.items() if use and kind in self.blocked_resource_types]


@dataclass(frozen=True)
class Output:
    path: str | None = None
    format: str = "jsonl"
    text_source: str = "engine"
    include_html: bool = False
    include_text: bool = True
    include_links: bool = True
    max_text_chars: int = 120_000

    def __post_init__(self):
        if self.format not in ("jsonl", "jsonl.gz", "none"):
            raise ValueError(f"unknown output format {self.format}")
        if self.text_source not in ("engine", "backend"):
            raise ValueError(f"unknown text source {self.text_source}")


def split_seeds(seeds: str | list[str]) -> tuple[str, ...]:
    """Seeds from a list or a string with commas or line ends; a bare host gets https."""
    parts = re.split(r"[,\n]", seeds) if isinstance(seeds, str) else seeds
    found = [p.strip() for p in parts if p and p.strip()]
    return tuple(p if "://" in p else f"https://{p}" for p in found)


@dataclass(frozen=True)
class CrawlConfig:
    seeds: tuple[str, ...] = ()
    backend: str = "corpus"
    backend_options: dict = field(default_factory=dict)
    concurrency: int = 32
    max_pages: int = 1000
    max_depth: int = 2
    max_retries: int = 2
    retry_backoff_s: float = 1.5
    time_budget_s: float = 0.0
    max_frontier: int = 500_000
    max_frontier_per_host: int = 50_000
    scope: str = "site"
    allow_patterns: tuple[str, ...] = ()
    deny_patterns: tuple[str, ...] = ()
    allow_domains: tuple[str, ...] = ()
    deny_domains: tuple[str, ...] = ()
    strict_path: bool = False
    follow_links: bool = True
    strip_query: bool = False
    skip_binary: bool = True
    dedup: str = "exact"
    dedup_capacity: int = 10_000_000
    dedup_error_rate: float = 0.001
    politeness: Politeness = field(default_factory=Politeness)
    output: Output = field(default_factory=Output)
    browser: Browser = field(default_factory=Browser)

    def __post_init__(self):
        if self.dedup not in ("exact", "bloom"):
            raise ValueError(f"unknown dedup {self.dedup}")
        if self.dedup_capacity < 1000 or not 0 < self.dedup_error_rate < 1:
            raise ValueError("dedup_capacity is at least 1000, and dedup_error_rate between 0 and 1")
        if self.scope not in ("site", "host", "path", "any"):
            raise ValueError(f"unknown scope {self.scope}")
        object.__setattr__(self, "seeds", split_seeds(list(self.seeds) if not isinstance(self.seeds, str) else self.seeds))
        capped = min(self.politeness.per_host_concurrency, self.concurrency)
        object.__setattr__(self, "politeness", dataclasses.replace(self.politeness, per_host_concurrency=capped))

    @classmethod
    def of(cls, values: dict) -> CrawlConfig:
        """From a mapping; unknown keys are an error, nested mappings become nested settings."""
        known = {f.name: f for f in dataclasses.fields(cls)}
        if extra := set(values) - set(known):
            raise ValueError(f"unknown settings: {', '.join(sorted(extra))}")
        nested = {"politeness": Politeness, "output": Output, "browser": Browser}
        flat = lambda v: tuple(v) if isinstance(v, list) else v
        made = {}
        for k, v in values.items():
            if k in nested and isinstance(v, dict):
                if extra := set(v) - {f.name for f in dataclasses.fields(nested[k])}:
                    raise ValueError(f"unknown settings of {k}: {', '.join(sorted(extra))}")
                v = nested[k](**{n: flat(x) for n, x in v.items()})
            made[k] = flat(v)
        return cls(**made)

    def to_dict(self) -> dict:
        """Plain values: what ``of`` reads."""
        plain = lambda v: {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else list(v) if isinstance(v, tuple) else v
        return plain(dataclasses.asdict(self))

    def to_yaml(self) -> str:
        """All settings with their values; JSON, which YAML includes, where no YAML library is."""
        try:
            import yaml
        except ImportError:
            return json.dumps(self.to_dict(), indent=2) + "\n"
        return yaml.safe_dump(self.to_dict(), sort_keys=False)

    @classmethod
    def from_file(cls, path: str, **overrides) -> CrawlConfig:
        with open(path) as f:
            body = f.read()
        try:
            values = json.loads(body)
        except ValueError:
            if path.endswith(".json"):
                raise
            import yaml

            values = yaml.safe_load(body)
        if not isinstance(values, dict):
            raise ValueError("settings must be a mapping")
        return cls.of({**values, **overrides})

    @classmethod
    def from_env(cls, prefix: str = "WEFTLINE_", environ=None) -> CrawlConfig:
        """Names after the prefix, nested ones with two underscores; values are JSON where they parse."""
        values: dict = {}
        for name, raw in (environ if environ is not None else os.environ).items():
            if name.startswith(prefix):
                try:
                    value = json.loads(raw)
                except ValueError:
                    value = raw
                at, keys = values, name[len(prefix) :].lower().split("__")
                for k in keys[:-1]:
                    at = at.setdefault(k, {})
                at[keys[-1]] = value
        return cls.of(values)

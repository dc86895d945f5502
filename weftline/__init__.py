"""A web-crawl analytics engine on PySpark DataFrames."""

from .functions.http import RETRYABLE, STATUSES
from .operators.crawl import Crawl, crawl
from .operators.dedup import Bloom, new_urls
from .operators.routing import content_check, route
from .operators.service import FetchService, ServiceBusy
from .plans.config import Browser, CrawlConfig, Output, Politeness
from .sources.contract import Capabilities, FetchSource, get_source, list_sources, register
from .sources.corpus import CorpusSource
from .sources.live import HttpSource
from .sources.sinks import JsonlSink, MemorySink, NullSink, Sink, make_sink

__version__ = "0.2.0"

__all__ = [
    "RETRYABLE", "STATUSES", "Bloom", "Browser", "Capabilities", "CorpusSource", "Crawl", "CrawlConfig", "FetchService", "FetchSource", "HttpSource", "JsonlSink",
    "MemorySink", "NullSink", "Output", "Politeness", "ServiceBusy", "Sink", "content_check", "crawl", "get_source", "list_sources", "make_sink", "new_urls", "register", "route",
]

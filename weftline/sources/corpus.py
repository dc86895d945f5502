"""A corpus table in the fetcher's place, with faults; seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import http, urls
from .contract import Capabilities, FetchSource, get_source, list_sources, register

__all__ = ["CorpusSource", "get_source", "list_sources", "register", "seeds"]


@register("corpus", "builtin")
class CorpusSource(FetchSource):
    """Pages of a table (url, html; optional: final_url, http_status, status, error, fail_attempts, elapsed, fetched_at, retry_after).

    A URL that the table lacks is a 404.  A URL that it has several times stands for one
    page, that with the least HTML; whether there are any is looked up once
    (a scan of the URLs alone) unless ``unique`` says.
    """

    name = "corpus"
    capabilities = Capabilities()

    def __init__(self, corpus: DataFrame, max_retries: int = 2, backoff_s: float = 1.5, unique: bool = False, name: str = "corpus"):
        have = set(corpus.columns)
        col = lambda c, default, kind: F.col(c).cast(kind) if c in have else F.lit(default).cast(kind)
        if not unique and not corpus.groupBy("url").count().where("count > 1").isEmpty():
            fields = F.struct("html", *[c for c in corpus.columns if c not in ("url", "html")])
            corpus = corpus.groupBy("url").agg(F.min(fields).alias("p")).select("url", "p.*")
        code = col("http_status", 200, "int")
        status = F.coalesce(col("status", None, "string"), http.http_status(code))
        self.pages = corpus.select(
            F.col("url"),
            F.col("html").alias("c_html"),
            code.alias("c_code"),
            status.alias("c_status"),
            F.coalesce(col("error", None, "string"), http.http_error(code)).alias("c_error"),
            F.coalesce(col("final_url", None, "string"), F.col("url")).alias("c_final"),
            F.coalesce(col("fail_attempts", 0, "int"), F.lit(0)).alias("c_fails"),
            F.coalesce(col("elapsed", 0.0, "double"), F.lit(0.0)).alias("c_elapsed"),
            col("fetched_at", None, "double").alias("c_at"),
            col("retry_after", None, "double").alias("c_after"),
            F.lit(True).alias("there"),
        )
        self.max_retries, self.backoff_s, self.name = max_retries, backoff_s, name

    def fetch(self, requests: DataFrame) -> DataFrame:
        """``requests`` with the columns of a result, and waited_s, the backoffs. Transient failures are tried again."""
        r = requests.join(self.pages, "url", "left")
        there = F.col("there").isNotNull()
        failed = F.col("c_fails") > self.max_retries
        answered = there & ~failed
        attempt = F.when(there, F.least("c_fails", F.lit(self.max_retries))).otherwise(0)
        out = {
            "final_url": F.when(answered, F.col("c_final")).otherwise(F.col("url")),
            "html": F.when(answered, F.col("c_html")).otherwise(""),
            "http_status": F.when(~there, 404).when(answered, F.col("c_code")),
            "status": F.when(~there, "http_error").when(failed, "timeout").otherwise(F.col("c_status")),
            "error": F.when(~there, "HTTP 404").when(failed, "no answer").otherwise(F.col("c_error")),
            "elapsed": F.coalesce("c_elapsed", F.lit(0.0)),
            "attempt": attempt,
            "backend": F.lit(self.name),
            "fetched_at": F.coalesce(F.col("c_at"), F.unix_micros(F.current_timestamp()) / 1e6),
            "retry_after": F.when(answered, F.col("c_after")),
            # the waits form a geometric series
            "waited_s": F.lit(self.backoff_s) * (F.pow(F.lit(2.0), attempt) - 1),
        }
        return r.select(*requests.columns, *[c.alias(k) for k, c in out.items() if k not in requests.columns])


def seeds(spark: SparkSession, raw: tuple[str, ...], more: DataFrame | None = None) -> DataFrame:
    """Normalised distinct seeds at depth 0, also of a table (raw); none usable is an error. Seeds aren't held to the scope."""
    rows = spark.createDataFrame([(s,) for s in raw], "raw string")
    rows = (rows if more is None else rows.unionByName(more)).select(urls.normalize("raw").alias("url")).where("url <> ''").distinct()
    if rows.isEmpty():
        raise ValueError("no usable seed")
    return rows.select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"))

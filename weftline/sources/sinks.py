"""Sinks for result tables: JSON lines (plain or gzip), none, memory, and the base of others."""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns of an output row, in order; html follows where it is asked for.
ROW = ("url", "final_url", "depth", "parent", "http_status", "status", "title", "text", "links", "n_links", "error", "elapsed_s", "backend", "fetched_at")


class Sink:
    """Takes tables of pages: ``write`` one or more between ``open`` and ``close``; of a stream, each micro-batch (``foreachBatch(sink.batch)``)."""

    def open(self) -> None:
        pass

    def write(self, pages: DataFrame) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass

    def batch(self, pages: DataFrame, batch_id: int) -> None:
        self.write(pages)

    def __enter__(self) -> Sink:
        self.open()
        return self

    def __exit__(self, *_) -> None:
        self.close()


class NullSink(Sink):
    """Computes the rows and drops them."""

    def write(self, pages: DataFrame) -> None:
        pages.write.format("noop").mode("overwrite").save()


class MemorySink(Sink):
    """Rows as dictionaries on the driver, for tests and small results."""

    def __init__(self):
        self.pages: list[dict] = []

    def write(self, pages: DataFrame) -> None:
        self.pages += rows(pages)


class JsonlSink(Sink):
    """A folder of JSON lines, replaced by the first table and added to by others; without a path, lines on the console."""

    def __init__(self, path: str | None = None, include_html: bool = False, gzip: bool = False):
        self.path, self.include_html, self.zipped, self.mode = path, include_html, gzip or bool(path and path.endswith(".gz")), "overwrite"

    def open(self) -> None:
        self.mode = "overwrite"

    def write(self, pages: DataFrame) -> None:
        out = pages if self.include_html or "html" not in pages.columns else pages.drop("html")
        if self.path is None:
            for line in out.toJSON().toLocalIterator():
                sys.stdout.write(line + "\n")
            return
        out.write.mode(self.mode).option("ignoreNullFields", "false").option("compression", "gzip" if self.zipped else "none").json(self.path)
        self.mode = "append"

    def batch(self, pages: DataFrame, batch_id: int) -> None:
        """A folder for each micro-batch, so that one that is run again replaces itself."""
        own = JsonlSink(f"{self.path}/batch={batch_id}", self.include_html, self.zipped)
        own.write(pages)


def make_sink(path: str | None, format: str = "jsonl", include_html: bool = False) -> Sink:
    if format == "none":
        return NullSink()
    if format not in ("jsonl", "jsonl.gz"):
        raise ValueError(f"unknown output {format} to {path}")
    return JsonlSink(path, include_html, format == "jsonl.gz")


def write(df: DataFrame, path: str | None, format: str = "jsonl", include_html: bool = False) -> None:
    """Nulls are written, html only where asked for; a path that ends in .gz is compressed."""
    with make_sink(path, format, include_html) as sink:
        sink.write(df)


def rows(df: DataFrame) -> list[dict]:
    """The memory sink's rows."""
    return [r.asDict(recursive=True) for r in df.collect()]


def page_row(df: DataFrame, include_html: bool = False, include_links: bool = True) -> DataFrame:
    """The output projection: the row's columns in order, elapsed rounded to four places as elapsed_s."""
    out = df.withColumn("elapsed_s", F.round("elapsed", 4))
    if not include_links and "links" in df.columns:
        out = out.withColumn("links", F.array().cast("array<string>"))
    known = [c for c in ROW if c in out.columns]
    extra = [c for c in df.columns if c not in (*ROW, "elapsed", "html")] if not set(ROW) <= set(out.columns) else []
    return out.select(*extra, *known, *(["html"] if include_html and "html" in df.columns else []))


def write_stats(summary: DataFrame, path: str) -> None:
    """The one row of a summary as a JSON file on the driver."""
    import pathlib

    pathlib.Path(path).parent.mkdir(parents=True, exist_ok=True)
    pathlib.Path(path).write_text(json.dumps(summary.first().asDict(recursive=True), indent=2, default=str))

"""Sets of seen URLs: exact by anti join, or a Bloom filter in shards before the exact test."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored


def bloom_size(capacity: int, error_rate: float) -> tuple[int, int]:
    """Bits and hash functions, at most eight of the latter."""
    if capacity < 1 or not 0 < error_rate < 1:
        raise ValueError("capacity must be positive and error_rate between 0 and 1")
    bits = max(8, int(-capacity * math.log(error_rate) / math.log(2) ** 2))
    return bits, min(8, max(1, round(bits / capacity * math.log(2))))


def bloom_places(urls: list[str], bits: int, k: int) -> np.ndarray:
    digest = b"".join(hashlib.blake2b(u.encode(), digest_size=8 * k).digest() for u in urls)
    return (np.frombuffer(digest, "<u8") % np.uint64(bits)).astype(np.int64).reshape(len(urls), k)


#: URLs for which one shard of a filter is made.
SHARD = 1_000_000


class Bloom:
    """A filter in shards by the hash of a URL: a row (shard, bits, inserts) each, built and probed by the task that has the shard's URLs. Nothing comes to the driver, nothing is broadcast."""

    def __init__(self, capacity: int = 10_000_000, error_rate: float = 0.001, shard: int = SHARD):
        self.capacity = capacity
        self.shards = -(-capacity // shard)
        self.bits, self.k = bloom_size(-(-capacity // self.shards), error_rate)
        self.maps: DataFrame | None = None

    def _dealt(self, urls: DataFrame, column: str) -> DataFrame:
        return urls.withColumn("__shard", F.pmod(F.xxhash64(column), F.lit(self.shards)).cast("int"))

    def add(self, urls: DataFrame, column: str = "url") -> Bloom:
        """URLs are inserted in their order, into the maps that are there, so that the count of inserts that set a bit is the same every time."""
        bits, k = self.bits, self.k

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, shard, inserts = None, None, 0
            for p in parts:
                for s, rows in p.groupby("__shard", sort=False):
                    if s != shard:
                        if own is not None:
                            yield pd.DataFrame({"shard": [shard], "bits": [own.tobytes()], "inserts": [inserts]})
                        own, shard, inserts = np.zeros(-(-bits // 8), np.uint8), s, 0
                    for m, n in zip(rows["__bits"], rows["__n"], strict=True):
                        if m is None:
                            break
                        own, inserts = np.frombuffer(m, np.uint8).copy(), int(n)
                    new = rows["url"].dropna().tolist()
                    for at in bloom_places(new, bits, k) if new else ():
                        byte, bit = at >> 3, (1 << (at & 7)).astype(np.uint8)
                        if not (own[byte] & bit).all():
                            inserts += 1
                            np.bitwise_or.at(own, byte, bit)
            if own is not None:
                yield pd.DataFrame({"shard": [shard], "bits": [own.tobytes()], "inserts": [inserts]})

        dealt = self._dealt(urls.select(F.col(column).alias("url")).where("url is not null"), "url").select("url", "__shard", F.lit(None).cast("binary").alias("__bits"), F.lit(0).cast("bigint").alias("__n"))
        if self.maps is not None:
            dealt = dealt.unionByName(self.maps.select(F.lit(None).cast("string").alias("url"), F.col("shard").alias("__shard"), F.col("bits").alias("__bits"), F.col("inserts").alias("__n")))
        maps = dealt.repartition("__shard").sortWithinPartitions("__shard", F.col("__bits").isNull(), "url").mapInPandas(run, "shard int, bits binary, inserts bigint")
        self.maps = stored(maps, "bloom")
        return self

    def flagged(self, urls: DataFrame, column: str = "url", flag: str = "maybe_seen") -> DataFrame:
        """``urls`` with a flag that is false only for what was never added. A shard's map comes first in its task, then its URLs in batches."""
        bits, k, names = self.bits, self.k, urls.columns
        schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema], f"`{flag}` boolean"])

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            maps: dict[int, np.ndarray] = {}
            for p in parts:
                out = p[names].copy()
                found = np.zeros(len(p), bool)
                for s, at in p.groupby("__shard", sort=False).indices.items():
                    for m in p["__bits"].iloc[at].dropna():
                        maps = {s: np.frombuffer(m, np.uint8)}
                    mine = at[p["__bits"].iloc[at].isna().to_numpy()]
                    if s in maps and len(mine):
                        place = bloom_places(p[column].iloc[mine].fillna("").tolist(), bits, k)
                        found[mine] = ((maps[s][place >> 3] >> (place & 7)) & 1).all(axis=1)
                out[flag] = found
                yield out[p["__bits"].isna().to_numpy()]

        rows = self._dealt(urls, column).withColumn("__bits", F.lit(None).cast("binary"))
        maps = self.maps.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in urls.schema], F.col("shard").alias("__shard"), F.col("bits").alias("__bits"))
        both = rows.unionByName(maps).repartition("__shard").sortWithinPartitions("__shard", F.col("__bits").isNull())
        return both.mapInPandas(run, schema)

    def inserts(self) -> int:
        """How many added URLs were new to the filter."""
        return self.maps.agg(F.coalesce(F.sum("inserts"), F.lit(0))).first()[0]

    def saturation(self) -> float:
        return self.inserts() / self.capacity


def apart(found: DataFrame, seen: DataFrame, bloom: Bloom) -> DataFrame:
    """Rows of ``found`` whose URL isn't in ``seen``; only those that the filter can't rule out go to the join."""
    marked = stored(bloom.flagged(found), "flagged")
    sure = marked.where(~F.col("maybe_seen")).drop("maybe_seen")
    return sure.unionByName(marked.where("maybe_seen").drop("maybe_seen").join(seen.select("url"), "url", "left_anti").select(*found.columns))


def new_urls(found: DataFrame, seen: DataFrame, kind: str = "exact", capacity: int = 10_000_000, error_rate: float = 0.001) -> DataFrame:
    """Distinct URLs of ``found`` that aren't in ``seen``; 'bloom' sends only possible members to the join."""
    distinct = found.select("url").distinct()
    if kind == "exact":
        return distinct.join(seen, "url", "left_anti")
    if kind != "bloom":
        raise ValueError(f"unknown kind of set {kind}")
    return apart(distinct, seen, Bloom(capacity, error_rate).add(seen))

"""URL filters from a sorted array of digests.

Entries of the block list are whole URLs (with a scheme), hosts (which also stand for all
hosts below them), or hosts with a path (which stand for all paths below it).  URLs and
entries are brought to the canonical form first (case, default ports, fragments, tracking
parameters, the order of the query), so another spelling of an entry is blocked as well.  A
URL is probed under its canonical form, its host and the domains above it, and its paths,
down to the deepest path of the list.

The keys of the list are hashed in Spark (64-bit xxhash), spread over shards by the top bits of
the digest, and each shard is written to the shared folder as three flat files: sorted
digests, offsets, and the full strings.  Workers map the files of a shard into memory and
probe a whole batch of keys by vectorised binary search; only pages of the file that the
search touches are read.  A hit counts only if the stored string equals the key, so
collisions of digests (all strings with a digest lie side by side) cannot block a URL.

Shards are written by the tasks that sort them (a file under another name, then an atomic
rename, the same bytes on every attempt), so a lost executor costs a retry.  The driver
holds only the shards' manifest.  The folder must be mounted by all workers, as the
shared folder is; another scheme than ``file:`` is refused with an error, as what isn't
mounted can't be mapped.

Defined results: a null, empty or unusable URL is never blocked, and is no entry; entries are
distinct keys; very long URLs are compared whole; repeated rows are judged alike; of several
entries that block a URL the first of URL, host (the longest first) and path (the shortest
first) is named; an empty list blocks nothing; an empty table gives no row; other columns,
whatever their names, pass through ``filtered``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls as U
from ..oracles import _norm as canonical
from .shared import flattened, fresh_path, picked, written

SHARD_ENTRIES = 1_000_000
_SIGN = np.uint64(1 << 63)


def local_path(uri: str) -> str:
    """The mounted path of a file: URI."""
    u = urlsplit(uri)
    if u.scheme not in ("", "file"):
        raise ValueError(f"the digest index needs a mounted shared folder, not {u.scheme}:")
    return unquote(u.path) if u.scheme else uri


def _place(path: str, content: bytes) -> None:
    own = f"{path}.{os.getpid()}.{np.random.default_rng().integers(1 << 62)}"
    with open(own, "wb") as f:
        f.write(content)
        f.flush()
        os.fsync(f.fileno())
    os.replace(own, path)


def ordered(digest: np.ndarray) -> np.ndarray:
    """Signed digests as unsigned ones in the same order."""
    return digest.astype(np.int64).view(np.uint64) ^ _SIGN


class Shard:
    """The mapped files of a shard."""

    def __init__(self, folder: str, shard: int):
        at = f"{folder}/{shard:06d}"
        size = os.path.getsize(f"{at}.digest")
        self.digest = np.memmap(f"{at}.digest", np.uint64, "r") if size else np.zeros(0, np.uint64)
        self.offset = np.memmap(f"{at}.offset", np.int64, "r")
        self.text = np.memmap(f"{at}.text", np.uint8, "r") if os.path.getsize(f"{at}.text") else np.zeros(0, np.uint8)

    def has(self, digest: np.ndarray, keys: pa.Array) -> np.ndarray:
        """Which keys are entries."""
        found = np.zeros(len(digest), bool)
        if not len(self.digest):
            return found
        low = np.searchsorted(self.digest, digest)
        for k in np.flatnonzero(self.digest[np.minimum(low, len(self.digest) - 1)] == digest):
            at = int(low[k])
            while at < len(self.digest) and self.digest[at] == digest[k] and not found[k]:
                found[k] = self.text[self.offset[at] : self.offset[at + 1]].tobytes() == keys[int(k)].as_py().encode()
                at += 1
        return found


def entry_key(entry: Column) -> Column:
    """The key of an entry: u and the canonical URL, h and a host, or p and a host with a path; empty where it is none."""
    e = F.trim(F.coalesce(entry.cast("string"), F.lit("")))
    bare = U.normalize(F.concat(F.lit("http://"), e))
    host, path = U.host_of(bare), F.regexp_replace(U.path_of(bare), "/+$", "")
    url = U.normalize(e)
    short = F.when(host == "", "").when(path == "", F.concat(F.lit("h "), host)).otherwise(F.concat(F.lit("p "), host, path))
    return F.when(e.contains("://"), F.when(url == "", "").otherwise(F.concat(F.lit("u "), url))).when(e == "", "").otherwise(short)


def probes(url: Column, depth: int) -> Column:
    """The keys under which a URL may be listed, by precedence. depth: segments of the longest path of the list."""

    def keys(x: Column) -> Column:
        labels = F.split(x["host"], r"\.")
        n = F.size(labels)
        hosts = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("h "), F.array_join(F.slice(labels, i, n), ".")))
        out = F.concat(F.array(F.concat(F.lit("u "), x["url"])), hosts)
        if depth:
            parts = F.slice(F.array_remove(F.split(x["path"], "/"), ""), 1, depth)
            paths = F.transform(F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("p "), x["host"], F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
            out = F.concat(out, paths)
        return F.when(x["url"] == "", F.array().cast("array<string>")).otherwise(out)

    canonical = lambda u: U.let(F.struct(u.alias("url"), U.host_of(u).alias("host"), U.path_of(u).alias("path")), keys)
    return U.let(U.normalize(url), canonical)


class Index:
    """A block list as shards of sorted digests in the shared folder. ``hashed``: the digest of a string column, for tests of collisions."""

    def __init__(self, entries: DataFrame, column: str = "url", shard_entries: int = SHARD_ENTRIES, hashed=F.xxhash64):
        spark = entries.sparkSession
        self.hashed = hashed
        self.folder = local_path(fresh_path(spark, "digests"))
        os.makedirs(self.folder)
        folder = self.folder
        rows = picked(entries, column).select(entry_key(F.col(column)).alias("key")).where("key <> ''").distinct()
        # the list may be costly to make, and is counted before it is spread
        rows = written(rows, "entries")
        facts = rows.agg(F.count("*"), F.max(F.when(F.col("key").startswith("p "), F.size(F.split("key", "/")) - 1))).first()
        self.depth = facts[1] or 0
        self.shards = max(1, -(-facts[0] // shard_entries))
        rows = rows.withColumn("digest", hashed("key"))
        # the top 31 bits of the digest, in equal ranges
        rows = rows.withColumn("shard", F.floor((F.shiftright("digest", 33) + (1 << 30)) * F.lit(self.shards) / F.lit(1 << 31)).cast("int"))

        def write(t: pa.Table) -> pa.Table:
            shard = t.column("shard")[0].as_py()
            digest = ordered(t.column("digest").to_numpy())
            keys = [u.encode() for u in t.column("key").to_pylist()]
            order = sorted(range(len(keys)), key=lambda k: (digest[k], keys[k]))
            at = f"{folder}/{shard:06d}"
            _place(f"{at}.text", b"".join(keys[k] for k in order))
            _place(f"{at}.offset", np.cumsum([0, *(len(keys[k]) for k in order)]).astype(np.int64).tobytes())
            _place(f"{at}.digest", digest[order].tobytes())
            return pa.table({"shard": pa.array([shard], pa.int32()), "entries": pa.array([len(keys)], pa.int64())})

        self.entries = {r[0]: r[1] for r in rows.groupBy("shard").applyInArrow(write, "shard int, entries bigint").collect()}

    def marked(self, urls: DataFrame, column: str, entry: str) -> DataFrame:
        """``urls`` with a string column ``entry``: the key of the entry that blocks the URL, else null."""
        folder, present, shards = self.folder, frozenset(self.entries), self.shards
        n = len(urls.columns)
        flat = flattened(urls)
        flat = flat.select("*", probes(F.col(f"c{urls.columns.index(column)}").cast("string"), self.depth).alias("k"))
        flat = flat.select("*", F.transform("k", lambda x: self.hashed(x)).alias("d"))
        schema = T.StructType([*[T.StructField(f"c{k}", f.dataType) for k, f in enumerate(urls.schema)], T.StructField("entry", T.StringType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            open_: dict[int, Shard] = {}
            for b in batches:
                lists, flat_digest = b.column(n), b.column(n + 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
                keys = lists.flatten()
                digest = ordered(flat_digest)
                shard = np.floor(((flat_digest >> 33) + (1 << 30)) * shards / (1 << 31)).astype(np.int64)
                found = np.zeros(len(keys), bool)
                for s in np.unique(shard).tolist():
                    if s not in present:
                        continue
                    if s not in open_:
                        open_[s] = Shard(folder, s)
                    at = np.flatnonzero(shard == s)
                    found[at] = open_[s].has(digest[at], keys.take(pa.array(at)))
                hit = np.flatnonzero(found)
                blocked, first = np.unique(row[hit], return_index=True)
                place = np.full(b.num_rows, -1)
                place[blocked] = hit[first]
                which = keys.take(pa.array(place, mask=place < 0)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns[:n], which], names=[*[f"c{k}" for k in range(n)], "entry"])

        return flat.mapInArrow(run, schema).toDF(*urls.columns, entry)


def filtered(pages: DataFrame, index: Index, column: str = "url") -> DataFrame:
    """The pages whose URL no entry blocks, with their own columns."""
    at = pages.columns.index(column)
    return index.marked(flattened(pages), f"c{at}", "entry").where("entry is null").drop("entry").toDF(*pages.columns)


#: The query's block list: these domains, and the URLs of pages with a word of the lexicon.
DOMAINS = tuple(f"{name}.example.{top}" for name in "casino-win free-bets ads-track spam-farm cheap-pills adult-x".split() for top in ("com", "net", "org"))
LEXICON = ("worthless", "disgusting", "pathetic", "stupid", "trash", "scum")


def block_list(pages: DataFrame, domains=DOMAINS, lexicon=LEXICON) -> DataFrame:
    named = pages.sparkSession.createDataFrame([(d,) for d in domains], "url string")
    return named.unionByName(pages.where(F.lower("html").rlike("|".join(lexicon))).select("url"))


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, whether it is blocked and by which entry, of every page."""
    marked = Index(block_list(picked(pages, "url", "html"))).marked(picked(pages, "page_id", "url"), "url", "entry")
    return marked.select("page_id", "url", F.col("entry").isNotNull().alias("blocked"), "entry")


_HOST = "split_part(split_part(split_part(n, '//', 2), '/', 1), ':', 1)"
ORACLE = f"""
WITH p AS (SELECT page_id, u AS url, n, {_HOST} AS host, html FROM {canonical("(SELECT page_id, url AS u, html FROM pages)")}),
listed AS (SELECT DISTINCT n FROM p WHERE n <> '' AND regexp_matches(lower(html), '{"|".join(LEXICON)}')),
domains(d) AS (VALUES {", ".join(f"('{d}')" for d in DOMAINS)}),
m AS (SELECT page_id, url, CASE WHEN n IN (SELECT n FROM listed) THEN 'u ' || n ELSE (SELECT 'h ' || max(d) FROM domains WHERE host = d OR ends_with(host, '.' || d)) END AS entry FROM p)
SELECT page_id, url, entry IS NOT NULL AS blocked, entry FROM m"""

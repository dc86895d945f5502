"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

First pass: the words of the test items are counted over the whole corpus.  An item's
n-gram is a *seed* if the product of its words' shares of the corpus is at most
``RARE``, or if that product is the least of some ``WINDOW`` consecutive n-grams of the
item.  Three of four words (``GAPPED``) are seeds as well where they are as rare, so
that a copy with every third or fourth word replaced has one.  Rarity is judged by words, not by documents that hold the n-gram, because a
passage that leaked into thousands of copies makes its own n-grams frequent and would
lose its seeds.  Second pass: seeds join passages of the documents to the items,
and each passage (the hits of one item that lie together, with the item's length on
either side) is aligned with the item over words.  The score is the local alignment
score over that of a perfect match (2 a word); ``THRESHOLD`` and above is a leak.

The corpus is read twice and never shuffled: counts are combined in the worker and only
those of the items' words leave it.  The benchmark's words and seeds are broadcast in chunks of at most ``CHUNK_WORDS`` words; a larger benchmark takes more
passes, not more memory.

Defined results: a null, empty or word-less text or item matches nothing; items
shorter than ``NGRAM`` words use the whole item as seed and match only verbatim;
very long texts are searched whole; repeated documents each give rows, and repeated
items (equal id and text) count once; null ids are carried as they are; of equal
alignments the earliest passage is reported; empty tables give no row; other columns
are ignored, or passed through by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import flattened, picked, written

NGRAM, WINDOW = 4, 4
#: Three of four words: what is left where every third or fourth word of an item was replaced.
GAPPED = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
RARE = 1e-8
THRESHOLD = 0.5
CHUNK_WORDS = 4_000_000
SMALL_TABLE_BYTES = 64 << 20
SCHEMA = "doc_id bigint, item_id bigint, score double, matched_words int, item_words int, start_char bigint, end_char bigint"


def grams(w: K.Words, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the words at the places of ``shape`` from each position, and the positions where they lie in one document."""
    if shape == tuple(range(len(shape))):
        return w.grams(len(shape))
    m = len(w.hash) - shape[-1]
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = w.hash[:m].copy()
    for k in shape[1:]:
        g = K.mix(g * np.uint64(0xD6E8FEB86659FD93) + w.hash[k : m + k])
    at = np.flatnonzero(w.doc[:m] == w.doc[shape[-1] : m + shape[-1]])
    return g[at], at


class Items:
    """The words of a chunk of test items and their n-grams, one row for each item and position."""

    def __init__(self, ids: list, texts: list, n: int = NGRAM):
        data, offs = K.utf8(pa.array(texts, pa.string()))
        w = K.Words(data, offs)
        cut = np.searchsorted(w.doc, np.arange(len(texts) + 1))
        self.ids, self.words, self.n = ids, [w.hash[cut[i] : cut[i + 1]] for i in range(len(texts))], n
        self.sizes: dict[tuple[tuple[int, ...], bool], tuple] = {}
        by: dict[int, list] = {}
        for k, x in enumerate(self.words):
            if len(x):
                by.setdefault(min(n, len(x)), []).append(k)
        shapes = [(tuple(range(size)), False, own) for size, own in by.items()]
        shapes += [(shape, True, by[n]) for shape in GAPPED if n in by and shape[-1] < n]
        for shape, partial, own in shapes:
            g, at = grams(w, shape)
            item = w.doc[at]
            mine = np.isin(item, own)
            self.sizes[shape, partial] = (g[mine], item[mine], at[mine] - cut[item[mine]])

    def word_keys(self) -> np.ndarray:
        return K.distinct(np.concatenate([np.zeros(0, np.uint64), *self.words]))[0]

    def seeds(self, keys: np.ndarray, share: np.ndarray, rare: float = RARE, window: int = WINDOW) -> dict[tuple[tuple[int, ...], bool], tuple]:
        """(keys, first row, items, positions) of the seeds of each shape, whole or partial. share: of each word in the corpus."""
        log = np.log(np.maximum(share, 1e-300))
        weight = [log[np.searchsorted(keys, x)] for x in self.words]
        out = {}
        for size, (g, item, pos) in self.sizes.items():
            chance = np.array([sum(weight[i][p + k] for k in size[0]) for i, p in zip(item.tolist(), pos.tolist(), strict=True)])
            take = chance <= np.log(rare)
            bounds = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1], [True])))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if not size[1] and not take[a:b].all():
                    for s in range(max(1, b - a - window + 1)):
                        take[a + s + int(chance[a + s : min(b, a + s + window)].argmin())] = True
            order = np.flatnonzero(take)
            order = order[np.argsort(g[order], kind="stable")]
            found, size_of = K.distinct(g[order])
            out[size] = (found, np.concatenate(([0], np.cumsum(size_of))), item[order], pos[order])
        return out


def _word_shares(docs: DataFrame, keys: np.ndarray) -> np.ndarray:
    """The share of each word in all words of the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = K.Lookup(shared.value)
        total, words = np.zeros(len(shared.value), np.int64), 0
        for b in batches:
            data, offs = K.utf8(b.column(0))
            for i, j in K.blocks(offs):
                w = K.Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                total += np.bincount(look.find(w.hash)[1], minlength=len(total))
                words += len(w.hash)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], words))], names=["i", "n"])

    found = docs.select("text").mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    i, n = (found.column(c).to_numpy() for c in ("i", "n"))
    counts = np.zeros(len(keys))
    counts[i[i >= 0]] = n[i >= 0]
    return counts / max(1, int(n[i < 0].sum()))


def passages(doc_hits: np.ndarray, positions: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Spans of words to align: from hits (word, position in the item), those that overlap joined."""
    low, high = doc_hits - positions - length, doc_hits - positions + 2 * length
    order = np.argsort(low, kind="stable")
    spans: list[list[int]] = []
    for a, b in zip(low[order].tolist(), high[order].tolist(), strict=True):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return [(a, b) for a, b in spans]


def _aligned(docs: DataFrame, items: Items, seeds: dict[int, tuple], threshold: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((items.ids, items.words, seeds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, seed = shared.value
        look = {s: K.Lookup(x[0]) for s, x in seed.items()}
        for b in batches:
            data, offs = K.utf8(b.column(1))
            rows: list[tuple] = []
            for i, j in K.blocks(offs):
                part, base = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                w = K.Words(part, base)
                found = []
                for s, lk in look.items():
                    g, at = grams(w, s[0])
                    hit, key = lk.find(g)
                    _, first, item, pos = seed[s]
                    n = first[key + 1] - first[key]
                    row = np.repeat(first[key], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    found.append((np.repeat(at[hit], n), item[row], pos[row]))
                if not found:
                    continue
                word, item, pos = (np.concatenate(x) for x in zip(*found, strict=True))
                doc = w.doc[word]
                order = np.lexsort((word, item, doc))
                word, item, pos, doc = word[order], item[order], pos[order], doc[order]
                cut = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]), [True]))) if len(word) else np.zeros(1, int)
                edge = np.searchsorted(w.doc, np.arange(j - i + 1))
                for a, e in zip(cut[:-1], cut[1:], strict=True):
                    d, k = int(doc[a]), int(item[a])
                    query, lo, hi = words[k], int(edge[d]), int(edge[d + 1])
                    best = (0, 0, 0, 0)
                    for s, t in passages(word[a:e], pos[a:e], len(query)):
                        s, t = max(s, lo), min(t, hi)
                        score, same, x, y = K.align(query, w.hash[s:t])
                        if score > best[0]:
                            best = (score, same, s + x, s + y - 1)
                    if best[0] >= threshold * 2 * len(query):
                        chars = part[base[d] : w.end[best[3]]]
                        letters = (chars & 0xC0) != 0x80
                        head = int(w.start[best[2]] - base[d])
                        rows.append((i + d, ids[k], best[0] / (2 * len(query)), best[1], len(query), int(letters[:head].sum()), int(letters.sum())))
            col = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7)]
            own = b.column(0).take(pa.array(col[0], pa.int64()))
            kinds = (pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([own, *[pa.array(c, k) for c, k in zip(col[1:], kinds, strict=True)]], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, chunk_words: int = CHUNK_WORDS, rare: float = RARE, window: int = WINDOW) -> DataFrame:
    """One row for each document and test item whose alignment reaches the threshold."""
    spark = docs.sparkSession
    docs = picked(docs, "doc_id", "text")
    bench = picked(benchmark, "item_id", "text").select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("trim(text) <> ''").distinct()
    chars = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = 1 + chars // (4 * chunk_words)
    out = None
    for c in range(chunks):
        rows = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == c).orderBy("item_id", "text").collect()
        items = Items([r[0] for r in rows], [r[1] for r in rows])
        if not items.sizes:
            continue
        keys = items.word_keys()
        part = _aligned(docs, items, items.seeds(keys, _word_shares(docs, keys), rare, window), threshold)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that leak no test item, with their own columns; those without an id are judged by their text."""
    flat = flattened(docs)
    text = f"c{docs.columns.index('text')}"
    keyed = flat.select("*", F.xxhash64(text).alias("h"))
    slim = flat.select(F.xxhash64(text).alias("doc_id"), F.col(text).alias("text"))
    bad = written(leaks(slim, benchmark, **options).select(F.col("doc_id").alias("bad")).distinct(), "leaks")
    side = F.broadcast(bad) if bad.count() * 16 <= SMALL_TABLE_BYTES else bad
    return keyed.join(side, keyed["h"] == side["bad"], "left_anti").drop("h").toDF(*docs.columns)

"""Language-model scores from a weighted backoff automaton over UTF-8 bytes.

Training counts the byte n-grams of the order ``ORDER`` over the whole corpus: a
worker sorts and merges the n-grams of its partition, a shuffle adds them up.  Counts
of the lower orders are sums over the suffixes, each order taken from the next.  Every
n-gram that occurs is kept, so the model grows with the corpus.

Smoothing is absolute discounting with backoff.  Contexts become the states of an
automaton: an arc for each n-gram kept, with its log-probability, to the state of the
longest context that follows, and a failure arc, with the log of the backoff weight,
to the context without its oldest byte.  At the root all 256 bytes have an arc.  Joins
and windows by context compute the arcs; tasks write them, by shards of their hash, into
a table of the shared folder (which all workers must mount) that scorers map into memory.
The driver sees only counts, and nothing is broadcast.
Scoring is one left-to-right traversal that carries the state and adds up
log-probabilities, for thousands of lanes in step.  A long text is cut into several
lanes; a lane begins ``ORDER - 1`` bytes early from the root without adding anything,
after which its state is the one that the traversal from the beginning has, as no state
is longer than that.

Defined results: null and empty texts have n_bytes 0, log_prob 0 and bits_per_byte
null; very long texts are scored whole; repeated rows count as often as they occur and
are scored alike; rows without an id are scored; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .shared import Scratch, fresh_path, picked
from .urlfilter import local_path

ORDER = 5
SHARD_ARCS = 1_000_000
DISCOUNT = 0.75
LANE = 512
BLOCK = 1 << 22
_BITS = 9
#: No arc has this key, so what no task writes is empty.
_EMPTY = 0
_FILES = {"keys": np.int64, "size": np.uint8, "logp": np.float64}


def codes(data: np.ndarray, offs: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each byte: 9 bits a symbol, the newest lowest; 0 stands before a text, byte b is b + 1."""
    pad = order - 1
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    at = np.arange(len(data)) + (doc + 1) * pad
    line = np.zeros(len(data) + len(offs) * pad, np.uint64)
    line[at] = data.astype(np.uint64) + np.uint64(1)
    code = line.copy()
    for k in range(1, order):
        code[k:] |= line[:-k] << np.uint64(_BITS * k)
    return code[at]


class Counter:
    """Sorted runs of (code, count), merged when they grow."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows = self.limit = 0

    def add(self, code: np.ndarray) -> None:
        self.runs.append(K.distinct(code))
        self.rows += len(self.runs[-1][0])
        if self.rows > max(2_000_000, 2 * self.limit):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.runs:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.runs) > 1:
            code, n = (np.concatenate(x) for x in zip(*self.runs, strict=True))
            order = np.argsort(code, kind="stable")
            code, n = code[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            self.runs = [(code[first], np.add.reduceat(n, first))]
        self.rows = self.limit = len(self.runs[0][0])
        return self.runs[0]


def ngram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(code, n) of the corpus' n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Counter()
        for b in batches:
            data, offs = K.utf8(b.column(0))
            for i, j in K.blocks(offs, BLOCK):
                c.add(codes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], order))
        code, n = c.merge()
        for lo in range(0, len(code), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(code[lo : lo + 100_000].astype(np.int64)), pa.array(n[lo : lo + 100_000])], names=["code", "n"])

    return picked(docs, "text").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


class Model:
    """The automaton as a hash table in files of the shared folder, which workers map.

    A state is its context's code under its length; an arc's key is the state and the byte, and the key with symbol 0
    holds the state's backoff.  Pickled, it is only the files' names.
    """

    def __init__(self, folder: str, order: int, shards: int, room: int, start: int, arcs: int):
        self.folder, self.order, self.start, self.arcs = folder, order, start, arcs
        self.room, self.shift = room, 64 - int(np.log2(shards * room))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("keys", "size", "logp")}

    def opened(self) -> Model:
        if not hasattr(self, "keys"):
            self.keys, self.size, self.logp = (np.memmap(f"{self.folder}/{name}", kind, "r") for name, kind in _FILES.items())
        return self

    def find(self, key: np.ndarray) -> np.ndarray:
        """The slot of each arc, -1 where there is none."""
        slot = (_hash(key) >> np.uint64(self.shift)).astype(np.int64)
        have = self.keys[slot]
        out = np.where(have == key, slot, -1)
        open_ = np.flatnonzero((have != key) & (have != _EMPTY))
        while len(open_):
            slot[open_] = _following(slot[open_], self.room)
            have = self.keys[slot[open_]]
            same = have == key[open_]
            out[open_[same]] = slot[open_[same]]
            open_ = open_[~same & (have != _EMPTY)]
        return out

    def step(self, state: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next state and log-probability of each lane; where an arc is missing, failure arcs are taken."""
        width = _BITS * (self.order - 1)
        slot = self.find(state << _BITS | (sym + 1))
        extra = np.zeros(len(state))
        miss = np.flatnonzero(slot < 0)
        at = state[miss]
        while len(miss):
            extra[miss] += self.logp[self.find(at << _BITS)]
            size = (at >> width) - 1
            at = size << width | at & ((1 << _BITS * size) - 1)
            got = self.find(at << _BITS | (sym[miss] + 1))
            ok = got >= 0
            slot[miss[ok]] = got[ok]
            miss, at = miss[~ok], at[~ok]
        size = self.size[slot].astype(np.int64)
        history = (state << _BITS | (sym + 1)) & ((1 << _BITS * size) - 1)
        return size << width | history, self.logp[slot] + extra

    def score(self, data: np.ndarray, offs: np.ndarray, lane: int = LANE) -> np.ndarray:
        """Log-probability of each text of a block."""
        self.opened()
        warm = self.order - 1
        size = np.diff(offs)
        per = -(-size // lane)
        doc = np.repeat(np.arange(len(size)), per)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        begin = offs[doc] + nth * lane
        end = np.minimum(begin + lane, offs[doc + 1])
        skip = np.where(nth > 0, warm, 0)
        begin = begin - skip
        order = np.argsort(begin - end, kind="stable")
        doc, nth, begin, end, skip = doc[order], nth[order], begin[order], end[order], skip[order]
        length = end - begin
        state = np.where(nth > 0, 0, self.start).astype(np.int64)
        total = np.zeros(len(doc))
        active = len(doc) - np.searchsorted(length[::-1], np.arange(int(length.max(initial=0))), "right")
        for t, a in enumerate(active.tolist()):
            state[:a], lp = self.step(state[:a], data[begin[:a] + t].astype(np.int64))
            total[:a] += lp if t >= warm else np.where(skip[:a] > t, 0.0, lp)
        return np.bincount(doc, total, len(size))


def _hash(key: np.ndarray) -> np.ndarray:
    key = key.astype(np.uint64)
    return (key ^ (key >> np.uint64(23))) * np.uint64(0x9E3779B97F4A7C15)


def _following(slot: np.ndarray, room: int) -> np.ndarray:
    """The next slot; a shard's last is followed by its first."""
    return slot & ~(room - 1) | (slot + 1) & (room - 1)


def _filled(key: np.ndarray, room: int, shards: int) -> np.ndarray:
    """The slot, within its shard, of each key."""
    slot = (_hash(key) >> np.uint64(64 - int(np.log2(shards * room)))).astype(np.int64) & (room - 1)
    taken, todo = np.zeros(room, bool), np.arange(len(key))
    while len(todo):
        free = np.flatnonzero(~taken[slot[todo]])
        _, first = np.unique(slot[todo[free]], return_index=True)
        taken[slot[todo[free[first]]]] = True
        rest = np.ones(len(todo), bool)
        rest[free[first]] = False
        todo = todo[rest]
        slot[todo] = _following(slot[todo], room)
    return slot


def _entries(counts: DataFrame, order: int, least: int, discount: float, written) -> DataFrame:
    """(key, size, p): the arcs with the length of the next state, and the backoff weights, level by level."""
    spark = counts.sparkSession
    width = _BITS * (order - 1)
    low = lambda c, k: c.bitwiseAND(F.lit((1 << _BITS * k) - 1))
    grams = {order: counts}
    for k in range(order - 1, 0, -1):
        grams[k] = written(grams[k + 1].groupBy(low(F.col("code"), k).alias("code")).agg(F.sum("n").alias("n")), f"grams{k}")
    contexts = {k: grams[k + 1].where(F.col("n") >= least).select(F.shiftright("code", _BITS).alias("context")).distinct() for k in range(1, order)}
    n1 = np.zeros(256)
    for code, n in grams[1].where(F.col("n") >= least).collect():
        n1[code - 1] = n
    level = spark.createDataFrame([(w + 1, float(p)) for w, p in enumerate((n1 + 1) / (n1.sum() + 256))], "code bigint, p double").withColumn("shorter", F.lit(0))
    out = None
    for k in range(1, order + 1):
        context = F.shiftright("code", _BITS)
        if k > 1:
            by = Window.partitionBy("context")
            # in the order of the symbols, so that sums don't vary in the last place
            whole = by.orderBy("code").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            own = grams[k].withColumn("context", context).withColumn("total", F.sum("n").over(by)).where(F.col("n") >= least)
            below = level.select(F.col("code").alias("suffix"), F.col("p").alias("below"), F.col("size").alias("shorter"))
            own = own.join(below, low(F.col("code"), k - 1) == F.col("suffix")).withColumn("p", (F.col("n") - discount) / F.col("total"))
            own = own.withColumn("kept", F.sum("p").over(whole)).withColumn("left", 1 - F.sum("below").over(whole))
            full = F.col("left") < 1e-12
            level = own.select("code", F.when(full, F.col("p") / F.col("kept")).otherwise(F.col("p")).alias("p"), "shorter", "context", F.when(full, 1.0).otherwise((1 - F.col("kept")) / F.when(~full, F.col("left"))).alias("backoff"))
        if k < order:
            level = level.join(contexts[k].select(F.col("context").alias("again")), F.col("code") == F.col("again"), "left")
            level = level.withColumn("size", F.when(F.col("again").isNotNull(), k).otherwise(F.col("shorter"))).drop("again")
        else:
            level = level.withColumn("size", F.col("shorter"))
        level = written(level, f"arcs{k}")
        state = lambda c, k=k: F.shiftleft(c + F.lit((k - 1) << width), _BITS)
        part = level.select((state(context) + F.col("code").bitwiseAND(F.lit(511))).alias("key"), F.col("size").cast("int").alias("size"), "p")
        out = part if out is None else out.unionByName(part)
        if k > 1:
            out = out.unionByName(level.groupBy("context").agg(F.first("backoff").alias("p")).select(state(F.col("context")).alias("key"), F.lit(0).alias("size"), "p"))
    return out


def train(docs: DataFrame, order: int = ORDER, least: int = 1, discount: float = DISCOUNT, shard_arcs: int = SHARD_ARCS) -> Model:
    """Count the corpus' n-grams, and let tasks write the automaton. ``least``: the count an n-gram needs to be kept, the same at every size; by default every one is."""
    if not 2 <= order <= 6:
        raise ValueError("a state and a byte of order 2 to 6 fit a key")
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        written = scratch.written
        counts = written(ngram_counts(docs, order), "ngrams")
        entries = written(_entries(counts, order, least, discount, written), "automaton")
        size = entries.count()
        shards = 1 << max(0, int(np.ceil(np.log2(size / shard_arcs))))
        width = _BITS * (order - 1)
        begin = [k << width << _BITS for k in range(1, order)]
        start = max((r[0] >> _BITS for r in entries.where(F.col("key").isin(begin)).select("key").collect()), default=0)

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                top = _hash(b.column(0).to_numpy()) >> np.uint64(32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((top * np.uint64(shards) >> np.uint64(32)).astype(np.int32))], names=["key", "size", "p", "shard"])

        spread_out = written(entries.mapInArrow(spread, "key bigint, size int, p double, shard int"), "shards")
        room = 1 << int(np.ceil(np.log2(2 * spread_out.groupBy("shard").count().agg(F.max("count")).first()[0])))
        folder = local_path(fresh_path(spark, "model"))
        os.makedirs(folder)
        for name, kind in _FILES.items():
            with open(f"{folder}/{name}", "wb") as f:
                f.truncate(shards * room * np.dtype(kind).itemsize)

        def write(t: pa.Table) -> pa.Table:
            shard = t.column("shard")[0].as_py()
            key, following, p = (t.column(c).to_numpy() for c in ("key", "size", "p"))
            by = np.argsort(key)
            slot = _filled(key[by], room, shards)
            content = {"keys": (key, _EMPTY), "size": (following, 0), "logp": (np.log(p), 0)}
            for name, kind in _FILES.items():
                values, none = content[name]
                part = np.full(room, none, kind)
                part[slot] = values[by]
                # a range of its own and the same bytes on every attempt
                with open(f"{folder}/{name}", "r+b") as f:
                    f.seek(shard * part.nbytes)
                    f.write(part.tobytes())
                    f.flush()
                    os.fsync(f.fileno())
            return pa.table({"shard": pa.array([shard], pa.int32())})

        spread_out.groupBy("shard").applyInArrow(write, "shard int").collect()
        return Model(folder, order, shards, room, start, size)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_bytes, log_prob (natural) and bits_per_byte of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.opened()
        for b in batches:
            data, offs = K.utf8(b.column(1))
            lp = np.zeros(b.num_rows)
            for i, j in K.blocks(offs, BLOCK):
                lp[i:j] = m.score(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            n = np.diff(offs)
            bits = -lp / np.maximum(n, 1) / np.log(2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(lp), pa.array(bits, mask=n == 0)], names=["doc_id", "n_bytes", "log_prob", "bits_per_byte"])

    return picked(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, log_prob double, bits_per_byte double")


def score(docs: DataFrame, order: int = ORDER, least: int = 1) -> DataFrame:
    """Train on all of ``docs`` and score them."""
    return scored(docs, train(docs, order, least))

"""SimHash near-duplicates by recursive filtering of fingerprints.

Every document gets a 256-bit SimHash of its distinct word pairs.  Equal
fingerprints are one node.  Nodes within ``RADIUS`` bits are found in the manner
of May and Ozerov: many random strips of coordinates are drawn, and for each some
random patterns; a node joins the list of a pattern if its bits on the strip
differ from the pattern in at most ``THETA`` places (its partial weight).  Nodes
near each other join the same list far more often than others do.  A short list is
compared by brute force.  A long one is filtered again on narrow strips, each with all its
patterns and no place that may differ, so that a sort makes the lists of a strip; how narrow follows from
the list's length and from sampled distances, such that the work for a node grows as the power 0.4 of the length
and not as the length.  It finds a pair with a chance of ``LIST_RECALL`` only, and there are more rounds
for it: that costs less than to find in each round what others find too.
The number of rounds follows from the target recall for a pair right at the
radius (``round_recall``, exact for a strip shared by its patterns), so it depends on the data by the number of nodes alone; the number of filters made before the
shuffle grows with the logarithm of the number of nodes, so that a list fits a
task at any size.  Lists are counted first: one that still is longer than ``LIST_ROWS``,
as its nodes are all near each other, is cut into parts by hash, and each pair of parts is
a task, so nothing is lost and no task holds more than two parts.  Each task gives a spanning forest of its near pairs, not all
pairs: what is linked already isn't compared again, so a dense list costs little more than its
length.  Connected components (large star, small star, every round written to
the shared folder) give the groups.  Groups are counted by aggregation before they are joined,
never gathered.

Defined results: texts that are null, empty or without words belong to no group;
a document with fewer than ``MIN_SHINGLES`` distinct word pairs matches only equal
fingerprints, as an edit can't be told from chance there; one-word texts have that
word as their shingle; very long texts are hashed whole; repeated rows are members
of one group; rows without an id are members, and are named last; of a group the
smallest doc_id is kept, ties by content; an empty table gives no group; other
columns are ignored, or passed through by ``deduplicated``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .shared import Scratch, flattened, picked, written

BITS, WORDS64 = 256, 4
RADIUS = 64
MIN_SHINGLES = 8
STRIP, THETA, PATTERNS = 16, 3, 94
RECALL, INNER_RECALL, LIST_RECALL = 0.95, 0.985, 0.7
LEAF, PIVOTS = 4096, 8
#: Lists of a narrow strip longer than this are solved by themselves.
SHORT = 64
#: About the nanoseconds for a node on a narrow strip, for a pair of neighbours there, and for a pair by brute force.
STRIP_COST, PAIR_COST, BRUTE_COST = 60, 12, 10
LIST_ROWS = 500_000
SMALL_TABLE_BYTES = 64 << 20
SEED = 20_150_811
_LANES = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.uint8)).copy().view(np.uint64).ravel()
_SALT = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)
_POP16 = np.bitwise_count(np.arange(1 << 16, dtype=np.uint16))


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, 48-bit hash) of the distinct word pairs of a block; of one-word texts, the word."""
    w = K.Words(data, offs)
    g, at = w.grams(2)
    doc = w.doc[at]
    per = np.bincount(w.doc, minlength=len(offs) - 1)
    lone = np.flatnonzero(per[w.doc] == 1)
    g, doc = np.concatenate((g, w.hash[lone])), np.concatenate((doc, w.doc[lone]))
    key, _ = K.distinct((doc.astype(np.uint64) << np.uint64(48)) | (g >> np.uint64(16)))
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1)


def fingerprints(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 32) bytes of SimHash and the number of distinct shingles of each row."""
    n = len(offs) - 1
    doc, h = shingles(data, offs)
    count = np.bincount(doc, minlength=n)
    out = np.zeros((n, BITS // 8), np.uint8)
    if not len(h):
        return out, count
    byte = np.empty((WORDS64, len(h)), np.uint64)
    for k in range(WORDS64):
        byte[k] = K.mix(h ^ _SALT[k])
    byte = byte.view(np.uint8).reshape(WORDS64, len(h), 8)
    first = np.concatenate(([0], np.flatnonzero(doc[1:] != doc[:-1]) + 1))
    size = np.diff(np.append(first, len(doc)))
    # lanes of 8 bits hold sums of at most 255 rows
    bounds = np.concatenate([np.arange(a, a + s, 255) for a, s in zip(first, size, strict=True)])
    heads = np.searchsorted(bounds, first)
    sums = np.empty((len(first), BITS), np.int32)
    for j in range(BITS // 8):
        lanes = np.add.reduceat(_LANES[byte[j // 8, :, j % 8]], bounds)
        sums[:, 8 * j : 8 * j + 8] = np.add.reduceat(lanes.view(np.uint8).reshape(len(bounds), 8).astype(np.int32), heads, axis=0)
    out[doc[first]] = np.packbits(2 * sums > size[:, None], axis=1)
    return out, count


def fingerprinted(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` with the columns fp (32 bytes, null without words) and n_shingles."""
    slim = docs.select(*keys, F.col(text).alias("__text"))
    schema = docs.select(*keys).schema.add("fp", T.BinaryType()).add("n_shingles", T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = K.utf8(b.column(len(keys)))
            fp, count = np.zeros((b.num_rows, BITS // 8), np.uint8), np.zeros(b.num_rows, np.int32)
            for i, j in K.blocks(offs):
                fp[i:j], count[i:j] = fingerprints(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            flat = pa.array([x.tobytes() if c else None for x, c in zip(fp, count, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], flat, pa.array(count)], names=[*keys, "fp", "n_shingles"])

    return slim.mapInArrow(run, schema)


def pass_probability(strip: int = STRIP, theta: int = THETA) -> float:
    """Chance that a random node joins a given list."""
    return sum(math.comb(strip, i) for i in range(theta + 1)) / 2**strip


def round_recall(radius: int = RADIUS, strip: int = STRIP, theta: int = THETA, patterns: int = PATTERNS) -> float:
    """Chance that a pair at the radius shares a list of one strip: over the places of the strip in which it differs, as all patterns share it."""
    total = 0.0
    for d in range(min(strip, radius) + 1):
        differ = math.comb(radius, d) * math.comb(BITS - radius, strip - d) / math.comb(BITS, strip)
        both = sum(math.comb(d, a) * math.comb(strip - d, c) for a in range(d + 1) for c in range(strip - d + 1) if a + c <= theta and d - a + c <= theta)
        total += differ * (1 - (1 - both / 2**strip) ** patterns)
    return total


def lists_needed(levels: int, recall: float = RECALL, radius: int = RADIUS, found: float = 1.0) -> int:
    """Rounds that find a pair at the radius with the target recall; it has to pass every level of a round, and is found in the list they share with the chance ``found``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-(round_recall(radius) ** levels) * found)))


def agree(distance: int, strip: int) -> float:
    """Chance that a pair at this distance agrees on a whole strip."""
    return math.comb(BITS - distance, strip) / math.comb(BITS, strip)


_AGREE = np.array([[agree(d, k) for d in range(BITS + 1)] for k in range(17)])


def levels_for(nodes: int, list_rows: int = LIST_ROWS) -> int:
    """Filters before the shuffle, so that a list is expected to have at most ``list_rows`` nodes."""
    levels = 1
    while nodes * pass_probability() ** levels > list_rows:
        levels += 1
    return levels


def _strip(rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    return rng.permutation(BITS)[:STRIP], rng.integers(0, 1 << STRIP, PATTERNS, dtype=np.uint16)


def _codes(bits: np.ndarray, coords: np.ndarray) -> np.ndarray:
    return np.packbits(np.ascontiguousarray(bits[:, coords]), axis=1).view(np.uint16).ravel()


def memberships(fp: np.ndarray, levels: int, rounds: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of every list that a fingerprint joins."""
    bits = np.unpackbits(fp, axis=1)
    rows, lists = [], []
    for r in range(rounds):
        at, path = np.arange(len(fp)), np.zeros(len(fp), np.int64)
        for level in range(levels):
            coords, patterns = _strip(np.random.default_rng([seed, r, level]))
            code = _codes(bits, coords)[at]
            hit = [np.flatnonzero(_POP16[code ^ p] <= THETA) for p in patterns]
            took = np.concatenate(hit)
            path = path[took] * PATTERNS + np.repeat(np.arange(PATTERNS), [len(x) for x in hit])
            at = at[took]
        rows.append(at)
        lists.append(path * rounds + r)
    return np.concatenate(rows), np.concatenate(lists)


class Forest:
    """Components of the near pairs seen so far (union-find with path halving), and the pairs that joined them."""

    def __init__(self, n: int):
        self.parent, self.pairs = np.arange(n), []

    def find(self, i: np.ndarray) -> np.ndarray:
        """The root of each node."""
        at = i
        while True:
            up = self.parent[at]
            top = self.parent[up]
            if (up == top).all():
                self.parent[i] = up
                return up
            self.parent[at] = top
            at = top

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def hits(self, i: np.ndarray, j: np.ndarray) -> None:
        """Near pairs: of those between the same two components one is enough."""
        a, b = self.find(i), self.find(j)
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        _, first = np.unique(np.minimum(a, b).astype(np.uint64) << np.uint64(32) | np.maximum(a, b).astype(np.uint64), return_index=True)
        for p, q in zip(i[first].tolist(), j[first].tolist(), strict=True):
            u, v = self.root(p), self.root(q)
            if u != v:
                self.parent[max(u, v)] = min(u, v)
                self.pairs.append((p, q))


def _near(words: np.ndarray, some: np.ndarray, idx: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.zeros((len(some), len(idx)), np.uint16)
    for k in range(WORDS64):
        d += np.bitwise_count(words[some, k][:, None] ^ words[idx, k][None, :])
    a, b = np.nonzero(d <= radius)
    return some[a], idx[b]


def brute(words: np.ndarray, idx: np.ndarray, forest: Forest, radius: int, cells: int = 1 << 17) -> None:
    """Compare all of ``idx`` with each other, but for pairs within its largest component. words: (n, 4) 64-bit."""
    label = forest.find(idx)
    value, n = np.unique(label, return_counts=True)
    own = label == value[n.argmax()] if n.max() > 1 else np.zeros(len(idx), bool)
    order = np.concatenate((idx[own], idx[~own]))
    kept, step = int(own.sum()), max(1, cells // max(1, len(idx)))
    w = np.ascontiguousarray(words[order].T)

    def against(lo: int, hi: int, start: int, end: int) -> None:
        near = _distance(w[:, lo:hi, None], w[:, None, start:end]) <= radius
        if near.any():
            i, j = np.nonzero(near)
            _link(forest, w, order, i + lo, j + start, radius)

    for k in range(kept, len(order), step):
        # each of the rest against the largest component, and what of the rest comes not before it
        if kept:
            against(k, k + step, 0, kept)
        against(k, k + step, k, len(order))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ, as a byte: 256 of them count as none, which ``_link`` rejects. a, b: (4, ...) 64-bit."""
    d = np.bitwise_count(a[0] ^ b[0])
    for k in range(1, WORDS64):
        d += np.bitwise_count(a[k] ^ b[k])
    return d


def _link(forest: Forest, w: np.ndarray, order: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> None:
    true = (i != j) & (np.bitwise_count(w[:, i] ^ w[:, j]).sum(axis=0) <= radius)
    if true.any():
        forest.hits(order[i[true]], order[j[true]])


def strips_for(n: int, distances: np.ndarray, apart: float, recall: float, radius: int) -> tuple[int, int]:
    """(width, number) of the narrow strips that find a pair at the radius with this recall in a list of ``n`` nodes for the least work; width 0 where brute force is less.

    distances: of sampled pairs that aren't linked yet, which are the share ``apart`` of all.
    """
    best = (BRUTE_COST * n / 2, 0, 0)
    for k in range(4, len(_AGREE)):
        if not 0 < _AGREE[k, radius] < 1:
            continue
        strips = max(1, math.ceil(math.log(1 - recall) / math.log1p(-_AGREE[k, radius])))
        together = apart * _AGREE[k, distances].mean() if len(distances) else 0.0
        best = min(best, (strips * (STRIP_COST + PAIR_COST * n / 2 * together), k, strips))
    return best[1:]


def near_forest(fp: np.ndarray, radius: int = RADIUS, leaf: int = LEAF, recall: float = INNER_RECALL, seed: int = SEED) -> list[tuple[int, int]]:
    """Spanning forest of the near pairs of a list; a list longer than ``leaf`` is filtered on narrow strips, unless what is linked leaves few pairs to compare."""
    words = np.ascontiguousarray(fp).view(np.uint64)
    forest = Forest(len(fp))

    def filtered(idx: np.ndarray, depth: int, recall: float) -> None:
        rng = np.random.default_rng([seed, 7, depth, len(idx)])
        a, b = idx[rng.integers(0, len(idx), (2, 4096))]
        apart = forest.find(a) != forest.find(b)
        distances = np.bitwise_count(words[a[apart]] ^ words[b[apart]]).sum(axis=1)
        width, strips = strips_for(len(idx), distances, apart.mean(), recall, radius)
        if not width:
            brute(words, idx, forest, radius)
            return
        bits, w = np.ascontiguousarray(np.unpackbits(fp[idx], axis=1).T), np.ascontiguousarray(words[idx].T)
        # strips of one permutation have no place in common, which makes recall no less
        places = np.concatenate([rng.permutation(BITS)[: BITS // width * width] for _ in range(-(-strips // (BITS // width)))])
        for r in range(strips):
            code = np.zeros(len(idx), np.uint16)
            for c in places[r * width : (r + 1) * width].tolist():
                code += code
                code |= bits[c]
            order = np.argsort(code, kind="stable")
            code = code[order]
            head = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            size = np.diff(np.append(head, len(code)))
            for k in np.flatnonzero(size > SHORT).tolist():
                solve(idx[order[head[k] : head[k] + size[k]]], depth + 1, INNER_RECALL)
            short = np.repeat(size <= SHORT, size)
            order, code = order[short], code[short]
            ws, own = w[:, order], idx[order]
            for step in range(1, min(SHORT, len(code))):
                same = code[step:] == code[:-step]
                n = np.count_nonzero(same)
                if not n:
                    break
                if 4 * n > len(code):  # all neighbours cost less than to pick those
                    i = np.flatnonzero(_distance(ws[:, :-step], ws[:, step:]) <= radius)
                else:
                    i = np.flatnonzero(same)
                    i = i[_distance(ws[:, i], ws[:, i + step]) <= radius]
                _link(forest, ws, own, i, i + step, radius)

    def solve(idx: np.ndarray, depth: int, recall: float) -> None:
        if len(idx) > leaf:
            rng = np.random.default_rng([seed, 5, depth, len(idx)])
            for p in rng.choice(idx, PIVOTS, replace=False):
                forest.hits(*_near(words, np.array([p]), idx, radius))
        _, n = np.unique(forest.find(idx), return_counts=True)
        if len(n) < 2:
            return
        if (len(idx) - n.max()) * len(idx) <= leaf * leaf or depth > 6:
            brute(words, idx, forest, radius)
        else:
            filtered(idx, depth, recall)

    if len(fp) > 1:
        solve(np.arange(len(fp)), 1, recall)
    return forest.pairs


def near_pairs(nodes: DataFrame, count: int, radius: int = RADIUS, leaf: int = LEAF, recall: float = RECALL, list_rows: int = LIST_ROWS) -> DataFrame:
    """Pairs (a, b) of fingerprints within the radius that span all the components found."""
    levels = levels_for(count, list_rows)
    long = count * pass_probability() ** levels > leaf
    rounds = lists_needed(levels, recall, radius, LIST_RECALL if long else 1.0)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        for b in batches:
            flat = b.column(0)
            fp = np.frombuffer(b"".join(flat.to_pylist()), np.uint8).reshape(-1, BITS // 8)
            for lo in range(0, len(fp), 2048):
                row, lst = memberships(fp[lo : lo + 2048], levels, rounds)
                yield flat, row + lo, lst

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for _, _, lst in joined(batches):
            for k, n in zip(*(x.tolist() for x in np.unique(lst, return_counts=True)), strict=True):
                total[k] = total.get(k, 0) + n
            if len(total) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["list", "n"])
                total = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["list", "n"])

    long_lists = nodes.select("fp").mapInArrow(sizes, "list bigint, n bigint").groupBy("list").agg(F.sum("n").alias("n")).where(F.col("n") > list_rows)
    # at most a row for each list_rows memberships
    parts = {k: -(-n // list_rows) for k, n in long_lists.collect()} if count > list_rows else {}
    shared = nodes.sparkSession.sparkContext.broadcast(parts)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = shared.value
        hot = np.array(sorted(cut), np.int64)
        for flat, row, lst in joined(batches):
            own = [(row, lst, np.zeros(len(row), np.int64))]
            if len(hot):
                is_hot = np.isin(lst, hot)
                own = [(row[~is_hot], lst[~is_hot], np.zeros(int((~is_hot).sum()), np.int64))]
                for k in np.unique(lst[is_hot]).tolist():
                    at, n = row[lst == k], cut[k]
                    fp = np.frombuffer(b"".join(flat.take(pa.array(at)).to_pylist()), np.uint64).reshape(-1, WORDS64)
                    part = (K.mix(fp[:, 0] + fp[:, 3]) % np.uint64(n)).astype(np.int64)
                    for other in range(n):
                        own.append((at, np.full(len(at), k), np.minimum(part, other) * n + np.maximum(part, other)))
            at, k, part = (np.concatenate(x) for x in zip(*own, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(part), flat.take(pa.array(at))], names=["list", "part", "fp"])

    def solve(t: pa.Table) -> pa.Table:
        fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint8).reshape(-1, BITS // 8)
        pairs = near_forest(fp, radius, leaf, LIST_RECALL if long else INNER_RECALL)
        a, b = ([fp[p[k]].tobytes() for p in pairs] for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return nodes.select("fp").mapInArrow(lists, "list bigint, part bigint, fp binary").groupBy("list", "part").applyInArrow(solve, "a binary, b binary").distinct()


def components(pairs: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """(node, label): the least node of each node's component, by alternating large and small stars."""
    written = (scratch or Scratch(pairs.sparkSession)).written
    edges = written(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # least neighbours by aggregation and join: a hub's edges may be split over tasks
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = now


def grouped(docs: DataFrame, keys: list[str], text: str = "text", radius: int = RADIUS, min_shingles: int = MIN_SHINGLES, leaf: int = LEAF, recall: float = RECALL, list_rows: int = LIST_ROWS) -> DataFrame:
    """``keys`` of each document that has a fingerprint, with ``label``, the same for all of a group; a table of the shared folder."""
    with Scratch(docs.sparkSession) as scratch:
        prints = scratch.written(fingerprinted(docs, keys, text).where("fp is not null"), "fingerprints")
        nodes = scratch.written(prints.where(F.col("n_shingles") >= min_shingles).select("fp").distinct(), "nodes")
        near = components(near_pairs(nodes, nodes.count(), radius, leaf, recall, list_rows), scratch=scratch)
        return written(prints.join(near, prints.fp == near.node, "left").select(*keys, F.coalesce("label", "fp").alias("label")), "labels")


def groups(docs: DataFrame, **options) -> DataFrame:
    """Members of groups of two or more: doc_id, keep_id (the group's least doc_id), group_size."""
    g = grouped(picked(docs, "doc_id", "text"), ["doc_id"], **options)
    sizes = g.groupBy("label").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    return g.join(sizes, "label").select("doc_id", "keep_id", "group_size")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without all but one document of each group, with their own columns."""
    flat = flattened(docs)
    own = flat.columns
    # maps have no hash; rows that differ in them alone are the same
    hashed = [c for c, f in zip(own, docs.schema, strict=True) if "map<" not in f.dataType.simpleString()]
    keyed = flat.select("*", F.col(own[docs.columns.index("doc_id")]).alias("id"), F.xxhash64(*hashed).alias("row"))
    g = grouped(keyed.select("id", "row", F.col(own[docs.columns.index("text")]).alias("text")), ["id", "row"], **options)
    first = g.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"), F.count("*").alias("size")).where("size > 1")
    marked = g.join(first, "label").select("id", "row", (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("row") == F.col("first.row"))).alias("stays"))
    # of equal rows, one that stays has losers beside it
    rank = marked.groupBy("id", "row").agg(F.max("stays").alias("stays"), F.count("*").alias("copies"))
    named = written(rank.where("not stays or copies > 1"), "ranked")
    few = named.count() * 64 <= SMALL_TABLE_BYTES

    def side(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if few else rows

    def match(rows: DataFrame):
        return keyed["id"].eqNullSafe(rows["id"]) & (keyed["row"] == rows["row"])

    gone, twice = side(named), side(named.where("stays"))
    rest = keyed.join(gone, match(gone), "left_anti")
    picks = keyed.join(twice, match(twice), "left_semi").dropDuplicates(["id", "row"])
    return rest.select(*own).unionByName(picks.select(*own)).toDF(*docs.columns)

"""Packing documents into training sequences by first-fit decreasing.

Documents are dealt to random groups by a seeded hash of their id, text and place in the
table of lengths, so no repeated id or text, and no lack of ids, fills a group; each group is
packed alone, so groups run in parallel and no order over the corpus is needed.
Within a group pieces go, longest first, to the first bin with room.  A tournament
tree over bin capacities, whose inner nodes hold the larger of their two children,
finds that bin in O(log n).  A document longer than ``CAPACITY`` is cut into pieces
of that many tokens and a rest; all are packed, nothing is dropped.

Only (doc_id, tokens) is shuffled, never text.  The number of groups follows the
number of documents (``GROUP_DOCS`` each on average), so a group's size doesn't grow
with the corpus.

Lengths are exact token counts of a public byte-level BPE vocabulary.

Defined results: null, empty texts have no tokens, and give one row with bin_id null;
pieces of equal length go by doc_id, then by order of the text's hash; repeated rows are
packed each for itself, also those without an id;
an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import picked, written
from .tokens import TOKENIZER, token_counts

CAPACITY = 2048
GROUP_DOCS = 4096
SEED = 17
SCHEMA = "group_id bigint, bin_id int, doc_id bigint, piece int, start_token bigint, n_tokens bigint"


class Tournament:
    """Free room of bins; an inner node holds the most room below it."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.room = [capacity] * (2 * self.size)

    def first(self, need: int) -> int:
        """The first bin with at least ``need`` room, which is then taken."""
        room, k = self.room, 1
        while k < self.size:
            k *= 2
            if room[k] < need:
                k += 1
        bin_id = k - self.size
        room[k] -= need
        k //= 2
        while k:
            most = room[2 * k] if room[2 * k] >= room[2 * k + 1] else room[2 * k + 1]
            if room[k] == most:
                break
            room[k] = most
            k //= 2
        return bin_id


def first_fit(lengths: list[int], capacity: int = CAPACITY) -> list[int]:
    """The bin of each length, taken in the given order. A length may not exceed the capacity."""
    tree = Tournament(len(lengths), capacity)
    return [tree.first(n) for n in lengths]


def _pack(capacity: int):
    def run(t: pa.Table) -> pa.Table:
        group = t.column("group_id")[0].as_py()
        rows = []
        for doc, n, h in zip(t.column("doc_id").to_pylist(), t.column("n_tokens").to_pylist(), t.column("h").to_pylist(), strict=True):
            for piece, start in enumerate(range(0, n, capacity)):
                rows.append((-min(capacity, n - start), doc is None, doc or 0, h, piece, start))
            if not n:
                rows.append((0, doc is None, doc or 0, h, 0, 0))
        rows.sort()
        bins = first_fit([-r[0] for r in rows if r[0]], capacity)
        bins += [None] * (len(rows) - len(bins))
        return pa.table(
            {
                "group_id": pa.array([group] * len(rows), pa.int64()),
                "bin_id": pa.array(bins, pa.int32()),
                "doc_id": pa.array([None if r[1] else r[2] for r in rows], pa.int64()),
                "piece": pa.array([r[4] for r in rows], pa.int32()),
                "start_token": pa.array([r[5] for r in rows], pa.int64()),
                "n_tokens": pa.array([-r[0] for r in rows], pa.int64()),
            }
        )

    return run


def pack_lengths(lengths: DataFrame, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, seed: int = SEED) -> DataFrame:
    """Pack (doc_id, h, n_tokens): group_id, bin_id within the group, doc_id, piece, its first token and length."""
    n = lengths.count()
    groups = max(1, -(-n // group_docs))
    key: Column = F.xxhash64("doc_id", "h", F.monotonically_increasing_id(), F.lit(seed))
    dealt = lengths.select(F.pmod(key, F.lit(groups)).alias("group_id"), "doc_id", "n_tokens", "h")
    return dealt.groupBy("group_id").applyInArrow(_pack(capacity), SCHEMA)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, seed: int = SEED) -> DataFrame:
    """Pack the documents; lengths are counted once and written to the shared folder."""
    slim = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return pack_lengths(written(token_counts(slim, ["doc_id", "h"], tokenizer), "lengths"), capacity, group_docs, seed)

"""Vectorised text kernels over Arrow buffers.

All of them work on the UTF-8 bytes of an Arrow string column, for a whole
block of documents at a time, so a document costs no Python loop.  A *word* is a
maximal run of ASCII letters, digits, ``_`` and non-ASCII characters; Latin-1
symbols (U+0080-U+00BF) and general punctuation (U+2000-U+203F) separate words,
and each CJK character (U+3000-U+9FFF) is a word of its own.  Case is folded for
ASCII and Latin-1 letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18
BLOCK_DOCS = 60_000
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs, by sorting."""
    if not len(x):
        return x, np.zeros(0, np.int64)
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return x[at], np.diff(np.append(at, len(x)))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, base in (("p", _P), ("i", _P_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["p"], _powers["i"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def blocks(offs: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer document is a block by itself, whole."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n, i + BLOCK_DOCS)
        yield i, j
        i = j


class Words:
    """The words of a block: byte spans, document index and 64-bit hash of each."""

    __slots__ = ("doc", "end", "hash", "start")

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        n = len(data)
        word = _WORD[data]
        single = None
        fold = _FOLD[data]
        if n and data.max() >= 0x80:
            lead = np.flatnonzero(data == 0xC2)
            word[lead] = False
            word[np.minimum(lead + 1, n - 1)] &= ~(data[np.minimum(lead + 1, n - 1)] >= 0x80)
            lead = np.flatnonzero(data == 0xE2)
            lead = lead[lead + 2 < n]
            lead = lead[data[lead + 1] == 0x80]
            for k in range(3):
                word[lead + k] = False
            after = np.flatnonzero(data[:-1] == 0xC3) + 1
            up = after[(data[after] <= 0x9E) & (data[after] != 0x97)]
            fold[up] += 32
            single = (data >= 0xE3) & (data <= 0xE9)
        start = word.copy()
        start[1:] &= ~word[:-1]
        heads = offs[:-1][offs[:-1] < n]
        start[heads] |= word[heads]
        if single is not None and single.any():
            start |= single
            tail = np.flatnonzero(single) + 3
            tail = tail[tail < n]
            start[tail] |= word[tail]
        end = word.copy()
        end[:-1] &= ~word[1:] | start[1:]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.doc = np.searchsorted(offs, self.start, "right") - 1
        p, inv = _power(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[fold] * p[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * inv[self.start])

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``n`` words from each position, and the positions where they lie in one document."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        g = self.hash[:m].copy()
        for k in range(1, n):
            g = mix(g * np.uint64(0xD6E8FEB86659FD93) + self.hash[k : m + k])
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 : m + n - 1])
        return g[at], at


def words_of(texts: list[str | None]) -> list[np.ndarray]:
    """Word hashes of each text."""
    data, offs = utf8(pa.array(texts, pa.string()))
    w = Words(data, offs)
    cut = np.searchsorted(w.doc, np.arange(len(texts) + 1))
    return [w.hash[cut[i] : cut[i + 1]] for i in range(len(texts))]


class Lookup:
    """Membership of 64-bit keys: a bitmap turns most away, binary search settles the rest."""

    def __init__(self, keys: np.ndarray):
        self.keys = distinct(np.asarray(keys, np.uint64))[0]
        bits = max(16, int(np.ceil(np.log2(max(1, len(self.keys)) * 16))))
        self.shift = np.uint64(64 - bits)
        self.bitmap = np.zeros(1 << bits, bool)
        self.bitmap[self.keys >> self.shift] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``x`` whose key is present, and the key's index."""
        if not len(self.keys) or not len(x):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bitmap[x >> self.shift])
        k = np.minimum(np.searchsorted(self.keys, x[at]), len(self.keys) - 1)
        ok = self.keys[k] == x[at]
        return at[ok], k[ok]


SPAN = 1 << 20


def _sweep(query: np.ndarray, text: np.ndarray, costs: tuple[int, int, int], band: int | None, diagonal: int, matches: int, starts: int) -> tuple[int, int]:
    """Largest cell and the end of its alignment. A cell packs the score, and below it ``matches`` bits of matched words and ``starts`` bits of the start (from the end, so that the earlier one is larger)."""
    match, mismatch, gap = (c << matches + starts for c in costs)
    one = 1 << matches + starts
    counted = 1 << starts if matches else 0
    n = len(text)
    cols = np.arange(n, dtype=np.int64)
    fresh = (1 << starts) - 1 - cols if starts else np.zeros(n, np.int64)
    ramp = cols * -gap
    row = fresh.copy()
    best, end = 0, 0
    for i in range(len(query)):
        diag = np.empty(n, np.int64)
        diag[0] = fresh[0]
        diag[1:] = np.where(row[:-1] >= one, row[:-1], fresh[1:])  # what begins at a column starts there
        step = diag + np.where(text == query[i], match + counted, mismatch)
        new = np.maximum(np.maximum(step, row + gap), fresh)
        new = np.maximum.accumulate(new + ramp) - ramp
        new = np.maximum(new, fresh)
        if band is not None:
            new = np.where(np.abs(cols - i - diagonal) <= band, new, fresh)
        j = int(new.argmax())
        if new[j] >= one and new[j] > best:
            best, end = int(new[j]), j + 1
        row = new
    return best, end


def _best(query: np.ndarray, text: np.ndarray, costs: tuple[int, int, int], band: int | None, diagonal: int, width: int) -> tuple[int, int, int, int]:
    m, n = len(query), len(text)
    starts, matches = n.bit_length(), m.bit_length()
    top = (costs[0] * m - costs[2] * n).bit_length()
    if top + starts + matches <= width:
        best, end = _sweep(query, text, costs, band, diagonal, matches, starts)
        mask = (1 << starts) - 1
        return best >> matches + starts, best >> starts & (1 << matches) - 1, mask - (best & mask) if best else 0, end
    if top + max(starts, matches) > 63:
        raise ValueError("an alignment whose score doesn't fit a cell")
    # the two fields in turn, the second over the span that the first found
    best, end = _sweep(query, text, costs, band, diagonal, 0, starts)
    mask = (1 << starts) - 1
    score, start = best >> starts, mask - (best & mask) if best else 0
    if not score:
        return 0, 0, 0, 0
    again, _ = _sweep(query, text[start:end], costs, band, diagonal - start, matches, 0)
    return score, again & (1 << matches) - 1, start, end


def align(query: np.ndarray, text: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1, band: int | None = None, diagonal: int = 0, span: int = SPAN, width: int = 63) -> tuple[int, int, int, int]:
    """Best local alignment: (score, matched words, start, end) with the span in ``text``.

    Smith-Waterman with linear gaps, a row of cells at a time.  A cell packs
    score, matches and start into one integer, so no traceback is needed; of equal
    scores the one with more matches, then the earlier start wins.  With ``band``
    only cells within ``band`` of ``diagonal`` (text position minus query position)
    are filled.

    A text of more than ``span`` words is aligned in windows that overlap by the longest
    span that an alignment with a positive score can have, so its length has no bound.
    Where the fields don't fit in ``width`` bits, matches and start are found in turn.
    """
    m, n = len(query), len(text)
    if not m or not n:
        return 0, 0, 0, 0
    costs = (match, mismatch, gap)
    longest = m + m * match // -gap
    span = max(span, 2 * longest)
    best = (0, 0, 0, 0)
    for low in range(0, max(1, n - longest), span - longest):
        score, same, a, b = _best(query, text[low : low + span], costs, band, diagonal - low, width)
        if score and (score, same, -a - low) > (best[0], best[1], -best[2]):
            best = (score, same, a + low, b + low)
    return best

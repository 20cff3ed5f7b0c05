"""Benchmark decontamination by q-gram counting in diagonal bands and banded alignment.

Texts and benchmark items are compared as characters in a plain form: lower-case,
every ASCII character but letters and digits a blank, blanks collapsed.  An item is cut into
windows of ``WINDOW`` characters, one every ``STEP`` characters (a shorter item is one window), so any verbatim
quote of ``WINDOW + STEP - 1`` characters holds a whole window.  A document
contains a window when some part of it is within the edit budget k (8 % of the window).

q-gram lemma: such a part shares at least ``length - q + 1 - k * q`` q-grams with the window,
all within a band of k diagonals on either side.  The document's q-grams (eight characters, as a 64-bit
hash; equal hashes only add candidates, which are verified) are looked up in the index of the windows; hits are first thinned to stretches that
are dense enough for any window, then counted per window and pair of neighbouring bands; bands
that reach the bound are verified by a banded alignment of the window.

The index goes to the tasks with the function.  Its size is bounded: items are taken in parts of
at most ``PART_CHARS`` characters, each part being one more column over the same documents.

Defined results: null and empty texts contain nothing; items without id or text (or
with nothing left in plain form) take no part; items shorter than q characters must occur as
whole words; budgets shrink where the bound would fall below one; repeated documents
are judged each, equal items all count; documents are read whole; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.common import in_turn

Q = 8
WINDOW = 96
STEP = 16
BUDGET = 0.08
PART_CHARS = 1 << 20
GAP = 160                      # zeros between documents; more than a window and its band
SLICE = 1 << 18                # positions looked up at a time
BATCH = 1 << 18                # characters of the documents that are judged together
HITS = "array<struct<item_id:long,edits:int,windows:int>>"
_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("windows", pa.int32())]))

_BASE = 0x100000001B3
_PLAIN = {c: " " for c in range(128) if not chr(c).isalnum()}


def plain(text: str | None) -> str:
    return " ".join(text.lower().translate(_PLAIN).split()) if text else ""


def chars(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the eight characters from each position on."""
    n = max(0, len(data) - Q + 1)
    h = np.zeros(n, np.uint64)
    for i in range(Q):
        h *= np.uint64(_BASE)
        h += data[i:i + n]
    return h


def _slot(g: np.ndarray, bits: int) -> np.ndarray:
    return ((g ^ (g >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


class Index:
    """q-grams of all windows of some items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.windows: list[tuple[int, np.ndarray, int, int]] = []       # item, characters, budget, least shared q-grams
        self.short: list[tuple[int, str]] = []
        for item_id, text in items:
            p = plain(text)
            if 0 < len(p) < Q:
                self.short.append((item_id, f" {p} "))
                continue
            starts = [0] if len(p) <= WINDOW else [*range(0, len(p) - WINDOW, STEP), len(p) - WINDOW]
            for s in starts if p else ():
                w = chars(p[s:s + WINDOW])
                k = min(int(BUDGET * len(w)), (len(w) - Q) // Q)
                self.windows.append((item_id, w, k, len(w) - Q + 1 - k * Q))
        parts = [grams(w) for _, w, _, _ in self.windows]
        gram = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        own = np.repeat(np.arange(len(parts)), [len(p) for p in parts]).astype(np.int64)
        at = np.concatenate([np.arange(len(p)) for p in parts]).astype(np.int64) if parts else own
        order = np.argsort(gram, kind="stable")
        self.gram, first = np.unique(gram[order], return_index=True)
        self.first = np.append(first, len(gram))
        self.own, self.at = own[order], at[order]
        self.bits = max(16, min(24, int(math.log2(len(self.gram) + 1)) + 5))
        self.seen = np.zeros(1 << self.bits, dtype=bool)
        self.seen[_slot(self.gram, self.bits)] = True
        self.budget = np.array([k for _, _, k, _ in self.windows], dtype=np.int64)
        self.least = np.array([t for _, _, _, t in self.windows], dtype=np.int64)
        self.reach = int(max((len(w) + k for _, w, k, _ in self.windows), default=0))
        self.fewest = int(self.least.min()) if len(self.least) else 0

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose q-gram some window has, and the number of that q-gram; thinned to dense stretches."""
        found = []
        for s in range(0, max(0, len(data) - Q + 1), SLICE):
            part = grams(data[s:s + SLICE + Q - 1])
            may = np.flatnonzero(self.seen[_slot(part, self.bits)])
            where = np.searchsorted(self.gram, part[may])
            sure = self.gram[np.minimum(where, len(self.gram) - 1)] == part[may]
            found.append((may[sure] + s, where[sure]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pos, which = (np.concatenate(x) for x in zip(*found))
        # a window's q-grams lie within `reach` positions: at least `fewest` hits from some hit on
        last = np.searchsorted(pos, pos + self.reach, "right")
        dense = np.flatnonzero(last - np.arange(len(pos)) >= self.fewest)
        mark = np.bincount(dense, minlength=len(pos) + 1) - np.bincount(last[dense], minlength=len(pos) + 1)
        keep = np.cumsum(mark)[:-1] > 0
        return pos[keep], which[keep]

    def candidates(self, data: np.ndarray) -> set[tuple[int, int]]:
        """(window, band) with enough shared q-grams; a band is k + 1 diagonals wide."""
        if not self.windows:
            return set()
        pos, which = self.hits(data)
        if not len(pos):
            return set()
        out: set[tuple[int, int]] = set()
        n = self.first[which + 1] - self.first[which]
        cut = np.searchsorted(np.cumsum(n), np.arange(0, int(n.sum()), 4 * SLICE))     # postings are spread out in bounded parts
        # a part may end inside a stretch: neighbouring parts overlap by the reach of a window
        for a, b in zip(cut, [*cut[1:], len(pos)]):
            b = int(np.searchsorted(pos, pos[min(b, len(pos) - 1)] + self.reach, "right"))
            p, w, m = pos[a:b], which[a:b], n[a:b]
            entry = np.repeat(self.first[w] - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(int(m.sum()))
            own = self.own[entry]
            band = (np.repeat(p, m) - self.at[entry]) // (self.budget[own] + 1)
            key, count = np.unique(own * (1 << 40) + band + (1 << 20), return_counts=True)
            after = np.searchsorted(key, key + 1)
            both = count + np.where((after < len(key)) & (key[np.minimum(after, len(key) - 1)] == key + 1), count[np.minimum(after, len(key) - 1)], 0)
            before = np.searchsorted(key, key - 1)          # the lower band of the pair may hold no hit
            alone = ~((before < len(key)) & (key[np.minimum(before, len(key) - 1)] == key - 1))
            good = both >= self.least[key >> 40]
            out.update((int(x >> 40), int((x & ((1 << 40) - 1)) - (1 << 20))) for x in key[good])
            lower = alone & (count >= self.least[key >> 40])
            out.update((int(x >> 40), int((x & ((1 << 40) - 1)) - (1 << 20)) - 1) for x in key[lower])
        return out


def aligned(window: np.ndarray, data: np.ndarray, low: int, high: int, k: int) -> int | None:
    """Fewest edits (at most k) that turn the window into a part of ``data`` that starts on diagonals low..high."""
    w, first = high - low + 2 * k + 1, low - k
    n = len(window)
    cells = np.zeros(n + w, np.uint32)
    a, b = max(0, first), min(len(data), first + n + w)
    if b > a:
        cells[a - first:b - first] = data[a:b]
    where = np.flatnonzero(cells[:w + 1] == window[0])
    if any(np.array_equal(cells[i:i + n], window) for i in where):
        return 0
    step = np.arange(w)
    row = np.zeros(w, np.int64)
    for r in range(n):
        new = row + (cells[r:r + w] != window[r])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        row = np.minimum.accumulate(new - step) + step
        if row.min() > k:
            return None
    return int(row.min()) if row.min() <= k else None


def find_items(texts: list[str | None], index: Index) -> list[list[tuple[int, int, int]]]:
    """Per text the items it contains: (item, fewest edits, windows found)."""
    docs = [plain(t) for t in texts]
    starts = np.cumsum([0] + [len(d) + GAP for d in docs])
    data = chars(("\0" * GAP).join([*docs, ""]))
    found: list[dict[int, dict[int, int]]] = [{} for _ in docs]
    for own, band in index.candidates(data):
        item, window, k, _ = index.windows[own]
        low = band * (k + 1)
        high = low + 2 * (k + 1) - 1
        edits = aligned(window, data, low, high, k)
        if edits is not None:
            doc = int(np.searchsorted(starts, max(0, low + len(window) // 2), "right")) - 1
            if 0 <= doc < len(docs):
                best = found[doc].setdefault(item, {})
                best[own] = min(edits, best.get(own, edits))
    for doc, text in enumerate(docs):
        for item, word in index.short:
            if word in f" {text} ":
                found[doc].setdefault(item, {})[-1] = 0
    return [sorted((item, min(ws.values()), len(ws)) for item, ws in f.items()) for f in found]


def _batches(texts, size: int = BATCH):
    """Consecutive texts of about ``size`` characters; a longer one by itself."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t) if t else 0
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def leak_column(text: Column, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Column:
    """array<struct<item_id, edits, windows>> of the benchmark items found in each text."""
    spark = benchmark.sparkSession
    items = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = max(1, math.ceil(2 * size / PART_CHARS))

    def column(part: int) -> Column:
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).collect()       # about PART_CHARS / 2 characters
        shared = spark.sparkContext.broadcast(Index([(r.i, r.t) for r in own]))

        @F.arrow_udf(HITS)
        def leaks(texts: pa.Array) -> pa.Array:
            out = [f for batch in _batches(in_turn(texts)) for f in find_items(batch, shared.value)]
            return pa.array([[{"item_id": i, "edits": e, "windows": w} for i, e, w in f] for f in out], _HITS)

        return leaks(text)

    return F.concat(*(column(p) for p in range(parts)))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, windows): one row per document and benchmark item that it contains."""
    found = docs.select(F.col(id_col).alias("doc_id"), leak_column(F.col(text_col), benchmark).alias("found"))
    return found.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.item_id", "f.edits", "f.windows")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that contain no benchmark item, unchanged."""
    return docs.where(F.size(leak_column(F.col(text_col), benchmark)) == 0)

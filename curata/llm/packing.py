"""Packing documents into sequences by minimum bin slack.

A task encodes its documents (ids, then an end id) and cuts every window of ``capacity`` ids off
a document's start into a sequence of its own; what remains of each document goes to a pool.
Windows are filled from the pool by minimum bin slack: the longest piece opens the window, and
a subset-sum over the multiset of the other lengths (a bitset in which bit s says that
the sum s can be reached, lengths with their counts split into powers of two) finds the sum closest to
the room that is left; walking the bitsets back gives how many pieces of each length to take.  The same
choice serves while the counts last.  Room that no choice fills gets the start of another piece
(documents may be cut anywhere).  The last ids of a task, less than one window, are cut into sequences
whose lengths are powers of two, which need no padding: so no sequence is padded at all.

Each task packs for itself: nothing is shuffled or gathered, memory is the pool (``pool`` ids, whatever
the table's size) and one document.  A sequence never spans tasks; tasks should hold some thousand documents,
or the short last sequences weigh more.

Defined results: a null text is empty and gives the end id alone; repeated rows and null doc_ids are
documents of their own; an empty table gives no rows; other columns play no part.  Sequence ids are unique in one
evaluation (task number and a count) but not dense, and a second evaluation over other file splits packs
otherwise: write the result once where several readers need the same one.
"""

from __future__ import annotations

import json
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POOL = 1 << 20      # ids that a task keeps to choose from
BATCH = 1 << 20     # ids in one batch of results


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes for themselves, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_byte_bpe(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(token bytes -> id, special string -> id) of a byte-level BPE in a tokenizers file.

    The ids serve as merge ranks, so the file's merges must make the tokens in the order of their ids; else an error.
    """
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    specials = {t["content"]: t["id"] for t in j["added_tokens"]}
    vocab, symbols = j["model"]["vocab"], byte_symbols()
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in j["model"]["merges"]]
    if made != sorted(made) or j["normalizer"] is not None:
        raise ValueError(f"{path}: not a plain byte-level vocabulary whose ids follow its merges")
    return {bytes(symbols[c] for c in t): i for t, i in vocab.items() if t not in specials}, specials


_ENCODERS: dict[tuple, object] = {}


def encoder(ranks: dict[bytes, int], pattern: str, specials: dict[str, int]):
    """The encoder of a vocabulary, made once per worker process."""
    key = (len(ranks), hash(next(iter(ranks), b"")), hash(next(reversed(ranks), b"")), pattern, tuple(specials.items()))
    if key not in _ENCODERS:
        import tiktoken

        _ENCODERS[key] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials)
    return _ENCODERS[key]


def closest_fill(counts: dict[int, int], lengths: list[int], room: int) -> tuple[dict[int, int], int]:
    """({length: how many}, their sum): the choice out of ``counts`` whose sum comes closest to ``room`` from below.

    ``lengths``: the keys of ``counts``, ascending.  Longer pieces are tried first, and the search ends once the room is met.
    """
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for i in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[i]
        left, k = min(counts[length], room // length), 1
        while left > 0:
            take = min(k, left)
            grown = (reach | reach << length * take) & mask
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left, k = left - take, 2 * k
        if reach >> room:
            break
    at = total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen, total


class Pool:
    """Pieces (document number, start, ids) by length, and the windows made of them."""

    def __init__(self, capacity: int):
        self.capacity, self.by_length, self.counts, self.lengths, self.ids = capacity, {}, {}, [], 0

    def add(self, doc, start: int, ids: np.ndarray) -> None:
        n = len(ids)
        if not self.counts.get(n):
            insort(self.lengths, n)
            self.counts[n], self.by_length[n] = 0, []
        self.counts[n] += 1
        self.by_length[n].append((doc, start, ids))
        self.ids += n

    def take(self, n: int):
        self.counts[n] -= 1
        self.ids -= n
        if not self.counts[n]:
            del self.counts[n]
            del self.lengths[bisect_right(self.lengths, n) - 1]
        return self.by_length[n].pop()

    def cut(self, n: int):
        """The first n ids of the longest piece; the rest goes back."""
        doc, start, ids = self.take(self.lengths[-1])
        if n < len(ids):
            self.add(doc, start + n, ids[n:])
        return doc, start, ids[:n]

    def windows(self, until: int) -> Iterator[list]:
        """Full windows while the pool holds more than ``until`` ids and fills one."""
        while self.ids > until and self.ids >= self.capacity:
            seed = self.lengths[-1]
            others = self.counts | {seed: self.counts[seed] - 1}
            chosen, total = closest_fill(others, self.lengths, self.capacity - seed)
            chosen[seed] = chosen.get(seed, 0) + 1
            slack = self.capacity - seed - total
            for _ in range(1 if slack else min(self.counts[n] // k for n, k in chosen.items())):      # a cut changes the counts
                window = [self.take(n) for n, k in chosen.items() for _ in range(k)]
                while slack:
                    window.append(self.cut(min(slack, self.lengths[-1])))
                    slack -= len(window[-1][2])
                yield window
                if self.ids <= until or self.ids < self.capacity:
                    break

    def tail(self) -> Iterator[list]:
        """What is left, less than a window, in sequences of powers of two."""
        while self.ids:
            want, window = 1 << self.ids.bit_length() - 1, []
            while want:
                window.append(self.cut(min(want, self.lengths[-1])))
                want -= len(window[-1][2])
            yield window


def pack_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, specials: dict[str, int] | None = None, capacity: int = 2048,
                   end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", pool: int = POOL, rows: int = 128) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): one row per piece.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit numbers, ready to be written to a training file.
    Strings of ``specials`` inside a text become their ids.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks, specials or {}))
    id_type = docs.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, special = shared.value
        enc = encoder(known, pattern, special)
        here, n_sequences, open_pool = TaskContext.get().partitionId() << 40, 0, Pool(capacity)
        out: list[tuple] = []
        held = 0

        def put(window: list) -> None:
            nonlocal n_sequences, held
            at = 0
            for (doc_id, n), start, ids in window:
                out.append((doc_id, start, len(ids), n, here + n_sequences, at, ids.tobytes()))
                at += len(ids)
            n_sequences += 1
            held += at

        def drain() -> pa.RecordBatch:
            nonlocal held
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            kinds = [kind, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
            out.clear()
            held = 0
            return batch

        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    text = text or ""
                    found = enc.encode(text, allowed_special="all") if any(s in text for s in special) else enc.encode_ordinary(text)
                    found.append(end_id)
                    ids = np.array(found, dtype="<u4")
                    doc, full = (doc_id, len(ids)), len(ids) - len(ids) % capacity
                    for start in range(0, full, capacity):
                        put([(doc, start, ids[start:start + capacity])])
                    if full < len(ids):
                        open_pool.add(doc, full, ids[full:])
                    if held >= BATCH:
                        yield drain()
                if open_pool.ids > pool:
                    for window in open_pool.windows(pool // 2):
                        put(window)
                if held >= BATCH:
                    yield drain()
        for windows in (open_pool.windows(0), open_pool.tail()):
            for window in windows:
                put(window)
                if held >= BATCH:
                    yield drain()
        if out:
            yield drain()

    schema = f"doc_id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(pack, schema)

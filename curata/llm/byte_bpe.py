"""Byte-level BPE: encoding by ranked merges of byte pieces, decoding by joining pieces.

A text is cut by the vocabulary's pattern; each match is encoded by itself.  A match that is a
token is that token; otherwise its bytes are folded: the adjacent pair of lowest rank
(leftmost first) is merged until no pair has a rank.  Every task keeps the ids of matches in a
bounded memo and folds the distinct matches of some texts that it does not know together: a match is a lane of
NumPy arrays, and a step merges one pair of every lane.  Matches longer than ``LANE`` bytes are
folded one by one, those longer than ``LONG`` through a heap of pairs, so one endless word costs n log n.

Decoding stays in the JVM: ids look up a literal array of the pieces (as hex), the pieces are
joined and turned to bytes.

Ranks are read from a vocabulary file on the driver and go to the tasks with the function (the
file is bounded: one vocabulary).  Defined results: a null text is empty (no ids); texts are
encoded whole, special tokens are ordinary text; repeated rows are encoded each; an empty
table gives no rows; ids outside the vocabulary decode to nothing; other columns play no part.
"""

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.session import checkpointed

LONG = 256          # bytes; longer matches are merged through a heap
LANE = 64           # bytes; longer matches are folded one by one
LANES = 2048        # matches folded together
MEMO = 100_000      # matches in each of the two halves of a task's memo
MEMO_CHARS = 1 << 22    # and their characters
_NONE = np.iinfo(np.int64).max


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def fold(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > LONG:
        return _fold_long(piece, ranks)
    none = 1 << 60
    parts = [piece[i:i + 1] for i in range(len(piece))]
    pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs:
        least = min(pairs)
        if least == none:
            break
        i = pairs.index(least)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _fold_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of (rank, place) over a linked list of pieces."""
    n = len(piece)
    end = list(range(1, n + 1))           # where the piece that starts at i ends; 0 once it was merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not end[i] or end[i] >= n or end[end[i]] != stop:
            continue                      # one of the two has changed since
        gone = end[i]
        end[i], end[gone] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (left := before[i]) >= 0 and (r := ranks.get(piece[left:stop])) is not None:
            heapq.heappush(heap, (r, left, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:end[i]]])
        i = end[i]
    return ids


class Merges:
    """What pairs of pieces merge to, as arrays: made once on the driver.

    A piece is known by its rank (ranks are distinct); single bytes without one and the padding get numbers above all ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.above = ranks, max(ranks.values(), default=-1) + 1
        self.padding = self.above + 256
        parts = {bytes([b]): self.above + b for b in range(256)} | ranks
        found = sorted((parts[token[:k]] * (self.padding + 1) + parts[token[k:]], rank) for token, rank in ranks.items()
                       for k in range(1, len(token)) if token[:k] in parts and token[k:] in parts)
        self.pairs, self.merged = np.array([*found, (_NONE, _NONE)], np.int64).T.copy()     # the last fits no pair
        self.bytes = np.array([parts[bytes([b])] for b in range(256)], np.int64)
        self.of_bytes = self.rank(np.repeat(self.bytes, 256), np.tile(self.bytes, 256))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of pieces joined, or _NONE."""
        pair = left * (self.padding + 1) + right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.merged[at], _NONE)

    def fold_all(self, matches: list[str]) -> dict[str, bytes]:
        """match -> its ids as 32-bit integers."""
        out = {}
        matches = sorted(matches, key=len)      # lanes of like length together
        for at in range(0, len(matches), LANES):
            pieces = {match: match.encode("utf-8") for match in matches[at:at + LANES]}
            lanes = {match: piece for match, piece in pieces.items() if 1 < len(piece) <= LANE and piece not in self.ranks}
            out |= {match: np.array(fold(piece, self.ranks), np.int32).tobytes() for match, piece in pieces.items() if match not in lanes}
            if lanes:
                ids, ends = self._fold_lanes(list(lanes.values()))
                raw, ends = ids.tobytes(), (4 * ends).tolist()
                out |= {match: raw[i:j] for match, i, j in zip(lanes, [0, *ends], ends)}
        return out

    def _fold_lanes(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, where those of each end).

        A column is a lane, a row a byte's place.  ``after`` and ``before`` link the places where pieces start; a last row of
        padding stands before the first and after the last.  ``keys``: rank and place of the pair that starts there, in one number."""
        size = np.array([len(p) for p in pieces])
        n, width = len(pieces), int(size.max())
        text = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width).T.astype(np.int64, order="C")
        place = np.arange(width + 1)[:, None]
        ids = np.full((width + 1, n), self.padding)
        ids[:-1] = np.where(place[:-1] < size, self.bytes[text], self.padding)
        keys = np.full((width + 1, n), _NONE)
        first = self.of_bytes[text[:-1] * 256 + text[1:]]
        keys[:-2] = np.where((place[1:-1] < size) & (first < _NONE), first * width + place[:-2], _NONE)
        after, before = (place + 1).repeat(n), (place - 1).repeat(n)
        before[:n] = width
        flat_ids, flat_keys = ids.reshape(-1), keys.reshape(-1)
        while True:
            least = keys.min(axis=0)
            lane = np.flatnonzero(least < _NONE)
            if not len(lane):
                break
            rank, at = np.divmod(least[lane], width)
            here = at * n + lane
            gone = after[here] * n + lane
            right = after[gone]
            left = before[here]
            flat_ids[here], flat_ids[gone], flat_keys[gone] = rank, self.padding, _NONE
            after[here], before[right * n + lane] = right, at
            for start, key in ((at, self.rank(rank, flat_ids[right * n + lane])), (left, self.rank(flat_ids[left * n + lane], rank))):
                flat_keys[start * n + lane] = np.where(key < _NONE, key * width + start, _NONE)
        kept = (ids < self.padding).T
        found = ids.T[kept]
        if (found >= self.above).any():
            raise KeyError("a byte without a rank")
        return found.astype(np.int32), kept.sum(axis=1).cumsum()


class Memo:
    """match -> ids, in two halves: when the newer one is full it becomes the older one, and what that held is forgotten
    unless it was asked for meanwhile."""

    def __init__(self, merges: Merges):
        self.merges, self.ids, self.old, self.size = merges, {}, {}, 0

    def learn(self, matches: set[str]) -> dict[str, bytes]:
        """A map that holds the ids of all these matches."""
        if len(self.ids) >= MEMO or self.size >= MEMO_CHARS:
            self.old, self.ids, self.size = self.ids, {}, 0
        new = matches.difference(self.ids)
        back = {m: self.old[m] for m in new if m in self.old}
        self.ids |= back
        self.ids |= self.merges.fold_all([m for m in new if m not in back])
        self.size += sum(map(len, new))
        return self.ids


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 128) -> DataFrame:
    """(doc_id, ids): token ids of every text.  Tasks turn ``rows`` texts at a time into Python objects, so memory stays small."""
    shared = docs.sparkSession.sparkContext.broadcast(Merges(ranks))
    id_type = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, memo = regex.compile(pattern).findall, Memo(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                matches = [find(t) if t else [] for t in part.column(1).to_pylist()]
                known = memo.learn(set(chain.from_iterable(matches))).__getitem__
                found = [b"".join(map(known, m)) for m in matches]
                ends = np.cumsum([0, *map(len, found)]) // 4
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(encode, f"doc_id {id_type}, ids array<int>")


def decode_column(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of the ids, joined."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    table = F.split(F.lit(",".join(pieces)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""))


# ---- the same encoding by Spark's higher-order functions alone -----------------------------------------
# Measured and not used by the query: see the README.

_BUCKETS = 1 << 16


def _java(pattern: str) -> str:
    """The cutting pattern for Java's regular expressions, with white space as Unicode has it."""
    return "(?U)" + pattern


def rank_table(ranks: dict[bytes, int]) -> Column:
    """The rank map as a literal: array by hash of the piece of arrays of (hex of the piece, rank).

    (A literal map is searched entry by entry, 50,000 for each lookup.)  Parsed once, when the plan is made."""
    import json
    import zlib

    rows: list[list[str]] = [[] for _ in range(_BUCKETS)]
    for piece, rank in ranks.items():
        rows[zlib.crc32(piece.hex().upper().encode()) % _BUCKETS].append(f"{piece.hex().upper()}:{rank}")
    return F.from_json(F.lit(json.dumps(rows)), "array<array<string>>")


def fold_column(word: Column, ranks: Column) -> Column:
    """array<int>: the ids of one match, its byte pieces (as hex) merged by rank in a fold.

    ``ranks``: ``rank_table``."""
    none = F.lit(1 << 30)

    def rank(piece: Column) -> Column:
        row = F.get(ranks, (F.crc32(piece.cast("binary")) % _BUCKETS).cast("int"))
        mine = F.filter(row, lambda x: F.substring_index(x, ":", 1) == piece)
        return F.coalesce(F.substring_index(F.get(mine, 0), ":", -1).cast("int"), none)

    hexed = F.hex(word.cast("binary"))
    bytes_ = F.transform(F.sequence(F.lit(0), F.octet_length(word) - 1), lambda i: F.substring(hexed, 2 * i + 1, F.lit(2)))

    def merge(pieces: Column, _: Column) -> Column:
        pairs = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda a, i: rank(F.concat(a, F.get(pieces, i + 1))))
        least = F.array_min(pairs)
        at = F.array_position(pairs, least).cast("int")
        joined = F.concat(F.slice(pieces, 1, at - 1), F.array(F.concat(F.get(pieces, at - 1), F.get(pieces, at))),
                          F.slice(pieces, at + 2, F.size(pieces)))
        return F.when((F.size(pieces) > 1) & (F.coalesce(least, none) < none), joined).otherwise(pieces)

    folded = F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), bytes_, merge)
    whole = rank(hexed)
    return F.when(F.octet_length(word) == 0, F.array().cast("array<int>")).when(whole < none, F.array(whole)).otherwise(F.transform(folded, rank))


def encode_by_words(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) like ``encode_documents``: distinct matches are folded once and joined back by document and place."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    rows = checkpointed(rows, "bpe-rows")
    matches = rows.select("row", F.posexplode(F.regexp_extract_all("text", F.lit(_java(pattern)), F.lit(0))).alias("place", "word"))
    folded = checkpointed(matches.select("word").distinct().select("word", fold_column(F.col("word"), rank_table(ranks)).alias("ids")), "bpe-words")
    found = matches.join(folded, "word").groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "ids"))), lambda x: x["ids"])).alias("ids"))
    return rows.select("row", "doc_id").join(found, "row", "left").select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))

"""Alignment of two tokenisations of the same texts.

Every text is encoded by a byte-level BPE (A, over a space and the text) and by a sentence-piece
model (B, which puts that space itself).  A task lays the tokens of a batch of documents end to
end as byte offsets, cuts every document into lanes of at most ``LANE`` B tokens (a lane starts at
the A token that covers its first byte) and merges all lanes in lockstep: one NumPy vector holds the A and B places of
every lane; a step emits the link under each lane's pointers, a cut where both tokens end at the same byte, moves the pointer of
the token that ends first (both at a cut) and drops the lanes that are done.  Lanes keep the number of steps small and
equal, however long a document is.

The links of a document leave the task as distinct (A id, B id) pairs with how many links hold them.  Counts over the corpus
are a sum per pair.  They are brought back to the documents in two parts: the most frequent pairs, at most ``HEAD`` of
them by a histogram of their counts, are broadcast and looked up in place; the rest are joined through a shuffle.

Defined results: null and empty texts, and texts that a side doesn't give back byte for byte, have no tokens, zeros and an empty
groups string; special strings in a text are plain text; repeated rows and null doc_ids count as documents of their own; an
empty table gives no rows; other columns play no part.  Memory of a task: one batch of about ``TOKENS`` tokens, or one document
if that is longer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.packing import encoder
from curata.session import checkpointed

LANE = 256              # B tokens of a lane
TOKENS = 400_000        # A tokens of a batch
HEAD = 500_000          # pairs that are broadcast at most (about 40 MB)
SEPARATORS = ",|;"      # inside a group's side, after its A side, after the group; nothing after the last group


def piece_bytes(processor) -> list[bytes]:
    """The bytes of every piece of a sentence-piece model; control and unknown pieces have none."""
    out = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if processor.is_byte(i):
            out.append(bytes([int(re.fullmatch("<0x(..)>", piece)[1], 16)]))
        elif processor.is_control(i) or processor.is_unknown(i):
            out.append(b"")
        else:
            out.append(piece.replace("▁", " ").encode())
    return out


_MODELS: dict[tuple, tuple] = {}


def model(serialised: bytes):
    """(processor, bytes of its pieces), made once per worker process."""
    key = (len(serialised), hash(serialised))
    if key not in _MODELS:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_proto=serialised)
        _MODELS[key] = own, piece_bytes(own)
    return _MODELS[key]


def number_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and lengths of every number below ``size`` followed by each separator, or by none: row 4 * number + kind."""
    words = [str(i).encode() + s for i in range(size) for s in (*(c.encode() for c in SEPARATORS), b"")]
    width = max(map(len, words), default=1)
    table = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
    return table, np.array([len(w) for w in words], np.int64)


def lockstep(end_a: np.ndarray, end_b: np.ndarray, size_b: np.ndarray, first_b: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, ...]:
    """Links (places in A, places in B) and cuts (places in A, places in B) of documents laid end to end.

    ``end_a``, ``end_b``: the byte at which each token ends; ``first_b``: where each document's B tokens start, and their number.
    """
    begin, stop = first_b[:-1], first_b[1:]
    lanes = -(-(stop - begin) // lane)
    doc = np.repeat(np.arange(len(begin)), lanes)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    j = begin[doc] + nth * lane
    last = np.minimum(j + lane, stop[doc])
    i = np.searchsorted(end_a, end_b[j] - size_b[j], side="right")
    links_a, links_b, cuts_a, cuts_b = [i[:0]], [j[:0]], [i[:0]], [j[:0]]
    while len(j):
        links_a.append(i)
        links_b.append(j)
        a, b = end_a[i], end_b[j]
        both = a == b
        cuts_a.append(i[both])
        cuts_b.append(j[both])
        i, j = i + (a <= b), j + (b <= a)
        live = j < last
        if not live.all():
            i, j, last = i[live], j[live], last[live]
    return tuple(map(np.concatenate, (links_a, links_b, cuts_a, cuts_b)))


def group_strings(ids_a: np.ndarray, ids_b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray,
                  table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets by document) of ``a1,a2|b1;a3|b2,b3``."""
    cuts_a, cuts_b = np.sort(cuts_a), np.sort(cuts_b)
    kind_a, kind_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    kind_a[cuts_a], kind_b[cuts_b] = 1, 2
    group_a, group_b = np.cumsum(kind_a == 1) - (kind_a == 1), np.cumsum(kind_b == 2) - (kind_b == 2)
    ends = first_b[1:][np.diff(first_b) > 0] - 1
    kind_b[ends] = 3
    codes = np.empty(len(ids_a) + len(ids_b), np.int64)
    codes[np.arange(len(ids_a)) + np.concatenate(([0], cuts_b + 1))[group_a]] = 4 * ids_a + kind_a
    codes[np.arange(len(ids_b)) + (cuts_a + 1)[group_b]] = 4 * ids_b + kind_b
    words, lengths = table
    size = lengths[codes]
    data = words[codes][np.arange(words.shape[1]) < size[:, None]]
    return data, np.concatenate(([0], np.cumsum(size)))[first_a + first_b]


def align_documents(docs: DataFrame, a_ranks: dict[bytes, int], a_pattern: str, b_model: bytes, id_col: str = "doc_id", text_col: str = "text",
                    rows: int = 128) -> DataFrame:
    """(row_id, doc_id, n_a, n_b, n_groups, n_links, groups, pairs, pair_links): one row per document.

    ``groups``: decimal ids of both sides per group.  ``pairs``: the distinct linked pairs as A id * 2^32 + B id, ascending;
    ``pair_links``: how many links hold each.  ``row_id`` tells rows apart; write the result once before using it.
    """
    shared = docs.sparkSession.sparkContext.broadcast((a_ranks, b_model))
    id_type = docs.schema[id_col].dataType.simpleString()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, serialised = shared.value
        enc = encoder(ranks, a_pattern, {})
        processor, bytes_b = model(serialised)
        len_a = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for token, i in ranks.items():
            len_a[i] = len(token)
        len_b = np.array([len(x) for x in bytes_b], np.int64)
        table = number_table(max(len(len_a), len(len_b)))
        base, done = TaskContext.get().partitionId() << 40, 0
        names: list = []
        all_a: list[list[int]] = []
        all_b: list[list[int]] = []
        held = 0

        def drain() -> pa.RecordBatch:
            nonlocal done, held
            n = len(names)
            n_a, n_b = (np.fromiter(map(len, x), np.int64, n) for x in (all_a, all_b))
            ids_a, ids_b = (np.fromiter((i for x in side for i in x), np.int64, int(k.sum())) for side, k in ((all_a, n_a), (all_b, n_b)))
            first_a, first_b = (np.concatenate(([0], np.cumsum(k))) for k in (n_a, n_b))
            size_b = len_b[ids_b]
            links_a, links_b, cuts_a, cuts_b = lockstep(np.cumsum(len_a[ids_a]), np.cumsum(size_b), size_b, first_b)
            doc_b = np.repeat(np.arange(n), n_b)
            key = (doc_b[links_b] * len(len_a) + ids_a[links_a]) * len(len_b) + ids_b[links_b]
            key, times = np.unique(key, return_counts=True)
            rest, b = np.divmod(key, len(len_b))
            owner, a = np.divmod(rest, len(len_a))
            starts = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
            data, offsets = group_strings(ids_a, ids_b, cuts_a, cuts_b, first_a, first_b, table)
            count = lambda places: pa.array(np.bincount(doc_b[places], minlength=n), pa.int64())
            batch = pa.RecordBatch.from_arrays([
                pa.array(np.arange(base + done, base + done + n), pa.int64()), pa.array(names, kind), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()),
                count(cuts_b), count(links_b), pa.StringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)),
                pa.ListArray.from_arrays(pa.array(starts), pa.array((a << 32) + b, pa.int64())), pa.ListArray.from_arrays(pa.array(starts), pa.array(times, pa.int32()))],
                ["row_id", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "pair_links"])
            done += n
            held = 0
            for x in (names, all_a, all_b):
                x.clear()
            return batch

        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, text, b in zip(part.column(0).to_pylist(), texts, processor.encode(texts, num_threads=1)):
                    a = enc.encode_ordinary(" " + text) if text else []
                    if a:
                        raw = (" " + text).encode()
                        if enc.decode_bytes(a) != raw or b"".join([bytes_b[i] for i in b]) != raw:
                            a = []
                    names.append(doc_id)
                    all_a.append(a)
                    all_b.append(b if a else [])
                    held += len(a)
                    if held >= TOKENS:
                        yield drain()
        if names:
            yield drain()

    schema = (f"row_id long, doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, "
              "pair_links array<int>")
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(align, schema)


def _links(aligned: DataFrame) -> DataFrame:
    """One row per document and linked pair: (row_id, pair, n)."""
    return aligned.select("row_id", F.explode(F.arrays_zip(F.col("pairs").alias("pair"), F.col("pair_links").alias("n"))).alias("x")).select("row_id", "x.pair", "x.n")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, links, best): links of each pair over the corpus, and whether no pair of its B id has more."""
    counts = _links(aligned).groupBy("pair").agg(F.sum("n").alias("links")).withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1))
    counts = checkpointed(counts, "pair-counts")
    most = counts.groupBy("b").agg(F.max("links").alias("most"))
    return counts.join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, counts: DataFrame, head: int = HEAD) -> DataFrame:
    """(row_id, n_best, count_sum) of every document with links; ``aligned`` and ``counts`` should be written tables."""
    sizes = {r["k"]: r["n"] for r in counts.groupBy(F.floor(F.log2("links")).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}     # at most 63 rows
    least, room = 63, head
    while least > 0 and sizes.get(least - 1, 0) <= room:
        least -= 1
        room -= sizes.get(least, 0)
    value = (F.col("links") * 2 + F.col("best").cast("long")).alias("value")
    frequent = counts.where(F.col("links") >= (1 << least)).select("pair", value)
    links = _links(aligned)
    found = [links.join(F.broadcast(frequent), "pair")]
    if least:
        rare = counts.where(F.col("links") < (1 << least)).select("pair", value)
        found.append(links.join(F.broadcast(frequent.select("pair")), "pair", "left_anti").join(rare, "pair"))
    n_best, total = F.sum(F.col("n") * F.col("value").bitwiseAND(1)).alias("n_best"), F.sum(F.col("n") * F.shiftright("value", 1)).alias("count_sum")
    parts = [x.groupBy("row_id").agg(n_best, total) for x in found]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).groupBy("row_id").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def with_scores(aligned: DataFrame, head: int = HEAD) -> DataFrame:
    """``aligned`` (a written table) with n_best and count_sum instead of its pairs; documents without tokens have zeros."""
    scores = score_links(aligned, checkpointed(pair_counts(aligned), "pair-scores"), head)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rest = [c for c in aligned.columns if c not in ("row_id", "pairs", "pair_links")]
    return aligned.join(scores, "row_id", "left").select(*rest, zero("n_best"), zero("count_sum"))

"""Note sections, vocabulary, token encoding and hashed features.

Counting is explode -> aggregate.  Encoding looks frequent words up in place and
joins only rare ones; the note side is never collected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curata.functions.text import REASSEMBLED_HEADINGS, SECTIONS, extract_section, words
from curata.operators.keys import note_key
from curata.operators.ranking import range_row_number
from curata.session import checkpointed

# Special token ids and names.
SPECIALS = ((0, "[PAD]"), (1, "[CLS]"), (2, "[SEP]"), (3, "[UNK]"))
PAD, CLS, SEP, UNK = 0, 1, 2, 3
MAX_LEN = 512
HEAD_WORDS = 500_000        # words that encode_tokens broadcasts at most
HEAD_BYTES = 16 << 20
PART = 64                   # words of a note that go to Python in one row


def extract_sections(df: DataFrame, text: str = "text", blank_brackets: bool = False) -> DataFrame:
    """add one column per admission section.

    `blank_brackets=True` empties sections that start with "[]" (the reference
    meant to, but its assignment has no effect, so the default keeps them).
    """
    cols = {}
    for name, heading in SECTIONS:
        c = extract_section(text, heading)
        cols[name] = F.when(c.startswith("[]"), F.lit("")).otherwise(c) if blank_brackets else c
    return df.withColumns(cols)


def filter_has_section(df: DataFrame) -> DataFrame:
    """Keep notes with at least one non-empty section."""
    cond = F.lit(False)
    for name, _ in SECTIONS:
        cond = cond | (F.col(name) != "")
    return df.where(cond)


def reassemble_sections(df: DataFrame, out: str = "text") -> DataFrame:
    """Headings + sections joined by blank lines."""
    parts = []
    for i, ((name, _), head) in enumerate(zip(SECTIONS, REASSEMBLED_HEADINGS)):
        if i:
            parts.append(F.lit("\n\n"))
        parts += [F.lit(head), F.col(name)]
    return df.withColumn(out, F.concat(*parts))


def build_vocab(docs: DataFrame, text: str = "text", max_size: int | None = None, min_count: int = 1) -> DataFrame:
    """Word vocabulary; ids 0-3 special, then by (count desc, token).

    The token counts are a partial+final hash aggregate.  With ``max_size`` the top (max_size - 4)
    is a TakeOrdered (per-task top-k, then merge); without it every token of at least
    ``min_count`` occurrences gets an id, ranked by ranges of (n, token), so the many
    tokens of one count are split too.
    """
    counts = (docs.select(F.explode(words(text)).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("n"))
              .where(F.col("n") >= min_count))
    if max_size is None:
        ranked = range_row_number(counts, [], [F.desc("n"), F.asc("token")], "__r")
        learned = ranked.select((F.col("__r") + (len(SPECIALS) - 1)).cast("int").alias("token_id"), "token", "n")
    else:
        top = counts.orderBy(F.desc("n"), "token").limit(max_size - len(SPECIALS))
        learned = top.select((F.row_number().over(Window.orderBy(F.desc("n"), "token")) + (len(SPECIALS) - 1))
                             .cast("int").alias("token_id"), "token", "n")
    specials = docs.sparkSession.createDataFrame([(i, t, 0) for i, t in SPECIALS], "token_id int, token string, n long")
    return specials.unionByName(learned)


def frequent_words(vocab: DataFrame, max_words: int = HEAD_WORDS, max_bytes: int = HEAD_BYTES) -> pa.Array:
    """The words of the smallest ids, at most ``max_words`` and at most ``max_bytes`` of UTF-8, in id order from id 4 on."""
    top = vocab.where(F.col("token_id").between(UNK + 1, UNK + max_words)).select("token_id", "token")
    size = top.agg(F.sum(F.octet_length("token"))).first()[0] or 0
    if size > max_bytes:                          # long words: keep the part that fits
        total = F.sum(F.octet_length("token")).over(Window.orderBy("token_id"))
        top = top.withColumn("__b", total).where(F.col("__b") <= max_bytes).drop("__b")
    words = top.toArrow()
    return words.sort_by("token_id")["token"].combine_chunks().cast(pa.string())


def _whole_notes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows of (keys, part, words), cut before a note's first part; a note whose parts go on waits for the next batch."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        first = pc.equal(batch.column(batch.num_columns - 2), 0).to_numpy(zero_copy_only=False).nonzero()[0]
        if len(first):
            yield batch.slice(0, first[-1])
            batch = batch.slice(first[-1])
        rest = batch
    if rest is not None:
        yield rest


def look_up_notes(batches: Iterator[pa.RecordBatch], known: pa.Array, keys: Sequence[str], base: int = 0) -> Iterator[pa.RecordBatch]:
    """(keys, __row, __ids, __rest) of each note from the rows (keys, part, words) of its parts, one after the other; rows are numbered from ``base`` on."""
    done = 0
    for batch in _whole_notes(batches):
        first = pc.equal(batch.column(batch.num_columns - 2), 0).to_numpy(zero_copy_only=False).nonzero()[0]
        if not len(first):
            continue
        lists = batch.column(batch.num_columns - 1)
        flat, offsets = lists.flatten(), lists.offsets.to_numpy()
        at = (offsets - offsets[0])[[*first, len(lists)]]
        found = pc.index_in(flat, value_set=known)
        ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pc.add(found, pa.scalar(UNK + 1, pa.int32())))
        missed = pc.is_null(found).to_numpy(zero_copy_only=False).nonzero()[0]
        place = missed - at[at.searchsorted(missed, side="right") - 1]
        rest = pa.StructArray.from_arrays([pa.array(place, pa.int32()), flat.take(pa.array(missed))], ["pos", "token"])
        row = pa.array(range(base + done, base + done + len(first)), pa.int64())
        done += len(first)
        own = [c.take(pa.array(first)) for c in batch.columns[:-2]]
        yield pa.RecordBatch.from_arrays([*own, row, ids, pa.ListArray.from_arrays(pa.array(missed.searchsorted(at), pa.int32()), rest)],
                                         [*keys, "__row", "__ids", "__rest"])


def _look_up_in_place(tokens: DataFrame, keys: Sequence[str], head: pa.Array) -> DataFrame:
    """(keys, __row, __ids, __rest): ids of the head's words in place, null elsewhere, and the other words with their positions.

    Arrow batches are bounded in rows, so a note's words go in rows of ``PART`` words: a batch and what is made of it stay small."""
    shared = tokens.sparkSession.sparkContext.broadcast(head)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from look_up_notes(batches, shared.value, keys, TaskContext.get().partitionId() << 33)

    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size("__t") - 1, F.lit(0)), F.lit(PART)), lambda s: F.slice("__t", s + 1, PART))
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.select(*keys).schema)
    return tokens.select(*keys, F.posexplode(parts).alias("__part", "__words")).mapInArrow(
        look_up, f"{own}, __row long, __ids array<int>, __rest array<struct<pos:int,token:string>>")


def encode_tokens(docs: DataFrame, vocab: DataFrame, key: str | Sequence[str] | None = None, text: str = "text",
                  max_len: int = MAX_LEN, head_words: int = HEAD_WORDS) -> DataFrame:
    """[CLS] tokens [SEP], cut to max_len including both, padded with 0; mask 1/0.

    A split dictionary: the most frequent words, bounded in number and bytes, are broadcast and
    looked up where the tokens are (Arrow, no exchange); only the other words of a note, by row and position, are joined with
    the rest of the vocabulary.  Every row is encoded by itself, so equal or null keys don't meet.  A vocabulary
    that the head covers whole needs no join.  The cut comes before any lookup, so at most max_len - 2 tokens of a note count.
    """
    keys, body = note_key(docs, key), max_len - 2
    head = frequent_words(vocab, head_words)
    tokens = docs.select(*keys, F.slice(F.coalesce(words(text), F.array().cast("array<string>")), 1, body).alias("__t"))
    encoded = _look_up_in_place(tokens, keys, head)
    tail = vocab.where(F.col("token_id") > UNK + len(head)).select("token", "token_id")
    if not tail.isEmpty():
        encoded = checkpointed(encoded, "encoded")
        rare = encoded.select("__row", F.explode("__rest").alias("x")).select("__row", "x.pos", "x.token")
        found = (rare.join(tail, "token").groupBy("__row")
                 .agg(F.map_from_entries(F.collect_list(F.struct("pos", "token_id"))).alias("__found")))
        encoded = encoded.join(found, "__row", "left")
        patched = F.transform("__ids", lambda i, pos: F.coalesce(i, F.element_at("__found", pos)))
        encoded = encoded.withColumn("__ids", F.when(F.col("__found").isNull(), F.col("__ids")).otherwise(patched))
    ids = F.transform("__ids", lambda i: F.coalesce(i, F.lit(UNK)))
    n = F.size("__ids") + 2
    input_ids = F.concat(F.array(F.lit(CLS)), ids, F.array(F.lit(SEP)),
                         F.array_repeat(F.lit(PAD), F.lit(max_len) - n))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_len) - n))
    return encoded.select(*keys, input_ids.alias("input_ids"), mask.alias("attention_mask"),
                          n.cast("int").alias("n_tokens"))


def truncation_report(docs: DataFrame, group: str = "task", text: str = "text", max_len: int = MAX_LEN
                      ) -> DataFrame:
    """Notes cut by encode_tokens and the tokens they lose, per group."""
    body = max_len - 2
    n = F.size(words(text))
    return (docs.select(group, n.alias("__n"))
            .groupBy(group)
            .agg(F.count(F.lit(1)).alias("notes"),
                 F.count_if(F.col("__n") > body).alias("truncated"),
                 F.sum(F.greatest(F.col("__n") - body, F.lit(0))).cast("long").alias("tokens_lost")))


def hash_features(docs: DataFrame, key: str | Sequence[str] | None = None, text: str = "text", dim: int = 64) -> DataFrame:
    """M1: hashed bag of words, L2-normalised; long form (keys, bucket, weight).

    bucket = first 32 bits of md5(token) mod dim.  A note is all of ``key`` (null counts as a value).  Counts are a partial
    aggregate per (note, bucket) — at most `dim` rows per note leave the map side.
    """
    keys = note_key(docs, key)
    bucket = (F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long") % dim).cast("int")
    counts = (docs.select(*keys, F.explode(words(text)).alias("token"))
              .groupBy(*keys, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("c")))
    norm = F.sqrt(F.sum(F.col("c") * F.col("c")).over(Window.partitionBy(*keys)))
    return counts.select(*keys, "bucket", (F.col("c") / norm).alias("weight"))


def dense_features(sparse: DataFrame, key: str | Sequence[str] | None = None, dim: int = 64) -> DataFrame:
    """M1 dense form: array<double> of length dim from the long form."""
    keys = note_key(sparse, key)
    m = sparse.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("__m"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("__m", i), F.lit(0.0)))
    return m.select(*keys, vec.alias("features"))

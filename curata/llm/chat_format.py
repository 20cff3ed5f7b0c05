"""Chat formatting: conversations rebuilt from an event log, rendered with a loss mask, and read back.

An event is (conv_id, seq, target, op, role, text).  ``message`` opens a message at ``target``
(its place in the conversation), ``delta`` appends streamed text, ``edit`` and ``regenerate``
replace the text so far.  Events of one target are sorted by seq and folded: the final text
is the last replacing event's text and the deltas after it.

Template: a turn is ``<s>[ROLE]role[/ROLE]text</s>``.  Inside roles and texts ``&``, ``<`` and ``[``
become ``&a;``, ``&l;`` and ``&b;``, so no control string can occur in them and the escape
can be undone.  The loss mask covers the (escaped) text of assistant turns: code point
spans, end exclusive.

Work is dealt by (conversation, chunk of 256 places), so a conversation that holds a large
part of all rows is sorted, rendered and read back in many tasks; ``digests`` then hashes its chunks in a
stream, ``assembled`` joins them to one string (which must fit in a row).

Defined results: null text and null role are empty; a null target sorts first; several ``message`` events
at one target are turns each, ordered by (seq, op, role, text) - repeated rows are repeated
turns; a delta, edit or regeneration without a message before it opens one; a null conv_id is a
conversation of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 256
OPEN, ROLE_END, CLOSE = "<s>[ROLE]", "[/ROLE]", "</s>"
TURN = "struct<role:string,text:string>"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&a;")), F.lit("<"), F.lit("&l;")), F.lit("["), F.lit("&b;"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&b;"), F.lit("[")), F.lit("&l;"), F.lit("<")), F.lit("&a;"), F.lit("&"))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, target, ordinal, role, text): the final messages of an event log."""
    filled = events.select("conv_id", "target", "seq", F.coalesce("op", F.lit("message")).alias("op"),
                           F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # which message of its target an event belongs to (nearly always the first)
    order = Window.partitionBy("conv_id", "target").orderBy("seq", F.when(F.col("op") == "message", 0).otherwise(1), "op", "role", "text")
    numbered = (filled.withColumn("step", F.row_number().over(order))
                .withColumn("ordinal", F.greatest(F.lit(1), F.count_if(F.col("op") == "message").over(order.rowsBetween(Window.unboundedPreceding, 0)))))
    log = numbered.groupBy("conv_id", "target", "ordinal").agg(F.sort_array(F.collect_list(F.struct("step", "op", "role", "text"))).alias("log"))
    # one pass: replacing events restart the text, deltas extend it
    last = F.array_max(F.transform("log", lambda e, i: F.when(e["op"] != "delta", i).otherwise(0)))
    kept = F.slice("log", last + 1, F.size("log"))
    return log.select("conv_id", "target", "ordinal", F.element_at("log", 1)["role"].alias("role"),
                      F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"))


def render_chunks(messages: DataFrame) -> DataFrame:
    """(conv_id, chunk, formatted, loss): messages of 256 places each in order, with the loss spans inside the chunk.

    Messages without a place form the first chunk (null)."""
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(ROLE_END))
    turns = messages.select("conv_id", F.floor(F.col("target") / CHUNK).alias("chunk"), "target", "ordinal", "role",
                            F.concat(head, escaped(F.col("text")), F.lit(CLOSE)).alias("shown"), F.length(head).alias("from"), F.length(escaped(F.col("text"))).alias("n"))
    grouped = turns.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("target", "ordinal", "role", "shown", "from", "n"))).alias("turns"))
    # running start of each turn in the chunk, then the spans of the assistant's
    spans = F.aggregate(
        "turns", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["shown"])).alias("at"),
            F.when(t["role"] == "assistant", F.concat(acc["loss"], F.array(F.struct((acc["at"] + t["from"]).alias("start"), (acc["at"] + t["from"] + t["n"]).alias("end")))))
             .otherwise(acc["loss"]).alias("loss")))["loss"]
    return grouped.select("conv_id", "chunk", F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("formatted"), spans.alias("loss"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted string."""
    inner = F.split(F.substring(formatted, len(OPEN) + 1, F.length(formatted) - len(OPEN) - len(CLOSE)), r"\Q" + CLOSE + OPEN + r"\E", -1)
    return F.when(F.length(formatted) > 0, F.transform(inner, lambda t: F.struct(
        unescaped(F.substring_index(t, ROLE_END, 1)).alias("role"),
        unescaped(F.substring(t, F.length(F.substring_index(t, ROLE_END, 1)) + len(ROLE_END) + 1, F.length(t))).alias("text")))).otherwise(F.array().cast(f"array<{TURN}>"))


def loss_text(formatted: Column, loss: Column) -> Column:
    """The text under the mask, unescaped, nothing between."""
    return unescaped(F.array_join(F.transform(loss, lambda s: F.substring(formatted, s["start"] + 1, s["end"] - s["start"])), ""))


def assembled(chunks: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) of whole conversations from their chunks."""
    parts = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "formatted", "loss"))).alias("parts"))
    shifted = F.aggregate("parts", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss")), lambda acc, p: F.struct(
        (acc["at"] + F.length(p["formatted"])).alias("at"),
        F.concat(acc["loss"], F.transform(p["loss"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end")))).alias("loss")))["loss"]
    return parts.select("conv_id", F.array_join(F.transform("parts", lambda p: p["formatted"]), "").alias("formatted"), shifted.alias("loss"))


def format_conversations(events: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss spans) from an event log."""
    return assembled(render_chunks(fold_events(events)))


def digests(chunks: DataFrame) -> DataFrame:
    """What the formatted chunks say when read back, per conversation.

    A conversation's chunks are read one after the other by one task, which feeds running hashes and keeps no text."""
    per_chunk = chunks.select(
        "conv_id", "chunk", F.size(read_back(F.col("formatted"))).cast("long").alias("n"),
        F.array_join(F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        loss_text(F.col("formatted"), F.col("loss")).alias("under"), F.length("formatted").cast("long").alias("chars"))
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    id_type = chunks.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, done, state, at = None, [], None, None       # state: turns, hash of turns, characters under the mask, their hash, characters

        def close() -> None:
            done.append((at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def drain() -> pa.RecordBatch:
            kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
            done.clear()
            return batch

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, n, turns, under, length, chars in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != at:
                    if state:
                        close()
                    at, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += n
                state[1].update(turns.encode())
                state[2] += length
                state[3].update(under.encode())
                state[4] += chars
            if done:
                yield drain()
        if state:
            close()
            yield drain()

    dealt = per_chunk.repartition("conv_id").sortWithinPartitions("conv_id", F.col("chunk").asc_nulls_first())
    return dealt.select("conv_id", "n", "turns", "under", F.length("under").cast("long").alias("under_chars"), "chars").mapInArrow(
        run, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

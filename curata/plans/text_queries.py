"""Registered queries for text: sections, label literals, keys, vocabulary and encoding."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curata.functions import text as X
from curata.operators import text as TX
from curata.plans.corpus_queries import notes_split
from curata.plans.oracle_views import VIEWS
from curata.plans.registry import register
from curata.session import checkpointed
from curata.sources import tables as T

VOCAB_SIZE = None          # every word of the documents

_NL = "chr(10)"
_CLASS = "[^(\\\\|\\d.)' || chr(10) || ']+?:"


def _sql_section(heading: str) -> str:
    pat = f"'(?is){heading}(.+?)' || {_NL} || {_NL} || '{_CLASS}'"
    raw = f"regexp_extract(text, {pat}, 1)"
    return f"coalesce(regexp_replace(regexp_replace({raw}, {_NL}, ' ', 'g'), '^\\s+|\\s+$', '', 'g'), '')"


VIEWS["sections"] = (("section_notes",), "SELECT note_id, task, "
                     + ", ".join(f"{_sql_section(h)} AS {n}" for n, h in X.SECTIONS)
                     + " FROM section_notes")

VIEWS["vocab"] = ((), """
    SELECT * FROM (VALUES (0, '[PAD]', 0), (1, '[CLS]', 0), (2, '[SEP]', 0), (3, '[UNK]', 0)) s(token_id, token, n)
    UNION ALL
    SELECT CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS INTEGER) AS token_id, token, n
    FROM (SELECT token, count(*) AS n
          FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS token FROM documents)
          WHERE token <> '' GROUP BY token)""")


def _sections(spark, sf):
    return TX.extract_sections(T.spread(T.section_notes(spark, sf)))


_SEC_COLS = [n for n, _ in X.SECTIONS]


@register("extract_sections", "SELECT note_id, " + ", ".join(_SEC_COLS) + " FROM sections", ("sections",))
def q_extract_sections(spark, sf):
    return _sections(spark, sf).select("note_id", *_SEC_COLS)


@register("clean_text", """
SELECT doc_id AS note_id,
       coalesce(regexp_replace(regexp_replace(text, chr(10), ' ', 'g'), '^\\s+|\\s+$', '', 'g'), '') AS cleaned
FROM documents""")
def q_clean_text(spark, sf):
    d = T.table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("note_id"), X.clean_text("text").alias("cleaned"))


_HAS = " OR ".join(f"{n} <> ''" for n in _SEC_COLS)


@register("filter_has_section", f"SELECT note_id, task FROM sections WHERE {_HAS}", ("sections",))
def q_filter_has_section(spark, sf):
    return TX.filter_has_section(_sections(spark, sf)).select("note_id", "task")


@register("reassemble_sections", f"""
SELECT note_id, 'CHIEF COMPLAINT: ' || CHIEF_COMPLAINT || {_NL} || {_NL} || 'PRESENT ILLNESS: ' || PRESENT_ILLNESS
       || {_NL} || {_NL} || 'MEDICAL HISTORY: ' || MEDICAL_HISTORY || {_NL} || {_NL}
       || 'HOSPITAL_COURSE: ' || BRIEF_HOSPITAL_COURSE AS text
FROM sections WHERE {_HAS}""", ("sections",))
def q_reassemble_sections(spark, sf):
    s = TX.filter_has_section(_sections(spark, sf))
    return TX.reassemble_sections(s).select("note_id", "text")


@register("parse_label_list", """
SELECT note_id, array_to_string(labels, ',') AS parsed, CAST(len(labels) AS INTEGER) AS n FROM notes_docs""",
          ("notes_docs",))
def q_parse_label_list(spark, sf):
    """Labels rendered as Python list literals (as the reference's CSV cells hold them), parsed back."""
    n = T.notes_docs(spark, sf).select("note_id", X.render_label_list("labels").alias("cell"))
    p = n.select("note_id", X.parse_label_list("cell").alias("l"))
    return p.select("note_id", F.array_join("l", ",").alias("parsed"), F.size("l").cast("int").alias("n"))


@register("parse_result_cell", """
SELECT train_step, eval_task, round(CAST(regexp_extract(cell, ': ([^}]+)}', 1) AS DOUBLE), 6) AS value
FROM results_cells""", ("results_cells",))
def q_parse_result_cell(spark, sf):
    c = T.results_cells(spark, sf)
    return c.select("train_step", "eval_task", F.round(X.parse_result_cell("cell"), 6).alias("value"))


@register("parse_file_key", """
SELECT file_name, regexp_extract(file_name, '^(.*)\\.[^.]*$', 1) AS stem,
       regexp_extract(regexp_extract(file_name, '^(.*)\\.[^.]*$', 1), '^(.*)_[^_]*$', 1) AS task_key,
       split_part(regexp_extract(file_name, '^(.*)\\.[^.]*$', 1), '_', -1) AS split_key
FROM (SELECT DISTINCT lower(task) || '.csv_fold_1_' || split || '.csv' AS file_name FROM notes_split)""",
          ("notes_split",))
def q_parse_file_key(spark, sf):
    s = notes_split(spark, sf)
    names = s.select(F.concat(F.lower("task"), F.lit(".csv_fold_1_"), F.col("split"), F.lit(".csv"))
                     .alias("file_name")).distinct()
    stem = X.file_stem("file_name")
    return names.select("file_name", stem.alias("stem"), X.key_task(stem).alias("task_key"),
                        X.key_split(stem).alias("split_key"))


@register("sequence_key", """
SELECT pos, alias, array_to_string(list(alias) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                                   '_') AS seq_key
FROM (SELECT CAST(row_number() OVER (ORDER BY n DESC, s.task) - 1 AS INTEGER) AS pos, a.alias
      FROM (SELECT task, count(*) AS n FROM notes_split WHERE split = 'train' GROUP BY task) s
      JOIN task_alias a ON s.task = a.task)""", ("notes_split", "task_alias"))
def q_sequence_key(spark, sf):
    """Tasks ordered by training size make the sequence; key at each position (F8)."""
    s = notes_split(spark, sf).where(F.col("split") == "train").groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    alias = F.create_map(*[x for a, t in zip(T.ALIASES, T.SEGMENTS) for x in (F.lit(t), F.lit(a))])
    seq = s.select((F.row_number().over(Window.orderBy(F.desc("n"), "task")) - 1).cast("int").alias("pos"),
                   F.element_at(alias, F.col("task")).alias("alias"))
    whole = F.collect_list("alias").over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding,
                                                                           Window.unboundedFollowing))
    return seq.select("pos", "alias", X.sequence_key(whole, F.col("pos")).alias("seq_key"))


@register("run_stamp", "SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS stamp FROM events")
def q_run_stamp(spark, sf):
    return T.table(spark, sf, "events").select("event_id", X.run_stamp("ts").alias("stamp"))


@register("build_vocab", "SELECT token_id, token, n FROM vocab", ("vocab",))
def q_build_vocab(spark, sf):
    return TX.build_vocab(T.spread(T.table(spark, sf, "documents").select("text")), max_size=VOCAB_SIZE)


@register("encode_tokens", """
SELECT n.note_id, n.task,
       array_to_string(list_resize(list_concat([1], coalesce(x.ids, []::INTEGER[]), [2]), 512, 0), ' ') AS input_ids,
       CAST(len(coalesce(x.ids, []::INTEGER[])) + 2 AS INTEGER) AS n_tokens
FROM keyed_docs n
LEFT JOIN (SELECT t.task, t.note_id, list(coalesce(v.token_id, 3) ORDER BY t.pos) AS ids
           FROM (SELECT task, note_id, unnest(tok) AS token, generate_subscripts(tok, 1) AS pos
                 FROM (SELECT task, note_id,
                              list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')[1:510] AS tok
                       FROM keyed_docs)) t
           LEFT JOIN (SELECT token, token_id FROM vocab WHERE token_id > 3) v ON t.token = v.token
           GROUP BY t.task, t.note_id) x ON n.note_id = x.note_id AND n.task IS NOT DISTINCT FROM x.task""", ("vocab", "keyed_docs"))
def q_encode_tokens(spark, sf):
    """Notes of tasks that share ids; the vocabulary holds every word, written once."""
    docs = T.table(spark, sf, "documents").select(F.col("doc_id").alias("note_id"), F.col("lang").alias("task"), "text")
    vocab = checkpointed(TX.build_vocab(T.spread(docs.select("text")), max_size=VOCAB_SIZE), "vocab")
    enc = TX.encode_tokens(T.keyed(T.spread(docs)), vocab)
    return enc.select("note_id", "task", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"),
                      "n_tokens")


@register("truncation_report", """
SELECT lang AS task, count(*) AS notes, CAST(count_if(n > 510) AS BIGINT) AS truncated,
       CAST(sum(greatest(n - 510, 0)) AS BIGINT) AS tokens_lost
FROM (SELECT lang, len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS n
      FROM documents)
GROUP BY lang""")
def q_truncation_report(spark, sf):
    d = T.table(spark, sf, "documents").select(F.col("lang").alias("task"), "text")
    return TX.truncation_report(T.spread(d))


@register("hash_features", """
SELECT note_id, task, bucket, round(c / sqrt(sum(c * c) OVER (PARTITION BY task, note_id)), 6) AS weight
FROM (SELECT note_id, task, CAST(('0x' || substr(md5(token), 1, 8))::BIGINT % 64 AS INTEGER) AS bucket,
             count(*) AS c
      FROM (SELECT note_id, task, unnest(regexp_split_to_array(lower(text), '\\s+')) AS token FROM keyed_docs)
      WHERE token <> '' GROUP BY ALL)""", ("keyed_docs",))
def q_hash_features(spark, sf):
    """Notes of tasks that share ids."""
    d = T.table(spark, sf, "documents").select(F.col("doc_id").alias("note_id"), F.col("lang").alias("task"), "text")
    f = TX.hash_features(T.keyed(T.spread(d)))
    return f.select("note_id", "task", "bucket", F.round("weight", 6).alias("weight"))

"""Registered queries for splits, order, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.operators import labels as L
from curata.operators import splits as S
from curata.operators import stratify as ST
from curata.plans.corpus_queries import notes_split
from curata.plans.oracle_views import VIEWS
from curata.plans.registry import register
from curata.session import checkpointed
from curata.sources import tables as T

H = "md5('42:' || CAST(note_id AS VARCHAR))"

VIEWS["padded_split"] = (("notes_split",), f"""
    SELECT s.note_id, s.task, coalesce(mv.to_split, s.split) AS split, mv.to_split IS NOT NULL AS moved
    FROM notes_split s
    LEFT JOIN (SELECT c.note_id, CASE WHEN c.r <= z.k1 THEN 'dev' ELSE 'test' END AS to_split
               FROM (SELECT task, note_id, row_number() OVER (PARTITION BY task ORDER BY {H}, note_id) AS r
                     FROM notes_split WHERE split = 'train') c
               JOIN (SELECT task, (8 - count_if(split = 'dev') % 8) % 8 AS k1,
                            (8 - count_if(split = 'test') % 8) % 8 AS k2
                     FROM notes_split GROUP BY task) z ON c.task = z.task
               WHERE c.r <= z.k1 + z.k2) mv ON s.note_id = mv.note_id""")


def padded(spark, sf, split=None):
    return S.pad_split_to_multiple(notes_split(spark, sf) if split is None else split)


@register("seeded_order", f"""
SELECT note_id, task, row_number() OVER (PARTITION BY task ORDER BY {H}, note_id) AS rn FROM notes_orders""",
          ("notes_orders",))
def q_seeded_order(spark, sf):
    return S.seeded_order(T.notes_orders(spark, sf).select("note_id", "task"), ["task"], "note_id")


@register("stratified_split", "SELECT note_id, task, stratum, split FROM notes_split", ("notes_split",))
def q_stratified_split(spark, sf):
    return notes_split(spark, sf).select("note_id", "task", "stratum", "split")


@register("iterative_split", """
SELECT task, label, split, positives, round(CAST(positives * share AS DOUBLE), 6) AS quota, n_notes, true AS met
FROM (SELECT task, label, count(*) AS positives FROM (SELECT DISTINCT note_id, task, unnest(labels) AS label FROM notes_orders) GROUP BY ALL)
JOIN (SELECT task, count(*) AS n_notes FROM notes_orders GROUP BY task) USING (task),
  (VALUES ('train', 0.66), ('dev', 0.17), ('test', 0.17)) s(split, share)""", ("notes_orders",))
def q_iterative_split(spark, sf):
    """D1 over all order notes, those without labels too: every label's quota per split, and whether the notes it got are within one of
    it (asked of labels with 6 notes or more); n_notes counts the notes that have a split."""
    notes = checkpointed(T.notes_orders(spark, sf).select("note_id", "task", "labels"), "notes")     # read twice
    q = ST.label_quotas(ST.iterative_split(notes))
    met = (F.abs(F.col("assigned") - F.col("quota")) <= 1) | (F.col("positives") < 6)
    return q.select("task", "label", "split", "positives", F.round("quota", 6).alias("quota"), "n_notes", met.alias("met"))


@register("pad_split_to_multiple", "SELECT note_id, task, split FROM padded_split", ("padded_split",))
def q_pad_split_to_multiple(spark, sf):
    return padded(spark, sf).select("note_id", "task", "split")


@register("sample_n", f"SELECT note_id, task FROM notes_orders ORDER BY {H}, note_id LIMIT 100", ("notes_orders",))
def q_sample_n(spark, sf):
    return S.sample_n(T.notes_orders(spark, sf).select("note_id", "task"), 100)


@register("batch_assign", """
SELECT note_id, task, CAST((row_number() OVER (PARTITION BY task ORDER BY note_id) - 1) // 8 AS BIGINT) AS batch_id
FROM notes_orders""", ("notes_orders",))
def q_batch_assign(spark, sf):
    return S.batch_assign(T.notes_orders(spark, sf).select("note_id", "task"), ["task"], "note_id")


@register("head_per_frame", """
SELECT note_id, task, split FROM (
  SELECT note_id, task, split, row_number() OVER (PARTITION BY task, split ORDER BY note_id) AS r FROM notes_split)
WHERE r <= 300""", ("notes_split",))
def q_head_per_frame(spark, sf):
    s = notes_split(spark, sf).select("note_id", "task", "split")
    return S.head_per_group(s, ["task", "split"], "note_id", 300)


@register("head_per_split", """
SELECT s.note_id, s.task, s.split FROM (
  SELECT note_id, task, split, row_number() OVER (PARTITION BY task, split ORDER BY note_id) AS r FROM notes_split) s
JOIN (SELECT split, least(min(n), CASE split WHEN 'train' THEN 5000 ELSE 1000 END) AS size
      FROM (SELECT task, split, count(*) AS n FROM notes_split GROUP BY ALL) GROUP BY split) c
  ON s.split = c.split
WHERE s.r <= c.size""", ("notes_split",))
def q_head_per_split(spark, sf):
    s = checkpointed(notes_split(spark, sf).select("note_id", "task", "split"), "split")     # the caps and the ranges read it
    caps = L.split_size_cap(s, {"train": 5000, "dev": 1000, "test": 1000})
    return S.head_per_split(s, caps, "note_id")


@register("split_shares", """
SELECT task, split, n, round(n / sum(n) OVER (PARTITION BY task), 6) AS share
FROM (SELECT task, split, count(*) AS n FROM notes_split GROUP BY ALL)""", ("notes_split",))
def q_split_shares(spark, sf):
    out = S.split_shares(notes_split(spark, sf))
    return out.select("task", "split", "n", F.round("share", 6).alias("share"))


@register("distinct_text_count", """
SELECT task, count(*) AS n_rows, count(DISTINCT text) AS n_distinct_texts FROM notes_docs GROUP BY task""",
          ("notes_docs",))
def q_distinct_text_count(spark, sf):
    return S.distinct_text_count(T.notes_docs(spark, sf))


@register("dedup_text", "SELECT task, text, min(note_id) AS note_id FROM notes_docs GROUP BY task, text",
          ("notes_docs",))
def q_dedup_text(spark, sf):
    return S.dedup_text(T.notes_docs(spark, sf))


@register("union_splits", """
SELECT note_id, split, stratum FROM notes_split WHERE split = 'train'
UNION ALL SELECT note_id, split, NULL FROM notes_split WHERE split = 'dev'
UNION ALL SELECT note_id, split, stratum FROM notes_split WHERE split = 'test'""", ("notes_split",))
def q_union_splits(spark, sf):
    s = notes_split(spark, sf)
    tr = s.where(F.col("split") == "train").select("note_id", "split", "stratum")
    dv = s.where(F.col("split") == "dev").select("note_id", "split")
    te = s.where(F.col("split") == "test").select("stratum", "split", "note_id")
    return S.union_splits(tr, dv, te).select("note_id", "split", "stratum")


@register("subjects_intersect", """
SELECT subject_id FROM notes_split WHERE split = 'train'
INTERSECT SELECT subject_id FROM notes_split WHERE split = 'test'""", ("notes_split",))
def q_subjects_intersect(spark, sf):
    return S.subjects_intersect(notes_split(spark, sf), "train", "test")


@register("rows_except", """
SELECT note_id, task FROM notes_split WHERE split = 'train'
  AND note_id NOT IN (SELECT note_id FROM padded_split WHERE moved)""", ("padded_split",))
def q_rows_except(spark, sf):
    s = notes_split(spark, sf)
    p = padded(spark, sf, s)
    moved = p.join(s.select("note_id", F.col("split").alias("old")), "note_id").where(F.col("split") != F.col("old"))
    return S.rows_except(s.where(F.col("split") == "train").select("note_id", "task"), moved)


@register("split_leakage", """
SELECT t.task, p.split_a, p.split_b,
       (SELECT count(*) FROM (SELECT DISTINCT task, subject_id, split FROM notes_split) a
        JOIN (SELECT DISTINCT task, subject_id, split FROM notes_split) b ON a.subject_id = b.subject_id AND a.task = b.task
        WHERE a.split = p.split_a AND b.split = p.split_b AND a.task = t.task) AS shared_subjects
FROM (SELECT DISTINCT task FROM notes_split) t, (VALUES ('dev', 'test'), ('dev', 'train'), ('test', 'train')) p(split_a, split_b)""", ("notes_split",))
def q_split_leakage(spark, sf):
    """J5 between the splits of each task."""
    return S.split_leakage(notes_split(spark, sf), groups=["task"])


@register("rank_tasks_by_size", """
SELECT task, n, CAST(row_number() OVER (ORDER BY n DESC, task) AS INTEGER) AS rank
FROM (SELECT task, count(*) AS n FROM notes_split WHERE split = 'train' GROUP BY task)""", ("notes_split",))
def q_rank_tasks_by_size(spark, sf):
    return S.rank_groups_by_size(notes_split(spark, sf).where(F.col("split") == "train"))

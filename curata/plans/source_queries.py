"""Registered queries for file sources and sinks.

Each query first writes Spark-derived files from the test tables into a fresh
folder below the shared checkpoint folder, then reads them with the source
under test; the oracle is the SQL of the table that was written.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.functions.text import parse_result_cell
from curata.operators import labels as L
from curata.plans.corpus_queries import notes_split, split_inputs
from curata.plans.oracle_views import VIEWS
from curata.plans.registry import register
from curata.session import checkpointed, shared_dir
from curata.sources import files as FS
from curata.sources import results as RS
from curata.sources import tables as T


@register("read_notes_csv", """
SELECT note_id, task, text, array_to_string(labels, ',') AS labels FROM notes_docs""", ("notes_docs",))
def q_read_notes_csv(spark, sf):
    """Documents (multi-line text) written as note CSV and read back."""
    path = shared_dir(spark, "notes-csv")
    FS.write_notes_csv(T.notes_docs(spark, sf).select("note_id", "task", F.col("text").alias("TEXT"), "labels"),
                       path)
    n = FS.read_notes_csv(spark, path)
    return n.select(F.col("note_id").cast("long").alias("note_id"), "task", "text",
                    F.array_join("labels", ",").alias("labels"))


@register("read_notes_csv_blocks", """
SELECT note_id, task, text, array_to_string(labels, ',') AS labels, n FROM notes_docs, (SELECT count(*) AS n FROM documents)""", ("notes_docs",))
def q_read_notes_csv_blocks(spark, sf):
    """S1 by blocks: the documents in one CSV folder, each file cut at record ends; n: row numbers of all files."""
    path = shared_dir(spark, "notes-csv")
    FS.write_notes_csv(T.notes_docs(spark, sf).select("note_id", "task", F.col("text").alias("TEXT"), "labels"), path)
    n = checkpointed(FS.read_notes_csv(spark, path, by_blocks=True), "notes")
    rows = n.groupBy("file_name").agg(F.countDistinct("row_idx").alias("k")).agg(F.sum("k")).scalar()
    return n.select(F.col("note_id").cast("long").alias("note_id"), "task", "text",
                    F.array_join("labels", ",").alias("labels"), rows.alias("n"))


@register("scan_task_dir", """
SELECT note_id, lower(coalesce(task, 'none')) || '_fold_1' AS task, CASE WHEN note_id % 10 < 7 THEN 'train' WHEN note_id % 10 < 9 THEN 'dev' ELSE 'test' END AS split,
       text, array_to_string(labels, ',') AS labels FROM notes_docs""", ("notes_docs",))
def q_scan_task_dir(spark, sf):
    """One CSV folder per (task, split) named `{task}_fold_1_{split}.csv`; task and split from the name, texts (with line breaks) and labels from the rows."""
    path = shared_dir(spark, "task-dir")
    d = F.col("note_id") % 10
    n = T.notes_docs(spark, sf).withColumn("split", F.when(d < 7, "train").when(d < 9, "dev").otherwise("test"))
    n = n.withColumn("file_key", F.concat(F.lower(F.coalesce("task", F.lit("none"))), F.lit("_fold_1_"), F.col("split"), F.lit(".csv")))
    FS.write_notes_csv(n.select("note_id", "text", "labels", "file_key"), path, ("file_key",))
    r = FS.scan_task_dir(spark, path)
    return r.select(F.col("note_id").cast("long").alias("note_id"), "task", "split", "text", F.array_join("labels", ",").alias("labels"))


@register("scan_stratified_dir", """
SELECT s.note_id, s.split, lower(s.task) || '_strat_' || s.split AS key, CASE s.task WHEN 'MACHINERY' THEN 0 ELSE 1 END AS task_rank,
       array_to_string(list_transform(range((SELECT count(*) FROM label_dict)),
                       lambda i: CASE WHEN list_contains(x.ids, CAST(i AS INTEGER)) THEN '1' ELSE '0' END), '') AS bits
FROM notes_split s JOIN (SELECT note_id, list(label_id) AS ids FROM split_labels GROUP BY note_id) x ON x.note_id = s.note_id
WHERE s.task IN ('BUILDING', 'MACHINERY')""", ("split_labels", "label_dict"))
def q_scan_stratified_dir(spark, sf):
    """S3: pre-split files with multi-hot labels, requested tasks only, in request order; every label of every note."""
    path = shared_dir(spark, "strat-dir")
    n, s = split_inputs(spark, sf)
    d = L.label_dictionary(n)
    mh = L.multi_hot(L.labels_to_ids(s, d, carry=["split"]), L.num_labels(d))
    out = mh.select("note_id", F.col("labels_ohe").alias("labels"),
                    F.concat(F.lower("task"), F.lit("_strat_fold_"), F.col("split"), F.lit(".csv"))
                    .alias("file_key"))
    FS.write_notes_csv(out, path, ("file_key",))
    r = FS.scan_stratified_dir(spark, path, ["machinery", "building"])
    bits = F.array_join(F.transform("labels", lambda x: x.cast("int").cast("string")), "")
    return r.select(F.col("note_id").cast("long").alias("note_id"), "split", "key", "task_rank", bits.alias("bits"))


@register("read_label_universe",
          "SELECT DISTINCT label FROM (SELECT unnest(labels) AS label FROM notes_orders) WHERE label IS NOT NULL",
          ("notes_orders",))
def q_read_label_universe(spark, sf):
    """The label universe written as `{"all_D_codes": [...]}` and read back."""
    path = shared_dir(spark, "universe")
    FS.write_label_universe(L.label_universe(T.notes_orders(spark, sf)), path)
    return FS.read_label_universe(spark, path)


@register("read_three_splits", """
SELECT note_id, CASE WHEN note_id % 10 < 7 THEN 'train' ELSE 'dev' END AS split, text, array_to_string(labels, ',') AS labels, 'no test' AS written
FROM notes_docs WHERE note_id % 10 < 9 AND len(labels) > 0
UNION ALL
SELECT note_id, CASE WHEN note_id % 10 < 7 THEN 'train' WHEN note_id % 10 < 9 THEN 'dev' ELSE 'test' END, text, array_to_string(labels, ','), 'all'
FROM notes_docs WHERE len(labels) > 0""", ("notes_docs",))
def q_read_three_splits(spark, sf):
    """Three splits written, read once without the test split (optional, so empty) and once with it; unlabelled notes are dropped."""
    root = shared_dir(spark, "three")
    d, out = F.col("note_id") % 10, []
    n = T.notes_docs(spark, sf).withColumn("split", F.when(d < 7, "train").when(d < 9, "dev").otherwise("test"))
    for written, splits in (("no test", ("train", "dev")), ("all", ("test",))):
        for sp in splits:
            FS.write_notes_csv(n.where(F.col("split") == sp).select("note_id", "text", "labels"), f"{root}/{sp}")
        r = FS.read_three_splits(spark, root + "/{split}")
        out.append(r.select(F.col("note_id").cast("long").alias("note_id"), "split", "text", F.array_join("labels", ",").alias("labels"), F.lit(written).alias("written")))
    return out[0].unionByName(out[1])


@register("read_code_list", "SELECT DISTINCT label AS ccs FROM (SELECT unnest(labels) AS label FROM notes_orders) WHERE label IS NOT NULL", ("notes_orders",))
def q_read_code_list(spark, sf):
    """Every label, one row per use, written as a `ccs` code list and read back: each code once."""
    path = shared_dir(spark, "codes")
    used = T.notes_orders(spark, sf).select(F.explode("labels").alias("ccs"))
    used.write.mode("overwrite").option("header", "true").csv(path)
    return FS.read_code_list(spark, path)


@register("write_splits", """
SELECT note_id, task, split, array_to_string(labels, ',') AS labels, form FROM notes_split, (VALUES ('parquet'), ('csv')) f(form)""", ("notes_split",))
def q_write_splits(spark, sf):
    """Folders by (task, split), as Parquet and as CSV, every row and label read back (reading one split prunes the other folders)."""
    s = checkpointed(notes_split(spark, sf).select("note_id", "task", "split", "labels"), "split")
    out = []
    for form in ("parquet", "csv"):
        path = shared_dir(spark, "splits")
        FS.write_splits(s, path, form)
        r = spark.read.parquet(path) if form == "parquet" else FS.read_notes_csv(spark, path)
        out.append(r.select(F.col("note_id").cast("long").alias("note_id"), "task", "split", F.array_join("labels", ",").alias("labels"), F.lit(form).alias("form")))
    return out[0].unionByName(out[1])


#: Fixed values of the result runs below: (alias sequence, tasks in its order, stamp).
RUNS = (("a_b_c_d", ("de", "en", "es", "fr"), "20240102-030405"), ("d_b", ("fr", "en"), "20240203-040506"))

_RUN_SQL = """
SELECT 'results_a_b_c_d_20240102-030405.csv' AS file_name, 'a_b_c_d' AS sequence, '20240102-030405' AS stamp, train_step, eval_task,
       list_position(['de', 'en', 'es', 'fr'], eval_task) - 1 AS eval_pos, value FROM cells
UNION ALL
SELECT 'results_d_b_20240203-040506.csv', 'd_b', '20240203-040506', train_step, eval_task, list_position(['fr', 'en'], eval_task) - 1, value
FROM cells WHERE eval_task IN ('fr', 'en') AND train_step < 2"""

# value of a cell; the cell of step 1 on `en` is not a number, the one of step 0 on `fr` is empty
VIEWS["cells"] = (("results_cells",), """
    SELECT train_step, eval_task,
           CASE WHEN train_step = 0 AND eval_task = 'fr' THEN NULL WHEN train_step = 1 AND eval_task = 'en' THEN 'NaN'::DOUBLE
                ELSE CAST(regexp_extract(cell, ': ([^}]+)}', 1) AS DOUBLE) END AS value
    FROM results_cells""")


def _cells(spark, sf):
    empty, nan = (F.col("train_step") == 0) & (F.col("eval_task") == "fr"), (F.col("train_step") == 1) & (F.col("eval_task") == "en")
    value = F.when(empty, None).when(nan, float("nan")).otherwise(parse_result_cell("cell"))
    return checkpointed(T.results_cells(spark, sf).select("train_step", "eval_task", value.alias("value")), "cells")


def _written_runs(spark, sf):
    root, cells = shared_dir(spark, "result-csv"), _cells(spark, sf)
    (s0, t0, at0), (s1, t1, at1) = RUNS
    RS.write_result_csv(cells, root, s0, t0, at0)
    RS.write_result_csv(cells.where(F.col("eval_task").isin(*t1) & (F.col("train_step") < 2)), root, s1, t1, at1)
    return root


@register("write_result_matrix", """
SELECT train_step, de, en, es, fr FROM (
  SELECT train_step, eval_task, CASE WHEN isnan(value) THEN '[{''torchmetrics.auroc'': nan}]'
         WHEN value IS NOT NULL THEN '[{''torchmetrics.auroc'': ' || CAST(value AS VARCHAR) || '}]' END AS cell FROM cells)
PIVOT (first(cell) FOR eval_task IN ('de', 'en', 'es', 'fr') GROUP BY train_step)""", ("cells",))
def q_write_result_matrix(spark, sf):
    """The file of a run, read as plain CSV: one column per task in sequence order, the row's position is the step."""
    root = _written_runs(spark, sf)
    raw = spark.read.options(**FS.CSV_OPTIONS).csv(f"{root}/results_a_b_c_d_20240102-030405.csv")
    rows = FS.with_row_index(raw.select(*RUNS[0][1], F.col("_metadata.file_path").alias("__path")), "__path")
    return rows.select(F.col("row_idx").cast("int").alias("train_step"), *RUNS[0][1])


@register("read_result_dir", f"""
SELECT file_name, sequence, stamp, CAST(train_step AS BIGINT) AS train_step, eval_task, CAST(eval_pos AS INTEGER) AS eval_pos,
       isnan(coalesce(value, 0)) AS is_nan, round(CASE WHEN NOT isnan(value) THEN value END, 6) AS value FROM ({_RUN_SQL})""", ("cells",))
def q_read_result_dir(spark, sf):
    """The files of two runs with different tasks and steps, read as one long table, every value of it."""
    d = RS.read_result_csvs(spark, _written_runs(spark, sf))
    nan = F.isnan(F.coalesce("value", F.lit(0.0)))
    return d.select("file_name", "sequence", "stamp", "train_step", "eval_task", "eval_pos", nan.alias("is_nan"),
                    F.round(F.when(~nan, F.col("value")), 6).alias("value"))

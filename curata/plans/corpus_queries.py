"""Registered queries for corpus preparation: labels, dictionary, multi-hot, projections.

Spark side: operators from ``curata.operators`` over the fixture views.
Oracle side: DuckDB SQL over the same parquet files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.operators import labels as L
from curata.operators import splits as S
from curata.plans.oracle_views import VIEWS
from curata.plans.registry import register
from curata.session import checkpointed, shared_dir
from curata.sources import tables as T
from curata.streaming.labels import grow_dictionary, latest_dictionary, run_dictionary_stream

# ---- shared oracle views -------------------------------------------------------------------

VIEWS["label_dict"] = (("notes_orders",), """
    SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id, label
    FROM (SELECT DISTINCT label FROM (SELECT unnest(labels) AS label FROM notes_orders)
          WHERE label IS NOT NULL)""")

VIEWS["notes_split"] = (("notes_orders",), """
    SELECT note_id, subject_id, task, labels, stratum,
           CASE WHEN (rnk * 61) % 100 < 66 THEN 'train' WHEN (rnk * 61) % 100 < 83 THEN 'dev' ELSE 'test' END AS split
    FROM (SELECT b.*, coalesce(st.stratum, '') AS stratum,
                 row_number() OVER (PARTITION BY b.task ORDER BY coalesce(st.stratum, ''),
                                    md5('42:' || CAST(b.note_id AS VARCHAR)), b.note_id) AS rnk
          FROM (SELECT * FROM notes_orders WHERE len(labels) > 0) b
          LEFT JOIN (SELECT note_id, label AS stratum
                     FROM (SELECT ex.note_id, ex.label,
                                  row_number() OVER (PARTITION BY ex.note_id ORDER BY sup.support, ex.label) AS r
                           FROM (SELECT DISTINCT note_id, unnest(labels) AS label
                                 FROM notes_orders WHERE len(labels) > 0) ex
                           JOIN (SELECT note_id, task FROM notes_orders) own ON own.note_id = ex.note_id
                           JOIN (SELECT task, label, count(*) AS support
                                 FROM (SELECT DISTINCT note_id, task, unnest(labels) AS label
                                       FROM notes_orders WHERE len(labels) > 0) GROUP BY task, label) sup
                             ON ex.label = sup.label AND own.task IS NOT DISTINCT FROM sup.task)
                     WHERE r = 1) st ON b.note_id = st.note_id) x""")

VIEWS["split_labels"] = (("notes_split", "label_dict"), """
    SELECT DISTINCT s.note_id, s.task, s.split, d.label_id, d.label
    FROM (SELECT note_id, task, split, unnest(labels) AS label FROM notes_split) s
    JOIN label_dict d ON s.label = d.label""")


# ---- Spark helpers ---------------------------------------------------------------------------

def labelled_notes(spark: SparkSession, sf: str) -> DataFrame:
    """The order notes with at least one label, written once to the shared checkpoint
    folder and read back as Parquet (the view is a lineitem/part/orders/customer join
    that the split reads three times)."""
    return checkpointed(T.notes_orders(spark, sf).where(F.size("labels") > 0), "notes")


def split_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(labelled notes, their D1 split with seed 42).

    Lookups that need only the notes (label dictionary, task list) read the
    Parquet notes instead of evaluating the split a second time.  The split
    itself stays lazy (measured: materialising it too was slower at every use).
    """
    n = labelled_notes(spark, sf)
    return n, S.stratified_split(n)


def notes_split(spark: SparkSession, sf: str) -> DataFrame:
    """D1 over the labelled order notes (seed 42)."""
    return split_inputs(spark, sf)[1]


def _ids_str(c: str) -> F.Column:
    return F.array_join(F.col(c).cast("array<string>"), ",")


# ---- A1, A2, A5 ----------------------------------------------------------------------------------

@register("label_universe", "SELECT DISTINCT label FROM (SELECT unnest(labels) AS label FROM notes_orders) "
          "WHERE label IS NOT NULL", ("notes_orders",))
def q_label_universe(spark, sf):
    return L.label_universe(T.notes_orders(spark, sf))


@register("label_dictionary", "SELECT label_id, label FROM label_dict", ("label_dict",))
def q_label_dictionary(spark, sf):
    return L.label_dictionary(T.notes_orders(spark, sf))


@register("num_labels", "SELECT CAST(count(*) AS INTEGER) AS num_labels FROM label_dict", ("label_dict",))
def q_num_labels(spark, sf):
    d = L.label_dictionary(T.notes_orders(spark, sf))
    return d.agg(F.count(F.lit(1)).cast("int").alias("num_labels"))


# ---- J1, J2, A3, J3 ------------------------------------------------------------------------------

_IDS_SQL = """
SELECT n.note_id, n.task, coalesce(x.ids, '') AS label_ids, CAST(coalesce(x.k, 0) AS INTEGER) AS n_ids
FROM {notes} n
LEFT JOIN (SELECT task, note_id, string_agg(CAST(label_id AS VARCHAR), ',' ORDER BY pos) AS ids, count(*) AS k
           FROM (SELECT task, note_id, unnest(labels) AS label, generate_subscripts(labels, 1) AS pos
                 FROM {notes}) e
           JOIN {dict} d ON e.label = d.label
           GROUP BY task, note_id) x ON n.note_id = x.note_id AND n.task IS NOT DISTINCT FROM x.task"""


@register("labels_to_ids_strict", _IDS_SQL.format(dict="label_dict", notes="keyed_orders"), ("label_dict", "keyed_orders"))
def q_labels_to_ids_strict(spark, sf):
    n = T.keyed(T.notes_orders(spark, sf))
    out = L.labels_to_ids(n, L.label_dictionary(n), strict=True, carry=["task"])
    return out.select("note_id", "task", _ids_str("label_ids").alias("label_ids"),
                      F.size("label_ids").cast("int").alias("n_ids"))


VIEWS["label_dict_open"] = (("label_dict", "code_list"), """
    SELECT label_id, label FROM label_dict WHERE label NOT IN (SELECT ccs FROM code_list)""")


@register("labels_to_ids_lenient", _IDS_SQL.format(dict="label_dict_open", notes="keyed_orders"), ("label_dict_open", "keyed_orders"))
def q_labels_to_ids_lenient(spark, sf):
    """Dictionary without the held-out codes: their labels are dropped, not an error."""
    n = checkpointed(T.keyed(T.notes_orders(spark, sf)), "notes")
    d = L.label_dictionary(n).join(T.code_list(spark).withColumnRenamed("ccs", "label"), "label", "left_anti")
    out = L.labels_to_ids(n, d, strict=False)
    return out.select("note_id", "task", _ids_str("label_ids").alias("label_ids"),
                      F.size("label_ids").cast("int").alias("n_ids"))


_MULTI_HOT_SQL = """
SELECT n.note_id, n.task,
       array_to_string(list_transform(range((SELECT count(*) FROM label_dict)),
                       lambda i: CASE WHEN list_contains(coalesce(x.ids, []::INTEGER[]), CAST(i AS INTEGER))
                                      THEN '1' ELSE '0' END), '') AS bits,
       CAST(coalesce(len(list_distinct(x.ids)), 0) AS INTEGER) AS n_hot
FROM notes_orders n
LEFT JOIN (SELECT note_id, list(d.label_id) AS ids
           FROM (SELECT note_id, unnest(labels) AS label FROM notes_orders) e
           JOIN label_dict d ON e.label = d.label GROUP BY note_id) x ON n.note_id = x.note_id"""


def _multi_hot(n):
    d = L.label_dictionary(n)
    return L.multi_hot(L.labels_to_ids(n, d, carry=["task"]), L.num_labels(d)), d


@register("multi_hot", _MULTI_HOT_SQL, ("label_dict",))
def q_multi_hot(spark, sf):
    mh, _ = _multi_hot(T.notes_orders(spark, sf))
    bits = F.array_join(F.transform("labels_ohe", lambda x: x.cast("int").cast("string")), "")
    n_hot = F.aggregate("labels_ohe", F.lit(0.0), lambda a, x: a + x).cast("int")
    return mh.select("note_id", "task", bits.alias("bits"), n_hot.alias("n_hot"))


@register("ids_to_labels",
          "SELECT note_id, task, array_to_string(list_sort(list_distinct(labels)), ',') AS decoded FROM keyed_orders",
          ("keyed_orders",))
def q_ids_to_labels(spark, sf):
    mh, d = _multi_hot(T.keyed(T.notes_orders(spark, sf)))
    out = L.ids_to_labels(mh, d)
    return out.select("note_id", "task", F.array_join("decoded", ",").alias("decoded"))


# ---- A6 -----------------------------------------------------------------------------------------

@register("scorable_labels", """
SELECT p.task, p.label_id, p.label, p.positives, s.n,
       CAST(row_number() OVER (PARTITION BY p.task ORDER BY p.label_id) - 1 AS INTEGER) AS position, p.label_id IN (2, 3, 5, 7, 11, 400) AS chosen
FROM (SELECT n.task, d.label_id, d.label, count(DISTINCT n.note_id) AS positives
      FROM (SELECT note_id, task, unnest(labels) AS label FROM notes_orders) n
      JOIN label_dict d ON n.label = d.label GROUP BY 1, 2, 3) p
JOIN (SELECT task, count(*) AS n FROM notes_orders GROUP BY task) s ON p.task = s.task
WHERE p.positives > 0 AND p.positives < s.n""", ("label_dict",))
def q_scorable_labels(spark, sf):
    n = T.notes_orders(spark, sf)
    d = L.label_dictionary(n)
    # one read of the notes: distinct labels of each note, looked up, counted per (task, label)
    long = (n.select("task", F.explode(F.array_distinct("labels")).alias("label"))
            .join(d, "label").select("task", "label_id"))
    pos = long.groupBy("task", "label_id").agg(F.count(F.lit(1)).alias("positives"))
    sizes = n.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    sc = L.scorable_from_sparse(pos, sizes, selected=[2, 3, 5, 7, 11, 400])
    return sc.join(d, "label_id").select("task", "label_id", "label", "positives", "n", "position", "chosen")


@register("scorable_cells", """
SELECT task, label_id, sum(y_true) AS positives, count(*) AS n,
       CAST(row_number() OVER (PARTITION BY task ORDER BY label_id) - 1 AS INTEGER) AS position, label_id IN (1, 5) AS chosen
FROM preds GROUP BY task, label_id HAVING sum(y_true) > 0 AND sum(y_true) < count(*)""", ("preds",))
def q_scorable_cells(spark, sf):
    """A6 on prediction cells, with chosen labels (one of them doesn't occur)."""
    return L.scorable_labels(T.preds(spark, sf), selected=[1, 5])


# ---- U5 -----------------------------------------------------------------------------------------

@register("labels_union", """
SELECT DISTINCT label FROM (
  SELECT unnest(labels) AS label FROM notes_orders
  UNION ALL SELECT unnest(labels) AS label FROM notes_docs) WHERE label IS NOT NULL""",
          ("notes_orders", "notes_docs"))
def q_labels_union(spark, sf):
    return L.labels_union(T.notes_orders(spark, sf), T.notes_docs(spark, sf))


# ---- P1-P6 --------------------------------------------------------------------------------------

@register("drop_unlabelled", """
SELECT note_id, task, CAST(len(labels) AS INTEGER) AS n_labels FROM notes_orders WHERE len(labels) > 0""",
          ("notes_orders",))
def q_drop_unlabelled(spark, sf):
    n = T.notes_orders(spark, sf).where(F.size("labels") > 0)
    return n.select("note_id", "task", F.size("labels").cast("int").alias("n_labels"))


@register("prune_columns", """
SELECT note_id, text, array_to_string(labels, ',') AS labels FROM notes_docs""", ("notes_docs",))
def q_prune_columns(spark, sf):
    n = T.notes_docs(spark, sf).select("note_id", "text", "labels")
    return n.select("note_id", "text", F.array_join("labels", ",").alias("labels"))


@register("normalise_columns", "SELECT doc_id AS note_id, text FROM documents")
def q_normalise_columns(spark, sf):
    raw = T.table(spark, sf, "documents").select(F.col("doc_id").alias("note_id"), F.col("text").alias("TEXT"))
    return L.normalise_columns(raw)


@register("select_translation", """
SELECT doc_id AS note_id, replace(text, 'the', 'THE') AS notes, text AS org_notes, replace(text, 'la', 'LA') AS "Opus_el_en", 'x' AS selected
FROM documents
UNION ALL SELECT doc_id, replace(text, 'la', 'LA'), text, replace(text, 'the', 'THE'), 'y' FROM documents""")
def q_select_translation(spark, sf):
    """Each translation chosen once (selected x: the official one, y: the other); the one not chosen stays a column."""
    d = T.table(spark, sf, "documents")
    raw = d.select(F.col("doc_id").alias("note_id"), F.col("text").alias("notes"),
                   F.replace("text", F.lit("the"), F.lit("THE")).alias("official_translation"),
                   F.replace("text", F.lit("la"), F.lit("LA")).alias("Opus_el_en"))
    official = L.select_translation(raw, "official_translation").withColumn("selected", F.lit("x"))
    other = L.select_translation(raw, "Opus_el_en").withColumnRenamed("official_translation", "Opus_el_en").withColumn("selected", F.lit("y"))
    return official.unionByName(other)


@register("filter_tasks", _IDS_SQL.format(dict="label_dict", notes="notes_orders") + "\nWHERE n.task LIKE '%AUTO%' OR n.task LIKE '%MACH%'",
          ("label_dict",))
def q_filter_tasks(spark, sf):
    """The dictionary covers all tasks; the task filter comes after it (reference order)."""
    n = T.notes_orders(spark, sf)
    d = L.label_dictionary(n)
    out = L.labels_to_ids(L.filter_tasks(n, ["AUTO", "MACH"], match="contains"), d, carry=["task"])
    return out.select("note_id", "task", _ids_str("label_ids").alias("label_ids"),
                      F.size("label_ids").cast("int").alias("n_ids"))


@register("filter_split", "SELECT note_id, task, stratum FROM notes_split WHERE split = 'dev'",
          ("notes_split",))
def q_filter_split(spark, sf):
    return notes_split(spark, sf).where(F.col("split") == "dev").select("note_id", "task", "stratum")


# ---- J4, A7, A20, A4 ------------------------------------------------------------------------------

@register("mask_zero_shot", """
SELECT note_id, split, label_id FROM split_labels
WHERE NOT (split IN ('train', 'dev') AND label IN (SELECT ccs FROM code_list))""",
          ("split_labels", "code_list"))
def q_mask_zero_shot(spark, sf):
    n, s = split_inputs(spark, sf)
    d = L.label_dictionary(n)      # the labelled notes carry every label of the corpus
    long = (s.select("note_id", "split", F.explode(F.array_distinct("labels")).alias("label"))
            .join(d, "label").select("note_id", "split", "label_id"))
    return L.mask_zero_shot(long, T.code_list(spark), d).select("note_id", "split", "label_id")


@register("unused_labels", """
SELECT g.task, g.split, d.label_id, d.label, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
       coalesce(c.n, 0) > 0 AS used
FROM label_dict d
JOIN (SELECT DISTINCT task, split FROM notes_split) g ON TRUE
LEFT JOIN (SELECT task, split, label_id, count(*) AS n FROM split_labels GROUP BY ALL) c
  ON c.task = g.task AND c.split = g.split AND c.label_id = d.label_id""", ("split_labels",))
def q_unused_labels(spark, sf):
    n, s = split_inputs(spark, sf)
    d = L.label_dictionary(n)      # the labelled notes carry every label of the corpus
    long = (s.select("note_id", "task", "split", F.explode(F.array_distinct("labels")).alias("label"))
            .join(d, "label").select("note_id", "task", "split", "label_id"))
    groups = [(t, sp) for t in T.SEGMENTS for sp in S.SPLITS]
    return L.unused_labels(long, d, ["task", "split"], groups)


@register("split_support_by_label", """
SELECT label, split, positives, round(positives / sum(positives) OVER (PARTITION BY label), 6) AS share
FROM (SELECT label, split, count(*) AS positives FROM split_labels GROUP BY ALL)""",
          ("split_labels",))
def q_split_support_by_label(spark, sf):
    """The order notes as tasks that share ids: a count of ids alone would be too low."""
    s = T.keyed(notes_split(spark, sf))
    ex = s.select("task", "note_id", "split", F.explode("labels").alias("label"))
    return L.split_support_by_label(ex).withColumn("share", F.round("share", 6))


@register("split_size_cap", """
SELECT split, smallest, least(smallest, CASE split WHEN 'train' THEN 5000 ELSE 1000 END) AS size
FROM (SELECT split, min(n) AS smallest FROM (SELECT task, split, count(*) AS n FROM notes_split GROUP BY ALL)
      GROUP BY split)""", ("notes_split",))
def q_split_size_cap(spark, sf):
    return L.split_size_cap(notes_split(spark, sf), {"train": 5000, "dev": 1000, "test": 1000})


# ---- ST1 ----------------------------------------------------------------------------------------

@register("grow_label_dictionary", """
SELECT label_id, label FROM (VALUES (0, 'quality'), (1, 'toxic')) v0(label_id, label)
WHERE label IN (SELECT unnest(labels) FROM notes_docs)
UNION ALL
SELECT CAST(row_number() OVER (ORDER BY label) + 1 AS INTEGER) AS label_id, label
FROM (SELECT DISTINCT unnest(labels) AS label FROM notes_orders)
WHERE label NOT IN ('quality', 'toxic')""", ("notes_docs", "notes_orders"))
def q_grow_label_dictionary(spark, sf):
    """Batch form: the dictionary of the document labels grows by the order-note labels."""
    v0 = L.label_dictionary(T.notes_docs(spark, sf))
    return grow_dictionary(v0, T.notes_orders(spark, sf).select(F.explode("labels").alias("label")))


@register("grow_label_dictionary_stream", """
SELECT CAST(row_number() OVER (ORDER BY p, label) - 1 AS INTEGER) AS label_id, label
FROM (SELECT e.label, min(t.pos) AS p
      FROM (SELECT task, unnest(labels) AS label FROM notes_orders) e
      JOIN (SELECT task, row_number() OVER (ORDER BY task) AS pos
            FROM (SELECT DISTINCT task FROM notes_orders)) t ON e.task = t.task
      GROUP BY e.label)""", ("notes_orders",))
def q_grow_label_dictionary_stream(spark, sf):
    """Stream form: the order notes of each task arrive as several files, tasks in name order; one
    micro-batch per arrival, a base after every second one.  New labels of a batch get the next ids, so the final
    dictionary orders labels by (first task they appear in, label)."""
    src, store, ck = shared_dir(spark, "st-src"), shared_dir(spark, "st-dict"), shared_dir(spark, "st-ck")
    n = checkpointed(T.notes_orders(spark, sf).select("note_id", "task", "labels"), "st-notes")
    tasks = sorted(r[0] for r in n.select("task").distinct().collect())      # a handful of task names
    for i, t in enumerate(tasks):                                              # arrivals
        n.where(F.col("task") == t).repartition(4).write.parquet(f"{src}/{i:05d}")
        run_dictionary_stream(spark, f"{src}/*", "note_id long, task string, labels array<string>", store, ck, compact=2)
    return latest_dictionary(spark, store)

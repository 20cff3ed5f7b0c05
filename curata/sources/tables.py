"""The driver's test tables and the fixture views built over them.

The views carry the shapes the reference's code works on (see FIXTURES.md):
notes with label lists, prediction tables, dense vectors, trial logs.  Each
view has a twin in ``curata.plans.oracle_views`` written in DuckDB SQL, so a
query built on a view can be checked against SQL on the same parquet files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixed values of the fixture views (FIXTURES.md section 2).
PRED_LABELS = ("quality", "toxic")          # label_id 0, 1
CODE_LIST = ("Brand#1", "Brand#2", "Brand#UNKNOWN")
ALIASES = ("a", "b", "c", "d", "e")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PRUNED_EVERY = 3
LEARNING_RATES = (5e-6, 1e-5, 2e-5, 3e-5, 5e-5, 8e-5)
WARMUP_STEPS = (0, 100, 250, 500, 750)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def notes_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note per order; labels = brands of its line items (repeats kept, sorted).

    lineitem joins part on the part key (shuffle on p_partkey, or broadcast when
    AQE measures part as small); the brand lists are built per order with a
    partial aggregate before the shuffle on l_orderkey.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    brands = (li.join(part, li.l_partkey == part.p_partkey)
              .groupBy("l_orderkey")
              .agg(F.collect_list("p_brand").alias("brands")))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (orders.join(cust, orders.o_custkey == cust.c_custkey, "left")
            .join(brands, orders.o_orderkey == brands.l_orderkey, "left")
            .select(F.col("o_orderkey").alias("note_id"),
                    F.col("o_custkey").alias("subject_id"),
                    F.col("c_mktsegment").alias("task"),
                    F.sort_array(F.coalesce("brands", F.array().cast("array<string>")))
                    .alias("labels")))


def _doc_label_list(q: Column, t: Column) -> Column:
    return F.concat(F.when(q == 1, F.array(F.lit(PRED_LABELS[0]))).otherwise(F.array().cast("array<string>")),
                    F.when(t == 1, F.array(F.lit(PRED_LABELS[1]))).otherwise(F.array().cast("array<string>")))


def notes_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a note; labels from the `labels` table (empty when absent)."""
    docs = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return (docs.join(lab, "doc_id", "left")
            .select(F.col("doc_id").alias("note_id"),
                    F.col("source").alias("subject_id"),
                    F.col("lang").alias("task"),
                    "text",
                    _doc_label_list(F.col("quality"), F.col("toxic")).alias("labels")))


def keyed(notes: DataFrame) -> DataFrame:
    """The same notes as tasks that number their notes on their own: five tasks share each id, one of them is null."""
    part = F.col("note_id") % 5
    return notes.withColumns({"task": F.when(part < 4, F.concat("task", F.lit("-"), part.cast("string"))),
                              "note_id": F.floor(F.col("note_id") / 5).cast("long")})


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores: a test table is one row group, so one task would do all work on its texts.
    (On a large table the scan has splits enough; nothing in the library repartitions.)"""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction table: labelled documents x {quality 0, toxic 1}, scores with many ties."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    lab = table(spark, sf_dir, "labels")
    cells = (docs.join(lab, "doc_id")
             .select("doc_id", "lang",
                     F.explode(F.array(
                         F.struct(F.lit(0).alias("label_id"), F.col("quality").alias("y_true")),
                         F.struct(F.lit(1).alias("label_id"), F.col("toxic").alias("y_true")))).alias("c")))
    y_prob = ((F.col("doc_id") * 7919 + F.col("c.label_id") * 104729) % 101).cast("double") / 100.0
    return cells.select(F.col("lang").alias("task"),
                        F.col("doc_id").alias("note_id"),
                        F.col("c.label_id").cast("int").alias("label_id"),
                        F.col("c.y_true").cast("int").alias("y_true"),
                        y_prob.alias("y_prob"),
                        ((y_prob - 0.5) * 8.0).alias("logit"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("note_id"),
                      F.concat(F.lit("t"), (F.col("vec_id") % 3).cast("string")).alias("task"),
                      F.col("embedding").cast("array<double>").alias("embedding"),
                      F.col("label").cast("int").alias("label"))


def epoch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-epoch validation metric of a trial: events of one user and type in time order."""
    ev = table(spark, sf_dir, "events").select("event_type", "user_id", "ts", "event_id", "value")
    r = ev.withColumn("__r", F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")))
    return r.select(F.col("event_type").alias("study"),
                    F.col("user_id").alias("trial"),
                    (F.col("__r") - 1).cast("int").alias("epoch"),
                    F.col("value"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    lr = F.element_at(F.array(*[F.lit(x) for x in LEARNING_RATES]),
                      (F.col("event_id") % len(LEARNING_RATES) + 1).cast("int"))
    wu = F.element_at(F.array(*[F.lit(float(x)) for x in WARMUP_STEPS]),
                      (F.col("event_id") % len(WARMUP_STEPS) + 1).cast("int"))
    return ev.select(F.col("event_type").alias("study"),
                     F.col("event_id").alias("trial"),
                     F.when(F.col("event_id") % PRUNED_EVERY == 0, "PRUNED").otherwise("COMPLETE").alias("state"),
                     F.col("value"),
                     F.create_map(F.lit("learning_rate"), lr, F.lit("warmup_steps"), wu).alias("params"))


def section_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents turned into sectioned notes; every section holds the whole document text.

    doc_id % 3 picks the layout: chief complaint + present illness; present
    illness only; medical history + hospital course (heading without a colon).
    Each note ends with a `Discharge:` heading so the last section is closed.
    """
    docs = table(spark, sf_dir, "documents")
    nl2 = "\n\n"
    t = F.col("text")
    k = F.col("doc_id") % 3
    text = (F.when(k == 0, F.concat(F.lit("Chief Complaint: "), t, F.lit(nl2 + "Present Illness: "), t,
                                    F.lit(nl2 + "Discharge: ")))
            .when(k == 1, F.concat(F.lit("Present Illness: "), t, F.lit(nl2 + "Discharge: ")))
            .otherwise(F.concat(F.lit("Medical History: "), t, F.lit(nl2 + "Brief Hospital Course\n"), t,
                                F.lit(nl2 + "Discharge: "))))
    return docs.select(F.col("doc_id").alias("note_id"), F.col("lang").alias("task"), text.alias("text"))


def code_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in CODE_LIST], "ccs string")


def task_alias(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, a, t) for i, (a, t) in enumerate(zip(ALIASES, SEGMENTS))],
                                 "pos int, alias string, task string")


def results_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result matrix in the reference's cell format, made from `preds`.

    The value of step s on task t is the share of cells of t whose prediction
    at cut (s+1)/5 is right.  Steps follow the sorted task names.
    """
    p = preds(spark, sf_dir)
    tasks = p.select("task").distinct()
    steps = tasks.select(F.col("task").alias("train_task"),
                         (F.dense_rank().over(Window.orderBy("task")) - 1).cast("int").alias("train_step"))
    # one row per (step, cell): steps is tiny (number of tasks), exploded from an array
    step_arr = steps.agg(F.sort_array(F.collect_list("train_step")).alias("s")).scalar()
    cells = p.select("task", "y_true", "y_prob", F.explode(step_arr).alias("train_step"))
    cut = (F.col("train_step") + 1).cast("double") / 5.0
    right = F.when((F.col("y_prob") >= cut) == (F.col("y_true") == 1), 1.0).otherwise(0.0)
    agg = cells.groupBy("train_step", F.col("task").alias("eval_task")).agg(F.round(F.avg(right), 4).alias("v"))
    return agg.select("train_step", "eval_task",
                      F.concat(F.lit("[{'torchmetrics.auroc': "), F.col("v").cast("string"), F.lit("}]")).alias("cell"))

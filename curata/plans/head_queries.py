"""Registered queries for the linear head and continual runs.

The one-step fit from a zero head has a closed form (gradient at W = 0), so it
and the logits it gives are checked against SQL; multi-epoch fits, sequence
runs and trial grids are iterative and checked by row counts plus pytest.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.operators import continual as C
from curata.operators import experiments as E
from curata.operators import head as Hd
from curata.operators import splits as S
from curata.operators.catalogue import HeadCatalogue
from curata.plans.oracle_views import VIEWS
from curata.plans.registry import register
from curata.session import checkpointed, shared_dir
from curata.sources import tables as T

EPOCHS = 5
LR = 2.0
GRID = ((0.5, 0), (1.0, 0), (2.0, 1), (4.0, 2))   # (learning rate, warm-up epochs) for the linear head

VIEWS["vec_cells"] = (("vectors",), """
    SELECT note_id, label, unnest(embedding) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS d
    FROM vectors""")
VIEWS["vec_labels"] = (("vectors",), """
    SELECT CAST(unnest(range(0, (SELECT max(label) + 1 FROM vectors))) AS INTEGER) AS label_id""")
VIEWS["head_step"] = (("vec_cells", "vec_labels"), """
    SELECT l.label_id, c.d,
           sum(((CASE WHEN c.label = l.label_id THEN 1.0 ELSE 0.0 END) - 0.5) * c.v)
             / ((SELECT count(*) FROM vectors) * (SELECT count(*) FROM vec_labels)) AS w
    FROM vec_cells c, vec_labels l GROUP BY ALL
    UNION ALL
    SELECT l.label_id, -1 AS d,
           sum((CASE WHEN v.label = l.label_id THEN 1.0 ELSE 0.0 END) - 0.5)
             / ((SELECT count(*) FROM vectors) * (SELECT count(*) FROM vec_labels)) AS w
    FROM vectors v, vec_labels l GROUP BY ALL""")


def vector_notes(spark, sf):
    """vectors with label_ids = [label] and a stratified split per task."""
    v = T.vectors(spark, sf).withColumn("labels", F.array(F.col("label").cast("string")))
    s = S.stratified_split(v)
    return s.select("note_id", "task", "split", "embedding", F.array("label").alias("label_ids"))


def _shape(df):
    r = df.agg(F.max(F.element_at("label_ids", 1)).alias("l"), F.max(F.size("embedding")).alias("d")).first()
    return int(r["l"]) + 1, int(r["d"])


def _step_head(spark, sf):
    v = T.vectors(spark, sf).select("embedding", F.array("label").alias("label_ids"))
    n_labels, dim = _shape(v)
    return Hd.fit_linear_head(v, Hd.Head.zeros(n_labels, dim), lr=1.0, epochs=1), n_labels, dim


@register("fit_linear_head_step", "SELECT label_id, d, round(w, 6) AS w FROM head_step", ("head_step",))
def q_fit_linear_head_step(spark, sf):
    head, n_labels, dim = _step_head(spark, sf)
    rows = [(i, d, float(head.weights[i, d])) for i in range(n_labels) for d in range(dim)]
    rows += [(i, -1, float(head.bias[i])) for i in range(n_labels)]
    return spark.createDataFrame(rows, "label_id int, d int, w double").select(
        "label_id", "d", F.round("w", 6).alias("w"))


@register("score_linear_head", """
SELECT c.note_id, h.label_id, round(sum(c.v * h.w) + max(b.w), 6) AS logit
FROM vec_cells c JOIN head_step h ON c.d = h.d
JOIN (SELECT label_id, w FROM head_step WHERE d = -1) b ON h.label_id = b.label_id
GROUP BY c.note_id, h.label_id""", ("head_step",))
def q_score_linear_head(spark, sf):
    head, _, _ = _step_head(spark, sf)
    v = T.vectors(spark, sf)
    s = Hd.score_linear_head(v, head)
    return s.select("note_id", "label_id", F.round("logit", 6).alias("logit"))


@register("fit_linear_head")
def q_fit_linear_head(spark, sf):
    v = vector_notes(spark, sf)
    n_labels, dim = _shape(v)
    train = checkpointed(v.where(F.col("split") == "train"))
    head = Hd.fit_linear_head(train, Hd.Head.zeros(n_labels, dim), LR, EPOCHS)
    rows = [(i, float(head.bias[i]), float(np.linalg.norm(head.weights[i]))) for i in range(n_labels)]
    return spark.createDataFrame(rows, "label_id int, bias double, weight_norm double")


@register("continual_run")
def q_continual_run(spark, sf):
    v = vector_notes(spark, sf)
    n_labels, dim = _shape(v)
    seq = ["t0", "t1", "t2"]
    return C.continual_run(v, seq, n_labels, dim, EPOCHS, LR)


TASKS = ("t0", "t1", "t2")


def _trials(spark, sf):
    """The trial grid of every task: (task, metrics, trials, snapshots)."""
    v = checkpointed(vector_notes(spark, sf), "vector-notes")
    n_labels, dim = _shape(v)
    for t in TASKS:
        own = v.where(F.col("task") == t)
        yield (t, *C.trial_grid(own.where(F.col("split") == "train"), own.where(F.col("split") == "dev"), GRID, n_labels, dim, EPOCHS, study=t))


@register("trial_grid")
def q_trial_grid(spark, sf):
    """M4 then W1/W2 per task and trial: the best epoch and its score."""
    out = []
    for _, metrics, trials, _ in _trials(spark, sf):
        best = E.best_checkpoint(metrics, patience=E.PATIENCE)
        out.append(best.join(trials.select("study", "trial", F.element_at("params", F.lit("learning_rate")).alias("learning_rate")), ["study", "trial"]))
    return reduce(DataFrame.unionByName, out)


@register("select_best_head")
def q_select_best_head(spark, sf):
    """M5 for every task: the promoted weights are those of the best trial's best epoch."""
    cat = shared_dir(spark, "heads")
    out = [C.select_best_head(metrics, trials, snapshots, cat, "grid", i, t) for i, (t, metrics, trials, snapshots) in enumerate(_trials(spark, sf))]
    return reduce(DataFrame.unionByName, out).select("experiment", "step", "seq_key", "trial", "epoch", "learning_rate", "label_id", "bias")


@register("head_catalogue")
def q_head_catalogue(spark, sf):
    """A second run of the whole sequence finds the head of every step in the catalogue."""
    v = checkpointed(vector_notes(spark, sf), "vector-notes")
    n_labels, dim = _shape(v)
    cat = shared_dir(spark, "heads")
    C.continual_run(v, TASKS, n_labels, dim, 2, LR, catalogue=cat, experiment="cat").collect()
    again = C.continual_run(v, TASKS, n_labels, dim, 2, LR, catalogue=cat, experiment="cat")
    heads = HeadCatalogue(spark, cat)
    found = heads.rows([heads.lookup("cat", i, "_".join(TASKS[: i + 1])) for i in range(len(TASKS))])
    return found.select("experiment", "step", "seq_key", "version", "label_id", "bias").join(again.select("seq_key", "eval_task", "auroc_macro"), "seq_key")


@register("score_with", """
SELECT vec_id AS note_id,
       round(1.0 / (1.0 + exp(-(list_sum(e) / (sqrt(list_sum(list_transform(e, lambda x: x * x))) + 1e-12)))), 6)
           AS y_prob
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""")
def q_score_with(spark, sf):
    """M6: a user model function over Arrow batches (here: sigmoid of the normalised sum of the vector)."""
    v = T.vectors(spark, sf)

    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.asarray(e, dtype=float) for e in pdf["embedding"]]) if len(pdf) else np.zeros((0, 1))
        norm = np.linalg.norm(x, axis=1) + 1e-12
        p = 1.0 / (1.0 + np.exp(-(x.sum(axis=1) / norm)))
        return pd.DataFrame({"note_id": pdf["note_id"].to_numpy(), "y_prob": p})

    scored = Hd.score_with(v.select("note_id", "embedding"), model, "note_id long, y_prob double")
    return scored.select("note_id", F.round("y_prob", 6).alias("y_prob"))

"""Continual experiments on Spark: sequence runs, trial grids and head promotion (M3, M4, M5).

The driver loops over the few positions of a task sequence (and over epochs
inside M2); every pass over notes is a distributed Spark job.  Scoring turns
heads into long prediction cells which go through the same metric operators
as any prediction table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.functions.numeric import sigmoid
from curata.operators.catalogue import HeadCatalogue
from curata.operators.experiments import PATIENCE, best_checkpoint, study_summary
from curata.operators.head import Head, fit_linear_head, gradient_pass, head_from_rows, lr_at, score_linear_head
from curata.operators.metrics import auroc_macro_weighted, auroc_micro
from curata.session import checkpointed, shared_dir

SNAPSHOT = "study string, trial bigint, epoch int, label_id int, weights array<double>, bias double"


def prediction_cells(df: DataFrame, head: Head, features: str = "embedding", targets: str = "label_ids",
                     group: str = "task") -> DataFrame:
    """Score a head and pair each cell with its truth: (group, note_id, label_id, y_true, logit, y_prob)."""
    s = score_linear_head(df, head, features, keep=[group, targets])
    return s.select(group, "note_id", "label_id",
                    F.array_contains(targets, F.col("label_id")).cast("int").alias("y_true"),
                    "logit", sigmoid("logit").alias("y_prob"))


def evaluate(df: DataFrame, head: Head, features: str = "embedding", targets: str = "label_ids") -> DataFrame:
    """Macro and micro AUROC of a head on every task of `df` (J7 + J8 + A15 + A16)."""
    cells = prediction_cells(df, head, features, targets)
    macro = auroc_macro_weighted(cells).select("task", "auroc_macro")
    micro = auroc_micro(cells)
    return macro.join(micro, "task", "full").withColumnRenamed("task", "eval_task")


def continual_run(feats: DataFrame, sequence: Sequence[str], n_labels: int, dim: int, epochs: int, lr: float,
                  catalogue: str | None = None, experiment: str = "run", features: str = "embedding",
                  targets: str = "label_ids") -> DataFrame:
    """M3: for each task in order, reuse a stored head of the ``catalogue`` (a folder, S10) or fit from the previous head
    (M2) and publish it; then evaluate on all tasks.  Output: (train_step, trained_task, seq_key,
    eval_task, auroc_macro, auroc_micro) — the long form of the result matrix."""
    spark = feats.sparkSession
    feats = checkpointed(feats.select("note_id", "task", "split", features, targets))
    test = feats.where(F.col("split") == "test")
    head = Head.zeros(n_labels, dim)
    heads = HeadCatalogue(spark, catalogue) if catalogue is not None else None
    out = []
    for i, task in enumerate(sequence):
        seq_key = "_".join(sequence[: i + 1])
        known = heads.lookup(experiment, i, seq_key) if heads else None
        if known is None:
            train = feats.where((F.col("task") == task) & (F.col("split") == "train"))
            head = fit_linear_head(train, head, lr, epochs, features=features, targets=targets)
            if heads and not heads.publish(head.to_frame(spark), experiment, i, seq_key, learning_rate=float(lr)):
                known = heads.lookup(experiment, i, seq_key)         # another run was first: go on with its head
        if known is not None:
            head = head_from_rows(heads.rows([known]).collect(), n_labels, dim)      # <= L rows
        ev = evaluate(test, head, features, targets)
        out.append(ev.select(F.lit(i).alias("train_step"), F.lit(task).alias("trained_task"),
                             F.lit(seq_key).alias("seq_key"), "eval_task", "auroc_macro", "auroc_micro"))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def trial_grid(train: DataFrame, dev: DataFrame, grid: Sequence[tuple[float, int]], n_labels: int, dim: int,
               epochs: int, init: Head | None = None, study: str = "study", features: str = "embedding",
               targets: str = "label_ids", patience: int = PATIENCE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M4: every (learning rate, warm-up) trial trained in the same passes over `train`.

    After each epoch the heads are scored on `dev` in one job (stacked into one head of K*L
    labels), their macro AUROC per trial is logged and the heads are written as snapshots of the epoch.  A trial whose AUROC has not
    improved for ``patience`` epochs, or is missing, stops and leaves the stacked passes.
    Returns (epoch_metrics, trials, snapshots); snapshots: (study, trial, epoch, label_id, weights, bias).
    """
    spark = train.sparkSession
    train = checkpointed(train.select(features, targets))
    dev = checkpointed(dev.select("note_id", "task", features, targets))
    init = init or Head.zeros(n_labels, dim)
    store = shared_dir(spark, "snapshots")
    w, b = np.stack([init.weights] * len(grid)).astype(np.float64), np.stack([init.bias] * len(grid)).astype(np.float64)
    log: list[tuple] = []
    best, since = [-np.inf] * len(grid), [0] * len(grid)
    active = list(range(len(grid)))
    for e in range(epochs):
        if not active:
            break
        g, gb, n = gradient_pass(train, w[active], b[active], features, targets)
        if not n:
            break
        for at, t in enumerate(active):
            size = lr_at(e, grid[t][0], grid[t][1], epochs) / (n * n_labels)
            w[t] -= size * g[at]
            b[t] -= size * gb[at]
        rows = [(study, t, e, i, w[t, i].tolist(), float(b[t, i])) for t in active for i in range(n_labels)]       # K x L rows
        spark.createDataFrame(rows, SNAPSHOT).coalesce(1).write.parquet(f"{store}/at={e}")
        stacked = Head(np.concatenate(w[active]), np.concatenate(b[active]))
        s = score_linear_head(dev, stacked, features, keep=[targets])
        label = F.col("label_id") % n_labels
        cells = s.select((F.col("label_id") / n_labels).cast("int").alias("at"), "note_id", label.alias("label_id"),
                         F.array_contains(targets, label.cast("int")).cast("int").alias("y_true"), sigmoid("logit").alias("y_prob"))
        found = {r["at"]: r["auroc_macro"] for r in auroc_macro_weighted(cells, group=("at",)).collect()}           # K rows
        values = [found.get(at) for at in range(len(active))]
        log += [(study, t, e, None if v is None else float(v)) for t, v in zip(active, values)]
        for t, v in zip(list(active), values):
            if v is not None and v > best[t]:
                best[t], since[t] = v, e
            elif v is None or e - since[t] >= patience:
                active.remove(t)
    metrics = spark.createDataFrame(log, "study string, trial bigint, epoch int, value double")
    trials = spark.createDataFrame(
        [(study, t, "COMPLETE", {"learning_rate": float(grid[t][0]), "warmup_steps": float(grid[t][1])})
         for t in range(len(grid))], "study string, trial bigint, state string, params map<string,double>")
    snapshots = spark.read.schema(SNAPSHOT).parquet(*[f"{store}/at={e}" for e in sorted({r[2] for r in log})]) if log else spark.createDataFrame([], SNAPSHOT)
    return metrics, trials, snapshots


def select_best_head(metrics: DataFrame, trials: DataFrame, snapshots: DataFrame, catalogue: str, experiment: str, step: int,
                     seq_key: str, patience: int = PATIENCE) -> DataFrame:
    """M5: the best trial's head of its best epoch (W2, A19), by a join with the snapshots, is published as promoted.

    Returns the promoted head with the trial's learning rate and epoch.  No trial with a value is an error; a head
    that was promoted before under the same name stays.
    """
    outcome = best_checkpoint(metrics, patience=patience).select("study", "trial", "best_epoch", F.col("best_value").alias("value"))
    scored = trials.join(outcome, ["study", "trial"]).where(F.col("value").isNotNull())
    best = study_summary(scored).select("study", F.col("best_trial").alias("trial"), F.col("best_learning_rate").alias("learning_rate"))
    chosen = best.join(outcome, ["study", "trial"]).select("study", "trial", F.col("best_epoch").alias("epoch"), "learning_rate")
    rows = chosen.collect()                           # one per study
    if len(rows) != 1:
        raise ValueError(f"{len(rows)} best trials to promote, not one")
    head = snapshots.join(chosen, ["study", "trial", "epoch"])
    heads = HeadCatalogue(metrics.sparkSession, catalogue)
    heads.publish(head, experiment, step, seq_key, version=1, promoted=True, trial=rows[0]["trial"], epoch=rows[0]["epoch"], learning_rate=rows[0]["learning_rate"])
    return heads.rows([heads.lookup(experiment, step, seq_key)])

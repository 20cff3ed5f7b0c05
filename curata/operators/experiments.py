"""Trial logs, early stopping, result matrices and forgetting.

A trial's log is folded in one row, bounded by the epoch limit of a trial;
per-study aggregates are hash aggregates.  The result matrix stays long; the pivot is for display only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.operators.ranking import two_level_scan

PATIENCE = 4           # the reference hard-codes 4 (its config value 3 is never read)
EPOCH_BUCKET = 1024    # epochs per bucket of the two-level running maxima
BATCH_SIZE = 8
ACCUMULATION = 4


def trial_outcomes(metrics: DataFrame, keys: Sequence[str] = ("study", "trial"), patience: int = PATIENCE) -> DataFrame:
    """W1 and W2 in one pass: (keys, stop_epoch, best_epoch, best_value) of every trial (mode max).

    One aggregation gathers a trial's epochs, at most its epoch limit (100 in the reference's configs), sorts them and folds them: a value
    strictly above the best so far is the new best; training stops at the first epoch that lies ``patience`` or more after the
    best one, else with the last epoch.  What comes after the stop doesn't count.

    A value that isn't finite (NaN, infinite) stops the trial at its epoch, as a finiteness check does, and is never the best; an epoch without a
    value (null) is skipped.  A trial without a finite value has no best.  Null keys are a trial of their own.  For logs without an epoch limit use
    ``early_stop_long``.
    """
    k = list(keys)
    epoch = F.when(F.col("value").isNotNull(), F.struct(F.col("epoch").cast("int").alias("epoch"), F.col("value").cast("double").alias("value")))
    logs = metrics.groupBy(*k).agg(F.sort_array(F.collect_list(epoch)).alias("__log"), F.max("epoch").cast("int").alias("__last"))
    none = F.struct(F.lit(None).cast("double").alias("best"), F.lit(None).cast("int").alias("best_epoch"), F.lit(None).cast("int").alias("since"), F.lit(None).cast("int").alias("stop"))

    def step(state: Column, x: Column) -> Column:
        finite = ~F.isnan(x["value"]) & (F.abs(x["value"]) != float("inf"))
        better = finite & (state["best"].isNull() | (x["value"] > state["best"]))
        since = F.when(better | state["since"].isNull(), x["epoch"]).otherwise(state["since"])
        over = ~finite | (x["epoch"] - since >= patience)
        new = F.struct(F.when(better, x["value"]).otherwise(state["best"]).alias("best"), F.when(better, x["epoch"]).otherwise(state["best_epoch"]).alias("best_epoch"),
                       since.alias("since"), F.when(over, x["epoch"]).alias("stop"))
        return F.when(state["stop"].isNotNull(), state).otherwise(new)

    folded = logs.withColumn("__s", F.aggregate("__log", none, step))
    return folded.select(*k, F.coalesce("__s.stop", "__last").alias("stop_epoch"), F.col("__s.best_epoch").alias("best_epoch"), F.col("__s.best").alias("best_value"))


def early_stop(metrics: DataFrame, keys: Sequence[str] = ("study", "trial"), patience: int = PATIENCE) -> DataFrame:
    """The epoch at which each trial stops (``trial_outcomes``)."""
    return trial_outcomes(metrics, keys, patience).select(*keys, "stop_epoch")


def best_checkpoint(metrics: DataFrame, keys: Sequence[str] = ("study", "trial"), patience: int = PATIENCE) -> DataFrame:
    """First epoch reaching the maximum up to the stop epoch; its value is the trial score (``trial_outcomes``)."""
    return trial_outcomes(metrics, keys, patience)


def early_stop_long(metrics: DataFrame, keys: Sequence[str] = ("study", "trial"), patience: int = PATIENCE) -> DataFrame:
    """W1 for logs of any length (finite values, epochs 0, 1, 2, ...), spread over tasks.

    The running best (inclusive) is non-decreasing, and it changes exactly at the
    improving epochs; so each value of it is a plateau whose first epoch s is an
    improvement.  Training stops at s + patience for the first plateau that lasts
    that long.  One two-level running max (epoch buckets, so even a huge epoch log
    is spread over tasks) and two partial aggregates; no second scan.
    """
    k = list(keys)
    bucket = F.floor(F.col("epoch") / EPOCH_BUCKET).cast("int")
    m = two_level_scan(metrics, k, bucket, [F.col("epoch")], "value", "__best", "max", inclusive=True)
    plateaus = m.groupBy(*k, "__best").agg(F.min("epoch").alias("__s"), F.max("epoch").alias("__e"))
    stop = F.min(F.when(F.col("__e") - F.col("__s") >= patience, F.col("__s") + patience))
    return plateaus.groupBy(*k).agg(F.coalesce(stop, F.max("__e")).cast("int").alias("stop_epoch"))


def study_summary(trials: DataFrame, param_names: Sequence[str] = ("learning_rate", "warmup_steps")) -> DataFrame:
    """Trials total, pruned, complete per study; the best complete trial (maximise,
    lowest trial number on ties) with its value and parameters."""
    done = F.col("state") == "COMPLETE"
    best = F.max_by(F.when(done, F.struct("trial", "value", "params")),
                    F.when(done, F.struct(F.col("value"), -F.col("trial"))))
    agg = trials.groupBy("study").agg(F.count(F.lit(1)).alias("n_trials"),
                                      F.count_if(F.col("state") == "PRUNED").alias("n_pruned"),
                                      F.count_if(done).alias("n_complete"),
                                      best.alias("__b"))
    return agg.select("study", "n_trials", "n_pruned", "n_complete",
                      F.col("__b.trial").alias("best_trial"), F.col("__b.value").alias("best_value"),
                      *[F.element_at("__b.params", F.lit(p)).alias(f"best_{p}") for p in param_names])


def rank_results(results: DataFrame, metric: str = "value", tie: str = "trial", k: int | None = None) -> DataFrame:
    """O3: all rows by the metric, descending (a range sort); with ``k`` the top k (TakeOrdered)."""
    ranked = results.orderBy(F.desc(metric), F.col(tie))
    return ranked if k is None else ranked.limit(k)


def result_matrix(long: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """Train step x eval task matrix of the metric, for display (pivot values given)."""
    return long.groupBy("train_step").pivot("eval_task", list(tasks)).agg(F.first("value"))


def forgetting_summary(long: DataFrame, positions: DataFrame) -> DataFrame:
    """M7: average final score, backward transfer and forgetting of a task sequence.

    `long` = (train_step, eval_task, value); `positions` = (eval_task, task_pos): the
    step at which each task was trained.  R[T-1, i] is the final row.
    BWT = mean_{i<T-1}(R[T-1,i] - R[i,i]); forgetting = mean_{i<T-1}(max_{l<T-1} R[l,i] - R[T-1,i]).
    """
    last = long.agg(F.max("train_step").alias("T1")).scalar()
    r = long.join(positions, "eval_task").withColumn("__T1", last)
    per_task = r.groupBy("eval_task", "task_pos", "__T1").agg(
        F.max(F.when(F.col("train_step") == F.col("__T1"), F.col("value"))).alias("final"),
        F.max(F.when(F.col("train_step") == F.col("task_pos"), F.col("value"))).alias("diag"),
        F.max(F.when(F.col("train_step") < F.col("__T1"), F.col("value"))).alias("best_prior"))
    before = F.col("task_pos") < F.col("__T1")
    return per_task.agg(F.avg("final").alias("avg_final"),
                        F.avg(F.when(before, F.col("final") - F.col("diag"))).alias("backward_transfer"),
                        F.avg(F.when(before, F.col("best_prior") - F.col("final"))).alias("forgetting"))


def alias_lookup(aliases: Sequence[str], tasks: Sequence[str], col: Column | str, reverse: bool = False) -> Column:
    """Alias letter -> task name (or back); an unknown value fails the query."""
    pairs = zip(tasks, aliases) if reverse else zip(aliases, tasks)
    m = F.create_map(*[x for a, b in pairs for x in (F.lit(a), F.lit(b))])
    c = F.col(col) if isinstance(col, str) else col
    v = F.element_at(m, c)
    return F.when(v.isNull(), F.raise_error(F.concat(F.lit("unknown sequence item: "), c))).otherwise(v)


def step_budget(sizes: DataFrame, epochs: int, batch_size: int = BATCH_SIZE,
                accumulation: int = ACCUMULATION) -> DataFrame:
    """P10: optimiser steps per task = floor(ceil(n / batch) / accumulation) * epochs."""
    batches = F.ceil(F.col("n") / F.lit(batch_size)).cast("long")
    return sizes.select("*", batches.alias("batches"),
                        (F.floor(batches / F.lit(accumulation)) * epochs).cast("long").alias("steps"))


def eval_grid(test_notes: DataFrame, steps: DataFrame) -> DataFrame:
    """Every trained step is evaluated on every task (also tasks not trained yet).

    `steps` = (train_step, trained_task), one row per position of the sequence
    (bounded by the sequence length).  The steps travel as one array (a scalar
    subquery) and are exploded next to each note: no join of the note table.
    """
    arr = steps.agg(F.sort_array(F.collect_list(F.struct("train_step", "trained_task")))).scalar()
    return test_notes.withColumn("__s", arr).select("*", F.explode("__s").alias("__x")).select(
        F.col("__x.train_step").alias("train_step"), F.col("__x.trained_task").alias("trained_task"),
        *[c for c in test_notes.columns])


def eval_grid_counts(test_notes: DataFrame, steps: DataFrame) -> DataFrame:
    """J7 as counts: (train_step, trained_task, task, n_notes), from the notes of each task and the step list; no note is copied."""
    arr = steps.agg(F.sort_array(F.collect_list(F.struct("train_step", "trained_task")))).scalar()
    counts = test_notes.groupBy("task").agg(F.count(F.lit(1)).alias("n_notes")).withColumn("__s", arr)
    return counts.select(F.explode("__s").alias("__x"), "task", "n_notes").select("__x.train_step", "__x.trained_task", "task", "n_notes")

"""Registered queries for trial logs and continual-experiment results."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curata.functions.text import parse_result_cell
from curata.operators import experiments as E
from curata.plans.corpus_queries import notes_split, split_inputs
from curata.plans.oracle_views import VIEWS
from curata.plans.registry import register
from curata.sources import tables as T

# The languages of the test documents (result-matrix columns).
LANGS = ("de", "en", "es", "fr")

VIEWS["stops"] = (("epoch_metrics",), """
    SELECT study, trial, coalesce(min(epoch) FILTER (WHERE epoch - last_imp >= 4), max(epoch)) AS stop_epoch
    FROM (SELECT *, max(CASE WHEN best_before IS NULL OR value > best_before THEN epoch END)
                      OVER (PARTITION BY study, trial ORDER BY epoch
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp
          FROM (SELECT *, max(value) OVER (PARTITION BY study, trial ORDER BY epoch
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before
                FROM epoch_metrics))
    GROUP BY study, trial""")

VIEWS["results_long"] = (("results_cells",), """
    SELECT train_step, eval_task, CAST(regexp_extract(cell, ': ([^}]+)}', 1) AS DOUBLE) AS value
    FROM results_cells""")


def _results_long(spark, sf):
    c = T.results_cells(spark, sf)
    return c.select("train_step", "eval_task", parse_result_cell("cell").alias("value"))


@register("early_stop", "SELECT study, trial, stop_epoch FROM stops", ("stops",))
def q_early_stop(spark, sf):
    return E.early_stop(T.epoch_metrics(spark, sf))


@register("best_checkpoint", """
SELECT study, trial, stop_epoch, epoch AS best_epoch, round(value, 6) AS best_value
FROM (SELECT e.study, e.trial, s.stop_epoch, e.epoch, e.value,
             row_number() OVER (PARTITION BY e.study, e.trial ORDER BY e.value DESC, e.epoch) AS r
      FROM epoch_metrics e JOIN stops s ON e.study = s.study AND e.trial = s.trial
      WHERE e.epoch <= s.stop_epoch)
WHERE r = 1""", ("stops",))
def q_best_checkpoint(spark, sf):
    b = E.best_checkpoint(T.epoch_metrics(spark, sf))
    return b.select("study", "trial", "stop_epoch", "best_epoch", F.round("best_value", 6).alias("best_value"))


@register("study_summary", """
SELECT t.study, t.n_trials, t.n_pruned, t.n_complete, b.trial AS best_trial, round(b.value, 6) AS best_value,
       b.learning_rate AS best_learning_rate, b.warmup_steps AS best_warmup_steps
FROM (SELECT study, count(*) AS n_trials, CAST(count_if(state = 'PRUNED') AS BIGINT) AS n_pruned,
             CAST(count_if(state = 'COMPLETE') AS BIGINT) AS n_complete FROM trials GROUP BY study) t
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY study ORDER BY value DESC, trial) AS r
                          FROM trials WHERE state = 'COMPLETE') WHERE r = 1) b ON t.study = b.study""",
          ("trials",))
def q_study_summary(spark, sf):
    s = E.study_summary(T.trials(spark, sf))
    return s.withColumn("best_value", F.round("best_value", 6))


@register("rank_results", """
SELECT study, trial, round(value, 6) AS value FROM trials ORDER BY value DESC, trial""", ("trials",))
def q_rank_results(spark, sf):
    r = E.rank_results(T.trials(spark, sf).select("study", "trial", "value"))
    return r.select("study", "trial", F.round("value", 6).alias("value"))


@register("result_matrix", "SELECT train_step, " + ", ".join(
    f"round(max(CASE WHEN eval_task = '{t}' THEN value END), 6) AS {t}" for t in LANGS)
          + " FROM results_long GROUP BY train_step", ("results_long",))
def q_result_matrix(spark, sf):
    m = E.result_matrix(_results_long(spark, sf), LANGS)
    return m.select("train_step", *[F.round(t, 6).alias(t) for t in LANGS])


@register("forgetting_summary", """
SELECT round(avg(final), 6) AS avg_final,
       round(avg(final - diag) FILTER (WHERE pos < t1), 6) AS backward_transfer,
       round(avg(best_prior - final) FILTER (WHERE pos < t1), 6) AS forgetting
FROM (SELECT r.eval_task, p.pos, m.t1,
             max(CASE WHEN r.train_step = m.t1 THEN r.value END) AS final,
             max(CASE WHEN r.train_step = p.pos THEN r.value END) AS diag,
             max(CASE WHEN r.train_step < m.t1 THEN r.value END) AS best_prior
      FROM results_long r
      JOIN (SELECT eval_task, CAST(dense_rank() OVER (ORDER BY eval_task) - 1 AS INTEGER) AS pos
            FROM (SELECT DISTINCT eval_task FROM results_long)) p ON r.eval_task = p.eval_task
      JOIN (SELECT max(train_step) AS t1 FROM results_long) m ON TRUE
      GROUP BY ALL)""", ("results_long",))
def q_forgetting_summary(spark, sf):
    long = _results_long(spark, sf)
    pos = long.select("eval_task").distinct().select(
        "eval_task", (F.dense_rank().over(Window.orderBy("eval_task")) - 1).cast("int").alias("task_pos"))
    f = E.forgetting_summary(long, pos)
    return f.select(*[F.round(c, 6).alias(c) for c in ("avg_final", "backward_transfer", "forgetting")])


@register("map_task_alias", """
SELECT a.alias, n.task, count(*) AS n FROM notes_orders n JOIN task_alias a ON n.task = a.task GROUP BY ALL""",
          ("notes_orders", "task_alias"))
def q_map_task_alias(spark, sf):
    n = T.notes_orders(spark, sf)
    c = n.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    alias = E.alias_lookup(T.ALIASES, T.SEGMENTS, "task", reverse=True)
    back = E.alias_lookup(T.ALIASES, T.SEGMENTS, "alias")
    return c.select(alias.alias("alias"), "task", "n").select("alias", back.alias("task"), "n")


@register("step_budget", """
SELECT task, n, CAST(ceil(n / 8.0) AS BIGINT) AS batches, CAST(floor(ceil(n / 8.0) / 4) * 100 AS BIGINT) AS steps
FROM (SELECT task, count(*) AS n FROM notes_split WHERE split = 'train' GROUP BY task)""", ("notes_split",))
def q_step_budget(spark, sf):
    s = notes_split(spark, sf).where(F.col("split") == "train").groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    return E.step_budget(s, epochs=100)


@register("eval_grid", """
SELECT s.train_step, s.trained_task, n.task AS eval_task, count(*) AS n_notes
FROM (SELECT note_id, task FROM notes_split WHERE split = 'test') n,
     (SELECT CAST(row_number() OVER (ORDER BY task) - 1 AS INTEGER) AS train_step, task AS trained_task
      FROM (SELECT DISTINCT task FROM notes_split)) s
GROUP BY ALL""", ("notes_split",))
def q_eval_grid(spark, sf):
    n, s = split_inputs(spark, sf)
    steps = n.select("task").distinct().select(
        (F.row_number().over(Window.orderBy("task")) - 1).cast("int").alias("train_step"),
        F.col("task").alias("trained_task"))
    test = s.where(F.col("split") == "test").select("note_id", "task")
    return E.eval_grid_counts(test, steps).withColumnRenamed("task", "eval_task")

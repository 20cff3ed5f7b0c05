"""Registered queries for multi-label evaluation on the `preds` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.functions.numeric import sigmoid, threshold
from curata.operators import metrics as M
from curata.plans.oracle_views import VIEWS
from curata.plans.registry import register
from curata.sources import tables as T


def r6(c):
    return F.round(c, 6)


VIEWS["cells"] = (("preds",), """
    SELECT task, note_id, label_id, y_true, y_prob, logit,
           CASE WHEN y_prob >= 0.5 THEN 1 ELSE 0 END AS y_pred FROM preds""")
VIEWS["scorable_cells"] = (("cells",), """
    SELECT task, label_id FROM cells GROUP BY ALL HAVING sum(y_true) > 0 AND sum(y_true) < count(*)""")
VIEWS["roc_label"] = (("cells",), """
    SELECT task, label_id,
           sum(CAST(pos AS DOUBLE) * (cneg + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auroc,
           CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives
    FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY task, label_id ORDER BY y_prob
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cneg
          FROM (SELECT task, label_id, y_prob, sum(y_true) AS pos, sum(1 - y_true) AS neg
                FROM cells GROUP BY ALL))
    GROUP BY ALL HAVING sum(pos) > 0 AND sum(neg) > 0""")
VIEWS["roc_micro"] = (("cells",), """
    SELECT task, sum(CAST(pos AS DOUBLE) * (cneg + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auroc_micro
    FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY task ORDER BY y_prob
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cneg
          FROM (SELECT task, y_prob, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM cells GROUP BY ALL))
    GROUP BY ALL HAVING sum(pos) > 0 AND sum(neg) > 0""")
VIEWS["loss_task"] = (("cells",), """
    SELECT task, avg(bm) AS loss_batch_mean, sum(s) / sum(k) AS loss_row_mean
    FROM (SELECT c.task, nb.batch_id, avg(l) AS bm, sum(l) AS s, count(*) AS k
          FROM (SELECT task, note_id,
                       greatest(logit, 0.0) - logit * y_true + ln(1 + exp(-abs(logit))) AS l FROM cells) c
          JOIN (SELECT task, note_id, (row_number() OVER (PARTITION BY task ORDER BY note_id) - 1) // 8 AS batch_id
                FROM (SELECT DISTINCT task, note_id FROM cells)) nb
            ON c.task = nb.task AND c.note_id = nb.note_id
          GROUP BY ALL)
    GROUP BY task""")


def _truth(spark, sf):
    """Positive (note, label) pairs from the note label lists, mapped to the fixed ids."""
    ids = F.create_map(*[x for i, lab in enumerate(T.PRED_LABELS) for x in (F.lit(lab), F.lit(i))])
    n = T.notes_docs(spark, sf)
    return n.select("task", "note_id", F.explode("labels").alias("label")).select(
        "task", "note_id", F.element_at(ids, F.col("label")).alias("label_id"))


@register("align_predictions", """
SELECT CASE WHEN note_id % 5 < 4 THEN task || '-' || CAST(note_id % 5 AS VARCHAR) END AS task, note_id // 5 AS note_id, label_id, y_prob, y_true
FROM preds""", ("preds",))
def q_align_predictions(spark, sf):
    """Notes of tasks that share ids."""
    scores = T.preds(spark, sf).select("task", "note_id", "label_id", "y_prob")
    return M.align_predictions(T.keyed(scores), T.keyed(_truth(spark, sf)))


@register("sigmoid", "SELECT note_id, label_id, round(1.0 / (1.0 + exp(-logit)), 6) AS p FROM preds", ("preds",))
def q_sigmoid(spark, sf):
    return T.preds(spark, sf).select("note_id", "label_id", r6(sigmoid("logit")).alias("p"))


@register("threshold", "SELECT note_id, label_id, CAST(CASE WHEN y_prob >= 0.5 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS y_pred "
          "FROM preds", ("preds",))
def q_threshold(spark, sf):
    return T.preds(spark, sf).select("note_id", "label_id", threshold("y_prob").alias("y_pred"))


@register("bce_loss", "SELECT task, round(loss_batch_mean, 6) AS loss_batch_mean, "
          "round(loss_row_mean, 6) AS loss_row_mean FROM loss_task", ("loss_task",))
def q_bce_loss(spark, sf):
    out = M.bce_loss(T.preds(spark, sf))
    return out.select("task", r6("loss_batch_mean").alias("loss_batch_mean"),
                      r6("loss_row_mean").alias("loss_row_mean"))


@register("f1_scores", """
SELECT task,
       round(avg(f1) FILTER (WHERE pos > 0 AND pos < n), 6) AS f1_macro,
       round(sum(f1 * pos) FILTER (WHERE pos > 0 AND pos < n) / sum(pos) FILTER (WHERE pos > 0 AND pos < n), 6)
           AS f1_weighted,
       round(CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) = 0 THEN 0.0
                  ELSE 2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) END, 6) AS f1_micro
FROM (SELECT *, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1
      FROM (SELECT task, label_id, sum(y_true * y_pred) AS tp, sum((1 - y_true) * y_pred) AS fp,
                   sum(y_true * (1 - y_pred)) AS fn, sum(y_true) AS pos, count(*) AS n
            FROM cells GROUP BY ALL))
GROUP BY task""", ("cells",))
def q_f1_scores(spark, sf):
    out = M.f1_scores(T.preds(spark, sf))
    return out.select("task", *[r6(c).alias(c) for c in ("f1_macro", "f1_weighted", "f1_micro")])


@register("exact_match", """
SELECT task, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS exact_match
FROM (SELECT c.task, c.note_id, bool_and(c.y_pred = c.y_true) AS ok
      FROM cells c JOIN scorable_cells s ON c.task = s.task AND c.label_id = s.label_id GROUP BY ALL)
GROUP BY task""", ("scorable_cells",))
def q_exact_match(spark, sf):
    return M.exact_match(T.preds(spark, sf)).select("task", r6("exact_match").alias("exact_match"))


@register("label_accuracy", """
SELECT task, round(avg(acc), 6) AS acc_macro, round(sum(acc * pos) / sum(pos), 6) AS acc_weighted,
       round(sum(r) / sum(n), 6) AS acc_micro
FROM (SELECT task, label_id, avg(CASE WHEN y_pred = y_true THEN 1.0 ELSE 0.0 END) AS acc,
             sum(y_true) AS pos, sum(CASE WHEN y_pred = y_true THEN 1.0 ELSE 0.0 END) AS r, count(*) AS n
      FROM cells GROUP BY ALL)
GROUP BY task""", ("cells",))
def q_label_accuracy(spark, sf):
    out = M.label_accuracy(T.preds(spark, sf))
    return out.select("task", *[r6(c).alias(c) for c in ("acc_macro", "acc_weighted", "acc_micro")])


@register("auroc_per_label", "SELECT task, label_id, round(auroc, 6) AS auroc, positives, negatives FROM roc_label",
          ("roc_label",))
def q_auroc_per_label(spark, sf):
    out = M.auroc_per_label(T.preds(spark, sf))
    return out.select("task", "label_id", r6("auroc").alias("auroc"), "positives", "negatives")


@register("auroc_macro_weighted", """
SELECT task, round(avg(auroc), 6) AS auroc_macro, round(sum(auroc * positives) / sum(positives), 6) AS auroc_weighted
FROM roc_label GROUP BY task""", ("roc_label",))
def q_auroc_macro_weighted(spark, sf):
    out = M.auroc_macro_weighted(T.preds(spark, sf))
    return out.select("task", r6("auroc_macro").alias("auroc_macro"), r6("auroc_weighted").alias("auroc_weighted"))


@register("auroc_micro", "SELECT task, round(auroc_micro, 6) AS auroc_micro FROM roc_micro", ("roc_micro",))
def q_auroc_micro(spark, sf):
    return M.auroc_micro(T.preds(spark, sf)).select("task", r6("auroc_micro").alias("auroc_micro"))


_MICRO_SQL = """(SELECT a.task, sum(CASE WHEN a.y_prob > b.y_prob THEN 1.0 WHEN a.y_prob = b.y_prob THEN 0.5 ELSE 0.0 END) / count(*) AS area
           FROM (SELECT c.* FROM cells c JOIN roc_label k ON c.task = k.task AND c.label_id = k.label_id WHERE y_true = 1 {only}) a
           JOIN (SELECT c.* FROM cells c JOIN roc_label k ON c.task = k.task AND c.label_id = k.label_id WHERE y_true = 0 {only}) b ON a.task = b.task
           GROUP BY a.task)"""


@register("label_report", f"""
SELECT s.task, s.label_id, round(r.auroc, 6) AS auroc, s.support, s.support > 0 AND s.support < s.n AS kept,
       round(m.auroc_macro, 6) AS auroc_macro, round(m.auroc_weighted, 6) AS auroc_weighted, round(mi.area, 6) AS auroc_micro,
       round(l.loss_batch_mean, 6) AS loss, s.label_id = 1 AND r.auroc IS NOT NULL AS chosen,
       CASE WHEN s.label_id = 1 AND r.auroc IS NOT NULL THEN CAST(r.place AS INTEGER) END AS position,
       round(m.chosen_macro, 6) AS chosen_macro, round(ch.area, 6) AS chosen_micro
FROM (SELECT task, label_id, CAST(sum(y_true) AS BIGINT) AS support, count(*) AS n FROM cells GROUP BY ALL) s
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY task ORDER BY label_id) - 1 AS place FROM roc_label) r ON s.task = r.task AND s.label_id = r.label_id
LEFT JOIN (SELECT task, avg(auroc) AS auroc_macro, sum(auroc * positives) / sum(positives) AS auroc_weighted, avg(auroc) FILTER (WHERE label_id = 1) AS chosen_macro
           FROM roc_label GROUP BY task) m ON s.task = m.task
LEFT JOIN {_MICRO_SQL.format(only="")} mi ON s.task = mi.task
LEFT JOIN {_MICRO_SQL.format(only="AND k.label_id IN (1, 5)")} ch ON s.task = ch.task
LEFT JOIN loss_task l ON s.task = l.task""", ("roc_label", "loss_task"))
def q_label_report(spark, sf):
    """A17 with the chosen labels 1 and 5 (5 doesn't occur)."""
    out = M.label_report(T.preds(spark, sf), selected=[1, 5])
    return out.select("task", "label_id", "support", "kept", "chosen", "position",
                      *[r6(c).alias(c) for c in ("auroc", "auroc_macro", "auroc_weighted", "auroc_micro", "loss", "chosen_macro", "chosen_micro")])

"""Multi-label evaluation over long prediction tables.

Input cells: (group..., note_id, label_id, y_true 0/1, score).  No dense n x L
matrix is built; every metric is a grouped aggregate, and the ROC areas are
computed from per-score counts with bucketed prefix sums, so neither a hot
label nor a hot task is ranked in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curata.functions.numeric import bce_with_logits, threshold
from curata.operators.ranking import join_null_safe, two_level_prefix_sum, with_order_bucket
from curata.operators.splits import batch_assign

G = ("task",)


def align_predictions(scores: DataFrame, truth: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Pair each score with its truth; a (note, label) absent from `truth` is 0.

    A note is its task and its id where both frames have a task (null equals null)."""
    keys = keys or [c for c in ("task", "note_id", "label_id") if c in scores.columns and c in truth.columns]
    t = truth.select(*keys).distinct().withColumn("y_true", F.lit(1))
    return (join_null_safe(scores, t, list(keys), "left")
            .withColumn("y_true", F.coalesce("y_true", F.lit(0)).cast("int")))


def scorable(cells: DataFrame, group: Sequence[str] = G, y: str = "y_true") -> DataFrame:
    """Labels of a group with both classes present (A6 in dense form)."""
    g = list(group)
    return (cells.groupBy(*g, "label_id")
            .agg(F.sum(y).alias("positives"), F.count(F.lit(1)).alias("n"))
            .where((F.col("positives") > 0) & (F.col("positives") < F.col("n")))
            .select(*g, "label_id"))


def bce_loss(cells: DataFrame, group: Sequence[str] = G, logit: str = "logit", y: str = "y_true",
             batch_size: int = 8) -> DataFrame:
    """A10: mean BCE; `loss_batch_mean` = unweighted mean of per-batch means (reference
    epoch value), `loss_row_mean` = plain mean over all cells.  Batches are 8 notes in
    note_id order inside each group."""
    g = list(group)
    notes = cells.select(*g, "note_id").distinct()
    nb = batch_assign(notes, g, "note_id", batch_size)
    per_batch = (join_null_safe(cells, nb, [*g, "note_id"])
                 .withColumn("__l", bce_with_logits(logit, y))
                 .groupBy(*g, "batch_id")
                 .agg(F.avg("__l").alias("bm"), F.sum("__l").alias("s"), F.count(F.lit(1)).alias("k")))
    return per_batch.groupBy(*g).agg(F.avg("bm").alias("loss_batch_mean"),
                                     (F.sum("s") / F.sum("k")).alias("loss_row_mean"))


def _with_pred(cells: DataFrame, score: str) -> DataFrame:
    return cells.withColumn("y_pred", threshold(score).cast("int"))


def f1_scores(cells: DataFrame, group: Sequence[str] = G, score: str = "y_prob") -> DataFrame:
    """Macro and weighted F1 over scorable labels, micro F1 over all labels; 0 when undefined."""
    g = list(group)
    c = _with_pred(cells, score)
    per = (c.groupBy(*g, "label_id")
           .agg(F.sum(F.col("y_true") * F.col("y_pred")).alias("tp"),
                F.sum((1 - F.col("y_true")) * F.col("y_pred")).alias("fp"),
                F.sum(F.col("y_true") * (1 - F.col("y_pred"))).alias("fn"),
                F.sum("y_true").alias("pos"), F.count(F.lit(1)).alias("n")))
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    per = per.withColumn("f1", F.when(den == 0, 0.0).otherwise(2.0 * F.col("tp") / den))
    keep = (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    micro_den = 2 * tp + fp + fn
    return per.groupBy(*g).agg(
        F.avg(F.when(keep, F.col("f1"))).alias("f1_macro"),
        (F.sum(F.when(keep, F.col("f1") * F.col("pos"))) / F.sum(F.when(keep, F.col("pos")))).alias("f1_weighted"),
        F.when(micro_den == 0, 0.0).otherwise(2.0 * tp / micro_den).alias("f1_micro"))


def exact_match(cells: DataFrame, group: Sequence[str] = G, score: str = "y_prob") -> DataFrame:
    """Share of notes whose predicted set equals the true set over the scorable labels."""
    g = list(group)
    c = join_null_safe(_with_pred(cells, score), scorable(cells, g), [*g, "label_id"])
    per_note = c.groupBy(*g, "note_id").agg(F.bool_and(F.col("y_pred") == F.col("y_true")).alias("ok"))
    return per_note.groupBy(*g).agg(F.avg(F.col("ok").cast("double")).alias("exact_match"))


def label_accuracy(cells: DataFrame, group: Sequence[str] = G, score: str = "y_prob") -> DataFrame:
    """Label-wise accuracy averaged macro, weighted by positives, and micro."""
    g = list(group)
    c = _with_pred(cells, score).withColumn("__ok", (F.col("y_pred") == F.col("y_true")).cast("double"))
    per = c.groupBy(*g, "label_id").agg(F.avg("__ok").alias("acc"), F.sum("y_true").alias("pos"),
                                        F.sum("__ok").alias("right"), F.count(F.lit(1)).alias("n"))
    return per.groupBy(*g).agg(F.avg("acc").alias("acc_macro"),
                               (F.sum(F.col("acc") * F.col("pos")) / F.sum("pos")).alias("acc_weighted"),
                               (F.sum("right") / F.sum("n")).alias("acc_micro"))


def score_histogram(cells: DataFrame, keys: Sequence[str], score: str = "y_prob") -> DataFrame:
    """Positives and negatives per distinct score: (keys, score, pos, neg).  A partial
    aggregate, so a hot (key, score) pair leaves each map task as one row.  Cells without
    a score or a truth take no part."""
    return (cells.where(F.col(score).isNotNull() & F.col("y_true").isNotNull()).groupBy(*keys, score)
            .agg(F.sum("y_true").cast("long").alias("pos"),
                 F.sum(1 - F.col("y_true")).cast("long").alias("neg")))


def area_from_histogram(hist: DataFrame, keys: Sequence[str], score: str = "y_prob") -> DataFrame:
    """Exact ROC area per `keys` from a score histogram, ties counted one half.

    negatives strictly below each score = bucketed prefix sum (see ranking);
    area = sum(pos * (neg_below + neg_here / 2)) / (P * N).
    """
    return _areas(hist, list(keys), score).where(F.col("auroc").isNotNull())


def _areas(hist: DataFrame, keys: list[str], score: str) -> DataFrame:
    """(keys, auroc, positives, negatives); a null auroc where a class is missing."""
    cum = two_level_prefix_sum(with_order_bucket(hist, keys, score), keys, F.col("__order_bucket"), [F.col(score)], "neg", "neg_below")
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return cum.groupBy(*keys).agg(F.when(pairs > 0, F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)) / F.nullif(pairs, F.lit(0.0))).alias("auroc"),
                                  F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def _roc_area(cells: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    return area_from_histogram(score_histogram(cells, keys, score), keys, score)


def auroc_per_label(cells: DataFrame, group: Sequence[str] = G, score: str = "y_prob") -> DataFrame:
    """ROC area of every label with both classes; single-class labels are left out."""
    return _roc_area(cells, [*group, "label_id"], score)


def auroc_macro_weighted(cells: DataFrame, group: Sequence[str] = G, score: str = "y_prob") -> DataFrame:
    """Mean of A14 over scorable labels, and the mean weighted by positives."""
    per = auroc_per_label(cells, group, score)
    return per.groupBy(*group).agg(
        F.avg("auroc").alias("auroc_macro"),
        (F.sum(F.col("auroc") * F.col("positives")) / F.sum("positives")).alias("auroc_weighted"))


def auroc_micro(cells: DataFrame, group: Sequence[str] = G, score: str = "y_prob") -> DataFrame:
    """One ROC over all cells of a group (all labels pooled)."""
    return _roc_area(cells, list(group), score).select(*group, F.col("auroc").alias("auroc_micro"))


def report_areas(cells: DataFrame, group: Sequence[str] = G, score: str = "y_prob", selected: Sequence[int] | None = None) -> DataFrame:
    """The areas of a report from one read of the cells: (group, area, label_id, auroc, positives, negatives).

    ``area``: `label` (one row per label; null auroc where a class is missing), `all` (micro, over the labels with both classes) and, with
    ``selected``, `chosen` (micro over the selected ones of them).  The score histogram of the labels is taken once; its rows are
    given to every area that they belong to, summed, and one prefix sum serves all areas.
    """
    g = list(group)
    hist = score_histogram(cells, [*g, "label_id"], score)
    totals = hist.groupBy(*g, "label_id").agg(((F.sum("pos") > 0) & (F.sum("neg") > 0)).alias("__kept"))
    flagged = join_null_safe(hist, totals, [*g, "label_id"])
    one = lambda area, label: F.struct(F.lit(area).alias("area"), label.alias("label_id"))
    nobody = F.lit(None).cast(cells.schema["label_id"].dataType)
    into = [one("label", F.col("label_id")), F.when(F.col("__kept"), one("all", nobody))]
    if selected is not None:
        into.append(F.when(F.col("__kept") & F.col("label_id").isin(list(selected)), one("chosen", nobody)))
    each = flagged.select(*g, score, "pos", "neg", F.explode(F.array_compact(F.array(*into))).alias("x")).select(*g, "x.area", "x.label_id", score, "pos", "neg")
    keys = [*g, "area", "label_id"]
    pooled = each.groupBy(*keys, score).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return _areas(pooled, keys, score)


def label_report(cells: DataFrame, group: Sequence[str] = G, score: str = "y_prob",
                 logit: str = "logit", selected: Sequence[int] | None = None) -> DataFrame:
    """Per label AUROC, support and kept flag, with the group's macro, weighted and micro AUROC over the
    labels with both classes, and its loss; with ``selected`` also macro and micro over the selected ones of them, whether a
    label is one, and its position among the kept labels (A6).

    The cells are read twice: once for the histogram behind all areas and supports, once for the loss (it needs the logits).
    What is the same for all labels of a group is taken by windows over its labels.
    """
    g = list(group)
    areas = report_areas(cells, g, score, selected)
    of_group = Window.partitionBy(*g)
    is_label, kept = F.col("area") == "label", F.col("auroc").isNotNull()
    mean = lambda x, on: F.avg(F.when(is_label & on, x)).over(of_group)
    weights = F.sum(F.when(is_label & kept, F.col("positives"))).over(of_group)
    chosen = F.col("label_id").isin(list(selected)) if selected is not None else F.lit(False)
    rows = (areas.withColumn("auroc_macro", mean(F.col("auroc"), kept))
            .withColumn("auroc_weighted", F.sum(F.when(is_label & kept, F.col("auroc") * F.col("positives"))).over(of_group) / weights)
            .withColumn("auroc_micro", F.max(F.when(F.col("area") == "all", F.col("auroc"))).over(of_group)))
    extra = []
    if selected is not None:
        place = F.row_number().over(Window.partitionBy(*g, is_label & kept).orderBy("label_id")) - 1
        rows = rows.withColumns({"chosen": chosen & kept, "position": F.when(kept & chosen, place).cast("int"), "chosen_macro": mean(F.col("auroc"), kept & chosen),
                                 "chosen_micro": F.max(F.when(F.col("area") == "chosen", F.col("auroc"))).over(of_group)})
        extra = ["chosen", "position", "chosen_macro", "chosen_micro"]
    rows = rows.where(is_label)
    loss = bce_loss(cells, g, logit).select(*g, F.col("loss_batch_mean").alias("loss"))
    out = join_null_safe(rows, loss, g, "left")
    return out.select(*g, "label_id", "auroc", F.col("positives").alias("support"), F.col("auroc").isNotNull().alias("kept"),
                      "auroc_macro", "auroc_weighted", "auroc_micro", "loss", *extra)

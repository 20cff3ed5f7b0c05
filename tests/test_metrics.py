"""Metrics against brute force on hand-made cells: ties, single-class labels, threshold edge."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curata.operators import metrics as M


def cells_df(spark, rows):
    return spark.createDataFrame(rows, "task string, note_id long, label_id int, y_true int, y_prob double, "
                                       "logit double")


def pairwise_auc(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def make_rows(seed, n_notes=60, n_labels=4, grid=20):
    rnd = random.Random(seed)
    rows = []
    for n in range(n_notes):
        for lab in range(n_labels):
            p = rnd.randint(0, grid) / grid          # many ties
            y = 1 if rnd.random() < 0.3 + 0.1 * lab else 0
            rows.append(("t", n, lab, y, p, (p - 0.5) * 8))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_auroc_per_label_equals_pairwise(spark, seed):
    rows = make_rows(seed)
    got = {r["label_id"]: r["auroc"] for r in M.auroc_per_label(cells_df(spark, rows)).collect()}
    for lab in range(4):
        y = [r[3] for r in rows if r[2] == lab]
        s = [r[4] for r in rows if r[2] == lab]
        assert got[lab] == pytest.approx(pairwise_auc(y, s), abs=1e-12)


def test_auroc_micro_equals_pairwise(spark):
    rows = make_rows(7)
    got = M.auroc_micro(cells_df(spark, rows)).first()["auroc_micro"]
    assert got == pytest.approx(pairwise_auc([r[3] for r in rows], [r[4] for r in rows]), abs=1e-12)


def test_auroc_ties_and_reversed(spark):
    equal = [("t", i, 0, i % 2, 0.3, 0.0) for i in range(10)]
    rev = [("t", i, 0, 1 if i < 5 else 0, i / 10, 0.0) for i in range(10)]
    assert M.auroc_per_label(cells_df(spark, equal)).first()["auroc"] == pytest.approx(0.5)
    assert M.auroc_per_label(cells_df(spark, rev)).first()["auroc"] == pytest.approx(0.0)


def test_single_class_labels_left_out(spark):
    rows = [("t", i, 0, 0, i / 10, 0.0) for i in range(5)] + [("t", i, 1, 1, i / 10, 0.0) for i in range(5)] \
        + [("t", i, 2, i % 2, i / 10, 0.0) for i in range(5)]
    per = M.auroc_per_label(cells_df(spark, rows)).collect()
    assert [r["label_id"] for r in per] == [2]
    mw = M.auroc_macro_weighted(cells_df(spark, rows)).first()
    assert mw["auroc_macro"] == pytest.approx(per[0]["auroc"])


def test_threshold_inclusive_and_f1(spark):
    rows = [("t", 0, 0, 1, 0.5, 0.0), ("t", 1, 0, 0, 0.49, 0.0), ("t", 2, 0, 1, 0.2, 0.0), ("t", 3, 0, 0, 0.9, 0.0)]
    f = M.f1_scores(cells_df(spark, rows)).first()
    # tp=1 (0.5 counts as positive), fp=1, fn=1 -> f1 = 2/4
    assert f["f1_macro"] == pytest.approx(0.5)
    assert f["f1_micro"] == pytest.approx(0.5)


def test_f1_exact_match_accuracy_brute_force(spark):
    rows = make_rows(11, n_notes=40, n_labels=3, grid=10)
    df = cells_df(spark, rows)
    f = M.f1_scores(df).first()
    em = M.exact_match(df).first()["exact_match"]
    yt = np.zeros((40, 3))
    yp = np.zeros((40, 3))
    for _, n, lab, y, p, _z in rows:
        yt[n, lab] = y
        yp[n, lab] = 1.0 if p >= 0.5 else 0.0
    keep = [j for j in range(3) if 0 < yt[:, j].sum() < 40]
    f1s, sup = [], []
    for j in keep:
        tp = ((yt[:, j] == 1) & (yp[:, j] == 1)).sum()
        fp = ((yt[:, j] == 0) & (yp[:, j] == 1)).sum()
        fn = ((yt[:, j] == 1) & (yp[:, j] == 0)).sum()
        f1s.append(0.0 if 2 * tp + fp + fn == 0 else 2 * tp / (2 * tp + fp + fn))
        sup.append(yt[:, j].sum())
    assert f["f1_macro"] == pytest.approx(np.mean(f1s))
    assert f["f1_weighted"] == pytest.approx(np.average(f1s, weights=sup))
    assert em == pytest.approx(np.mean([(yt[i, keep] == yp[i, keep]).all() for i in range(40)]))


def test_bce_batch_mean(spark):
    rows = [("t", n, 0, n % 2, 0.0, (n - 4.5) / 2) for n in range(10)]     # 10 notes: batches of 8 and 2
    got = M.bce_loss(cells_df(spark, rows)).first()

    def bce(z, y):
        return max(z, 0) - z * y + math.log1p(math.exp(-abs(z)))
    losses = [bce(r[5], r[3]) for r in rows]
    assert got["loss_batch_mean"] == pytest.approx((np.mean(losses[:8]) + np.mean(losses[8:])) / 2)
    assert got["loss_row_mean"] == pytest.approx(np.mean(losses))


def test_same_result_for_1_and_16_partitions(spark):
    rows = make_rows(5)
    a = M.auroc_per_label(cells_df(spark, rows).repartition(1)).orderBy("label_id").collect()
    b = M.auroc_per_label(cells_df(spark, rows).repartition(16)).orderBy("label_id").collect()
    assert [r["auroc"] for r in a] == pytest.approx([r["auroc"] for r in b])


def test_report_with_chosen_labels_equals_pair_counts(spark):
    """Areas by counting pairs of cells, for all kept labels and for the chosen ones; a label without both classes and one that never occurs."""
    rnd = random.Random(12)
    rows = [(t, i, k, int(rnd.random() < (0.0 if k == 2 else 0.3)), rnd.choice([0.1, 0.25, 0.5, 0.5001, 0.9])) for t in (None, "a") for i in range(40) for k in range(6)]
    cells = spark.createDataFrame(rows, "task string, note_id int, label_id int, y_true int, y_prob double").withColumn("logit", F.col("y_prob"))
    selected = [4, 1, 2, 77]

    def area(own):
        pos, neg = [p for *_, y, p in own if y], [p for *_, y, p in own if not y]
        return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None

    found = {(r["task"], r["label_id"]): r for r in M.label_report(cells, selected=selected).collect()}
    assert len(found) == 12
    for t in (None, "a"):
        per = {k: area([r for r in rows if r[0] == t and r[2] == k]) for k in range(6)}
        kept = [k for k in range(6) if per[k] is not None]
        chosen = [k for k in kept if k in selected]
        support = {k: sum(r[3] for r in rows if r[0] == t and r[2] == k) for k in range(6)}
        for k in range(6):
            r = found[t, k]
            assert r["kept"] == (k in kept) and r["support"] == support[k] and r["auroc"] == (pytest.approx(per[k]) if k in kept else None)
            assert r["chosen"] == (k in chosen) and r["position"] == (kept.index(k) if k in chosen else None)
            assert r["auroc_macro"] == pytest.approx(sum(per[x] for x in kept) / len(kept))
            assert r["auroc_weighted"] == pytest.approx(sum(per[x] * support[x] for x in kept) / sum(support[x] for x in kept))
            assert r["auroc_micro"] == pytest.approx(area([x for x in rows if x[0] == t and x[2] in kept]))
            assert r["chosen_macro"] == pytest.approx(sum(per[x] for x in chosen) / len(chosen))
            assert r["chosen_micro"] == pytest.approx(area([x for x in rows if x[0] == t and x[2] in chosen]))
